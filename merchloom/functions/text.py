"""Text functions: cleaning, slugs, states told in words, CSV cells, error messages."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\x{00A0}]+"
# References that this decoder knows, in the order in which they are replaced.
NAMED = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'"), ("&nbsp;", " "))
# Error patterns in the order in which they are tried (over code and message), and the code each stands for.
ERRORS = (
    (r"ENOTFOUND", "DNS_FAILED"),
    (r"ECONNREFUSED", "CONN_REFUSED"),
    (r"ECONNRESET", "CONN_RESET"),
    (r"ETIMEDOUT|UND_ERR_CONNECT_TIMEOUT", "TIMEOUT"),
    (r"UND_ERR_HEADERS_TIMEOUT", "TIMEOUT"),
    (r"CERT_HAS_EXPIRED", "TLS_ERROR"),
    (r"(?i)abort", "TIMEOUT"),
    (r"(?i)HTTP 404", "NOT_FOUND"),
    (r"(?i)HTTP 40[13]", "BLOCKED"),
    (r"(?i)HTTP 429", "RATE_LIMITED"),
    (r"(?i)HTTP 5\d\d", "SERVER_ERROR"),
    (r"(?i)no product", "NO_PRODUCT"),
    (r"(?i)render", "RENDER_FAILED"),
)
#: What an operator is told of each code.
ADVICE = {
    "DNS_FAILED": "Check the address: no such host.", "CONN_REFUSED": "The host is up but takes no connections.", "CONN_RESET": "The connection broke; try again.", "TIMEOUT": "No answer in time; try again later.", "TLS_ERROR": "The host's certificate is not valid.", "NOT_FOUND": "There is no such page.",
    "BLOCKED": "The host keeps this page from us.", "RATE_LIMITED": "Too many requests; slow down.", "SERVER_ERROR": "The host has a fault of its own; try again later.", "NO_PRODUCT": "This page shows no product.", "RENDER_FAILED": "The page did not finish loading in a browser.", "UNKNOWN": "Something else went wrong; see the log.",
}
RETRYABLE = ("TIMEOUT", "CONN_RESET", "CONN_REFUSED", "RATE_LIMITED", "SERVER_ERROR", "RENDER_FAILED", "UNKNOWN")


def clean_text(raw: Column) -> Column:
    """White space to one space, trimmed; null for nothing."""
    return F.nullif(F.trim(F.regexp_replace(raw, SPACE, " ")), F.lit(""))


def decode_named(raw: Column) -> Column:
    """The named references and the apostrophes, one after another, so doubly encoded text is decoded twice."""
    for a, b in NAMED:
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return raw


def decode_numeric(raw: Column) -> Column:
    """Decimal and hexadecimal references of code points that exist; the others stay as they are."""
    pieces = F.regexp_extract_all(raw, F.lit(r"(?s)(&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|[^&]+|&)"), 1)

    def one(p: Column) -> Column:
        code = F.when(p.rlike(r"^&#[0-9]{1,7};$"), F.regexp_extract(p, r"(\d+)", 1).try_cast("int")).when(p.rlike(r"^&#[xX][0-9a-fA-F]{1,6};$"), F.conv(F.regexp_extract(p, r"(?i)x([0-9a-f]+)", 1), 16, 10).try_cast("int"))
        real = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(p)

    return F.when(raw.contains("&#"), F.array_join(F.transform(pieces, one), "")).otherwise(raw)


def escape_text(raw: Column, attribute: bool = False) -> Column:
    """For markup: & < > and, inside an attribute, the double quote."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if attribute else ())):
        raw = F.replace(raw, F.lit(sign), F.lit(name))
    return raw


def capitalise(raw: Column) -> Column:
    return F.concat(F.upper(F.substring(raw, 1, 1)), F.substring(raw, 2, 1_000_000))


def id_of_node(raw: Column) -> Column:
    """An identifier of structured data: no web address, no leading #, not blank."""
    return F.when(~raw.rlike(r"^(?i:https?)://"), F.nullif(F.trim(F.regexp_replace(raw, "^#", "")), F.lit("")))


def short_json(value: Column, most: int = 8000) -> Column:
    return F.substring(F.to_json(value), 1, most)


def title_words(raw: Column) -> Column:
    """Separators to spaces, each word with a capital, the rest as it is."""
    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(raw, r"[-_\s]+", " ")), " "), capitalise), " ")


def shortened(raw: Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis where something is cut."""
    return F.when(F.length(raw) > most, F.concat(F.substring(raw, 1, most - 1), F.lit("…"))).otherwise(raw)


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """A number with its noun."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def slugify_ascii(raw: Column) -> Column:
    """For text without marks to strip: lower case, no quotes, dashes for the rest, at most 255 characters."""
    s = F.regexp_replace(F.lower(raw), "['\"]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 255)


@F.pandas_udf(T.StringType())
def slugify(raw: pd.Series) -> pd.Series:
    """Any text: compatibility forms, no combining marks, then as slugify_ascii."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not 0x300 <= ord(c) <= 0x36F).lower()
        return re.sub(r"[^a-z0-9]+", "-", re.sub("['\"]", "", s)).strip("-")[:255]

    return raw.map(one)


def option_signature(options: Column) -> Column:
    """Sorted name=value pairs, lower case, trimmed, joined by a bar; options without a value do not count."""
    pairs = F.transform(options, lambda o: F.concat(F.lower(F.trim(o["name"])), F.lit("="), F.lower(F.trim(o["value"]))))
    return F.coalesce(F.array_join(F.sort_array(F.array_compact(pairs)), "|"), F.lit(""))


def describe_options(options: Column) -> Column:
    text = F.array_join(F.transform(options, lambda o: o["value"]), " / ")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("default"))


def friendly_field(key: Column) -> Column:
    """A provenance key in words: without its variant, a space before each capital, dots as spaces, in lower case."""
    bare = F.regexp_replace(key, r"^variants\[[^\]]+\]\.", "")
    return F.trim(F.lower(F.replace(F.regexp_replace(bare, "([A-Z])", " $1"), F.lit("."), F.lit(" "))))


def variant_of_key(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"^variants\[([^\]]+)\]", 1), F.lit(""))


def clean_attribute_name(raw: Column) -> Column:
    """A theme's attribute key as a label: prefixes off, separators to spaces, words with a capital, the rest as it is."""
    s = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^(?i:attribute_)?(?i:pa_)?", ""), r"[-_]+", " "))
    return F.array_join(F.transform(F.split(s, r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def malformed_html(html: Column) -> Column:
    """What is wrong with a description's markup, or null."""
    opens = F.regexp_count(html, F.lit(r"(?i)<([a-z][a-z0-9]*)\b[^>]*(?<!/)>"))
    closes = F.regexp_count(html, F.lit(r"(?i)</([a-z][a-z0-9]*)\s*>"))
    voids = F.regexp_count(html, F.lit(r"(?i)<(br|hr|img|input|meta|link|source|col)\b[^>]*>"))
    bare = F.regexp_replace(html, r"(?i)&(amp|lt|gt|quot|apos|nbsp|#\d+|#x[0-9a-f]+);", "")
    return (
        F.when(opens - voids - closes > 4, "The description leaves HTML tags open.")
        .when(html.rlike(r"(?i)<\s*script|onerror\s*=|onload\s*="), "The description still holds script.")
        .when(bare.rlike(r"(?i)&[a-z]+(?![a-z;])"), "The description holds broken character references.")
    )


def _told(raw: Column, words: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    s = F.lower(F.coalesce(raw, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for state, marks in words:
        for mark in marks:
            out = out.when(s.rlike(mark) if mark.startswith("\\") else s.contains(mark), state)
    return out.otherwise("unknown")


def stock_from_text(raw: Column) -> Column:
    return _told(raw, (("on_backorder", ("backorder",)), ("preorder", ("preorder",)), ("out_of_stock", ("out of stock", "outofstock", "sold out", "unavailable")), ("in_stock", ("in stock", "instock", "available"))))


def stock_from_page(raw: Column) -> Column:
    return _told(raw, (("on_backorder", ("backorder",)), ("preorder", ("pre-order", "preorder")), ("out_of_stock", ("out of stock", "sold out", "unavailable")), ("in_stock", ("in stock", r"\d+\s*(in stock|available)"))))


def stock_from_schema(raw: Column) -> Column:
    return _told(
        raw,
        (("on_backorder", ("backorder",)), ("preorder", ("preorder", "presale")), ("out_of_stock", ("outofstock", "out_of_stock", "soldout", "discontinued")), ("in_stock", ("instock", "in_stock", "limitedavailability", "onlineonly"))),
    )


def stock_from_form(html: Column, in_stock: Column) -> Column:
    told = _told(html, (("on_backorder", ("backorder",)), ("out_of_stock", ("out of stock", "sold out")), ("in_stock", ("in stock",))))
    return F.when(told != "unknown", told).when(in_stock, "in_stock").when(~in_stock, "out_of_stock").otherwise("unknown")


def condition_from_schema(raw: Column) -> Column:
    return _told(raw, (("new", ("newcondition",)), ("refurbished", ("refurbish",)), ("used", ("used", "damaged"))))


def error_code(raw: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for pattern, code in ERRORS:
        out = out.when(raw.rlike(pattern), code)
    return out.otherwise("UNKNOWN")


def error_advice(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair]), code), F.lit(ADVICE["UNKNOWN"]))


def is_retryable(code: Column) -> Column:
    return code.isNull() | code.isin(*RETRYABLE)


def csv_cell(value: Column, neutralise: bool = True) -> Column:
    """One CSV cell: empty for null; formulas get an apostrophe; quotes around separators, quotes, line ends, outer space."""
    whole = s = F.coalesce(value.cast("string"), F.lit(""))
    # most cells are empty or have none of these signs: one search tells that
    plain = (whole == "") | ~whole.rlike("[\",\r\n=+@-]|^\\s|\\s$")
    if neutralise:
        s = F.when(s.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(plain, whole).when(s.rlike("[\",\r\n]|^\\s|\\s$"), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def content_hash(normalized_url: Column, html: Column) -> Column:
    """First 16 hex digits over the address and the page's length (code points)."""
    return F.substring(F.sha2(F.concat(normalized_url, F.length(html).cast("string")), 256), 1, 16)


def stable_id(prefix: str, *keys: Column) -> Column:
    """An id that depends on its keys alone."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws(":", *keys), 256), 1, 16))


# Units of ages in milliseconds, the mean month and year, and what one unit back and ahead is called.
AGES = (("second", 1000, None, None), ("minute", 60_000, None, None), ("hour", 3_600_000, None, None), ("day", 86_400_000, "yesterday", "tomorrow"), ("week", 604_800_000, "last week", "next week"), ("month", 2_629_800_000, "last month", "next month"), ("year", 31_557_600_000, "last year", "next year"))


def relative_time(then: Column, now: Column) -> Column:
    """An age, or a time still to come, in words of the largest unit that fits, rounded half up."""
    ms = F.unix_millis(now) - F.unix_millis(then)
    out = F.when(F.abs(ms) < 45_000, F.lit("just now"))
    for name, size, back, ahead in reversed(AGES):
        n = F.floor(ms / size + 0.5).cast("long")
        words = F.concat(F.abs(n).cast("string"), F.lit(f" {name}"), F.when(F.abs(n) == 1, "").otherwise("s"))
        text = F.when(n >= 0, F.concat(words, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), words))
        if back and ahead:
            text = F.when(n == 1, back).when(n == -1, ahead).otherwise(text)
        out = out.when(F.abs(ms) >= size, text)
    return out


def iso_time(at: Column) -> Column:
    """UTC with milliseconds; the session's time zone is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def file_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss")


def date_and_time(at: Column) -> Column:
    return F.date_format(at, "d MMM yyyy, HH:mm")


def milliseconds_between(a: Column, b: Column) -> Column:
    return F.unix_millis(b) - F.unix_millis(a)


def file_size(n: Column, largest: str = "GB") -> Column:
    """Bytes in words: B, KB, MB or GB, one place from KB on; in no unit above the largest (KB at least)."""
    unit = lambda power, name: F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(f" {name}"))
    names = ("KB", "MB", "GB")
    last = names.index(largest)
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, name in enumerate(names[:last]):
        out = out.when(n < 1024 ** (i + 2), unit(i + 1, name))
    return out.otherwise(unit(last + 1, largest))


def duration_words(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(ms < 60_000, F.concat(F.format_number(ms / 1000, 1), F.lit(" s"))).otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit(" min "), F.floor(ms % 60_000 / 1000).cast("string"), F.lit(" s")))
