"""URL functions, by regular expressions that Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = r"^(utm_.*|gclid|fbclid|msclkid|mc_(cid|eid)|_ga|ref|referrer|srsltid|igshid|ttclid)$"
PARTS = r"^(?i:(https?))://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(#\S*)?$"
# Size marks that shop hosts put into image names.
SHOP_SIZE = r"_(\d{2,4}x\d{0,4}|x\d{2,4}|small|medium|large|grande|compact|pico|icon|thumb|master)(@\dx)?(\.[a-zA-Z]{3,4})$"
BLOG_SIZE = r"-\d{2,4}x\d{2,4}(\.[a-zA-Z]{3,4})$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def is_probably_url(raw: Column) -> Column:
    return F.trim(raw).rlike(r"^(?i:https?)://[^/\s]+\.[^/\s]+") & ~F.trim(raw).rlike(r"\s")


def coerce_url(raw: Column) -> Column:
    """Without wrapping marks, with https:// before a bare host; null for what is no web address."""
    s = F.regexp_replace(F.regexp_replace(F.trim(raw), r"""^[<"'(]+""", ""), r"""[>"')]+$""", "")
    s = F.when(s.rlike(r"^(?i:[a-z]+)://"), s).when(s.rlike(r"^[A-Za-z0-9_.-]+\.[A-Za-z]{2,}(/|$)"), F.concat(F.lit("https://"), s))
    host, path = F.lower(part(s, 2)), part(s, 3)
    whole = F.concat(F.lower(part(s, 1)), F.lit("://"), host, F.when(path == "", "/").otherwise(path), part(s, 4), part(s, 5))
    return F.when(s.rlike(PARTS) & host.contains("."), whole)


def normalize_url(raw: Column) -> Column:
    """Identity of an address: https, lower-case host without www, no fragment, no tracking, sorted query, no final slash."""
    u = F.trim(raw)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(u, 2)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(part(u, 3), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.filter(F.split(F.regexp_replace(part(u, 4), r"^\?", ""), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).rlike(TRACKING))
    query = F.array_join(F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "^[^=]*=?(.*)$", 1).alias("v")))), lambda x: F.concat(x.k, F.lit("="), x.v)), "&")
    whole = F.concat(F.lit("https://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(u.rlike(PARTS), whole).otherwise(F.lower(u))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(F.trim(url), 2)), r":\d+$", "")


def origin_of(url: Column) -> Column:
    return F.when(part(url, 1) == "", "").otherwise(F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2))))


def path_and_query(url: Column) -> Column:
    p = part(F.trim(url), 3)
    return F.concat(F.when(p == "", "/").otherwise(p), part(F.trim(url), 4))


def duplicate_key(url: Column) -> Column:
    """Key of the duplicate rule: cut at ? or #, lower case. Not the identity."""
    return F.lower(F.regexp_replace(url, r"[?#].*$", ""))


def product_handle(url: Column) -> Column:
    """Decoded segment after /products/, else null."""
    return F.try_url_decode(F.replace(F.nullif(F.regexp_extract(part(url, 3), r"(?i)/products/([^/?#]+)", 1), F.lit("")), F.lit("+"), F.lit("%2B")))


def locale_prefix(url: Column) -> Column:
    """What stands in the path before /products/."""
    return F.regexp_extract(part(url, 3), r"^(.*?)/products/", 1)


def slug_of(url: Column) -> Column:
    """Last part of the path that is not empty, decoded."""
    parts = F.filter(F.split(part(url, 3), "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.try_url_decode(F.element_at(parts, -1)))


def absolute_url(candidate: Column, base: Column) -> Column:
    """Candidate against base: absolute, scheme-relative, root-relative, query or path-relative; null for nothing or another scheme."""
    c = F.trim(candidate)
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(F.when(part(base, 3) == "", "/").otherwise(part(base, 3)), "[^/]*$", "")
    joined = F.concat(folder, F.regexp_replace(c, r"^(\./)+", ""))
    for _ in range(4):  # a/../b, as often as such a path goes up
        joined = F.regexp_replace(joined, r"/[^/.][^/]*/\.\./", "/")
    return (
        F.when(c.isNull() | (c == ""), None)
        .when(c.rlike(r"^(?i:https?)://"), c)
        .when(c.startswith("//"), F.concat(F.lit("https:"), c))
        .when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(c.startswith("/"), F.concat(root, c))
        .when(c.startswith("?"), F.concat(root, part(base, 3), c))
        .when(c.startswith("#"), F.concat(root, part(base, 3), part(base, 4), c))
        .otherwise(F.concat(root, joined))
    )


def image_identity(url: Column) -> Column:
    """The same picture in another size or under another query has the same identity."""
    s = F.regexp_replace(url, r"\?.*$", "")
    s = F.regexp_replace(s, f"(?i){SHOP_SIZE}", "$3")
    s = F.regexp_replace(s, BLOG_SIZE, "$1")
    return F.lower(F.regexp_replace(F.regexp_replace(s, r"^https?://", ""), r"^www\.", ""))


def full_size_blog_image(url: Column) -> Column:
    return F.regexp_replace(url, r"(?i)-\d{2,4}x\d{2,4}(\.[a-z]{3,4})(\?.*)?$", "$1$2")


def full_size_shop_image(url: Column) -> Column:
    """Largest rendition, for addresses of the shop's own image host only."""
    base = F.regexp_replace(F.regexp_replace(url, r"\?.*$", ""), r"(?i)" + SHOP_SIZE.replace("|master", ""), "$3")
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(width|height|crop)(=|$)"))
    clean = F.when(F.size(pairs) > 0, F.concat(base, F.lit("?"), F.array_join(pairs, "&"))).otherwise(base)
    return F.when(url.rlike(r"cdn\.shopify\.com|/cdn/shop/"), clean).otherwise(url)
