"""Prices, numbers and currencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency codes that are believed, and signs in the order in which they are tried.
CODES = "USD EUR GBP JPY INR CAD AUD NZD CHF SEK NOK DKK PLN CZK HUF RON BGN TRY RUB BRL MXN ARS CLP COP ZAR NGN KES EGP AED SAR QAR KWD ILS SGD HKD TWD KRW CNY THB MYR IDR PHP VND BDT PKR LKR NPR".split()
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₽": "RUB", "₩": "KRW", "₺": "TRY", "₪": "ILS", "₦": "NGN", "₫": "VND", "₱": "PHP", "R$": "BRL", "A$": "AUD", "C$": "CAD", "৳": "BDT", "฿": "THB", "CHF": "CHF"}
TRUE_WORDS = ("true", "1", "yes", "y", "on", "instock", "in stock")
FALSE_WORDS = ("false", "0", "no", "n", "off", "outofstock", "out of stock")


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d on doubles, as scripts round."""
    k = F.lit(float(10**digits))
    return F.floor(x * k + 0.5).cast("double") / k


def parse_money(raw: Column, cents_if_integer: bool = False) -> Column:
    """A price in a text as a double with six places, null if there is none.

    With both separators the last is the decimal one. A lone comma with three digits after it, in more than four
    characters, separates thousands; otherwise the first comma is decimal. More than one dot separates thousands.
    """
    s = F.regexp_replace(raw.cast("string"), r"[^0-9.,-]", "")
    commas, dots = F.length(F.regexp_replace(s, "[^,]", "")), F.length(F.regexp_replace(s, "[^.]", ""))
    last_comma, last_dot = F.length(s) - F.instr(F.reverse(s), ","), F.length(s) - F.instr(F.reverse(s), ".")
    no = lambda sign: F.replace(s, F.lit(sign), F.lit(""))
    first_comma_to_dot = lambda x: F.regexp_replace(x, r"^([^,]*),", "$1.")
    plain = (
        F.when((commas > 0) & (dots > 0), F.when(last_comma > last_dot, first_comma_to_dot(no("."))).otherwise(no(",")))
        .when(commas > 0, F.when((commas == 1) & (F.length(s) - last_comma - 1 == 3) & (F.length(s) > 4), no(",")).otherwise(first_comma_to_dot(s)))
        .when(dots > 1, no("."))
        .otherwise(s)
    )
    value = round_half_up(F.regexp_extract(plain, r"^(-?(\d+\.?\d*|\.\d+))", 1).try_cast("double"), 6)
    return F.when(raw.cast("string").rlike(r"^\s*-?\d+\s*$"), value / 100).otherwise(value) if cents_if_integer else value


def parse_number(raw: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(raw.cast("string"), r"[\s,\x{00A0}]", ""), r"(-?\d+(\.\d+)?)", 1).try_cast("double")


def parse_bool(raw: Column) -> Column:
    s = F.lower(F.trim(raw.cast("string")))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def currency_from(raw: Column) -> Column:
    """The first word of three capitals if it is a known code, else the first sign found in the list's order."""
    iso = F.regexp_extract(raw, r"\b([A-Z]{3})\b", 1)
    out = F.when(iso.isin(*CODES), iso)
    for sign, code in SIGNS.items():
        out = out.when(raw.contains(sign), code)
    return out


def store_money(raw: Column, minor_unit: Column) -> Column:
    """An amount in minor units (two places unless said), or a written price."""
    n = raw.try_cast("double")
    return F.when(n.isNotNull(), round_half_up(n / F.pow(F.lit(10.0), F.coalesce(minor_unit, F.lit(2))), 6)).otherwise(parse_money(raw))


def shop_money(raw: Column, cents: Column) -> Column:
    """Integer cents, or a decimal string."""
    return F.when(cents, F.floor(parse_number(raw) + 0.5) / 100).otherwise(parse_money(raw))


def fixed2(value: Column) -> Column:
    """Two places, as one target wants prices; empty for null."""
    return F.coalesce(value.cast("decimal(18,2)").cast("string"), F.lit(""))


def shortest(value: Column) -> Column:
    """No final zeros, as the other target wants numbers; empty for null."""
    s = F.regexp_replace(F.regexp_replace(value.cast("decimal(24,6)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.coalesce(s, F.lit(""))


def retry_after_ms(header: Column, base_ms: int, attempt: Column, most_ms: int = 60_000) -> Column:
    """Wait before another request: what the server asks for, at most a minute, else doubling."""
    asked = header.try_cast("double") * 1000
    return F.when(asked.isNotNull(), F.least(asked, F.lit(float(most_ms)))).otherwise(base_ms * F.pow(F.lit(2.0), attempt)).cast("long")
