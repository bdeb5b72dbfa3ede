"""Structured data of pages read by Catalyst alone: script blocks as VARIANT values, no tree and no Python.

For large sets of pages of which only the structured data counts. A block that is no JSON is mended as far as trailing
commas and comments go, and is nothing otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text

# Members in which a block may hold more objects; the names of trade item numbers, best first.
HOLDERS = ("@graph", "mainEntity", "mainEntityOfPage", "itemListElement", "item", "about")
GTINS = ("gtin13", "gtin12", "gtin14", "gtin8", "gtin")
AXES = ("color", "size", "material", "pattern")
#: Containers in containers that are opened at most.
DEPTH = 3
OFFER = "struct<price:string,currency:string,availability:string>"
LD_VARIANT = f"struct<sku:string,gtin:string,image:string,options:array<struct<name:string,value:string>>,offer:{OFFER}>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def script_blocks(html: Column, kind: str) -> Column:
    """Contents of a page's script blocks of that type."""
    return F.regexp_extract_all(html, F.lit(rf"""(?is)<script[^>]*\btype\s*=\s*["']?{kind}["']?[^>]*>(.*?)</script>"""), 1)


def json_or_mended(text: Column) -> Column:
    """A text as VARIANT: as it is, else without comments and trailing commas, else null."""
    mended = F.regexp_replace(F.regexp_replace(text, r"<!--|-->", ""), r",\s*([}\]])", "$1")
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(mended))


def member(v: Column, name: str, kind: str = "variant") -> Column:
    """A member of an object by any name; null where there is none, or it is of another kind."""
    return F.try_variant_get(v, f"$['{name}']", kind)


def listed(v: Column) -> Column:
    """A value's items: of a list its own, of anything else itself alone."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v)), F.array().cast("array<variant>"))


def objects_in(blocks: Column, depth: int = DEPTH) -> Column:
    """All objects of some blocks: what stands in lists and holders too, outer ones first."""
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    level = F.filter(F.flatten(F.transform(blocks, listed)), is_object)
    out = [level]
    for _ in range(depth):
        level = F.filter(F.flatten(F.transform(level, lambda v: F.flatten(F.array(*[listed(member(v, h)) for h in HOLDERS])))), is_object)
        out.append(level)
    return F.concat(*out)


def has_type(v: Column, name: str) -> Column:
    """Whether an object's @type is that, or one of several."""
    types = F.coalesce(member(v, "@type", "array<string>"), F.array(member(v, "@type", "string")))
    return F.coalesce(F.array_contains(types, name), F.lit(False))


def text_of(v: Column, depth: int = 2) -> Column:
    """Text of a value in any of its usual shapes: text or number, the first of a list, the first of an object's name, value and url."""

    def told(x: Column) -> Column:
        v, kind = x["v"], x["kind"]
        number = F.regexp_replace(F.try_variant_get(v, "$", "double").cast("string"), r"\.0$", "")
        out = F.when(kind == "STRING", clean_text(F.try_variant_get(v, "$", "string"))).when(kind == "BIGINT", F.try_variant_get(v, "$", "string")).when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), number)
        if depth:
            # what a list or an object holds is looked at by one expression: the first item, or the first member that there is
            inner = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$[0]", "variant")).when(kind.startswith("OBJECT"), F.coalesce(*[member(v, n) for n in ("name", "@value", "value", "url")]))
            out = F.coalesce(out, F.when(inner.isNotNull(), text_of(inner, depth - 1)))
        return out

    return let(F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind")), told)


def addresses_of(v: Column) -> Column:
    """Picture addresses in an image member: a text, a list, or objects with a url."""
    one = lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.try_variant_get(x, "$.url", "string"), F.try_variant_get(x, "$.contentUrl", "string"))
    return F.filter(F.transform(listed(v), one), lambda u: F.coalesce(u, F.lit("")) != "")


def _offer(v: Column) -> Column:
    told = lambda n: text_of(member(v, n), 0)
    return F.struct(told("price").alias("price"), told("priceCurrency").alias("currency"), told("availability").alias("availability")).cast(OFFER)


def _variant(v: Column, axes: Column) -> Column:
    named = F.transform(axes, lambda a: F.struct(F.initcap(a).alias("name"), F.coalesce(*[F.when(a == x, text_of(member(v, x))) for x in AXES]).alias("value")))
    return F.struct(
        text_of(member(v, "sku")).alias("sku"), F.coalesce(*[text_of(member(v, g)) for g in GTINS]).alias("gtin"), F.get(addresses_of(member(v, "image")), F.lit(0)).alias("image"), F.filter(named, lambda o: o["value"].isNotNull()).alias("options"),
        _offer(F.get(listed(member(v, "offers")), F.lit(0))).alias("offer"),
    ).cast(LD_VARIANT)


def product_of(html: Column) -> Column:
    """A page's product as structured data tells it, as VARIANT: a group of variants if there is one, else a product."""
    every = objects_in(F.transform(script_blocks(html, r"application/ld\+json"), json_or_mended))
    pick = lambda name: lambda vs: F.get(F.filter(vs, lambda v: has_type(v, name)), F.lit(0))
    return let(every, lambda vs: F.coalesce(pick("ProductGroup")(vs), pick("Product")(vs)))


def structured_products(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each page whose structured data tells of a product: its fields, pictures, offers and variants.

    A map over pages: each block is parsed once, nothing is shuffled, and the plan has no Python in it. Descriptions with
    markup are left to html.sanitise. Axes of variants are the four that the vocabulary names.
    """
    p = pages.select(F.col(id_col), product_of(F.col(html_col)).alias("p")).where("p IS NOT NULL")
    told = lambda n: text_of(member(F.col("p"), n))
    varies = F.transform(listed(member(F.col("p"), "variesBy")), lambda x: F.regexp_extract(text_of(x, 0), r"([^/]*)$", 1))
    p = p.withColumn("axes", F.when(F.size(varies) > 0, varies).otherwise(F.array(*map(F.lit, AXES))))
    offers = listed(member(F.col("p"), "offers"))
    out = p.select(
        F.col(id_col), told("name").alias("title"), told("sku").alias("sku"), told("brand").alias("brand"), told("category").alias("product_type"), told("productID").alias("source_product_id"), told("mpn").alias("mpn"), F.coalesce(*[told(g) for g in GTINS]).alias("gtin"), told("description").alias("description"),
        addresses_of(member(F.col("p"), "image")).alias("images"), F.filter(offers, lambda o: has_type(o, "AggregateOffer")).alias("groups"), offers.alias("offers"), F.transform(listed(member(F.col("p"), "hasVariant")), lambda v: _variant(v, F.col("axes"))).alias("variants"),
    )
    group = F.get("groups", F.lit(0))
    inner = F.when(F.size("groups") > 0, listed(member(group, "offers"))).otherwise(F.col("offers"))
    low = lambda n: text_of(member(group, n), 0)
    return out.withColumn("price_min", low("lowPrice")).withColumn("price_max", low("highPrice")).withColumn("offers", F.transform(inner, _offer)).drop("groups")


def inline_product_json(html: Column) -> Column:
    """The product JSON that a page holds in a plain JSON script, as text for payloads.shop_read; null without one."""
    blocks = F.transform(script_blocks(html, "application/json"), F.try_parse_json)
    whole = F.transform(blocks, lambda v: F.coalesce(member(v, "product"), v))
    good = lambda v: F.coalesce(F.schema_of_variant(member(v, "variants")).startswith("ARRAY") & (member(v, "title").isNotNull() | member(v, "handle").isNotNull()), F.lit(False))
    return F.to_json(F.get(F.filter(whole, good), F.lit(0)))
