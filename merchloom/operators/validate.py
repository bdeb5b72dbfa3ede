"""Validation: rules as Column expressions over the product document, each giving an array of findings.

All rules on one product are evaluated in one pass without a shuffle: a document becomes a row for itself and one for
each variant, so that conditions on variants are compiled expressions over a row and not functions over an array; what
several of them need is made once (_facts). Rules across products are one aggregation and one anti-join over the few
columns that they need.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import describe_options, friendly_field, malformed_html, option_signature, slugify_ascii, variant_of_key
from ..functions.units import dimension_unit, weight_unit
from ..functions.url import duplicate_key
from ..schema import severity_rank
from ..storage import has_shared_folder, shared_folder

FINDING = "struct<code:string,rule_id:string,severity:string,variant_id:string,field:string,observed:string,message:string>"


class Each(NamedTuple):
    """A finding for each variant that meets the condition: functions of its facts (see _facts) and its index."""

    condition: Callable[[Column, Column], Column]
    finding: Callable[[Column, Column], Column]


class Rule(NamedTuple):
    """findings(target) gives Columns of array<FINDING> over the document, and Each over its variants."""

    id: str
    label: str
    findings: Callable[[str], list[Column | Each]]


def _null() -> Column:
    return F.lit(None).cast("string")


def _finding(code: str, rule: str, severity: str | Column, message: Column | str, field: str | Column | None = None, observed: Column | None = None, variant: Column | None = None) -> Column:
    text = lambda x: _null() if x is None else (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct(F.lit(code).alias("code"), F.lit(rule).alias("rule_id"), text(severity).alias("severity"), text(variant).alias("variant_id"), text(field).alias("field"), text(observed).alias("observed"), text(message).alias("message")).cast(FINDING)


def _if(condition: Column, finding: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(finding)).otherwise(F.array().cast(f"array<{FINDING}>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _says(*parts: Column | str) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _name(v: Column) -> Column:
    return describe_options(v["options"])


V = F.col
MANY = 3  # option axes that one target has at most
#: Findings of one rule are numbered from a multiple of this, by variant; those across products come last.
SLOT = 1_000_000
LAST = 1000 * SLOT
NUMBERED = f"array<struct<n:int,f:{FINDING}>>"


def _required(target: str) -> list[Column]:
    r, v = "required-fields", V("variants")
    no_price = V("price").isNull() & V("price_min").isNull() & F.forall(v, lambda x: x["price"].isNull())
    out = [
        _if(_blank(V("title")), _finding("VAL-01", r, "CRITICAL", "The product has no title.", "title")),
        _if(no_price, _finding("VAL-02", r, "ERROR", "Neither the product nor a variant has a price.", "price")),
        _if(F.size("images") == 0, _finding("VAL-03", r, "WARNING", "The product has no picture.", "images")),
        _if(_blank(V("category_path")), _finding("VAL-04", r, "WARNING", "The product is in no category.", "category_path")),
        _if(_blank(V("description_html")) & _blank(V("description_text")), _finding("VAL-05", r, "INFO", "The product has no description.", "description_html")),
    ]
    if target == "shopify":
        out.append(_if(_blank(V("handle")) & _blank(V("title")), _finding("VAL-06", r, "ERROR", "There is neither a handle nor a title to make one of.", "handle")))
    return out


def _type(target: str) -> list[Column]:
    r, n = "product-type", F.size("variants")
    count = F.concat(n.cast("string"), F.lit(" variants"))
    return [
        _if(V("kind") == "unknown", _finding("VAL-07", r, "WARNING", "It is not clear whether the product has variants.", "kind", F.lit("unknown"))),
        _if((V("kind") == "variable") & (n < 2), _finding("VAL-08", r, "ERROR", "A variable product needs two variants at least.", "kind", count)),
        _if((V("kind") == "simple") & (n > 1), _finding("VAL-09", r, "WARNING", "A simple product has several variants.", "kind", count)),
    ]


def axis_names(options: Column, variants: Column) -> Column:
    """Distinct option axes by trimmed lower-case name, first spelling: the product's own, then its variants'."""
    names = F.array_distinct(F.concat(options["name"], F.flatten(variants["options"])["name"]))  # before what is done to each
    keyed = F.filter(F.transform(names, lambda n: F.struct(F.lower(F.trim(n)).alias("k"), n.alias("n"))), lambda x: x.k != "")
    keys = F.array_distinct(F.transform(keyed, lambda x: x.k))
    return F.transform(keys, lambda k: F.get(F.filter(keyed, lambda x: x.k == k), F.lit(0)).n)


def _limits(target: str) -> list[Column]:
    r, out = "destination-limits", []
    if target == "shopify":
        dropped = lambda axes: F.array_join(F.slice(axes, MANY + 1, 1000), " and ")
        out.append(let(axis_names(V("options"), V("variants")), lambda axes: _if(F.size(axes) > MANY, _finding("VAL-10", r, "ERROR", _says("The product has ", F.size(axes), f" option axes; the target takes {MANY}, so ", dropped(axes), " would be lost."), "options", F.array_join(axes, ", ")))))
    odd = lambda w, u: w.isNotNull() & weight_unit(u).isNull()
    strange = lambda what, w, u: _finding("VAL-11", r, "WARNING", _says(what, " weighs ", w, " in no unit that is known."), "weight_unit", u)
    # the first that is odd, the product before its variants; only that variant is named
    first = F.get(F.filter("variants", lambda v: odd(v["weight"], v["weight_unit"])), F.lit(0))
    of_variants = let(first, lambda v: _if(v.isNotNull(), strange(F.concat(F.lit("Variant "), _name(v)), v["weight"], v["weight_unit"])))
    out.append(F.when(odd(V("weight"), V("weight_unit")), F.array(strange("The product", V("weight"), V("weight_unit")))).otherwise(of_variants))
    sized = V("length").isNotNull() | V("width").isNotNull() | V("height").isNotNull()
    out.append(_if(sized & dimension_unit(V("dimension_unit")).isNull(), _finding("VAL-12", r, "WARNING", "The dimensions have no unit that is known.", "dimension_unit", V("dimension_unit"))))
    return out


def _integrity(target: str) -> list[Column]:
    r, vs = "variant-integrity", V("variants")
    same = (F.size(vs) > 2) & (F.size(F.array_distinct(vs["price"])) == 1) & (F.size(F.array_distinct(F.transform(vs["sku"], lambda x: F.coalesce(x, F.lit("null"))))) == 1) & F.get(vs, F.lit(0))["sku"].isNotNull()
    say = lambda v, text: _says("Variant ", v["told"], text)
    missing = lambda v: F.filter(v["wanted"], lambda a: ~F.array_contains(v["axes"], a))
    return [
        Each(lambda v, i: ~v["parent_id"].eqNullSafe(V("id")), lambda v, i: _finding("VAL-13", r, "CRITICAL", say(v, " belongs to another product."), "parent_id", v["parent_id"], v["id"])),
        Each(lambda v, i: v["several"] & (v["signature"] == ""), lambda v, i: _finding("VAL-14", r, "ERROR", "A variant among several has no option values.", "options", None, v["id"])),
        Each(lambda v, i: v["several"] & (v["signature"] != "") & (v["signature_at"] < i + 1), lambda v, i: _finding("VAL-15", r, "ERROR", _says("Two variants are both ", v["told"], "."), "options", v["signature"], v["id"])),
        Each(lambda v, i: ~_blank(v["sku"]) & (v["sku_at"] < i + 1), lambda v, i: _finding("VAL-16", r, "CRITICAL", _says("SKU ", v["sku"], " stands for ", v["sku_first"], " and for ", v["told"], "."), "sku", v["sku"], v["id"])),
        Each(lambda v, i: v["price"].isNull(), lambda v, i: _finding("VAL-17", r, "ERROR", say(v, " has no price."), "price", None, v["id"])),
        Each(lambda v, i: v["price"] < 0, lambda v, i: _finding("VAL-18", r, "ERROR", say(v, " has a price below zero."), "price", v["price"], v["id"])),
        Each(lambda v, i: v["compare_at_price"] <= v["price"], lambda v, i: _finding("VAL-19", r, "WARNING", say(v, " has a former price that is not higher."), "compare_at_price", _says(v["compare_at_price"], " vs ", v["price"]), v["id"])),
        Each(lambda v, i: (v["inventory_quantity"] < 0) | (v["inventory_quantity"] > 1_000_000), lambda v, i: _finding("VAL-20", r, "WARNING", say(v, " has a stock that cannot be."), "inventory_quantity", v["inventory_quantity"], v["id"])),
        Each(lambda v, i: v["stock_status"] == "unknown", lambda v, i: _finding("VAL-21", r, "INFO", say(v, " does not say whether it is in stock."), "stock_status", None, v["id"])),
        Each(lambda v, i: v["several"] & (F.size(missing(v)) > 0), lambda v, i: _finding("VAL-22", r, "ERROR", _says("Variant ", v["told"], " has no value for ", F.array_join(missing(v), ", "), "."), "options", F.array_join(v["axes"], ", "), v["id"])),
        _if(same, _finding("VAL-23", r, "WARNING", "All variants have one price and one SKU.", "variants")),
    ]


def _pictures(target: str) -> list[Column]:
    r, vs = "variant-images", V("variants")
    several = F.size(vs) > 1
    own = lambda body: let(F.filter(vs["image_url"], lambda u: ~_blank(u)), body)
    return [
        Each(lambda v, i: ~_blank(v["image_url"]) & ~v["in_gallery"], lambda v, i: _finding("VAL-24", r, "WARNING", _says("The picture of variant ", v["told"], " is not in the gallery."), "image_url", v["image_url"], v["id"])),
        own(lambda o: _if(several & (F.size(o) > 0) & (F.size(o) < F.size(vs)), _finding("VAL-25", r, "INFO", "Only some variants have a picture of their own.", "image_url", _says(F.size(o), "/", F.size(vs))))),
        own(lambda o: _if(several & (F.size(o) > 2) & (F.size(F.array_distinct(o)) == 1), _finding("VAL-26", r, "WARNING", "All variants share one picture.", "image_url", F.get(o, F.lit(0))))),
        _if((F.size("images") > 1) & (F.try_element_at("provenance", F.lit("featuredImageUrl"))["confidence"] == "low"), _finding("VAL-27", r, "INFO", "The main picture is a guess: the first of the gallery.", "featured_image_url", V("featured_image_url"))),
    ]


def _prices(target: str) -> list[Column]:
    r = "price-consistency"
    currencies = F.filter(F.array_distinct(F.concat(F.array("currency"), V("variants")["currency"])), lambda c: ~_blank(c))
    least, most = F.array_min(V("variants")["price"]), F.array_max(V("variants")["price"])
    cent = F.lit("0.01").cast("decimal(18,6)")
    outside = (V("price") < least - cent) | (V("price") > most + cent)
    disputed = F.filter(F.map_entries("provenance"), lambda e: e["value"]["conflict"].isNotNull())
    conflicts = F.transform(
        disputed,
        lambda e: _finding(
            "VAL-31", r, F.when(e["key"].rlike("(?i)price|sku|inventory"), "WARNING").otherwise("INFO"), _says("Two sources disagree about ", friendly_field(e["key"]), "; the value from ", e["value"]["source"], " stays."), e["key"],
            _says(e["value"]["conflict"]["other_value"], " (", e["value"]["conflict"]["other_source"], ")"), variant_of_key(e["key"]),
        ),
    )
    return [
        _if(F.size(currencies) > 1, _finding("VAL-28", r, "ERROR", _says("The product mixes currencies: ", F.array_join(currencies, ", "), "."), "currency", F.array_join(currencies, ", "))),
        _if(F.size(currencies) == 0, _finding("VAL-29", r, "INFO", "No currency is given.", "currency")),
        _if(outside, _finding("VAL-30", r, "WARNING", _says("The price lies outside those of the variants, ", least, " to ", most, "."), "price", V("price"))),
        F.coalesce(conflicts, F.array().cast(f"array<{FINDING}>")),
    ]


def _sku(target: str) -> list[Column]:
    r = "sku"
    none = (V("kind") != "variable") & _blank(V("sku")) & F.forall("variants", lambda v: _blank(v["sku"]))
    return [
        _if(none, _finding("VAL-32", r, "INFO", "The product has no SKU.", "sku")),
        Each(lambda v, i: v["sku"].rlike("^\\s|\\s$|[\\t\\n]"), lambda v, i: _finding("VAL-33", r, "WARNING", _says("The SKU of ", v["told"], " has white space around it."), "sku", v["sku"], v["id"])),
    ]


def _html(target: str) -> list[Column]:
    r, d = "description-html", V("description_html")
    return [
        _if(malformed_html(d).isNotNull(), _finding("VAL-34", r, "WARNING", malformed_html(d), "description_html")),
        _if(F.length(d) > 60_000, _finding("VAL-35", r, "INFO", "The description is very long.", "description_html", _says(F.length(d), " characters"))),
    ]


def _urls(target: str) -> list[Column]:
    r = "urls"
    bare = F.transform("images", lambda i: F.regexp_replace(i["url"], r"\?.*$", ""))
    again = F.filter(F.transform(bare, lambda u, i: F.when(F.array_position(bare, u) < i + 1, u)), lambda u: u.isNotNull())
    bad = F.transform(F.filter("images", lambda i: ~F.coalesce(i["url"].rlike(r"^(?i:https?)://[^/\s?#]+([/?#]\S*)?$"), F.lit(False))), lambda i: _finding("VAL-36", r, "ERROR", _says("Picture ", i["position"], " has no valid address."), _says("images[", i["position"], "].url"), i["url"]))
    return [bad, _if(F.size(again) > 0, _finding("VAL-37", r, "INFO", "The gallery shows a picture twice.", "images", F.get(again, F.lit(0))))]


def _google(target: str) -> list[Column]:
    wanted = (("GTIN", "gtin"), ("MPN", "mpn"), ("brand", "brand"), ("Google product category", "google_product_category"))
    missing = F.array_compact(F.array(*[F.when(_blank(V(f"google.{f}")), F.lit(n)) for n, f in wanted]))
    return [_if(F.size(missing) > 0, _finding("VAL-38", "google-shopping", "INFO", _says("Not given by the page, and left empty: ", F.array_join(missing, ", "), "."), "google", F.array_join(missing, ", ")))]


def _seo(target: str) -> list[Column]:
    r, n = "seo", F.length("seo.meta_description")
    return [
        _if(_blank(V("seo.title")) & _blank(V("title")), _finding("VAL-39", r, "INFO", "There is no title for search engines.", "seo.title")),
        _if(n > 320, _finding("VAL-40", r, "INFO", "The meta description is longer than is shown.", "seo.meta_description", _says(n, " characters"))),
        _if(F.lower("seo.robots").contains("noindex"), _finding("VAL-41", r, "INFO", "The page asks not to be indexed.", "seo.robots", V("seo.robots"))),
    ]


def _quality(target: str) -> list[Column]:
    r = "extraction-quality"
    weak = F.filter(F.map_entries("provenance"), lambda e: ((e["value"]["confidence"] == "low") | (e["value"]["source"] == "heuristic")) & e["key"].isin("price", "sku", "title", "stockStatus"))
    names = F.array_join(F.transform(weak, lambda e: e["key"]), ", ")
    notes = F.transform(F.coalesce("extraction_notes", F.array().cast("array<string>")), lambda n: _finding("VAL-44", r, "INFO", n))
    return [
        _if(F.size(weak) > 0, _finding("VAL-42", r, "WARNING", _says("Inferred rather than read: ", names, "."), names)),
        _if(V("source_platform") == "unknown", _finding("VAL-43", r, "INFO", "The shop's platform is not known.", "source_platform")),
        notes,
    ]


#: Rules on one product, in order; add a Rule to extend them.
RULES = [
    Rule("required-fields", "Required fields", _required),
    Rule("product-type", "Product type", _type),
    Rule("destination-limits", "Destination limits", _limits),
    Rule("variant-integrity", "Variant integrity", _integrity),
    Rule("variant-images", "Variant images", _pictures),
    Rule("price-consistency", "Price consistency", _prices),
    Rule("sku", "SKU", _sku),
    Rule("description-html", "Description HTML", _html),
    Rule("urls", "URLs", _urls),
    Rule("google-shopping", "Google Shopping", _google),
    Rule("seo", "SEO", _seo),
    Rule("extraction-quality", "Extraction quality", _quality),
]


def _numbered(target: str, rules: list[Rule]) -> list[tuple[int, Column | Each]]:
    """What the rules find, each with the number that its findings begin at."""
    return [(i * SLOT, x) for i, x in enumerate(x for rule in rules for x in rule.findings(target))]


def _own(found: list[tuple[int, Column | Each]]) -> Column:
    """Numbered findings of the document itself."""
    none = F.array().cast(NUMBERED)
    numbered = lambda x, n: F.transform(x, lambda f, j: F.struct((j + n).alias("n"), f.alias("f")))
    some = [F.coalesce(numbered(x, n), none) for n, x in found if isinstance(x, Column)]
    return F.concat(*some) if some else none


def _of_variants(found: list[tuple[int, Column | Each]]) -> Column:
    """Numbered findings of one variant, by its facts v at place at (the document's own row is at 0)."""
    v, i = F.col("v"), F.col("at") - 1
    some = [F.when(F.coalesce(x.condition(v, i), F.lit(False)), F.array(F.struct((i + n).alias("n"), x.finding(v, i).alias("f")))).otherwise(F.array().cast(NUMBERED)) for n, x in found if isinstance(x, Each)]
    return F.concat(*some) if some else F.array().cast(NUMBERED)


FACT_FIELDS = ("id", "parent_id", "sku", "price", "compare_at_price", "inventory_quantity", "stock_status", "image_url")


def _facts() -> Column:
    """Each variant's fields that rules ask for, and what is made of several: once for a variant, whatever rules need it.

    told: its options in words; signature and SKU with the place (from 1) of the first variant that has them; its
    product's axes and, where there are any, its own; whether its picture is in the gallery.
    """
    vs, several = F.col("variants"), F.size("variants") > 1
    known = F.struct(F.transform(vs["options"], option_signature).alias("signatures"), F.transform(vs["options"], describe_options).alias("told"), F.transform(vs["sku"], F.lower).alias("skus"), F.transform(F.col("options")["name"], F.lower).alias("axes"), F.col("images")["url"].alias("gallery"))

    def one(v: Column, i: Column, k: Column) -> Column:
        at = F.array_position(k["skus"], F.get(k["skus"], i))
        return F.struct(
            *[v[f].alias(f) for f in FACT_FIELDS], several.alias("several"), F.get(k["told"], i).alias("told"), F.get(k["signatures"], i).alias("signature"), F.array_position(k["signatures"], F.get(k["signatures"], i)).alias("signature_at"), at.alias("sku_at"), F.when(at < i + 1, F.get(k["told"], (at - 1).cast("int"))).alias("sku_first"),
            k["axes"].alias("wanted"), F.when(F.size(k["axes"]) > 0, F.transform(v["options"]["name"], F.lower)).alias("axes"), F.array_contains(k["gallery"], v["image_url"]).alias("in_gallery"),
        )

    made = let(known, lambda k: F.transform(vs, lambda v, i: one(v, i, k)))
    return F.coalesce(made, F.array())


def _rows(products: DataFrame, found: list[tuple[int, Column | Each]], *keys: Column) -> DataFrame:
    """A row for each document (at 0) and for each variant (from 1): product_id, ordinal, at, v, found, and keys of the document."""
    docs = products.select("id", "ordinal", *keys, _own(found).alias("own"), _facts().alias("facts"))
    # the document's row is that of no variant; its findings lie in that row alone. There is always a row, and the outer
    # form keeps Spark from testing first whether there is one, for which it would make all arrays twice
    both = F.concat(F.array(F.struct(F.lit(None).cast(docs.schema["facts"].dataType.elementType).alias("v"), F.col("own"))), F.transform("facts", lambda v: F.struct(v.alias("v"), F.lit(None).cast(NUMBERED).alias("own"))))
    each = docs.withColumn("both", both).drop("own", "facts").select("*", F.posexplode_outer("both").alias("at", "x")).select("*", "x.*").drop("both", "x")
    return each.withColumn("found", F.when(F.col("at") == 0, F.col("own")).otherwise(_of_variants(found))).drop("own").withColumnRenamed("id", "product_id")


def product_findings(products: DataFrame, target: str = "shopify", rules: list[Rule] | None = None) -> DataFrame:
    """Findings of the rules on single products: one pass, no shuffle."""
    found = _numbered(target, rules or RULES)
    if any(isinstance(x, Each) for _, x in found):
        return _exploded(_rows(products, found))
    return _exploded(products.select(F.col("id").alias("product_id"), "ordinal", _own(found).alias("found")))  # no row for a variant is needed


def _exploded(rows: DataFrame) -> DataFrame:
    each = rows.select("product_id", "ordinal", F.explode_outer("found").alias("x")).where("x IS NOT NULL")
    return each.select("product_id", "ordinal", "x.n", "x.f.*")


def _sku_key(sku: Column) -> Column:
    return F.nullif(F.lower(F.trim(sku)), F.lit(""))


def _url_key() -> Column:
    return duplicate_key(F.col("source_url"))


def _handle_key() -> Column:
    return F.nullif(F.lower(F.coalesce("handle", slugify_ascii(F.coalesce("title", F.lit(""))))), F.lit(""))


def _use(kind: str, at: Column, variant: Column, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), variant.cast("string").alias("variant_id"), key.alias("key"))


def _uses() -> Column:
    """A product's keys that others may have too: its address and handle, its own SKU and its variants'."""
    own = F.array(*[_use(kind, F.lit(0), _null(), key) for kind, key in (("url", _url_key()), ("handle", _handle_key()), ("sku", _sku_key(F.col("sku"))))])
    uses = F.concat(own, F.coalesce(F.transform("variants", lambda v, i: _use("sku", i + 1, v["id"], _sku_key(v["sku"]))), F.array()))
    return F.filter(uses, lambda u: u["key"].isNotNull())


def duplicate_findings(products: DataFrame, target: str = "shopify") -> DataFrame:
    """All but the first product of one address or handle, and all but the first use of a SKU that two products have.

    A third of all rows may share one key: only the first by order and the number of products are computed for each
    key, by partial aggregation, and joined back; no key's rows are gathered in one task.
    """
    uses = products.select(F.col("id").alias("product_id"), "ordinal", F.explode(_uses()).alias("u"))
    return _duplicates(uses.select("product_id", "ordinal", "u.*"), target)


def _duplicates(rows: DataFrame, target: str) -> DataFrame:
    place = F.struct("ordinal", "product_id", "at")
    first = rows.groupBy("kind", "key").agg(F.min(place).alias("first"), F.min("product_id").alias("a"), F.max("product_id").alias("b"))
    # a key that one row has needs no second look; a SKU must be that of two products
    shared = first.where("a <> b OR kind <> 'sku'").drop("a", "b")
    later = rows.join(shared, ["kind", "key"]).where(place > F.col("first"))
    by_kind = lambda url, handle, sku: F.when(F.col("kind") == "url", url).when(F.col("kind") == "handle", handle).otherwise(sku)
    message = by_kind(F.lit("Another product comes from the same address."), _says("Another product has the handle ", F.col("key"), "."), _says("Another product has the SKU ", F.col("key"), "."))
    return later.select(
        "product_id", "ordinal", F.lit(LAST).alias("n"), by_kind("VAL-45", "VAL-46", F.lit("VAL-47")).alias("code"), F.lit("duplicates").alias("rule_id"), by_kind("ERROR", "ERROR" if target == "shopify" else "WARNING", F.lit("ERROR")).alias("severity"), "variant_id",
        by_kind("source_url", "handle", F.lit("sku")).alias("field"), F.col("key").alias("observed"), message.alias("message"),
    )


def _parents() -> Column:
    """A product's variants with the parent that each of them names."""
    return F.transform("variants", lambda v: F.struct(v["id"].alias("variant_id"), v["parent_id"].alias("parent_id"), _name(v).alias("name")))


def orphan_findings(products: DataFrame) -> DataFrame:
    """Variants whose parent is none of the products: an anti-join."""
    variants = products.select(F.col("id").alias("product_id"), "ordinal", F.explode(_parents()).alias("v")).select("product_id", "ordinal", "v.*")
    return _orphans(variants, products.select(F.col("id").alias("parent_id")))


def _orphans(variants: DataFrame, ids: DataFrame) -> DataFrame:
    # a variant that names its own product needs no search
    lost = variants.where(~F.col("parent_id").eqNullSafe(F.col("product_id"))).join(ids, "parent_id", "left_anti")
    return lost.select("product_id", "ordinal", F.lit(LAST + 1).alias("n"), F.lit("VAL-48").alias("code"), F.lit("orphan-variants").alias("rule_id"), F.lit("CRITICAL").alias("severity"), "variant_id", F.lit("parent_id").alias("field"), F.col("parent_id").alias("observed"), _says("Variant ", F.col("name"), " belongs to a product that does not exist.").alias("message"))


def _fault(products: DataFrame, target: str, rules: list[Rule]) -> str | None:
    """Why rules cannot be built on these products, or None."""
    try:
        _rows(products, _numbered(target, rules))
    except Exception as error:
        return str(error).split("\n")[0][:200]
    return None


def validate(products: DataFrame, target: str = "shopify", rules: list[Rule] | None = None, store: bool | None = None) -> DataFrame:
    """All findings: product_id, ordinal, n, code, rule_id, severity, variant_id, field, observed, message, acknowledged.

    A rule that cannot be built becomes an INFO finding (VAL-49) on every product instead of ending the run. With store, what
    the rules give of each product and variant, and the keys that others may have too, is written to the shared folder first,
    so that making the documents is done once and not by each kind of rule; by default where there is such a folder.
    """
    safe, broken = list(rules or RULES), []
    if _fault(products, target, safe):  # some rule, then: which one is looked for
        faults = [(rule, _fault(products, target, [rule])) for rule in safe]
        safe, broken = [r for r, why in faults if not why], [(r, why) for r, why in faults if why]
    own = lambda key: F.when(F.col("at") == 0, F.col(key))
    rows = _rows(products, _numbered(target, safe), _url_key().alias("url"), _handle_key().alias("handle"), _sku_key(F.col("sku")).alias("own_sku"))
    rows = rows.select("product_id", "ordinal", "at", "found", own("url").alias("url"), own("handle").alias("handle"), F.when(F.col("at") == 0, F.col("own_sku")).otherwise(_sku_key(F.col("v.sku"))).alias("sku"), F.col("v.id").alias("variant_id"), "v.parent_id", F.col("v.told").alias("name"))
    spark = products.sparkSession
    if store if store is not None else has_shared_folder(spark):
        at = shared_folder(spark)
        rows.write.parquet(at)  # the documents are made once; each kind of rule reads its own columns
        rows = spark.read.parquet(at)
    of = lambda kind: _use(kind, F.col("at"), F.col("variant_id"), F.col(kind))
    uses = rows.select("product_id", "ordinal", F.explode(F.when(F.col("at") == 0, F.array(of("url"), of("handle"), of("sku"))).otherwise(F.array(of("sku")))).alias("u")).select("product_id", "ordinal", "u.*").where("key IS NOT NULL")
    ids = rows.where("at = 0").select(F.col("product_id").alias("parent_id"))
    out = _exploded(rows).unionByName(_duplicates(uses, target)).unionByName(_orphans(rows.where("at > 0").select("product_id", "ordinal", "variant_id", "parent_id", "name"), ids))
    for rule, why in broken:
        failed = _finding("VAL-49", rule.id, "INFO", f"The rule could not run: {why}.")
        out = out.unionByName(products.select(F.col("id").alias("product_id"), "ordinal", F.lit(0).alias("n"), failed.alias("f")).select("product_id", "ordinal", "n", "f.*"))
    return out.withColumn("acknowledged", F.lit(False))


def summary(issues: DataFrame) -> DataFrame:
    """One row: issue_count, a count for each severity, blocking_export (errors and criticals)."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return issues.agg(F.count("*").alias("issue_count"), *[count(s).alias(f"n_{s.lower()}") for s in ("INFO", "WARNING", "ERROR", "CRITICAL")], (count("ERROR") + count("CRITICAL")).alias("blocking_export"), F.count_distinct(F.when(F.col("severity") != "INFO", F.col("product_id"))).alias("needs_review"))


def worst(issues: DataFrame, unacknowledged: bool = True) -> DataFrame:
    """Worst severity and number of issues for each product; partial aggregation."""
    open_ = issues.where("product_id IS NOT NULL" + (" AND NOT acknowledged" if unacknowledged else ""))
    return open_.groupBy("product_id").agg(F.max(severity_rank(F.col("severity"))).alias("worst_rank"), F.count("*").alias("n_issues"))


def ordered(issues: DataFrame) -> DataFrame:
    """Critical first, then in the order of products and rules."""
    return issues.orderBy(F.desc(severity_rank(F.col("severity"))), "ordinal", "n")

