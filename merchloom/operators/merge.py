"""Reconciliation: ranked offers folded into one value each with provenance, and variant sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import option_signature
from ..schema import UNKNOWN_FIELDS, confidence_of, rank_of

STATE = "struct<value:string,source:string,rank:int,note:string,other_source:string,other_value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_empty_offer(value: Column) -> Column:
    """Null and blank text are no offers; 0, false and 'unknown' are."""
    return value.isNull() | (F.trim(value) == "")


def same_value(a: Column, b: Column) -> Column:
    """Equal text after trimming, or numbers closer than 1e-9."""
    # only what begins as a number is cast: a cast that fails costs many times a comparison
    number = r"^[\x00-\x20]*[-+]?\.?[0-9]"
    close = a.rlike(number) & b.rlike(number) & (F.abs(a.try_cast("double") - b.try_cast("double")) < 1e-9)
    return (F.trim(a) == F.trim(b)) | F.coalesce(close, F.lit(False))


def fold_offers(offers: Column, field: Column, start: Column | None = None) -> Column:
    """Ordered fold of one field's offers array<struct<seq,value,source,note>>: value, source, note, conflict.

    start: the state (STATE) that a field has before; else it is empty, or unknown for fields that begin so.

    An empty current value takes the offer. An equal offer raises the provenance if its source is strictly stronger and
    then drops the conflict. A different one replaces the value if strictly stronger, and the old value, if it had
    provenance, is the conflict; else it is the conflict itself, the last one staying.
    """
    empty = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("value", "string"), ("source", "string"), ("rank", "int"), ("note", "string"), ("other_source", "string"), ("other_value", "string"))])
    unknown = F.struct(F.lit("unknown").alias("value"), *[F.lit(None).cast(t).alias(n) for n, t in (("source", "string"), ("rank", "int"), ("note", "string"), ("other_source", "string"), ("other_value", "string"))])
    if start is None:
        start = F.when(field.isin(*UNKNOWN_FIELDS), unknown).otherwise(empty)

    def state(value: Column, source: Column, rank: Column, note: Column, other_source: Column, other_value: Column) -> Column:
        return F.struct(value.alias("value"), source.alias("source"), rank.alias("rank"), note.alias("note"), other_source.alias("other_source"), other_value.alias("other_value"))

    def step(s: Column, o: Column) -> Column:
        none = F.lit(None).cast("string")
        rank = rank_of(o["source"]).cast("int")
        held = F.coalesce(s["rank"], F.lit(0))
        taken = state(o["value"], o["source"], rank, o["note"], none, none)
        raised = state(s["value"], o["source"], rank, o["note"], none, none)
        replaced = state(o["value"], o["source"], rank, o["note"], s["source"], F.when(s["source"].isNotNull(), s["value"]))
        disputed = state(s["value"], s["source"], s["rank"], s["note"], o["source"], o["value"])
        return (
            F.when(is_empty_offer(o["value"]), s)
            .when(is_empty_offer(s["value"]), taken)
            .when(same_value(s["value"], o["value"]), F.when(rank > held, raised).otherwise(s))
            .when(rank > held, replaced)
            .otherwise(disputed)
        )

    return F.aggregate(offers, start.cast(STATE), lambda s, o: step(s, o).cast(STATE))


def merge_offers(offers: DataFrame, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Rows (keys.., field, seq, source, value[, note]) to one row for each key and field, by one shuffle.

    Offers of a product and field are few (a page's layers), so their array is small.
    """
    note = F.col("note") if "note" in offers.columns else F.lit(None).cast("string")
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.col("value").cast("string").alias("value"), "source", note.alias("note"))))
    merged = offers.groupBy(*keys, "field").agg(ordered.alias("offers")).withColumn("m", fold_offers(F.col("offers"), F.col("field")))
    return merged.where("m.source IS NOT NULL").select(*keys, "field", "m.value", "m.source", confidence_of(F.col("m.source")).alias("confidence"), "m.note", "m.other_source", "m.other_value")


def merge_guarded(unguarded: DataFrame, guarded: DataFrame, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Offers of a late layer count only where the earlier layers left a field empty (for prices: empty or 0)."""
    first = merge_offers(unguarded, keys)
    taken = first.where(~F.col("field").isin("price") | (F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)) != 0)).select(*keys, "field")
    return merge_offers(unguarded.unionByName(guarded.join(taken, [*keys, "field"], "left_anti")), keys)


#: Fields of a variant that offers can fill, by their names in provenance.
VARIANT_FIELDS = {
    "sku": "sku", "barcode": "barcode", "price": "price", "compareAtPrice": "compare_at_price", "regularPrice": "regular_price", "salePrice": "sale_price", "costPerItem": "cost_per_item", "currency": "currency", "stockStatus": "stock_status", "available": "available", "inventoryQuantity": "inventory_quantity",
    "inventoryPolicy": "inventory_policy", "weight": "weight", "weightUnit": "weight_unit", "length": "length", "width": "width", "height": "height", "dimensionUnit": "dimension_unit", "requiresShipping": "requires_shipping", "taxable": "taxable", "imageUrl": "image_url", "title": "title",
}


def variant_key(variant_id: Column, field: Column) -> Column:
    """Where provenance keeps a variant's field."""
    return F.concat(F.lit("variants["), variant_id, F.lit("]."), field)


def with_variant_offers(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Product documents with offers for single fields of their variants, merged by rank as a product's own fields are.

    offers: rows (product_id, variant_id, field, seq, source, value[, note]), fields as in VARIANT_FIELDS. They are folded by
    key in the order of seq, from what the variant has and where it is from; a value without provenance yields to any
    offer that differs. Provenance stands under variants[id].field. Offers for variants or fields that a product does not
    have, and empty ones, change nothing. Offers are dealt by product once; both aggregations keep to that, and one join follows.
    """
    note = F.col("note") if "note" in offers.columns else F.lit(None)
    known = offers.where(F.col("field").isin(*VARIANT_FIELDS)).select("product_id", "variant_id", "field", "seq", F.col("value").cast("string").alias("value"), "source", note.cast("string").alias("note"))
    dealt = known.repartition("product_id").groupBy("product_id", "variant_id").agg(F.array_sort(F.collect_list(F.struct("field", "seq", "value", "source", "note"))).alias("all"))
    own = lambda f: F.transform(F.filter("all", lambda o: o["field"] == f), lambda o: F.struct(o["seq"].alias("seq"), o["value"].alias("value"), o["source"].alias("source"), o["note"].alias("note")))
    by_variant = dealt.select("product_id", "variant_id", F.transform(F.array_distinct(F.transform("all", lambda o: o["field"])), lambda f: F.struct(f.alias("field"), own(f).alias("offers"))).alias("fields"))
    told = by_variant.groupBy(F.col("product_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("variant_id", "fields"))).alias("told"))
    rows = products.join(told, "id", "left")
    kinds = {f.name: f.dataType for f in products.schema["variants"].dataType.elementType.fields}

    def folded(v: Column, x: Column) -> Column:
        now = F.lit(None).cast("string")
        for field, name in VARIANT_FIELDS.items():
            now = F.when(x["field"] == field, v[name].cast("string")).otherwise(now)
        key = variant_key(v["id"], x["field"])

        def from_state(had: Column) -> Column:
            start = F.struct(F.nullif(now, F.lit("unknown")).alias("value"), had["source"].alias("source"), rank_of(had["source"]).cast("int").alias("rank"), had["note"].alias("note"), had["conflict"]["other_source"].alias("other_source"), had["conflict"]["other_value"].alias("other_value")).cast(STATE)
            return fold_offers(x["offers"], x["field"], start)

        return F.struct(x["field"].alias("field"), key.alias("key"), let(F.try_element_at("provenance", key), from_state).alias("state"))

    # only variants and fields with offers cost anything
    fold_kind = f"array<struct<field:string,key:string,state:{STATE}>>"
    of_variant = lambda v: F.coalesce(F.filter(F.transform(F.try_element_at("told", v["id"]), lambda x: folded(v, x)), lambda m: m["state"]["source"].isNotNull()), F.array().cast(fold_kind))
    rows = rows.withColumn("merged", F.when(F.col("told").isNotNull(), F.transform("variants", lambda v: F.struct(v.alias("v"), of_variant(v).alias("m")))))
    of_field = {name: field for field, name in VARIANT_FIELDS.items()}

    def filled(x: Column) -> Column:
        def cell(name: str, names: Column) -> Column:
            if name not in of_field:
                return x["v"][name]
            at = F.array_position(names, of_field[name])
            return F.when(at > 0, F.get(x["m"], (at - 1).cast("int"))["state"]["value"].try_cast(kinds[name])).otherwise(x["v"][name])

        return F.when(F.size(x["m"]) > 0, let(x["m"]["field"], lambda names: F.struct(*[cell(n, names).alias(n) for n in kinds]))).otherwise(x["v"])

    conflict = lambda m: F.when(m["other_source"].isNotNull(), F.struct(m["other_source"].alias("other_source"), m["other_value"].alias("other_value")))
    stamp = lambda m: F.struct(m["source"].alias("source"), confidence_of(m["source"]).alias("confidence"), m["note"].alias("note"), conflict(m).alias("conflict"))
    rows = rows.withColumn("stamps", F.flatten(F.transform("merged", lambda x: F.transform(x["m"], lambda m: F.struct(m["key"].alias("key"), stamp(m["state"]).alias("value"))))))
    keys = F.transform("stamps", lambda e: e["key"])
    both = F.map_concat(F.map_filter("provenance", lambda k, _: ~F.array_contains(keys, k)), F.map_from_entries("stamps").cast(products.schema["provenance"].dataType))
    changed = F.coalesce(F.size("stamps") > 0, F.lit(False))
    out = rows.withColumn("variants", F.when(changed, F.transform("merged", filled)).otherwise(F.col("variants"))).withColumn("provenance", F.when(changed, both).otherwise(F.col("provenance")))
    return out.select(products.columns)


def best_values(offers: DataFrame, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Values alone, without provenance: the first offer of the highest rank. Partial aggregation, no arrays."""
    real = offers.where(~is_empty_offer(F.col("value").cast("string")))
    return real.groupBy(*keys, "field").agg(F.max_by("value", F.struct(rank_of(F.col("source")).alias("r"), (-F.col("seq")).alias("s"))).alias("value"))


def union_strings(values: DataFrame, keys: tuple[str, ...], value: str = "value", order: str = "seq") -> DataFrame:
    """Case-insensitive union of strings: first spelling, in order of first sight, blanks dropped."""
    text = F.trim(F.col(value))
    first = values.where(text != "").groupBy(*keys, F.lower(text).alias("k")).agg(F.min(F.struct(F.col(order).alias("o"), text.alias("v"))).alias("f"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list("f")).getField("v").alias("values"))


def replace_variant_sets(sets: DataFrame, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Rows (product_id, seq, source, variants) to the set that holds: a strictly stronger source replaces the whole set.

    Equal rank does not replace. Positions are renumbered in the set's own order.
    """
    best = sets.where(F.size("variants") > 0).groupBy(*keys).agg(F.max_by(F.struct("source", "variants"), F.struct(rank_of(F.col("source")).alias("r"), (-F.col("seq")).alias("s"))).alias("b"))
    return best.select(*keys, F.col("b.source").alias("source"), F.transform("b.variants", lambda v, i: v.withField("position", (i + 1).cast("int"))).alias("variants"))


GAP_FIELDS = ("sku", "barcode", "price", "compare_at_price", "currency", "inventory_quantity", "image_url", "weight", "weight_unit")


def fill_variant_gaps(current: DataFrame, incoming: DataFrame, fields: tuple[str, ...] = GAP_FIELDS) -> DataFrame:
    """Rows of variants (product_id, source_variant_id, options, fields..): gaps filled from matched incoming ones.

    Matched by the platform's id, else by option signature ('' never matches). Only null and '' are gaps; a price or SKU
    that differs is recorded in price_conflict, sku_conflict. Incoming variants without a match are dropped.
    """
    fields = tuple(f for f in fields if f in current.columns and f in incoming.columns)
    cur = current.withColumn("signature", option_signature(F.col("options")))
    inc = incoming.withColumn("signature", option_signature(F.col("options")))
    first = lambda by: inc.groupBy("product_id", by).agg(F.min_by(F.struct(*fields), F.col("position")).alias(f"by_{by}"))
    by_id = first("source_variant_id").where("source_variant_id IS NOT NULL")
    by_sig = first("signature").where("signature <> ''")
    both = cur.join(by_id, ["product_id", "source_variant_id"], "left").join(by_sig, ["product_id", "signature"], "left")
    got = F.coalesce("by_source_variant_id", "by_signature")

    def filled(f: str) -> Column:
        have = F.col(f)
        blank = have.isNull() | (have.cast("string") == "")
        return F.when(blank, got[f]).otherwise(have).alias(f)

    conflicts = [F.when(~is_empty_offer(F.col(f).cast("string")) & ~is_empty_offer(got[f].cast("string")) & ~same_value(F.col(f).cast("string"), got[f].cast("string")), got[f].cast("string")).alias(f"{f}_conflict") for f in ("price", "sku") if f in fields]
    return both.select(*[filled(c) if c in fields else F.col(c) for c in current.columns], *conflicts)


def option_definitions(variants: Column) -> Column:
    """Axes of a variant array in order of first sight, each with its values in order of first sight."""
    all_options = F.filter(F.flatten(F.transform(variants, lambda v: v["options"])), lambda o: F.trim(o["name"]) != "")
    names = F.array_distinct(F.transform(all_options, lambda o: F.trim(o["name"])))
    values = lambda n: F.array_distinct(F.transform(F.filter(all_options, lambda o: (F.trim(o["name"]) == n) & (F.coalesce(o["value"], F.lit("")) != "")), lambda o: o["value"]))
    return F.transform(names, lambda n, i: F.struct(n.alias("name"), values(n).alias("values"), (i + 1).cast("int").alias("position")))


def final_kind(kind: Column, variants: Column, options: Column) -> Column:
    """Grouped and external stay; more than one variant with options is variable; one at most is simple."""
    n = F.size(F.coalesce(variants, F.array()))
    has_options = F.size(F.coalesce(options, F.array())) > 0
    return F.when(kind.isin("grouped", "external"), kind).when((n > 1) & has_options, "variable").when(n <= 1, "simple").otherwise("variable")


def featured_image(explicit: Column, images: Column) -> Column:
    """url, source, confidence: named by the page, flagged, the only one, or the first by position (a guess)."""
    by_place = F.array_sort(F.transform(images, lambda x, i: F.struct(x["position"].alias("p"), i.alias("i"), x["url"].alias("u"))))
    flagged = F.filter(images, lambda x: x["is_featured"])
    pick = lambda url, source, confidence: F.struct(url.alias("url"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    return (
        F.when(explicit.isNotNull(), pick(explicit, "page", "high"))
        .when(F.size(flagged) > 0, pick(F.get(flagged, F.lit(0))["url"], "page", "high"))
        .when(F.size(images) == 1, pick(F.get(images, F.lit(0))["url"], "html", "medium"))
        .when(F.size(images) > 1, pick(F.get(by_place, F.lit(0))["u"], "heuristic", "low"))
    )


def stock_rollup(variants: Column) -> Column:
    """Any variant in stock; all out of stock; else unknown."""
    status = F.transform(variants, lambda v: v["stock_status"])
    return F.when(F.exists(status, lambda s: s == "in_stock"), "in_stock").when((F.size(status) > 0) & F.forall(status, lambda s: s == "out_of_stock"), "out_of_stock").otherwise("unknown")


BACKFILLED = ("price", "compare_at_price", "regular_price", "sale_price", "sku", "barcode", "weight", "weight_unit", "inventory_quantity", "stock_status")


def single_variant_offers(products: DataFrame, seq: int = 1_000_000, fields: tuple[str, ...] = BACKFILLED) -> DataFrame:
    """Offers that a product without options may take from its one variant, at that variant set's source."""
    v = F.get("variants", F.lit(0))
    sole = products.where((F.size("variants") == 1) & (F.size(F.coalesce(v["options"], F.array())) == 0))
    value = lambda f: F.when(v[f] != "unknown", v[f]) if f == "stock_status" else v[f].cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields]))
    return sole.select(F.col("id").alias("product_id"), F.coalesce("variants_source", F.lit("html")).alias("source"), each.alias("x")).select("product_id", "x.field", F.lit(seq).alias("seq"), "source", "x.value").where("value IS NOT NULL")


def prune_images(images: DataFrame) -> DataFrame:
    """Rows (product_id, url, position, ord, source, alt, is_featured): one row for each picture, renumbered.

    Placeholders are left out. Of one picture the strongest source's address stays, the first text, any flag.
    """
    from ..functions.url import image_identity

    bad = F.lower("url").rlike(r"/no[-_]?image|placeholder|/spacer\.|1x1\.(gif|png)|data:image|loading\.(gif|svg)")
    strongest = F.struct(rank_of(F.col("source")).alias("r"), (-F.col("ord")).alias("o"))
    one = images.where(~bad).groupBy("product_id", image_identity(F.col("url")).alias("identity")).agg(
        F.max_by("url", strongest).alias("url"), F.max_by("source", strongest).alias("source"), F.min(F.struct("position", "ord")).alias("place"), F.min_by("alt", F.when(F.col("alt").isNotNull(), F.col("ord"))).alias("alt"), F.bool_or("is_featured").alias("is_featured")
    )
    at = Window.partitionBy("product_id").orderBy("place", "identity")
    return one.withColumn("position", F.row_number().over(at)).drop("place")

