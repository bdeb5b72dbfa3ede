"""Pages and endpoint answers to product documents: one parse of each page, one shuffle by product.

A page's layers, its payloads and its endpoints' answers meet in one row for each product; what follows (ranked merge,
variant sets, pictures, kind, provenance, notes) is column expressions over that row's small arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import currency_from, parse_bool, parse_money, parse_number
from ..functions.text import condition_from_schema, option_signature, stable_id, stock_from_schema, stock_from_text
from ..functions.units import dimension_unit, unit_from_code, unit_from_html
from ..functions.url import image_identity, normalize_url
from ..schema import ATTRIBUTE, GOOGLE, IMAGE, OPTION_DEFINITION, PRODUCT, PROVENANCE, SEO, UNKNOWN_FIELDS, VARIANT, columns_of, confidence_of, field_names, rank_of, struct_of
from ..sources import payloads as pay
from ..storage import shared_folder
from .extract import LAYERS, detect_platform, looks_like_product, needs_render, observed_variants, page_offers
from .merge import GAP_FIELDS, STATE, featured_image, final_kind, fold_offers, is_empty_offer, let, option_definitions

OFFER = "struct<seq:int,field:string,source:string,value:string,note:string,guarded:boolean>"
VARIANT_SET = f"struct<rank:int,seq:int,source:string,variants:array<{VARIANT}>>"
FOUND = "struct<url:string,alt:string,position:int,is_featured:boolean,source:string,ord:int>"
#: Endpoint answers by kind: the raw field that holds them and their place among the offers.
ENDPOINTS = {"shop": ("shopJson", 250), "store": ("storeJson", 400), "variation": ("variationJson", 401), "form": ("formJson", 450), "post": ("postJson", 460)}
SHOP_SEQ, STORE_SEQ, FORM_SEQ, POST_SEQ, LATE_SEQ = 300, 400, 450, 460, 1_000_000
#: Raw fields that are read as a whole and are no offers.
WHOLE = ("shopJson", "storeJson", "variationJson", "formJson", "postJson", "variants", "images", "note", "axes", "formLabels")
#: Fields of which a payload's absence is told.
UNAVAILABLE = ("google.gtin", "google.mpn", "google.googleProductCategory")
#: Offers of a product's one variant without options: field, and the variant's member.
FROM_VARIANT = {"price": "price", "compareAtPrice": "compare_at_price", "regularPrice": "regular_price", "salePrice": "sale_price", "sku": "sku", "barcode": "barcode", "weight": "weight", "weightUnit": "weight_unit", "inventoryQuantity": "inventory_quantity", "stockStatus": "stock_status"}
PLACEHOLDER = r"/no[-_]?image|placeholder|/spacer\.|1x1\.(gif|png)|data:image|loading\.(gif|svg)"


def typed(field: Column, value: Column) -> tuple[Column, Column]:
    """A raw reading's final field and value: prices as numbers, states told in words as states, currencies as codes."""
    known = lambda c: F.nullif(c, F.lit("unknown"))
    out = (
        F.when(field.isin("price", "priceMin", "priceMax", "salePrice", "regularPrice", "compareAtPrice"), parse_money(value).cast("string"))
        .when(field == "stockText", known(stock_from_text(value))).when(field == "stockSchema", known(stock_from_schema(value))).when(field == "google.conditionText", known(condition_from_schema(value))).when(field == "currencyText", currency_from(value))
        .when(field.isin("weightText", "weight", "ratingValue", "reviewCount"), parse_number(value).cast("string")).when(field == "weightUnitCode", unit_from_code(value)).when(field == "allowReviews", parse_bool(value).cast("string")).otherwise(value)
    )
    name = field
    for old, new in {"stockText": "stockStatus", "stockSchema": "stockStatus", "google.conditionText": "google.condition", "currencyText": "currency", "weightText": "weight", "weightUnitCode": "weightUnit"}.items():
        name = F.when(field == old, new).otherwise(name)
    return name, out


def _offer(seq: Column, field: Column, source: Column, value: Column, note: Column, guarded: Column) -> Column:
    return F.struct(seq.cast("int").alias("seq"), field.alias("field"), source.alias("source"), value.cast("string").alias("value"), note.cast("string").alias("note"), guarded.alias("guarded")).cast(OFFER)


def _offers_of_reading() -> Column:
    """The offers in one raw reading: itself in its final form, and what a weight or a size in words tells besides."""
    f, v = F.col("field"), F.col("value")
    name, value = typed(f, v)
    one = lambda n, x: _offer(F.col("seq"), n, F.col("source"), x, F.col("note"), F.col("guarded"))
    sides = F.regexp_extract_all(v, F.lit(r"(\d+(?:\.\d+)?)"), 1)
    unit = dimension_unit(F.regexp_extract(v, r"(?i)(cm|mm|inches|inch|in|ft|yd|m)\s*$", 1))
    sizes = F.array(*[one(F.lit(n), F.get(sides, F.lit(i))) for i, n in enumerate(("length", "width", "height"))], one(F.lit("dimensionUnit"), unit))
    plain = F.when(f == "weightText", F.array(one(name, value), one(F.lit("weightUnit"), unit_from_html(v)))).when(f == "dimensionsText", sizes).otherwise(F.array(one(name, value)))
    return F.when(f.isin(*WHOLE) | f.startswith("page."), F.array().cast(f"array<{OFFER}>")).otherwise(F.filter(plain, lambda o: o["value"].isNotNull()))


def collected(pages: DataFrame, endpoints: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", layers: list | None = None) -> DataFrame:
    """One row for each product: its offers in order, the bodies of its payloads, picture lists, notes, layers, page facts.

    endpoints: rows (product_id, kind, body) with a kind of ENDPOINTS. One scan of the pages, one Python pass, one shuffle.
    """
    raw = page_offers(pages, id_col, url_col, html_col, layers)
    if endpoints is not None:
        kind = F.col("kind")
        field, seq = F.lit(None).cast("string"), F.lit(0)
        for k, (f, s) in ENDPOINTS.items():
            field, seq = F.when(kind == k, f).otherwise(field), F.when(kind == k, s).otherwise(seq)
        told = endpoints.where(kind.isin(*ENDPOINTS)).select(F.col("product_id").cast("string").alias("product_id"), field.alias("field"), seq.cast("int").alias("seq"), F.lit("endpoint").alias("source"), F.col("body").alias("value"), F.lit(None).cast("string").alias("note"), F.lit(False).alias("guarded"))
        raw = raw.unionByName(told)
    first = lambda f: F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.struct("seq", "value")))
    every = lambda f, value: F.array_sort(F.collect_list(F.when(F.col("field") == f, value)))
    seen = F.when(~F.col("field").startswith("page.") & (F.col("field") != "note") & (F.col("source") != "endpoint"), F.floor(F.col("seq") / 100).cast("int"))
    wide = raw.withColumn("offers", _offers_of_reading()).groupBy("product_id").agg(
        F.array_sort(F.flatten(F.collect_list("offers"))).alias("plain"), *[first(f).alias(n) for f, n in (("shopJson", "shop_body"), ("storeJson", "store_body"), ("formJson", "form_body"), ("postJson", "post_body"), ("variants", "ld_body"), ("formLabels", "labels"), ("axes", "axes_body"))],
        every("variationJson", F.col("value")).alias("variation_bodies"), every("images", F.struct("seq", "source", "value")).alias("picture_lists"), every("note", F.concat(F.col("value"), F.lit("."))).alias("layer_notes"), F.sort_array(F.collect_set(seen)).alias("layer_ids"),
        *[first(f"page.{f}").alias(f"page_{f}") for f in ("url", "platform", "product", "hash", "chars")],
    )
    names = F.array(*[F.lit(name) for name, *_ in (layers or LAYERS)])
    return wide.withColumn("layers_used", F.transform(F.filter("layer_ids", lambda i: i < F.size(names)), lambda i: F.get(names, i))).drop("layer_ids")


def _set(source: str, seq: int, variants: Column) -> Column:
    return F.when(F.size(variants) > 0, F.struct(rank_of(F.lit(source)).alias("rank"), F.lit(seq).alias("seq"), F.lit(source).alias("source"), variants.alias("variants")).cast(VARIANT_SET))


def gap_filled(best: Column, others: Column) -> Column:
    """A variant array with its gaps filled from others: matched by the platform's id, else by option signature."""

    def filled(v: Column) -> Column:
        same_id = F.filter(others, lambda x: x["source_variant_id"] == v["source_variant_id"])
        same_options = F.filter(others, lambda x: (option_signature(x["options"]) == option_signature(v["options"])) & (option_signature(v["options"]) != ""))
        match = F.coalesce(F.get(same_id, F.lit(0)), F.get(same_options, F.lit(0)))
        return let(match, lambda m: struct_of(VARIANT, {n: F.coalesce(F.when(v[n].cast("string") != "", v[n]), m[n]) if n in GAP_FIELDS else v[n] for n in field_names(VARIANT)}))

    return F.transform(best, filled)


def pictures(lists: Column, shop: Column, store: Column, form: Column, page_url: Column) -> Column:
    """All pictures told, in the order of their sources."""
    listed = F.flatten(F.transform(lists, lambda x: F.transform(F.from_json(x["value"], "array<string>"), lambda u, i: F.struct(u.alias("url"), F.lit(None).cast("string").alias("alt"), (i + 1).cast("int").alias("position"), F.lit(False).alias("is_featured"), x["source"].alias("source"), (x["seq"] * 1000 + i).cast("int").alias("ord")).cast(FOUND))))
    told = lambda ps, source, seq: F.transform(ps, lambda p, i: F.struct(p["url"].alias("url"), p["alt"].alias("alt"), p["position"].alias("position"), p["is_featured"].alias("is_featured"), F.lit(source).alias("source"), (F.lit(seq * 1000) + i).cast("int").alias("ord")).cast(FOUND))
    return F.concat(F.coalesce(listed, F.array().cast(f"array<{FOUND}>")), told(shop, "shopify-product-json", SHOP_SEQ), told(store, "woo-rest", STORE_SEQ), told(form, "woo-variation-form", FORM_SEQ))


def gallery(found: Column) -> Column:
    """One entry for each picture, placeholders left out: the strongest source's address, the first text, any flag; renumbered."""
    real = F.filter(found, lambda p: (F.coalesce(p["url"], F.lit("")) != "") & ~F.lower(p["url"]).rlike(PLACEHOLDER))
    keyed = F.transform(real, lambda p: F.struct(image_identity(p["url"]).alias("k"), p.alias("p")))

    def one(k: Column, keyed: Column) -> Column:
        return let(F.transform(F.filter(keyed, lambda x: x["k"] == k), lambda x: x["p"]), told)

    def told(mine: Column) -> Column:
        best = F.array_max(F.transform(mine, lambda p: F.struct(rank_of(p["source"]).alias("r"), (-p["ord"]).alias("o"), p["url"].alias("url"), p["source"].alias("source"))))
        place = F.array_min(F.transform(mine, lambda p: F.struct((-rank_of(p["source"])).alias("r"), p["position"].alias("p"), p["ord"].alias("o"))))
        alt = F.get(F.filter(F.transform(mine, lambda p: p["alt"]), lambda a: F.coalesce(a, F.lit("")) != ""), F.lit(0))
        return let(best, lambda b: F.struct(place.alias("place"), b["url"].alias("url"), b["source"].alias("source"), alt.alias("alt"), F.exists(mine, lambda p: p["is_featured"]).alias("flag")))

    each = F.array_sort(let(keyed, lambda ps: F.transform(F.array_distinct(F.transform(ps, lambda x: x["k"])), lambda k: one(k, ps))))
    return F.transform(each, lambda x, i: struct_of(IMAGE, {"url": x["url"], "position": i + 1, "alt": x["alt"], "is_featured": x["flag"], "source": x["source"], "variant_ids": F.array().cast("array<string>")}))


def fold_guarded(mine: Column, field: Column) -> Column:
    """One field's offers, in order, folded; guarded ones count only where the layers before left it empty (a price: empty or 0)."""
    early = fold_offers(F.filter(mine, lambda o: ~o["guarded"] & (o["seq"] < LATE_SEQ)), field)
    taken = early["source"].isNotNull() & ((field != "price") | (F.coalesce(early["value"].try_cast("double"), F.lit(0.0)) != 0))
    guarded = let(taken, lambda t: fold_offers(F.filter(mine, lambda o: ~(o["guarded"] & t)), field))
    # most fields have one offer, or none that is guarded: the same result without the folds that change nothing
    none = F.lit(None).cast("string")
    lone = lambda o: F.struct(o["value"].alias("value"), o["source"].alias("source"), rank_of(o["source"]).cast("int").alias("rank"), o["note"].alias("note"), none.alias("other_source"), none.alias("other_value")).cast(STATE)
    real = (F.size(mine) == 1) & ~field.isin(*UNKNOWN_FIELDS) & ~is_empty_offer(F.get(mine, F.lit(0))["value"])
    return F.when(real, lone(F.get(mine, F.lit(0)))).when(F.exists(mine, lambda o: o["guarded"]), guarded).otherwise(fold_offers(mine, field))


def fields_of(offers: Column) -> Column:
    return F.array_distinct(F.transform(offers, lambda o: o["field"]))


def merged_map(offers: Column) -> Column:
    """Offers of one product, in order, to a map of its fields: value, source, rank, note, other_source, other_value."""
    field = lambda f: F.struct(f.alias("key"), let(F.filter(offers, lambda o: o["field"] == f), lambda mine: fold_guarded(mine, f)).alias("value"))
    return F.map_from_entries(F.filter(F.transform(fields_of(offers), field), lambda e: e["value"]["source"].isNotNull()))


def with_merge(rows: DataFrame) -> DataFrame:
    """Adds to collected rows: the variant sets, the one that holds (gaps filled), and all offers in order."""
    p = rows.select("*", pay.shop_read(F.col("shop_body")).alias("shop"), pay.store_read(F.col("store_body")).alias("store"), pay.form_read(F.col("form_body")).alias("form"), F.from_json("labels", "map<string,string>").alias("label_of"))
    p = p.withColumn("cents", pay.shop_cents(F.col("shop")))
    if "observed" not in rows.columns:
        p = p.withColumn("observed", pay.none_of(VARIANT))
    ident = F.col("product_id")
    told = F.array_compact(F.array(
        _set("jsonld", 200, pay.ld_variants_of(F.col("ld_body"), ident)), _set("shopify-product-json", SHOP_SEQ, pay.shop_variants(F.col("shop"), F.col("cents"), ident)),
        _set("woo-rest", STORE_SEQ, pay.store_variants(F.col("store"), F.col("variation_bodies"), ident)), _set("woo-variation-form", FORM_SEQ, pay.form_variants_of(F.col("form"), ident, F.col("label_of"))),
    ))
    strongest = lambda sets: F.array_sort(sets, lambda a, b: F.when(a["rank"] != b["rank"], b["rank"] - a["rank"]).otherwise(a["seq"] - b["seq"]))
    p = p.withColumn("sets", strongest(told))
    # what a browser saw counts only where no source tells of several variants that all have a price
    best = F.get("sets", F.lit(0))["variants"]
    p = p.withColumn("observed", F.when((F.size(best) > 1) & F.forall(best, lambda v: v["price"].isNotNull()), pay.none_of(VARIANT)).otherwise(F.coalesce("observed", pay.none_of(VARIANT))))
    p = p.withColumn("sets", strongest(F.array_compact(F.concat("sets", F.array(_set("html", LATE_SEQ - 1, F.col("observed"))))))).withColumn("variants_source", F.get("sets", F.lit(0))["source"])
    rest = F.coalesce(F.flatten(F.transform(F.slice("sets", 2, 10), lambda s: s["variants"])), pay.none_of(VARIANT))
    p = p.withColumn("variants", F.coalesce(gap_filled(F.get("sets", F.lit(0))["variants"], rest), pay.none_of(VARIANT)))
    none = F.lit(None).cast("string")
    told = lambda ps, seq, source, guard=F.lit(False): F.transform(ps, lambda x: _offer(F.lit(seq), x["field"], F.lit(source), x["value"], none, guard))
    late = F.array(*[_offer(F.lit(LATE_SEQ), F.lit(f), F.col("variants_source"), F.nullif(F.get("variants", F.lit(0))[m].cast("string"), F.lit("unknown")), F.lit("single variant"), F.lit(False)) for f, m in FROM_VARIANT.items()])
    lone = (F.size("variants") == 1) & (F.size(F.get("variants", F.lit(0))["options"]) == 0)
    offers = F.concat(
        "plain", told(F.coalesce(F.when(F.col("shop").isNotNull(), pay.shop_offers(F.col("shop"), F.col("cents"))), pay.none_of(pay.OFFER_PAIR)), SHOP_SEQ, "shopify-product-json"), told(F.coalesce(F.when(F.col("store").isNotNull(), pay.store_offers(F.col("store"))), pay.none_of(pay.OFFER_PAIR)), STORE_SEQ, "woo-rest"),
        told(F.coalesce(F.when(F.col("post_body").isNotNull(), pay.post_offers(F.col("post_body"))), pay.none_of(pay.OFFER_PAIR)), POST_SEQ, "platform-api", F.lit(True)), F.when(lone, F.filter(late, lambda o: o["value"].isNotNull())).otherwise(F.array().cast(f"array<{OFFER}>")),
    )
    return p.withColumn("offers", F.array_sort(offers))


def merged_fields(rows: DataFrame) -> DataFrame:
    """Merged fields as rows: product_id, field, value, source, confidence, note, other_source, other_value."""
    each = rows.select("product_id", "offers", F.explode(fields_of(F.col("offers"))).alias("field"))
    out = each.select("product_id", "field", fold_guarded(F.filter("offers", lambda o: o["field"] == F.col("field")), F.col("field")).alias("m")).where("m.source IS NOT NULL")
    return out.select("product_id", "field", "m.value", "m.source", confidence_of(F.col("m.source")).alias("confidence"), "m.note", "m.other_source", "m.other_value")


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() or (c.isdigit() and i) else c for i, c in enumerate(name))


def union_in_order(texts: Column) -> Column:
    """Case-insensitive union of a text array: first spelling, blanks dropped."""
    trimmed = F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != "")
    keys = F.transform(trimmed, lambda t: F.lower(t))
    return F.filter(trimmed, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1)


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, behind a generator that no filter is pushed through.

    A filter on a document's field would else be written out in all the expressions that the field is made of, each of them
    standing in the next one several times: planning would take longer than the work.
    """
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def assembled(rows: DataFrame) -> DataFrame:
    """Merged rows to product documents (schema.PRODUCT) and the outcome: ok, error_code, with product_id."""
    value = lambda f: F.try_element_at("merged", F.lit(f))["value"]
    split = lambda f: F.coalesce(union_in_order(F.flatten(F.transform(F.filter("offers", lambda o: o["field"] == f), lambda o: F.split(o["value"], ",")))), F.array().cast("array<string>"))
    p = settled(rows.withColumn("merged", merged_map(F.col("offers")))).withColumn("images", gallery(pictures(F.col("picture_lists"), F.coalesce(F.when(F.col("shop").isNotNull(), pay.shop_pictures(F.col("shop"))), pay.none_of(pay.PICTURE)), F.coalesce(F.when(F.col("store").isNotNull(), pay.store_pictures(F.col("store"))), pay.none_of(pay.PICTURE)), pay.form_pictures(F.col("form")), F.col("page_url"))))
    # a variant's picture takes the gallery's address for it, and the gallery tells which variants show it
    same = lambda url: F.get(F.filter("images", lambda i: image_identity(i["url"]) == image_identity(url)), F.lit(0))["url"]
    p = p.withColumn("variants", F.transform("variants", lambda v, i: v.withField("image_url", F.coalesce(same(v["image_url"]), v["image_url"])).withField("position", (i + 1).cast("int"))))
    p = p.withColumn("images", F.transform("images", lambda i: i.withField("variant_ids", F.transform(F.filter("variants", lambda v: v["image_url"] == i["url"]), lambda v: v["id"]))))
    p = p.withColumn("featured", featured_image(F.lit(None).cast("string"), F.col("images")))
    axes = F.coalesce(F.from_json("axes_body", f"array<{OPTION_DEFINITION}>"), pay.none_of(OPTION_DEFINITION))
    p = p.withColumn("options", F.when(F.size("variants") > 0, option_definitions(F.col("variants")).cast(f"array<{OPTION_DEFINITION}>")).otherwise(axes))
    attribute = F.transform(F.filter(F.map_entries("merged"), lambda e: e["key"].startswith("attribute.")), lambda e, i: struct_of(ATTRIBUTE, {"name": F.substring(e["key"], 11, 1000), "values": F.split(e["value"]["value"], r"\s*,\s*"), "is_global": F.lit(False), "is_variation": F.lit(False), "visible": F.lit(True), "position": i + 1}))
    told = F.coalesce(F.when(F.col("store").isNotNull(), pay.store_attributes(F.col("store"))), pay.none_of(ATTRIBUTE))
    attributes = F.when(F.size(told) > 0, told).otherwise(F.coalesce(attribute, pay.none_of(ATTRIBUTE)))
    meaningful = F.size(F.filter("variants", lambda v: F.size(v["options"]) > 0))
    kind = F.when(meaningful > 1, F.when(value("kind").isin("grouped", "external"), value("kind")).otherwise("variable")).otherwise(final_kind(F.coalesce(value("kind"), F.lit("unknown")), F.col("variants"), F.col("options")))
    conflict = lambda m: F.when(m["other_source"].isNotNull(), F.struct(m["other_source"].alias("other_source"), m["other_value"].alias("other_value")))
    stamp = lambda source, confidence, note, other: F.struct(source.alias("source"), confidence.alias("confidence"), note.cast("string").alias("note"), other.cast("struct<other_source:string,other_value:string>").alias("conflict"))
    none = F.lit(None)
    own = F.transform_values("merged", lambda _, m: stamp(m["source"], confidence_of(m["source"]), m["note"], conflict(m)))
    featured = F.when(F.col("featured").isNotNull(), F.map_from_arrays(F.array(F.lit("featuredImageUrl")), F.array(stamp(F.col("featured.source"), F.col("featured.confidence"), none, none))))
    of_set = F.when(F.size("variants") > 0, F.map_from_arrays(F.array(F.lit("variants")), F.array(stamp(F.col("variants_source"), confidence_of(F.col("variants_source")), none, none))))
    payload = F.col("shop").isNotNull() | F.col("store").isNotNull()
    absent = F.filter(F.array(*map(F.lit, UNAVAILABLE)), lambda f: payload & ~F.map_contains_key("merged", f))
    missing = F.map_from_arrays(absent, F.transform(absent, lambda _: stamp(F.lit("unavailable"), F.lit("none"), none, none)))
    empty = F.create_map().cast(PROVENANCE)
    provenance = F.map_concat(own.cast(PROVENANCE), F.coalesce(featured.cast(PROVENANCE), empty), F.coalesce(of_set.cast(PROVENANCE), empty), missing.cast(PROVENANCE))
    says = F.try_element_at("merged", F.lit("descriptionText"))["source"]
    notes = F.array_union("layer_notes", F.array_compact(F.array(
        F.when(value("descriptionHtml").isNull() & value("descriptionText").isNull(), F.lit("The page has no description of the product.")).when(value("descriptionHtml").isNull() & (says == "heuristic"), F.lit("The description is only what the page tells search engines.")),
        F.when(F.size("store.variations") > pay.MOST_VARIATIONS, F.concat(F.lit(f"Only the first {pay.MOST_VARIATIONS} of "), F.size("store.variations").cast("string"), F.lit(" variations were read."))),
        F.when(F.size("observed") > 0, F.concat(F.size("observed").cast("string"), F.lit(" variants were seen by trying out the page's options."))), F.when(unchanged("observed"), F.lit(UNCHANGED)),
        F.when(F.size("sets") > 1, F.concat(F.lit("Variants come from "), F.col("variants_source"), F.lit("; a weaker source filled gaps only."))),
    )))
    platform = F.coalesce(F.nullif("page_platform", F.lit("unknown")), value("sourcePlatform"), F.lit("unknown"))
    nested = lambda kind, prefix: struct_of(kind, {_snake(f): value(f"{prefix}.{f}") for f in _NESTED[prefix]} | {n: split(f"{prefix}.keywords") for n in ("keywords",) if prefix == "seo"})
    given: dict[str, Column] = {
        "id": stable_id("prd", normalize_url(F.col("page_url"))), "ordinal": F.col("product_id").try_cast("long"), "source_url": F.col("page_url"), "source_platform": platform, "kind": kind, "tags": split("tags"), "status": F.coalesce(value("status"), F.lit("unknown")), "stock_status": F.coalesce(value("stockStatus"), F.lit("unknown")),
        "options": F.col("options"), "attributes": attributes, "variants": F.col("variants"), "images": F.col("images"), "featured_image_url": F.col("featured.url"), "seo": nested(SEO, "seo"), "google": nested(GOOGLE, "google"), "provenance": provenance, "extraction_notes": notes, "layers_used": F.col("layers_used"), "content_hash": F.col("page_hash"),
    }
    flat = {"source_product_id": "sourceProductId", "source_product_type": "sourceProductType"} | {n: _camel(n) for n in columns_of(PRODUCT) if n not in given}
    cast = lambda c, kind: c.cast("boolean") if kind == "boolean" else c.try_cast(kind)
    cells = [(given[n] if n in given else cast(value(flat[n]), k)).cast(k).alias(n) for n, k in columns_of(PRODUCT).items()]
    ok = F.coalesce(F.trim(value("title")) != "", F.lit(False))
    return settled(p.select("product_id", *cells, ok.alias("ok"), F.when(~ok, "NO_PRODUCT").alias("error_code"), (F.col("page_product") == "true").alias("looks_like_product"), F.col("page_chars").try_cast("long").alias("page_chars")))


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


_NESTED = {
    "seo": ("title", "metaDescription", "description", "ogTitle", "ogDescription", "ogImage", "canonicalUrl", "robots"),
    "google": ("googleProductCategory", "gender", "ageGroup", "mpn", "gtin", "brand", "condition", "color", "size", "material", "pattern", "itemGroupId", "customLabel0", "customLabel1", "customLabel2", "customLabel3", "customLabel4"),
}


UNCHANGED = "The page showed one price and SKU for all options, so the variants' own could not be confirmed."


def unchanged(observed: str) -> Column:
    """Whether several combinations were tried out and the page answered all of them alike."""
    alike = lambda member: F.size(F.array_distinct(F.transform(observed, lambda v: F.coalesce(v[member].cast("string"), F.lit(""))))) == 1
    return (F.size(observed) > 1) & alike("price") & alike("sku")


def with_observed(rows: DataFrame, observations: DataFrame) -> DataFrame:
    """Collected rows with the variants that were seen in a browser: one for each option combination, the first seen."""
    one = observed_variants(observations.withColumn("product_id", F.col("product_id").cast("string")))
    variant = struct_of(VARIANT, {"id": F.concat("product_id", F.lit(":"), "signature"), "parent_id": F.col("product_id")} | {n: F.col(n) for n in ("options", "sku", "stock_status", "image_url")} | {"price": F.col("price").cast("decimal(18,6)")})
    sets = one.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("ord", variant.alias("v")))).getField("v").alias("observed"))
    return rows.join(sets, "product_id", "left")


def pages_to_products(pages: DataFrame, endpoints: DataFrame | None = None, existing: DataFrame | None = None, observations: DataFrame | None = None, **columns: str) -> DataFrame:
    """Pages (and endpoint answers) to product documents with their outcome; a page without a title is ok = false.

    existing: rows (normalized_url, id) of products known before, which keep their id when their page comes again.
    observations: rows as extract.observed_variants takes them, of pages that were tried out in a browser.
    """
    rows = collected(pages, endpoints, **columns)
    out = assembled(with_merge(rows if observations is None else with_observed(rows, observations)))
    if existing is None:
        return out
    known = existing.groupBy("normalized_url").agg(F.min("id").alias("known_id"))
    return out.join(known, normalize_url(F.col("source_url")) == known["normalized_url"], "left").withColumn("id", F.coalesce("known_id", "id")).drop("known_id", "normalized_url")


def pages_with_rendering(pages: DataFrame, rendered: DataFrame, mode: str = "auto", endpoints: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to product documents, those that need a browser read again from what it rendered; adds was_rendered.

    rendered: rows (url, html), html null or blank where rendering failed. By mode auto, a page needs a browser if its
    document is thin, it does not look like a product's page, or it is short; always and never speak for themselves. First
    readings are written to the shared folder; only pages that need it are read twice. One that was needed and is not there is noted, and keeps its first reading.
    """
    first = pages_to_products(pages, endpoints, id_col=id_col, url_col=url_col, html_col=html_col)
    need = needs_render(F.coalesce(F.col("page_chars"), F.lit(0)), F.coalesce(F.col("looks_like_product"), F.lit(False)), F.coalesce(is_thin(), F.lit(True)), mode)
    at = shared_folder(pages.sparkSession)
    first.withColumn("needs", need).write.parquet(at)  # read three times below, made once
    first = pages.sparkSession.read.parquet(at)
    one = rendered.groupBy("url").agg(F.max(F.when(F.trim("html") != "", F.col("html"))).alias("rendered_html"))
    key = first.where("needs").select("product_id")
    again = pages.withColumn("_id", F.col(id_col).cast("string")).join(key.withColumnRenamed("product_id", "_id"), "_id", "left_semi").join(one.withColumnRenamed("url", url_col), url_col, "left")
    good = again.where("rendered_html IS NOT NULL").withColumn(html_col, F.col("rendered_html")).select(pages.columns)
    second = pages_to_products(good, endpoints, id_col=id_col, url_col=url_col, html_col=html_col).withColumn("was_rendered", F.lit(True))
    kept = first.join(second.select("product_id"), "product_id", "left_anti").withColumn("was_rendered", F.lit(False))
    note = F.when(F.col("needs"), F.lit("The page needed a browser and was not rendered, so what it loads later may be missing."))
    kept = kept.withColumn("extraction_notes", F.concat("extraction_notes", F.array_compact(F.array(note)))).drop("needs")
    return kept.unionByName(second)


def extract(pages: DataFrame, endpoints: DataFrame | None = None, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Merged fields as rows, and variant sets (product_id, source, variants)."""
    rows = with_merge(collected(pages, endpoints, **columns))
    return merged_fields(rows), rows.where("size(variants) > 0").select("product_id", F.col("variants_source").alias("source"), "variants")


def page_report(pages: DataFrame, status: Column) -> DataFrame:
    """What can be said of an address before it is collected: platform, reachable, and a sentence."""
    found = pages.select("*", detect_platform(F.col("html"))["platform"].alias("platform"), looks_like_product(F.col("html")).alias("is_product"), F.coalesce((status >= 200) & (status < 400), F.lit(False)).alias("reachable"))
    named = F.when(F.col("platform") == "unknown", F.lit("The platform is not known")).otherwise(F.concat(F.lit("The platform is "), "platform"))
    shown = F.when(F.col("is_product"), F.lit("the page shows a product.")).otherwise(F.lit("the page does not look like a product's."))
    detail = F.when(status.isNull(), "There was no answer.").when(~F.col("reachable"), F.concat(F.lit("The host answered with status "), status.cast("string"), F.lit("."))).otherwise(F.concat(named, F.lit("; "), shown))
    return found.withColumn("detail", detail)


# ---- predicates on documents ----------------------------------------------------------------------------------------
def is_thin() -> Column:
    """Whether the essentials for an import are missing: title, any price, any picture, or any of variants, SKU and stock."""
    no_price = F.col("price").isNull() & F.col("price_min").isNull() & F.forall("variants", lambda v: v["price"].isNull())
    bare = (F.size("variants") == 0) & F.col("sku").isNull() & (F.col("stock_status") == "unknown")
    return F.col("title").isNull() | no_price | (F.size("images") == 0) | bare


def variants_incomplete() -> Column:
    return (F.size("variants") == 0) | F.exists("variants", lambda v: v["price"].isNull())


def looks_variable(html: Column) -> Column:
    """Option axes are known, or the page has a control that chooses one."""
    marks = r"""(?i)<select[^>]*name=["']?(attribute_|options\[\])|single-option-selector|<input[^>]*type=["']?radio[^>]*name=["'][^"']*option"""
    return (F.size("options") > 0) | F.coalesce(html.rlike(marks), F.lit(False))
