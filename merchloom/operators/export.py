"""Export: severity gate, row fan-out, column profiles, CSV."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import fixed2, shortest
from ..functions.text import csv_cell, slugify_ascii
from ..functions.units import dimension_unit, to_centimetres, to_grams, to_kilograms, weight_unit
from ..schema import SEVERITIES, VARIANT, ExportOptions, struct_of
from ..sources.one_file import write_lines
from .validate import worst

META = "meta:catalogue"


class Profile(NamedTuple):
    """id, format, label, and the function that gives its ordered (header, Column) pairs for fanned-out rows."""

    id: str
    format: str
    label: str
    columns: Callable[[ExportOptions], list[tuple[str, Column]]]


def gate(products: DataFrame, issues: DataFrame, options: ExportOptions) -> DataFrame:
    """Products with skip_reason: null where they are exported.

    A critical finding that nobody has acknowledged always blocks; errors and warnings by option. Category and product
    filters come first, an empty list meaning all; a product without a category has the category ''.
    """
    if options.category_ids:
        products = products.where(F.coalesce("category_id", F.lit("")).isin(*options.category_ids))
    if options.product_ids:
        products = products.where(F.col("id").isin(*options.product_ids))
    state = worst(issues).withColumnRenamed("product_id", "issue_product")
    rank = F.coalesce("worst_rank", F.lit(0))
    reason = F.when(rank == SEVERITIES.index("CRITICAL"), "critical issue")
    if options.exclude_errors:
        reason = reason.when(rank == SEVERITIES.index("ERROR"), "error")
    if options.exclude_warnings:
        reason = reason.when(rank == SEVERITIES.index("WARNING"), "warning")
    return products.join(state, F.col("id") == F.col("issue_product"), "left").withColumn("skip_reason", reason).drop("issue_product", "worst_rank", "n_issues")


def skip_summary(gated: DataFrame) -> DataFrame:
    """One row: reasons with counts, joined by '; '."""
    counts = gated.where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))
    return counts.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("n").cast("string"), F.lit(" × "), "skip_reason"))), "; ").alias("skipped"))


def ordered_images(images: Column, featured: Column) -> Column:
    """By position, the featured one first."""
    keyed = F.transform(images, lambda x, i: F.struct(F.when(x["url"] == featured, 0).otherwise(1).alias("f"), x["position"].alias("p"), i.alias("i"), x.alias("x")))
    one_first = F.array_sort(keyed, lambda a, b: F.when(a.f != b.f, a.f - b.f).when(a.p != b.p, a.p - b.p).otherwise(a.i - b.i))
    return F.transform(one_first, lambda k: k.x)


def emits_variations() -> Column:
    return (F.col("kind") == "variable") | (F.size("variants") > 1)


def _default_variant() -> Column:
    """The product's own values seen as its only variant; dimensions stay with the product."""
    own = {f: F.col(f) for f in ("sku", "barcode", "price", "compare_at_price", "regular_price", "sale_price", "cost_per_item", "currency", "stock_status", "inventory_quantity", "inventory_policy", "backorders_allowed", "weight", "weight_unit", "requires_shipping", "taxable")}
    own |= {"id": F.concat("id", F.lit("-default")), "parent_id": F.col("id"), "position": F.lit(1), "available": F.when(F.col("stock_status") != "unknown", F.col("stock_status") == "in_stock"), "options": F.array()}
    return struct_of(VARIANT, own)


def _first_two() -> Column:
    """Of a product's variants what its rows ask for beside their own: how many there are, up to two, and the first.

    Each row would otherwise hold all of them, which grows with the square of their number.
    """
    return F.slice("variants", 1, 2)


def shopify_rows(products: DataFrame) -> DataFrame:
    """Variants (or the product as one) zipped with the images, the featured one first: row_type, idx, variant, image."""
    some = F.when(F.size("variants") > 0, F.col("variants")).otherwise(F.array(_default_variant()))
    images = F.transform(ordered_images(F.col("images"), F.col("featured_image_url")), lambda x, i: x.withField("position", (i + 1).cast("int")))
    zipped = products.withColumn("all_variants", some).withColumn("all_images", images).withColumn("zip", F.arrays_zip("all_variants", "all_images")).withColumn("variants", _first_two())
    # there is always a first row; the outer form keeps Spark from making the arrays once more to test for it
    rows = zipped.select("*", F.posexplode_outer("zip").alias("idx", "z")).withColumn("variant", F.col("z.all_variants")).withColumn("image", F.col("z.all_images"))
    kind = F.when(F.col("idx") == 0, "primary").when(F.col("variant").isNotNull(), "variant").otherwise("image")
    return rows.withColumn("row_type", kind).drop("zip", "z", "all_variants", "all_images")


def woo_rows(products: DataFrame) -> DataFrame:
    """The product, and one row for each variant where variations are written: row_type, idx, variant."""
    none = F.lit(None).cast(VARIANT)
    rows = F.concat(F.array(none), F.when(emits_variations(), F.col("variants")).otherwise(F.array().cast(f"array<{VARIANT}>")))
    each = products.withColumn("rows", rows).withColumn("variants", _first_two())
    out = each.select("*", F.posexplode_outer("rows").alias("idx", "variant")).drop("rows")  # there is always a first row
    return out.withColumn("row_type", F.when(F.col("idx") == 0, "primary").otherwise("variant"))


def handle() -> Column:
    return F.coalesce(F.nullif(F.trim("handle"), F.lit("")), F.nullif(slugify_ascii(F.coalesce("title", F.lit(""))), F.lit("")), F.col("id"))


def _primary(value: Column | str) -> Column:
    return F.when(F.col("row_type") == "primary", value if isinstance(value, Column) else F.col(value))


def _flag(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(True)), "TRUE").otherwise("FALSE")


def _option_name(i: int) -> Column:
    declared = F.get(F.col("options")["name"], F.lit(i))
    first = F.get(F.get("variants", F.lit(0))["options"]["name"], F.lit(i))
    title = F.when(F.size("variants") <= 1, F.lit("Title")) if i == 0 else F.lit(None).cast("string")
    return F.coalesce(declared, first, title)


def _option_value(i: int) -> Column:
    v = F.col("variant.options")
    at = F.array_position(F.transform(v["name"], F.lower), F.lower(_option_name(i)))
    named = F.when(at > 0, F.get(v["value"], (at - 1).cast("int")))
    default = F.when(F.size("variants") <= 1, F.lit("Default Title")) if i == 0 else F.lit(None).cast("string")
    return F.when(F.col("variant").isNotNull(), F.coalesce(named, F.get(v, F.lit(i))["value"], default))


def _shopify_values() -> dict[str, Column]:
    v, p = F.col("variant"), _primary
    there = v.isNotNull()
    quantity = v["inventory_quantity"]
    late = v["stock_status"].isin("on_backorder", "preorder")
    policy = F.coalesce(v["inventory_policy"], F.when(late, "continue"), F.when(quantity.isNotNull(), "deny"))
    goes_on = F.coalesce(v["inventory_policy"], F.when(v["stock_status"] == "on_backorder", "continue"))
    grams = F.floor(to_grams(v["weight"], v["weight_unit"]) + 0.5).cast("long").cast("string")
    out = {
        "handle": handle(), "title": p("title"), "body": p(F.coalesce("description_html", "description_text")), "vendor": p(F.coalesce("vendor", "brand")), "category": p("category_path"), "type": p(F.coalesce("category_path", "source_product_type")),
        "tags": p(F.array_join("tags", ", ")), "published": p(_flag(F.col("published"))), "status": p(F.when(F.col("status") == "unknown", "active").otherwise(F.col("status"))),
        "sku": F.coalesce(v["sku"], p(F.when(~there, F.col("sku")))), "barcode": F.coalesce(v["barcode"], p(F.when(~there, F.col("barcode")))), "grams": grams, "weight_unit": v["weight_unit"],
        "tracker": F.when(there, F.coalesce(F.nullif(v["inventory_tracker"], F.lit("")), F.when(quantity.isNotNull(), "shopify"))), "quantity": quantity.cast("string"), "policy": F.when(there, policy), "continue": F.when(goes_on == "continue", "TRUE").when(goes_on.isNotNull(), "FALSE"),
        "fulfilment": F.when(there, "manual"), "price": fixed2(v["price"]), "compare": fixed2(v["compare_at_price"]), "shipping": F.when(there, _flag(v["requires_shipping"])), "taxable": F.when(there, _flag(v["taxable"])), "cost": fixed2(F.coalesce(v["cost_per_item"], p("cost_per_item"))),
        "variant_image": v["image_url"], "image": F.col("image.url"), "image_position": F.col("image.position").cast("string"), "image_alt": F.col("image.alt"), "gift": p(F.lit("FALSE")), "seo_title": p("seo.title"), "seo_description": p(F.coalesce("seo.meta_description", "seo.description")),
        "g_category": p("google.google_product_category"), "g_gender": p("google.gender"), "g_age": p("google.age_group"), "g_mpn": p("google.mpn"), "g_condition": p(F.nullif("google.condition", F.lit("unknown"))), "g_custom": p(F.when(~F.col("google.identifier_exists"), "TRUE")), "g_grouping": p("google.ads_grouping"), "g_labels": p(F.array_join("google.ads_labels", ", ")), "tax_code": F.lit(""),
    }
    for i in range(3):
        out |= {f"option{i + 1}_name": p(_option_name(i)), f"option{i + 1}_value": _option_value(i)}
    for i in range(5):
        out[f"g_label_{i}"] = p(f"google.custom_label_{i}")
    return out


# The headers of the targets' import files, in their order, and the value each holds.
_GOOGLE = "Google Shopping / "
SHOPIFY_HEADERS = {
    "Handle": "handle", "Title": "title", "Body (HTML)": "body", "Vendor": "vendor", "Product Category": "category", "Type": "type", "Tags": "tags", "Published": "published", "Option1 Name": "option1_name", "Option1 Value": "option1_value", "Option2 Name": "option2_name", "Option2 Value": "option2_value",
    "Option3 Name": "option3_name", "Option3 Value": "option3_value", "Variant SKU": "sku", "Variant Grams": "grams", "Variant Inventory Tracker": "tracker", "Variant Inventory Qty": "quantity", "Variant Inventory Policy": "policy", "Variant Fulfillment Service": "fulfilment", "Variant Price": "price",
    "Variant Compare At Price": "compare", "Variant Requires Shipping": "shipping", "Variant Taxable": "taxable", "Variant Barcode": "barcode", "Image Src": "image", "Image Position": "image_position", "Image Alt Text": "image_alt", "Gift Card": "gift", "SEO Title": "seo_title", "SEO Description": "seo_description",
    _GOOGLE + "Google Product Category": "g_category", _GOOGLE + "Gender": "g_gender", _GOOGLE + "Age Group": "g_age", _GOOGLE + "MPN": "g_mpn", _GOOGLE + "AdWords Grouping": "g_grouping", _GOOGLE + "AdWords Labels": "g_labels", _GOOGLE + "Condition": "g_condition", _GOOGLE + "Custom Product": "g_custom",
    **{f"{_GOOGLE}Custom Label {i}": f"g_label_{i}" for i in range(5)}, "Variant Image": "variant_image", "Variant Weight Unit": "weight_unit", "Variant Tax Code": "tax_code", "Cost per item": "cost", "Status": "status",
}
SHOPIFY_MODERN_HEADERS = {
    "Title": "title", "URL handle": "handle", "Description": "body", "Vendor": "vendor", "Product category": "category", "Type": "type", "Tags": "tags", "Published on online store": "published", "Status": "status", "SKU": "sku", "Barcode": "barcode", "Option1 name": "option1_name", "Option1 value": "option1_value",
    "Option2 name": "option2_name", "Option2 value": "option2_value", "Option3 name": "option3_name", "Option3 value": "option3_value", "Price": "price", "Compare-at price": "compare", "Cost per item": "cost", "Charge tax": "taxable", "Inventory tracker": "tracker", "Inventory quantity": "quantity",
    "Continue selling when out of stock": "continue", "Weight value (grams)": "grams", "Weight unit for display": "weight_unit", "Requires shipping": "shipping", "Fulfillment service": "fulfilment", "Product image URL": "image", "Image position": "image_position", "Image alt text": "image_alt",
    "Variant image URL": "variant_image", "Gift card": "gift", "SEO title": "seo_title", "SEO description": "seo_description", _GOOGLE + "Google Product Category": "g_category", _GOOGLE + "Gender": "g_gender", _GOOGLE + "Age Group": "g_age", _GOOGLE + "MPN": "g_mpn", _GOOGLE + "Condition": "g_condition",
    _GOOGLE + "Custom Product": "g_custom", **{f"{_GOOGLE}Custom Label {i}": f"g_label_{i}" for i in range(5)},
}
WOO_HEADERS = {
    "ID": "blank", "Type": "type", "SKU": "sku", "Name": "name", "Published": "published", "Is featured?": "zero", "Visibility in catalog": "visible", "Short description": "short", "Description": "description", "Date sale price starts": "blank", "Date sale price ends": "blank", "Tax status": "tax_status",
    "Tax class": "tax_class", "In stock?": "in_stock", "Stock": "stock", "Low stock amount": "low_stock", "Backorders allowed?": "backorders", "Sold individually?": "individually", "Weight (kg)": "weight", "Length (cm)": "length", "Width (cm)": "width", "Height (cm)": "height", "Allow customer reviews?": "reviews",
    "Purchase note": "note", "Sale price": "sale", "Regular price": "regular", "Categories": "categories", "Tags": "tags", "Shipping class": "shipping_class", "Images": "images", "Download limit": "blank", "Download expiry days": "blank", "Parent": "parent", "Grouped products": "blank", "Upsells": "blank",
    "Cross-sells": "blank", "External URL": "external_url", "Button text": "button", "Position": "position",
}


def _is_variation() -> Column:
    return F.col("row_type") == "variant"


def _sole() -> Column:
    return F.when(~emits_variations() & (F.size("variants") == 1), F.get("variants", F.lit(0)))


def _row_variant() -> Column:
    return F.when(_is_variation(), F.col("variant")).otherwise(_sole())


def parent_key(options: ExportOptions) -> Column:
    """Own SKU, the lone variant's, or a generated key."""
    own = F.coalesce(F.nullif(F.trim("sku"), F.lit("")), F.nullif(F.trim(_sole()["sku"]), F.lit("")))
    return F.coalesce(own, F.concat(F.lit(options.key_prefix), handle()) if options.generate_parent_keys else F.lit(""))


def price_split(price: Column, regular: Column, sale: Column, compare: Column) -> Column:
    """regular and sale price, from what the source told; nothing is invented."""
    lower = F.when(price < regular, price)
    return (
        F.when(regular.isNotNull(), F.struct(regular.alias("regular"), F.coalesce(sale, lower).alias("sale")))
        .when(compare > price, F.struct(compare.alias("regular"), price.alias("sale")))
        .otherwise(F.struct(price.alias("regular"), sale.alias("sale")))
    )


def _own_or_variant(field: str) -> Column:
    v = _row_variant()
    return F.when(_is_variation(), v[field]).otherwise(F.coalesce(F.col(field), v[field]))


def _status() -> Column:
    v = _row_variant()
    return F.coalesce(F.when(_is_variation(), v["stock_status"]).otherwise(F.coalesce(F.nullif("stock_status", F.lit("unknown")), v["stock_status"])), F.lit("unknown"))


def woo_prices() -> Column:
    v = F.col("variant")
    none = F.lit(None).cast("decimal(18,6)")
    own = price_split(*[_own_or_variant(f) for f in ("price", "regular_price", "sale_price", "compare_at_price")])
    return F.when(_is_variation(), price_split(v["price"], v["regular_price"], v["sale_price"], v["compare_at_price"])).when(emits_variations(), F.struct(none.alias("regular"), none.alias("sale"))).otherwise(own)


def attribute_axes() -> Column:
    """Options first, all of them variation axes, then the other attributes; one for each lower-case name."""
    kind = "struct<name:string,values:array<string>,is_global:boolean,is_variation:boolean,visible:boolean>"

    def from_option(o: Column) -> Column:
        declared = F.get(F.filter("attributes", lambda a: F.lower(a["name"]) == F.lower(o["name"])), F.lit(0))
        used = F.array_distinct(F.filter(F.transform("variants", lambda v: F.get(F.filter(v["options"], lambda x: F.lower(x["name"]) == F.lower(o["name"])), F.lit(0))["value"]), lambda x: F.coalesce(x, F.lit("")) != ""))
        values = F.when(F.size(o["values"]) > 0, o["values"]).otherwise(used)
        return F.struct(o["name"].alias("name"), values.alias("values"), F.coalesce(declared["is_global"], F.lit(False)).alias("is_global"), F.lit(True).alias("is_variation"), F.coalesce(declared["visible"], F.lit(True)).alias("visible")).cast(kind)

    from_attribute = lambda a: F.struct(a["name"].alias("name"), a["values"].alias("values"), a["is_global"].alias("is_global"), a["is_variation"].alias("is_variation"), a["visible"].alias("visible")).cast(kind)
    both = F.concat(F.transform("options", from_option), F.transform("attributes", from_attribute))
    keys = F.transform(both, lambda x: F.lower(x["name"]))
    return F.filter(both, lambda x, i: F.array_position(keys, F.lower(x["name"])) == i + 1)


def _woo_values(options: ExportOptions) -> dict[str, Column]:
    variation, v = _is_variation(), _row_variant()
    product = lambda x: F.when(~variation, x if isinstance(x, Column) else F.col(x))
    yes_no = lambda x: F.when(x, "1").when(~x, "0")
    kind = F.when(F.col("kind").isin("variable", "grouped", "external"), F.col("kind")).when(emits_variations(), "variable").otherwise("simple")
    values = F.array_join(F.transform(F.col("variant.options"), lambda o: o["value"]), ", ")
    title = F.coalesce("title", F.lit(""))
    back = _own_or_variant("backorders_allowed")
    size = lambda f: F.when(F.coalesce(_own_or_variant("dimension_unit"), F.lit("")) == "", shortest(_own_or_variant(f))).otherwise(shortest(to_centimetres(_own_or_variant(f), _own_or_variant("dimension_unit"))))
    gallery = F.array_join(F.transform(ordered_images(F.col("images"), F.col("featured_image_url")), lambda x: x["url"]), ", ")
    return {
        "blank": F.lit(""), "zero": F.lit("0"), "visible": F.lit("visible"), "type": F.when(variation, "variation").otherwise(kind), "sku": F.when(variation, F.col("variant.sku")).otherwise(parent_key(options)), "name": F.when(variation & (values != ""), F.concat(title, F.lit(" - "), values)).otherwise(title),
        "published": F.when(F.col("published") == False, "0").otherwise("1"), "short": product(F.coalesce("short_description_html", "short_description_text")), "description": product(F.coalesce("description_html", "description_text")), "tax_status": F.coalesce("tax_status", F.lit("taxable")), "tax_class": F.col("tax_class"),  # noqa: E712
        "in_stock": F.when(_status().isin("in_stock", "preorder", "on_backorder"), "1").when(_status() == "out_of_stock", "0"), "stock": _own_or_variant("inventory_quantity").cast("string"), "low_stock": F.col("low_stock_amount").cast("string"), "backorders": F.coalesce(yes_no(back), F.when(_status() == "on_backorder", "1")),
        "individually": yes_no(F.col("sold_individually")), "weight": F.when(F.coalesce(_own_or_variant("weight_unit"), F.lit("")) == "", shortest(_own_or_variant("weight"))).otherwise(shortest(to_kilograms(_own_or_variant("weight"), _own_or_variant("weight_unit")))), "length": size("length"), "width": size("width"), "height": size("height"),
        "reviews": yes_no(F.col("allow_reviews")), "note": F.col("purchase_note"), "sale": shortest(woo_prices()["sale"]), "regular": shortest(woo_prices()["regular"]), "categories": product(F.coalesce("category_path", "source_product_type")), "tags": product(F.array_join("tags", ", ")), "shipping_class": F.col("shipping_class"),
        "images": F.when(variation, F.col("variant.image_url")).otherwise(F.coalesce(F.nullif(gallery, F.lit("")), _sole()["image_url"])), "parent": F.when(variation, parent_key(options)), "external_url": F.when(F.col("kind") == "external", F.col("external_url")), "button": F.when(F.col("kind") == "external", F.col("external_button_text")),
        "position": F.when(variation, F.col("idx").cast("string")).otherwise("0"),
    }


def _dynamic(n_axes: int) -> list[tuple[str, Column]]:
    """Five columns for each attribute axis, then three on what the source published."""
    out, variation = [], _is_variation()
    for i in range(n_axes):
        axis = F.get("axes", F.lit(i))
        own = F.get(F.filter(F.col("variant.options"), _named(axis)), F.lit(0))["value"]
        flag = lambda x, axis=axis: F.when(variation | axis.isNull(), None).when(x, "1").otherwise("0")
        out += [(f"Attribute {i + 1} name", axis["name"]), (f"Attribute {i + 1} value(s)", F.when(variation, own).otherwise(F.array_join(axis["values"], ", "))), (f"Attribute {i + 1} visible", flag(axis["visible"])), (f"Attribute {i + 1} global", flag(axis["is_global"])), (f"Attribute {i + 1} default", F.lit(""))]
    return [*out, (f"{META}_source_weight_unit", weight_unit(_own_or_variant("weight_unit"))), (f"{META}_source_dimension_unit", dimension_unit(_own_or_variant("dimension_unit"))), (f"{META}_source_url", F.when(~variation, F.col("source_url")))]


def _named(axis: Column) -> Callable[[Column], Column]:
    return lambda o: F.lower(o["name"]) == F.lower(axis["name"])


def _picked(headers: dict[str, str], values: dict[str, Column]) -> list[tuple[str, Column]]:
    return [(h, values[k]) for h, k in headers.items()]


PROFILES = {
    p.id: p
    for p in (
        Profile("shopify-legacy", "shopify", "Shopify product import", lambda o: _picked(SHOPIFY_HEADERS, _shopify_values())),
        Profile("shopify-2024", "shopify", "Shopify, current column names", lambda o: _picked(SHOPIFY_MODERN_HEADERS, _shopify_values())),
        Profile("woocommerce-default", "woocommerce", "WooCommerce product import", lambda o: _picked(WOO_HEADERS, _woo_values(o))),
    )
}


def profile_of(name: str) -> Profile:
    """By id, else the first of that format."""
    found = PROFILES.get(name) or next((p for p in PROFILES.values() if p.format == name), None)
    if found is None:
        raise ValueError(f"no export profile {name!r}")
    return found


def most_axes(products: DataFrame) -> int:
    """The one figure that a header depends on: one number comes to the driver."""
    axes = products.select("options", "attributes").select(F.array_distinct(F.transform(F.concat(F.transform("options", lambda o: o["name"]), F.transform("attributes", lambda a: a["name"])), lambda n: F.lower(n))).alias("names"))
    return axes.agg(F.max(F.size("names"))).first()[0] or 0


@contextmanager
def forgiving(spark: SparkSession) -> Iterator[None]:
    """Columns that are put into a plan here give null where a value is bad: casts, divisions, places and sums in their try forms."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def safe_cells(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """Adds cells, the columns as texts in their order; '' for null and for what fails.

    A column that cannot be resolved on these rows is '' in all of them. One that fails on some row's values is '' there:
    the plan keeps how each expression deals with bad values from when it is built, whatever the session says when it runs.
    """
    with forgiving(rows.sparkSession):
        text = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]

        def fits(*some: Column) -> bool:
            try:
                rows.select(*some)
                return True
            except AnalysisException:
                return False

        good = text if fits(*text) else [c if fits(c) else F.lit("") for c in text]
        return rows.withColumn("cells", F.array(*good))


def build(included: DataFrame, options: ExportOptions) -> tuple[list[str], DataFrame]:
    """Headers and rows: ordinal, idx, cells array<string> in the order of the headers; no cell is null."""
    profile = profile_of(options.profile)
    if profile.format == "shopify":
        rows, columns = shopify_rows(included), profile.columns(options)
    else:
        rows = woo_rows(included.withColumn("axes", attribute_axes()))
        columns = [*profile.columns(options), *_dynamic(most_axes(included))]
    headers = [h for h, _ in columns]
    return headers, safe_cells(rows, [c for _, c in columns]).select("ordinal", F.col("id").alias("product_id"), "idx", "row_type", "cells")


def export(products: DataFrame, issues: DataFrame, options: ExportOptions) -> tuple[list[str], DataFrame, DataFrame]:
    """Gate first, then the header of what is left, then rows: headers, rows, gated products."""
    gated = gate(products, issues, options)
    headers, rows = build(gated.where("skip_reason IS NULL").drop("skip_reason"), options)
    return headers, rows, gated


def csv_lines(headers: list[str], rows: DataFrame) -> DataFrame:
    """Rows (ordinal, idx, line) of the file: the header first, with a byte order mark."""
    line = F.array_join(F.transform("cells", lambda c: csv_cell(c)), ",")
    head = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("ordinal"), F.lit(-1).alias("idx"), F.concat(F.lit("﻿"), F.array_join(F.array(*[csv_cell(F.lit(h), False) for h in headers]), ",")).alias("line"))
    return head.unionByName(rows.select("ordinal", "idx", line.alias("line")))


def write_csv(headers: list[str], rows: DataFrame, path: str, one_file: bool = False) -> None:
    """Lines ended by CR LF, in order. Range-sorted parts keep the order by name; with one_file, path is one file, for import.

    Nothing to export is an error, and no file is written.
    """
    if rows.isEmpty():
        raise ValueError("nothing to export: every product was skipped or filtered")
    lines = csv_lines(headers, rows).orderBy("ordinal", "idx").select("line")
    if one_file:
        write_lines(lines, path, "\r\n")
    else:
        lines.write.option("lineSep", "\r\n").mode("errorifexists").text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A written file back: quoted cells over lines, doubled quotes, all text."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


_RESERVED = re.compile(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])$", re.I)


def safe_file_name(name: str | None, fallback: str) -> str:
    """A name that every common file system takes, ending in .csv."""
    base = re.sub(r"\.csv$", "", name or "", flags=re.I)
    base = re.sub(r"[\x00-\x1f\x7f]", "", re.sub(r'[/\\:*?"<>|]', "-", base))
    base = re.sub(r"[. ]+$", "", base).strip() or fallback
    base = f"{base}-export" if _RESERVED.match(base) else base
    return f"{base[:120].rstrip()}.csv"


def free_name(taken: set[str], name: str, stamp: str) -> str:
    """The name itself, 'name (2).csv' to 999, then one with a time stamp."""
    stem = name[: -len(".csv")] if name.endswith(".csv") else name
    tries = (name, *(f"{stem} ({i}).csv" for i in range(2, 1000)), f"{stem} {stamp}.csv")
    return next((t for t in tries if t not in taken), tries[-1])
