"""Endpoint payloads as offers, variants and pictures: JSON read by Catalyst, no Python.

The column functions read one body inside a row; shop_product, store_product and form_variants apply them to tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_number, round_half_up, shop_money, store_money
from ..functions.text import clean_attribute_name, decode_named, stock_from_form, stock_from_schema
from ..functions.units import unit_from_html
from ..schema import ATTRIBUTE, VARIANT, struct_of

#: A picture as a payload tells it; position is the place in its own list.
PICTURE = "struct<url:string,alt:string,position:int,is_featured:boolean,id:string>"
OFFER_PAIR = "struct<field:string,value:string>"
#: Product JSON of a shop's own endpoint; numbers are read as text, for they come both ways, and what comes as text or object as text.
SHOP_JSON = (
    "struct<id:string,title:string,handle:string,description:string,body_html:string,vendor:string,type:string,product_type:string,published_at:string,status:string,tags:string,price:string,price_min:string,price_max:string,compare_at_price:string,available:boolean,"
    "options:array<string>,images:array<string>,featured_image:string,media:array<struct<src:string,alt:string,media_type:string>>,variants:array<struct<id:string,title:string,option1:string,option2:string,option3:string,sku:string,barcode:string,requires_shipping:boolean,taxable:boolean,available:boolean,"
    "price:string,compare_at_price:string,weight:double,grams:double,weight_unit:string,inventory_management:string,inventory_policy:string,inventory_quantity:bigint,image_id:string,featured_image:struct<src:string>>>>"
)
STORE_JSON = (
    "struct<id:string,name:string,slug:string,type:string,sku:string,permalink:string,short_description:string,description:string,on_sale:boolean,prices:struct<price:string,regular_price:string,sale_price:string,price_range:struct<min_amount:string,max_amount:string>,currency_code:string,"
    "currency_minor_unit:int>,average_rating:string,review_count:bigint,images:array<struct<id:string,src:string,name:string,alt:string>>,categories:array<struct<name:string>>,tags:array<struct<name:string>>,attributes:array<struct<name:string,taxonomy:string,has_variations:boolean,"
    "terms:array<struct<name:string,slug:string>>>>,variations:array<struct<id:string,attributes:array<struct<name:string,value:string>>>>,is_in_stock:boolean,is_on_backorder:boolean,sold_individually:boolean,low_stock_remaining:bigint,weight:string,dimensions:struct<length:string,width:string,height:string>>"
)
FORM_JSON = (
    "array<struct<variation_id:string,attributes:map<string,string>,display_price:double,display_regular_price:double,sku:string,is_in_stock:boolean,backorders_allowed:boolean,max_qty:string,weight:string,weight_html:string,dimensions:struct<length:string,width:string,height:string>,"
    "availability_html:string,image:struct<src:string,full_src:string,alt:string>>>"
)
LD_VARIANTS = "array<struct<position:int,sku:string,gtin:string,options:array<struct<name:string,value:string>>,price:string,currency:string,availability:string,image_url:string>>"
WP_POST = "struct<title:struct<rendered:string>,content:struct<rendered:string>,excerpt:struct<rendered:string>>"
#: Variations of a product that are read at most; beyond, a note says so.
MOST_VARIATIONS = 250


def pairs(fields: dict[str, Column]) -> Column:
    """Fields with a value that is not blank, as array<struct<field,value>>."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), v.cast("string").alias("value")) for n, v in fields.items()])
    return F.filter(each, lambda x: F.trim(x["value"]) != "").cast(f"array<{OFFER_PAIR}>")


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _text_or(c: Column, path: str) -> Column:
    """A text itself, or one member of what is an object."""
    return F.when(c.startswith("{"), F.get_json_object(c, path)).otherwise(c)


def shop_read(body: Column) -> Column:
    """A shop's product, wrapped in an object or not; null for what is none."""
    wrapped = F.from_json(body, f"struct<product:{SHOP_JSON}>").getField("product")
    p = F.coalesce(F.when(wrapped["title"].isNotNull(), wrapped), F.from_json(body, SHOP_JSON))
    return F.when(p["title"].isNotNull() | p["handle"].isNotNull(), p)


def shop_cents(p: Column) -> Column:
    """Integer prices are cents: told by the first price there is."""
    sample = F.coalesce(p["price"], p["price_min"], F.get(p["variants"], F.lit(0))["price"])
    return F.coalesce(sample.rlike(r"^-?\d+$"), F.lit(False))


def shop_offers(p: Column, cents: Column) -> Column:
    money = lambda c: shop_money(c, cents)
    one = F.when(F.size(p["variants"]) == 1, F.get(p["variants"], F.lit(0)))
    told = F.when(one["available"], "in_stock").when(~one["available"], "out_of_stock")
    rolled = F.when(F.exists(p["variants"], lambda v: v["available"]), "in_stock").when(F.forall(p["variants"], lambda v: ~v["available"]), "out_of_stock")
    return pairs(
        {"sourcePlatform": F.lit("shopify"), "sourceProductId": p["id"], "handle": p["handle"], "title": p["title"], "vendor": p["vendor"], "sourceProductType": F.coalesce(p["type"], p["product_type"]), "descriptionHtml": F.coalesce(p["description"], p["body_html"]), "tags": F.regexp_replace(p["tags"], '[\\[\\]"]', ""),
         "published": F.when(p["published_at"].isNotNull(), "true"), "status": F.coalesce(p["status"], F.when(p["published_at"].isNotNull(), "active")), "price": F.coalesce(money(p["price"]), money(one["price"])), "priceMin": money(p["price_min"]), "priceMax": money(p["price_max"]), "compareAtPrice": F.coalesce(money(p["compare_at_price"]), money(one["compare_at_price"])),
         "kind": F.when(F.size(p["variants"]) > 1, "variable").otherwise("simple"), "stockStatus": F.coalesce(told, rolled), "sku": one["sku"], "barcode": one["barcode"], "inventoryQuantity": one["inventory_quantity"], "inventoryPolicy": one["inventory_policy"], "requiresShipping": one["requires_shipping"], "taxable": one["taxable"],
         "weight": F.when(one["grams"] > 0, one["grams"]).otherwise(one["weight"]), "weightUnit": F.when(one["grams"] > 0, F.lit("g")).otherwise(one["weight_unit"])}
    )


def shop_pictures(p: Column) -> Column:
    """The gallery, or the media that are pictures; the featured one is flagged."""
    featured = F.regexp_replace(_text_or(p["featured_image"], "$.src"), r"\?.*$", "")
    picture = lambda url, alt, i, ident: F.struct(url.alias("url"), alt.alias("alt"), (i + 1).cast("int").alias("position"), F.coalesce(F.regexp_replace(url, r"\?.*$", "") == featured, F.lit(False)).alias("is_featured"), ident.alias("id")).cast(PICTURE)
    none = F.lit(None).cast("string")
    own = F.transform(p["images"], lambda x, i: picture(_text_or(x, "$.src"), F.when(x.startswith("{"), F.get_json_object(x, "$.alt")), i, F.when(x.startswith("{"), F.get_json_object(x, "$.id"))))
    media = F.transform(F.filter(p["media"], lambda m: m["media_type"] == "image"), lambda m, i: picture(m["src"], m["alt"], i, none))
    return F.coalesce(F.when(F.size(p["images"]) > 0, own), media, none_of(PICTURE))


def shop_axes(p: Column) -> Column:
    """Names of the option axes, told as texts or as objects."""
    return F.coalesce(F.transform(p["options"], lambda o: _text_or(o, "$.name")), F.array().cast("array<string>"))


def shop_variants(p: Column, cents: Column, product_id: Column) -> Column:
    money = lambda c: shop_money(c, cents).cast("decimal(18,6)")
    names = shop_axes(p)
    by_id = F.map_from_entries(F.transform(F.filter(p["images"], lambda x: x.startswith("{") & F.get_json_object(x, "$.id").isNotNull()), lambda x: F.struct(F.get_json_object(x, "$.id"), F.get_json_object(x, "$.src"))))

    def options(v: Column) -> Column:
        three = F.array(*[F.struct(F.coalesce(F.get(names, F.lit(i)), F.lit(f"Option{i + 1}")).alias("name"), v[f"option{i + 1}"].alias("value")) for i in range(3)])
        return F.filter(three, lambda o: o["value"].isNotNull() & (o["value"] != "Default Title"))

    def variant(v: Column, i: Column) -> Column:
        grams = F.coalesce(v["grams"], F.lit(0.0)) > 0
        return struct_of(VARIANT, {
            "id": F.concat(product_id, F.lit(":"), v["id"]), "parent_id": product_id, "source_variant_id": v["id"], "position": i + 1, "options": options(v), "sku": _blank(v["sku"]), "barcode": _blank(v["barcode"]), "price": money(v["price"]), "compare_at_price": money(v["compare_at_price"]), "available": v["available"],
            "stock_status": F.when(v["available"], "in_stock").when(~v["available"], "out_of_stock").otherwise("unknown"), "inventory_quantity": v["inventory_quantity"], "inventory_policy": v["inventory_policy"], "inventory_tracker": v["inventory_management"], "weight": F.when(grams, v["grams"]).otherwise(v["weight"]),
            "weight_unit": F.when(grams, F.lit("g")).otherwise(v["weight_unit"]), "image_url": F.coalesce(v["featured_image"]["src"], F.try_element_at(by_id, v["image_id"])), "requires_shipping": v["requires_shipping"], "taxable": v["taxable"], "title": v["title"],
        })

    return F.coalesce(F.transform(p["variants"], variant), none_of(VARIANT))


def store_read(body: Column) -> Column:
    """A store API's product; of a list the first."""
    first = F.get(F.from_json(body, f"array<{STORE_JSON}>"), F.lit(0))
    p = F.coalesce(F.when(body.rlike(r"^\s*\["), first), F.from_json(body, STORE_JSON))
    return F.when(p["id"].isNotNull(), p)


def store_stock(p: Column) -> Column:
    return F.when(p["is_on_backorder"], "on_backorder").when(p["is_in_stock"], "in_stock").when(~p["is_in_stock"], "out_of_stock")


def store_offers(p: Column) -> Column:
    money = lambda c: store_money(c, p["prices"]["currency_minor_unit"])
    price, regular = money(p["prices"]["price"]), money(p["prices"]["regular_price"])
    number = lambda c: c.try_cast("double")
    return pairs(
        {"sourceProductId": p["id"], "title": p["name"], "handle": p["slug"], "sku": p["sku"], "currency": p["prices"]["currency_code"], "descriptionHtml": p["description"], "shortDescriptionHtml": p["short_description"], "price": price, "regularPrice": regular, "salePrice": F.when(p["on_sale"], money(p["prices"]["sale_price"])),
         "compareAtPrice": F.when(p["on_sale"] & (regular > price), regular), "priceMin": money(p["prices"]["price_range"]["min_amount"]), "priceMax": money(p["prices"]["price_range"]["max_amount"]), "stockStatus": store_stock(p), "inventoryQuantity": p["low_stock_remaining"], "soldIndividually": p["sold_individually"],
         "weight": number(p["weight"]), "length": number(p["dimensions"]["length"]), "width": number(p["dimensions"]["width"]), "height": number(p["dimensions"]["height"]), "ratingValue": F.nullif(number(p["average_rating"]), F.lit(0.0)), "reviewCount": p["review_count"],
         "sourceProductType": F.array_join(F.transform(p["categories"], lambda c: c["name"]), " > "), "tags": F.array_join(F.transform(p["tags"], lambda t: t["name"]), ", "), "kind": F.when(F.size(p["variations"]) > 0, "variable").when(p["type"].isin("grouped", "external", "simple", "variable"), p["type"])}
    )


def store_pictures(p: Column) -> Column:
    """The gallery in order; the first is the featured one."""
    out = F.transform(p["images"], lambda x, i: F.struct(x["src"].alias("url"), _blank(x["alt"]).alias("alt"), (i + 1).cast("int").alias("position"), (i == 0).alias("is_featured"), x["id"].alias("id")).cast(PICTURE))
    return F.coalesce(out, none_of(PICTURE))


def store_attributes(p: Column) -> Column:
    out = F.transform(p["attributes"], lambda a, i: struct_of(ATTRIBUTE, {"name": a["name"], "values": F.transform(a["terms"], lambda t: t["name"]), "is_global": F.coalesce(a["taxonomy"], F.lit("")) != "", "is_variation": a["has_variations"], "visible": F.lit(True), "position": i + 1}))
    return F.coalesce(out, none_of(ATTRIBUTE))


def store_variants(p: Column, bodies: Column, product_id: Column) -> Column:
    """Variations by the product's references (MOST_VARIATIONS at most), each with its own body where one was fetched."""
    read = F.filter(F.transform(bodies, lambda b: F.from_json(b, STORE_JSON)), lambda v: v["id"].isNotNull())
    by_id = lambda i: F.get(F.filter(read, lambda v: v["id"] == i), F.lit(0))

    def variant(ref: Column, i: Column) -> Column:
        v = by_id(ref["id"])
        money = lambda c: store_money(c, v["prices"]["currency_minor_unit"]).cast("decimal(18,6)")
        price, regular = money(v["prices"]["price"]), money(v["prices"]["regular_price"])
        options = F.filter(F.transform(ref["attributes"], lambda a: F.struct(clean_attribute_name(a["name"]).alias("name"), a["value"].alias("value"))), lambda o: F.coalesce(o["value"], F.lit("")) != "")
        return struct_of(VARIANT, {
            "id": F.concat(product_id, F.lit(":"), ref["id"]), "parent_id": product_id, "source_variant_id": ref["id"], "position": i + 1, "options": options, "sku": _blank(v["sku"]), "price": price, "regular_price": regular, "sale_price": F.when(v["on_sale"], money(v["prices"]["sale_price"])), "compare_at_price": F.when(v["on_sale"] & (regular > price), regular),
            "currency": v["prices"]["currency_code"], "stock_status": F.coalesce(store_stock(v), F.lit("unknown")), "inventory_quantity": v["low_stock_remaining"], "weight": v["weight"].try_cast("double"), "length": v["dimensions"]["length"].try_cast("double"), "width": v["dimensions"]["width"].try_cast("double"),
            "height": v["dimensions"]["height"].try_cast("double"), "image_url": F.get(v["images"], F.lit(0))["src"],
        })

    return F.coalesce(F.transform(F.slice(p["variations"], 1, MOST_VARIATIONS), variant), none_of(VARIANT))


def form_read(body: Column) -> Column:
    """Entries of a variation form's JSON."""
    return F.from_json(body, FORM_JSON)


def form_variants_of(entries: Column, product_id: Column, labels: Column | None = None) -> Column:
    """Variants of a form; an axis is named as the page labels it, else by its cleaned key."""
    number = lambda c: c.try_cast("double")

    def variant(v: Column, i: Column) -> Column:
        sale = v["display_regular_price"] > v["display_price"]
        name = lambda k: F.coalesce(F.try_element_at(labels, F.lower(F.regexp_replace(k, r"^(attribute_)?", ""))), clean_attribute_name(k)) if labels is not None else clean_attribute_name(k)
        options = F.transform(F.map_entries(v["attributes"]), lambda e: F.struct(name(e["key"]).alias("name"), e["value"].alias("value")))
        back = F.when(F.coalesce(v["backorders_allowed"], F.lit(False)) & F.lower(v["availability_html"]).contains("backorder"), F.lit("on_backorder"))
        return struct_of(VARIANT, {
            "id": F.concat(product_id, F.lit(":"), v["variation_id"]), "parent_id": product_id, "source_variant_id": v["variation_id"], "position": i + 1, "options": F.filter(options, lambda o: F.coalesce(o["value"], F.lit("")) != ""), "sku": _blank(v["sku"]), "price": round_half_up(v["display_price"], 6).cast("decimal(18,6)"),
            "compare_at_price": F.when(sale, v["display_regular_price"]).cast("decimal(18,6)"), "regular_price": v["display_regular_price"].cast("decimal(18,6)"), "sale_price": F.when(sale, v["display_price"]).cast("decimal(18,6)"), "stock_status": F.coalesce(back, stock_from_form(v["availability_html"], v["is_in_stock"])),
            "inventory_quantity": v["max_qty"].try_cast("bigint"), "backorders_allowed": v["backorders_allowed"], "weight": number(v["weight"]), "weight_unit": unit_from_html(v["weight_html"]), "length": number(v["dimensions"]["length"]), "width": number(v["dimensions"]["width"]), "height": number(v["dimensions"]["height"]),
            "image_url": F.coalesce(_blank(v["image"]["full_src"]), _blank(v["image"]["src"])),
        })

    return F.coalesce(F.transform(entries, variant), none_of(VARIANT))


def form_pictures(entries: Column) -> Column:
    with_url = F.filter(F.transform(entries, lambda v: F.struct(F.coalesce(_blank(v["image"]["full_src"]), _blank(v["image"]["src"])).alias("url"), v["image"]["alt"].alias("alt"))), lambda x: x.url.isNotNull())
    out = F.transform(with_url, lambda x, i: F.struct(x.url.alias("url"), x.alt.alias("alt"), (i + 1).cast("int").alias("position"), F.lit(False).alias("is_featured"), F.lit(None).cast("string").alias("id")).cast(PICTURE))
    return F.coalesce(out, none_of(PICTURE))


def ld_variants_of(body: Column, product_id: Column) -> Column:
    """Variants that a page's structured data lists."""
    def variant(v: Column, i: Column) -> Column:
        return struct_of(VARIANT, {
            "id": F.concat(product_id, F.lit(":"), F.coalesce(v["sku"], (i + 1).cast("string"))), "parent_id": product_id, "position": i + 1, "options": v["options"], "sku": v["sku"], "barcode": v["gtin"], "price": parse_number(v["price"]).cast("decimal(18,6)"), "currency": v["currency"], "stock_status": stock_from_schema(v["availability"]), "image_url": v["image_url"],
        })

    return F.coalesce(F.transform(F.from_json(body, LD_VARIANTS), variant), none_of(VARIANT))


def post_offers(body: Column) -> Column:
    """Descriptions of a blog API's post (of a list the first); they matter where nothing else has any."""
    post = F.coalesce(F.when(body.rlike(r"^\s*\["), F.get(F.from_json(body, f"array<{WP_POST}>"), F.lit(0))), F.from_json(body, WP_POST))
    plain = lambda c: F.trim(decode_named(F.regexp_replace(c, r"<[^>]*>", "")))

    def told(p: Column) -> Column:
        content, excerpt = p["content"]["rendered"], p["excerpt"]["rendered"]
        return pairs({"descriptionHtml": content, "descriptionText": plain(content), "shortDescriptionHtml": excerpt, "shortDescriptionText": plain(excerpt), "title": plain(p["title"]["rendered"])})

    return F.element_at(F.transform(F.array(post), told), 1)


def first_answer(answers: DataFrame, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Rows (keys.., priority, status, body) to the first answer in order of priority that is JSON and was found."""
    good = answers.where((F.col("status") == 200) & F.col("body").rlike(r"^\s*[\[{]"))
    return good.groupBy(*keys).agg(F.min_by("body", "priority").alias("body"), F.min("priority").alias("priority"))


def store_api_bases(origin: Column) -> Column:
    """Addresses at which a store's API may answer, in the order in which they are tried."""
    return F.array(*[F.concat(origin, F.lit(path)) for path in ("/wp-json/wc/store/v1", "/wp-json/wc/store", "/index.php?rest_route=/wc/store/v1")])


def _rows(df: DataFrame, source: str, seq: int) -> DataFrame:
    return df.select("product_id", F.explode("offers").alias("x")).select("product_id", "x.field", F.lit(seq).alias("seq"), F.lit(source).alias("source"), "x.value")


def shop_product(payloads: DataFrame, seq: int = 300) -> tuple[DataFrame, DataFrame]:
    """Rows (product_id, body) of a shop's product JSON to offers and a variant set. Integer prices are cents.

    A body that is no JSON gives nothing and ends nothing.
    """
    p = payloads.select("product_id", shop_read(F.col("body")).alias("p")).where("p IS NOT NULL").withColumn("cents", shop_cents(F.col("p")))
    offers = _rows(p.select("product_id", shop_offers(F.col("p"), F.col("cents")).alias("offers")), "shopify-product-json", seq)
    sets = p.select("product_id", F.lit(seq).alias("seq"), F.lit("shopify-product-json").alias("source"), shop_variants(F.col("p"), F.col("cents"), F.col("product_id")).alias("variants")).where("size(variants) > 0")
    return offers, sets


def store_product(payloads: DataFrame, seq: int = 400) -> tuple[DataFrame, DataFrame]:
    """Rows (product_id, body) of a store API's product to offers and its variation references, at most MOST_VARIATIONS."""
    p = payloads.select("product_id", store_read(F.col("body")).alias("p")).where("p IS NOT NULL")
    refs = p.select("product_id", F.posexplode(F.slice("p.variations", 1, MOST_VARIATIONS)).alias("pos", "v")).select("product_id", "pos", F.col("v.id").alias("variation_id"), F.col("v.attributes").alias("options"))
    return _rows(p.select("product_id", store_offers(F.col("p")).alias("offers")), "woo-rest", seq), refs


def form_variants(payloads: DataFrame, seq: int = 450) -> DataFrame:
    """Rows (product_id, body) of a variation form's JSON to a variant set."""
    p = payloads.select("product_id", form_read(F.col("body")).alias("vs")).where("size(vs) > 0")
    return p.select("product_id", F.lit(seq).alias("seq"), F.lit("woo-variation-form").alias("source"), form_variants_of(F.col("vs"), F.col("product_id")).alias("variants"))
