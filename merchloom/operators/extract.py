"""Extraction: fetched pages to offers, layer by layer, and the whole path from page to product fields."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import SLICE, Node, parse, sanitise
from ..functions.text import content_hash
from ..functions.url import normalize_url

OFFER = "product_id string, field string, seq int, source string, value string, note string"
DETECT_CHARS = 400_000
# Headers of a shop platform's answers.
SHOP_HEADERS = ("x-shopid", "x-shopify-stage", "x-sorting-hat-shopid")
MOST_DEPTH, MOST_IMAGES = 8, 30
#: Shorter pages load the rest later.
SHORT_PAGE = 2000
#: What Catalyst reads of a page before its tree is built.
PAGE_FACTS = ("platform", "product", "hash", "chars")
# Words of which, in lower case, a page with a sign or a mark has one: looked for first, as that takes a fraction of the sign's time.
WORDS = {
    "shopify": ("shop",), "woocommerce": ("woocommerce", "variations_form", "wc_add_to_cart_params", "wc-ajax"), "wordpress-generic": ("wp-content", "wp-includes", "wp-json", "wordpress", "api.w.org"),
    "bigcommerce": ("bigcommerce",), "magento": ("magento_", "mage/", "static/version"), "squarespace": ("squarespace",),
}
# Signs of platforms in a page's first characters, and their weights.
SIGNS = {
    "shopify": ((r"(?i)cdn\.shopify\.com|cdn/shop/(files|products)", 3), (r"Shopify\.(theme|shop|currency|routes)", 4), (r"ShopifyAnalytics", 3), (r'(?i)<script[^>]*src="[^"]*shopify', 2), (r'<meta[^>]*name="shopify-checkout-api-token"', 4)),
    "woocommerce": (
        (r'(?i)<body[^>]*class="[^"]*woocommerce', 4), (r"(?i)wp-content/plugins/woocommerce", 4), (r'class="[^"]*(variations_form|woocommerce-product-gallery)', 4), (r"(?i)woocommerce_params|wc_add_to_cart_params|wc-ajax", 3), (r'(?i)<meta[^>]*name="generator"[^>]*content="[^"]*WooCommerce', 5),
    ),
    "wordpress-generic": ((r"(?i)wp-content|wp-includes|wp-json", 3), (r'(?i)<meta[^>]*name="generator"[^>]*content="[^"]*WordPress', 3), (r'<link[^>]*rel="https://api\.w\.org/"', 2)),
    "bigcommerce": ((r"(?i)cdn\d*\.bigcommerce\.com|bigcommerce\.com/s-", 5),),
    "magento": ((r"(?i)Magento_|mage/|static/version\d+/frontend", 5),),
    "squarespace": ((r"(?i)static1\.squarespace\.com|Static\.SQUARESPACE_CONTEXT", 5),),
}


def detect_platform(html: Column, headers: Column | None = None) -> Column:
    """platform and score (0 to 1) by weighted signs; ties go to the earlier platform.

    headers: the answer's headers, names in lower case; a shop platform's own ones weigh most. The signs are looked for once.
    """
    own = F.lit(0) if headers is None else F.when(F.exists(F.map_keys(headers), lambda k: F.lower(k).isin(*SHOP_HEADERS)), 5).otherwise(0)

    def scored(x: Column) -> Column:
        score = lambda p: F.when(_any_of(x["low"], WORDS[p]), sum((F.when(x["head"].rlike(sign), w).otherwise(0) for sign, w in SIGNS[p]), F.lit(0))).otherwise(0)
        return F.struct(*[(score(p) + own if p == "shopify" else score(p)).alias(p) for p in SIGNS])

    def told(raw: Column) -> Column:
        mine = {p: raw[p] for p in SIGNS}
        mine["wordpress-generic"] = F.when(mine["woocommerce"] > 0, 0).otherwise(mine["wordpress-generic"])
        best = F.greatest(*mine.values())
        name = F.when(best <= 0, "unknown")
        for p, s in mine.items():
            name = name.when(s == best, p)
        return F.struct(F.coalesce(name, F.lit("unknown")).alias("platform"), F.least(F.lit(1.0), best / 8).alias("score"))

    head = F.substring(html, 1, DETECT_CHARS)
    return F.element_at(F.transform(F.transform(F.array(F.struct(head.alias("head"), F.lower(head).alias("low"))), scored), told), 1)


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the table lies in fewer files than there are cores; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def looks_like_product(html: Column) -> Column:
    """Whether a page shows one product, by any of several marks."""
    marks = {'"@type"': r'"@type"\s*:\s*"?Product', 'property="og:type"': r'property="og:type"[^>]*content="product"', "product:price:amount": r'property="product:price:amount"', 'class="': r'class="[^"]*\b(variations_form|single-product|product-single|product__info)\b', "<form": r'<form[^>]*class="[^"]*\bcart\b'}
    found = F.lower(html).contains("schema.org/product") & html.rlike(r'(?i)itemtype="[^"]*schema\.org/Product')
    for word, mark in marks.items():
        found = found | (html.contains(word) & html.rlike(mark))
    return found | (html.contains('"variants"') & F.substring(html, 1, 3000).rlike(r"/products/[^/?#]+") & html.rlike(r'"variants"\s*:'))


def needs_render(chars: Column, product: Column, thin: Column, mode: str = "auto") -> Column:
    """Whether a page is to be opened in a browser, by its length, whether it looks like a product's, and what it gave."""
    return F.lit(True) if mode == "always" else F.lit(False) if mode == "never" else thin | ~product | (chars < SHORT_PAGE)


def _clean(s: str | None) -> str | None:
    s = " ".join((s or "").replace("\xa0", " ").split())
    return s or None


def _meta(doc: Node, *selectors: str) -> str | None:
    """First of some selectors with a content, value or text that is not blank."""
    for sel in selectors:
        for n in doc.select(sel):
            if (v := _clean(n.attr("content") or n.attr("value") or n.text)) is not None:
                return v
    return None


Offers = list[tuple[str, str, object]]


def _pictures(source: str, urls: list, base: str) -> Offers:
    """Picture addresses, absolute and each once, as one reading."""
    whole = list(dict.fromkeys(urljoin(base, u.strip()) for u in urls if isinstance(u, str) and u.strip()))
    return [("images", source, json.dumps(whole))] if whole else []


def meta_layer(doc: Node, url: str) -> Offers:
    """Title, description, price and identifiers that the head tells."""
    first: dict[tuple[str, str], str] = {}
    for by in ("property", "name"):
        for n in doc.select(f"meta[{by}]"):
            if (v := _clean(n.attr("content") or n.attr("value") or n.text)) is not None:
                first.setdefault((by, n.attrs[by]), v)
    og = lambda *names: next((first["property", n] for n in names if ("property", n) in first), None)
    name = lambda n: first.get(("name", n))
    out: Offers = []
    title, description = _meta(doc, "title"), name("description")
    out += [("seo.title", "html" if title else "opengraph", title or og("og:title")), ("seo.ogTitle", "opengraph", og("og:title")), ("seo.metaDescription", "html", description), ("seo.description", "html", description), ("seo.ogDescription", "opengraph", og("og:description")), ("seo.robots", "html", name("robots"))]
    link = doc.first('link[rel="canonical"]')
    out += [("seo.canonicalUrl", "html", link.attr("href") if link else None), ("seo.ogImage", "opengraph", og("og:image"))]
    out += [("seo.keywords", "html", ", ".join(dict.fromkeys(k.strip() for k in (name("keywords") or "").split(",") if k.strip())) or None)]
    out += [("title", "opengraph", og("og:title")), ("title", "html", _meta(doc, "h1")), ("descriptionText", "heuristic", description or og("og:description"))]
    out += [("price", "opengraph", og("product:price:amount", "og:price:amount")), ("currency", "opengraph", og("product:price:currency", "og:price:currency")), ("salePrice", "opengraph", og("product:sale_price:amount")), ("stockText", "opengraph", og("product:availability", "og:availability"))]
    out += [("brand", "opengraph", og("product:brand", "og:brand")), ("sku", "opengraph", og("product:retailer_item_id", "product:sku")), ("vendor", "heuristic", og("og:site_name"))]
    plain = {"gtin": "gtin", "mpn": "mfr_part_no", "gender": "gender", "ageGroup": "age_group", "color": "color", "size": "size", "material": "material", "itemGroupId": "item_group_id", "productTypeString": "category", "googleProductCategory": "google_product_category"}
    out += [(f"google.{f}", "opengraph", og(f"product:{p}")) for f, p in plain.items()] + [("google.brand", "opengraph", og("product:brand")), ("google.condition", "opengraph", og("product:condition"))]
    out += _pictures("opengraph", [n.attr("content") for n in doc.select('meta[property="og:image"]')], url)
    return out + [(f"google.customLabel{i}", "opengraph", og(f"product:custom_label_{i}")) for i in range(5)]


def microdata_layer(doc: Node, url: str) -> Offers:
    scope = doc.first('[itemtype*="schema.org/Product" i]')
    if scope is None:
        return []
    prop = lambda n: next((v for x in scope.select(f'[itemprop="{n}"]') if (v := _clean(x.attr("content") or x.attr("href") or x.attr("src") or x.text))), None)
    gtin = next((v for n in ("gtin", "gtin13", "gtin12", "gtin14", "gtin8") if (v := prop(n))), None)
    d = scope.first('[itemprop="description"]')
    html, text, _, _ = sanitise(d.inner(), url) if d else (None, None, False, [])
    fields = {"title": prop("name"), "sku": prop("sku"), "brand": prop("brand"), "google.brand": prop("brand"), "google.mpn": prop("mpn"), "google.gtin": gtin, "barcode": gtin, "price": prop("price"), "currency": prop("priceCurrency"), "stockSchema": prop("availability"), "ratingValue": prop("ratingValue"), "reviewCount": prop("reviewCount"), "descriptionHtml": html, "descriptionText": text}
    seen = [x.attr("src") or x.attr("content") or x.attr("href") for x in scope.select('[itemprop="image"]')]
    return [(f, "microdata", v) for f, v in fields.items()] + _pictures("microdata", seen, url)


def json_ld_nodes(doc: Node) -> list[dict]:
    """Objects of all ld+json blocks, containers opened to a bounded depth; broken blocks get a second chance or nothing."""
    out: list[dict] = []

    def collect(v: object, depth: int) -> None:
        if depth > MOST_DEPTH:
            return
        if isinstance(v, list):
            for x in v:
                collect(x, depth + 1)
        elif isinstance(v, dict):
            out.append(v)
            for k in ("@graph", "mainEntity", "mainEntityOfPage", "itemListElement", "item", "about"):
                if k in v:
                    collect(v[k], depth + 1)

    for n in doc.select('script[type="application/ld+json"]'):
        for text in (n.raw, re.sub(r",\s*([}\]])", r"\1", re.sub(r"<!--|-->", "", n.raw))):
            try:
                collect(json.loads(text), 0)
                break
            except ValueError:
                continue
    return out


def _types(v: dict) -> list[str]:
    t = v.get("@type")
    return [str(x) for x in (t if isinstance(t, list) else [t]) if x]


def _text(v: object) -> str | None:
    """Text of a value in any of its usual shapes."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (str, int, float)):
        return _clean(str(v))
    if isinstance(v, list):
        return _text(v[0]) if v else None
    return next((t for k in ("name", "@value", "value", "url") if (t := _text(v.get(k)))), None)


def _images(v: object) -> list[str]:
    """Addresses in an image member: a text, a list, or objects with a url."""
    if isinstance(v, list):
        return [u for x in v for u in _images(x)]
    if isinstance(v, dict):
        return _images(v.get("url") or v.get("contentUrl"))
    return [v] if isinstance(v, str) and v else []


def json_ld_layer(doc: Node, url: str) -> Offers:
    nodes = json_ld_nodes(doc)
    p = next((n for n in nodes if "ProductGroup" in _types(n)), None) or next((n for n in nodes if "Product" in _types(n)), None)
    if p is None:
        return []
    gtin = next((t for k in ("gtin13", "gtin12", "gtin14", "gtin8", "gtin") if (t := _text(p.get(k)))), None)
    raw = p.get("description")
    html, text, _, _ = sanitise(raw, url) if isinstance(raw, str) and re.search(r"<[a-z][\s\S]*>", raw, re.I) else (None, _text(raw), False, [])
    fields: dict[str, object] = {"title": _text(p.get("name")), "sourceProductId": _text(p.get("productID")), "sku": _text(p.get("sku")), "brand": _text(p.get("brand")), "vendor": _text(p.get("brand")), "google.brand": _text(p.get("brand")), "google.gtin": gtin, "barcode": gtin, "google.mpn": _text(p.get("mpn")), "descriptionHtml": html, "descriptionText": text, "sourceProductType": _text(p.get("category"))}
    fields |= {f"google.{k}": _text(p.get(k)) for k in ("color", "material", "pattern", "size")} | {"google.itemGroupId": _text(p.get("productGroupID") or p.get("inProductGroupWithID"))}
    rating = p.get("aggregateRating")
    if isinstance(rating, dict):
        fields |= {"ratingValue": _text(rating.get("ratingValue")), "reviewCount": _text(rating.get("reviewCount") or rating.get("ratingCount"))}
    weight = p.get("weight")
    if isinstance(weight, dict):
        fields |= {"weight": _text(weight.get("value")), "weightUnitCode": _text(weight.get("unitCode") or weight.get("unitText"))}
    out: Offers = [(f, "jsonld", v) for f, v in fields.items()]
    offers = p.get("offers")
    offers = offers if isinstance(offers, list) else [offers] if isinstance(offers, dict) else []
    group = next((o for o in offers if isinstance(o, dict) and "AggregateOffer" in _types(o)), None)
    if group:
        low, high = _text(group.get("lowPrice")), _text(group.get("highPrice"))
        out += [("priceMin", "jsonld", low), ("priceMax", "jsonld", high), ("currency", "jsonld", _text(group.get("priceCurrency")))]
        out += [("kind", "heuristic", "variable")] if low and high and low != high else []
        inner = group.get("offers")
        offers = inner if isinstance(inner, list) else [inner] if isinstance(inner, dict) else []
    offers = [o for o in offers if isinstance(o, dict)]
    if len(offers) == 1:
        o = offers[0]
        out += [(f, "jsonld", _text(o.get(k))) for f, k in (("price", "price"), ("currency", "priceCurrency"), ("stockSchema", "availability"), ("sku", "sku"), ("google.conditionText", "itemCondition"), ("externalUrl", "url"))]
    elif offers:
        prices = sorted(float(x) for o in offers if (x := _text(o.get("price"))) and re.fullmatch(r"\d+(\.\d+)?", x))
        out += [("currency", "jsonld", _text(offers[0].get("priceCurrency")))] + ([("priceMin", "jsonld", prices[0]), ("priceMax", "jsonld", prices[-1])] if prices else [])
    variants = [v for v in (p.get("hasVariant") or []) if isinstance(v, dict)]
    if variants:
        varies = [str(x).rsplit("/", 1)[-1] for x in (p.get("variesBy") if isinstance(p.get("variesBy"), list) else [p.get("variesBy")]) if x] or ["color", "size", "material", "pattern"]

        def variant(v: dict, i: int) -> dict:
            offer = v.get("offers")
            offer = offer[0] if isinstance(offer, list) and offer else offer if isinstance(offer, dict) else {}
            options = [{"name": a[:1].upper() + a[1:], "value": t} for a in varies if (t := _text(v.get(a)))]
            return {"position": i, "sku": _text(v.get("sku")), "gtin": next((t for k in ("gtin13", "gtin12", "gtin14", "gtin8", "gtin") if (t := _text(v.get(k)))), None), "options": options, "price": _text(offer.get("price")), "currency": _text(offer.get("priceCurrency")), "availability": _text(offer.get("availability")), "image_url": next(iter(_images(v.get("image"))), None)}

        out += [("kind", "jsonld", "variable"), ("variants", "jsonld", json.dumps([variant(v, i + 1) for i, v in enumerate(variants)], sort_keys=True))]
    out += _pictures("jsonld", _images(p.get("image")), url)
    return [*out, ("seo.canonicalUrl", "jsonld", _text(p.get("url"))), ("allowReviews", "heuristic", "true" if p.get("review") or rating else None)]


def shop_page_layer(doc: Node, url: str) -> Offers:
    """A product JSON that the page itself holds; Catalyst reads it as it reads the endpoint's."""
    for n in doc.select('script[type="application/json"]'):
        if "product" in (n.attr("id") or "").lower() or '"variants":' in n.raw:
            try:
                v = json.loads(n.raw)
            except ValueError:
                continue
            v = v.get("product", v) if isinstance(v, dict) else {}
            if isinstance(v.get("variants"), list) and (v.get("title") or v.get("handle")):
                return [("shopJson", "embedded-json", json.dumps(v, sort_keys=True))]
    return []


def store_page_layer(doc: Node, url: str) -> Offers:
    """A rendered store page: title, descriptions, prices, stock, table of attributes, categories, tags, external button."""
    if doc.first("form.variations_form, .woocommerce div.product, .woocommerce-product-gallery, body.woocommerce, div.product") is None:
        return []
    out: Offers = [("sourcePlatform", "html", "woocommerce"), ("title", "html", _meta(doc, "h1.product_title", ".product_title"))]
    for field, sel in (("shortDescription", ".woocommerce-product-details__short-description"), ("description", "#tab-description, .woocommerce-Tabs-panel--description")):
        if (n := doc.first(sel)) is not None:
            html, text, _, _ = sanitise(n.inner(), url)
            out += [(f"{field}Html", "html", html), (f"{field}Text", "html", text)]
    box = doc.first(".summary .price, p.price, .price")
    if box is not None:
        old, new = box.first("del"), box.first("ins")
        amount = lambda n: _clean(n.text) if n is not None else None
        out += [("price", "html", amount(new) or (amount(box) if old is None else None)), ("regularPrice", "html", amount(old)), ("salePrice", "html", amount(new)), ("compareAtPrice", "html", amount(old)), ("currencyText", "html", amount(box))]
    out += [("sku", "html", _meta(doc, ".sku")), ("stockText", "html", _meta(doc, ".stock"))]
    for row in doc.select(".woocommerce-product-attributes tr, table.shop_attributes tr"):
        label, value = (_clean(x.text) if (x := row.first(s)) is not None else None for s in ("th", "td"))
        key = (label or "").lower()
        if key == "weight":
            out += [("weightText", "html", value)]
        elif key == "dimensions":
            out += [("dimensionsText", "html", value)]
        elif label:
            out += [(f"attribute.{label}", "html", value)]
    out += _pictures("html", [n.attr("data-large_image") or n.attr("data-src") or n.attr("src") for n in doc.select(".woocommerce-product-gallery img")], url)
    labels, axes = {}, []
    for select in doc.select("table.variations select, form.variations_form select"):
        key = (select.attr("data-attribute_name") or select.attr("name") or select.attr("id") or "").lower().removeprefix("attribute_")
        row = select.closest("tr")
        label = _clean(x.text) if row is not None and (x := row.first("label, th")) is not None else None
        if key and label:
            labels[key] = label
        values = [v for o in select.select("option[value]") if (v := _clean(o.attr("value")))]
        if values:
            axes.append({"name": label or key, "values": values, "position": len(axes) + 1})
    out += [("formLabels", "html", json.dumps(labels) if labels else None), ("axes", "html", json.dumps(axes) if axes else None)]
    joined = lambda sel: ", ".join(x for n in doc.select(sel) if (x := _clean(n.text))) or None
    form = doc.first("form.variations_form[data-product_variations]")
    button = doc.first("form.cart[action] .single_add_to_cart_button, a.single_add_to_cart_button")
    out += [("sourceProductType", "html", joined(".posted_in a")), ("tags", "html", joined(".tagged_as a")), ("formJson", "woo-variation-form", form.attr("data-product_variations") if form else None)]
    out += [("externalUrl", "html", button.attr("href") if button is not None else None), ("externalButtonText", "html", _clean(button.text) if button is not None and button.attr("href") else None)]
    ident = doc.first("[name=add-to-cart][value], button[value].single_add_to_cart_button, [data-product_id]")
    body = re.search(r"\bpostid-(\d+)", (doc.first("body").attr("class") or "") if doc.first("body") else "")
    return [*out, ("sourceProductId", "embedded-json", (ident.attr("data-product_id") or ident.attr("value")) if ident else body[1] if body else None)]


# Where pages keep their descriptions and galleries, in the order in which they are tried.
GENERIC_TEXT = ("[itemprop=description]", ".product-description", ".product__description", "#description", ".description", "[class*=description]")
GENERIC_IMAGES = (".product-gallery img", ".product__media img", ".woocommerce-product-gallery img", "[class*=gallery] img", "[class*=product-image] img", ".product-images img", "[data-zoom-image]", "main img", "article img")


def generic_layer(doc: Node, url: str) -> Offers:
    """What is left to try on any page; it counts only where the layers before found nothing."""
    out: Offers = [("title", "html", _meta(doc, "h1")), ("price", "html", _meta(doc, "[class*=price]")), ("currencyText", "html", _meta(doc, "[class*=price]"))]
    for sel in GENERIC_TEXT:
        n = doc.first(sel)
        if n is not None and len(_clean(n.text) or "") >= 40:
            html, text, _, _ = sanitise(n.inner(), url)
            out += [("descriptionHtml", "html", html), ("descriptionText", "html", text)]
            break
    images: list[str] = []
    for sel in GENERIC_IMAGES:
        for n in doc.select(sel):
            src = n.attr("data-zoom-image") or n.attr("data-src") or n.attr("src")
            small = (n.attr("width") or "").isdigit() and int(n.attrs["width"]) < 150
            if src and not small and not re.search(r"logo|icon|sprite|payment|avatar|badge", src, re.I) and src not in images:
                images.append(src)
    return [*out, *_pictures("html", images[:MOST_IMAGES], url)]


#: Layers in their order; add (name, function, guarded) to extend them. A guarded layer's offers count only in gaps.
LAYERS: list[tuple[str, Callable[[Node, str], Offers], bool]] = [("meta", meta_layer, False), ("microdata", microdata_layer, False), ("jsonld", json_ld_layer, False), ("shop-page", shop_page_layer, False), ("store-page", store_page_layer, False), ("generic", generic_layer, True)]


def page_offers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", layers: list | None = None) -> DataFrame:
    """Raw readings of every page, all layers on one parsed tree: product_id, field, seq, source, value, note, guarded.

    What Catalyst reads of a page (platform, hash, length) comes along as fields "page.*"; a column headers (a map) helps to
    tell the platform. A page that cannot be parsed,
    or a layer that fails, gives a note and never ends the run.
    """
    chosen = layers or LAYERS
    names, text = ["product_id", "field", "seq", "source", "value", "note", "guarded"], pa.string()
    kinds = [text, text, pa.int32(), text, text, text, pa.bool_()]

    def read(pid: str, url: str, html: str | None) -> Iterator[tuple]:
        try:
            doc = parse(html)
        except Exception as e:
            yield (pid, "note", 0, "unavailable", f"The page could not be parsed: {type(e).__name__}", str(e)[:200], False)
            return
        for k, (name, layer, guarded) in enumerate(chosen):
            try:
                found = list(layer(doc, url))
            except Exception as e:  # one bad page or layer is a note, not an end
                yield (pid, "note", k * 100, "unavailable", f"Layer {name} failed: {type(e).__name__}", str(e)[:200], guarded)
                continue
            for i, (f, s, v) in enumerate(found):
                if v is not None and str(v).strip():
                    yield (pid, f, k * 100 + i, s, str(v), None, guarded)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                rows: list[tuple] = []
                for pid, url, html, *facts in zip(*[c.to_pylist() for c in whole.slice(at, SLICE).columns], strict=True):
                    rows += [(pid, f"page.{n}", -1, "page", v, None, False) for n, v in zip(("url", *PAGE_FACTS), (url, *facts), strict=True) if v is not None]
                    rows += read(pid, url or "", html)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    url, html = F.col(url_col), F.col(html_col)
    pages = spread(pages)
    facts = {"platform": detect_platform(html, F.col("headers") if "headers" in pages.columns else None)["platform"], "product": looks_like_product(html), "hash": content_hash(normalize_url(url), html), "chars": F.length(html)}
    rows = pages.select(F.col(id_col).cast("string").alias("id"), url.alias("url"), html.alias("html"), *[facts[n].cast("string").alias(n) for n in PAGE_FACTS])
    return rows.mapInArrow(run, f"{OFFER}, guarded boolean")


def extract(pages: DataFrame, endpoints: DataFrame | None = None, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Merged fields and variant sets of pages and their endpoints' answers; see products.extract."""
    from .products import extract as whole

    return whole(pages, endpoints, **columns)


def outcome(merged: DataFrame, pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row for each page: product_id, ok, error_code; a page without a title holds no product."""
    titled = merged.where("field = 'title'").select("product_id").distinct().withColumn("ok", F.lit(True))
    out = pages.select(F.col(id_col).cast("string").alias("product_id")).join(titled, "product_id", "left")
    return out.select("product_id", F.coalesce("ok", F.lit(False)).alias("ok"), F.when(F.col("ok").isNull(), "NO_PRODUCT").alias("error_code"))


def observed_variants(observations: DataFrame) -> DataFrame:
    """Rows (product_id, ord, selection, price, sku, availability_text, image_url) to one variant for each combination, first wins."""
    from ..functions.money import parse_money
    from ..functions.text import option_signature, stock_from_page

    keyed = observations.withColumn("signature", option_signature(F.col("selection"))).where("signature <> ''")
    one = keyed.groupBy("product_id", "signature").agg(F.min_by(F.struct("selection", "price", "sku", "availability_text", "image_url", "ord"), "ord").alias("o"))
    return one.select("product_id", "signature", F.col("o.ord").alias("ord"), F.col("o.selection").alias("options"), parse_money(F.col("o.price")).alias("price"), F.col("o.sku").alias("sku"), stock_from_page(F.col("o.availability_text")).alias("stock_status"), F.col("o.image_url").alias("image_url"))
