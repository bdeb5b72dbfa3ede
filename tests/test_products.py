"""Pages to documents, stored and fetched data, and paths, on rows of our own."""

import json

import pytest
from pyspark.sql import functions as F

from merchloom.functions import html
from merchloom.operators import export, extract, paths, products, validate
from merchloom.schema import ExportOptions
from merchloom.sources import fetch
from merchloom.streaming import jobs

LD = {"@type": "ProductGroup", "name": "Lamp", "description": "<p>Warm <b>light</b></p>", "image": ["https://s.com/i/a_300x300.jpg", {"url": "/i/b.jpg"}], "variesBy": ["https://schema.org/color"], "hasVariant": [{"sku": "L1", "color": "Red", "image": "https://s.com/i/a.jpg?v=2", "offers": {"price": "19.00", "priceCurrency": "EUR", "availability": "InStock"}}, {"sku": "L2", "color": "Blue", "offers": [{"priceCurrency": "EUR", "availability": "PreOrder"}]}]}
FORM = [{"variation_id": 5, "attributes": {"attribute_pa_color": "Red"}, "display_price": 21, "display_regular_price": 30, "sku": "F1", "is_in_stock": True, "max_qty": 3, "image": {"src": "/placeholder-x.png"}}, {"variation_id": 6, "attributes": {"attribute_pa_color": "Blue"}, "display_price": 22, "display_regular_price": 22, "is_in_stock": False}]
SHOP = f"""<html><head><meta property="og:title" content="Og lamp"><script type="application/ld+json">{json.dumps(LD)}</script></head><body class="woocommerce postid-77"><h1 class="product_title">Lamp</h1>
<form class="variations_form" data-product_variations='{json.dumps(FORM)}'><table class="variations"><tr><th><label>Colour</label></th><td><select name="attribute_pa_color" data-attribute_name="attribute_pa_color"><option value="">-</option><option value="Red">Red</option></select></td></tr></table></form>
<table class="woocommerce-product-attributes"><tr><th>Weight</th><td>2,5 kg</td></tr><tr><th>Dimensions</th><td>10 x 20.5 x 30 cm</td></tr><tr><th>Material</th><td>Brass, Glass</td></tr></table></body></html>"""
PLAIN = "<html><head><meta name='description' content='What it is.'></head><body><h1>Stool</h1><div class='price'>$ 12.50</div><main><img src='/i/stool.jpg'><img src='/logo.png'></main></body></html>"


@pytest.fixture(scope="module")
def docs(spark):
    pages = spark.createDataFrame([(1, "https://s.com/lamp?utm_source=x", SHOP), (2, "https://s.com/stool", PLAIN), (3, "https://s.com/none", None), (4, "https://s.com/deep", "<div>" * 3000 + "<h1>Deep</h1>")], "page_id int, url string, html string")
    known = spark.createDataFrame([("https://s.com/stool", "old-1"), ("https://s.com/stool", "old-2")], "normalized_url string, id string")
    return products.pages_to_products(pages, existing=known).cache()


def test_page_to_document(docs):
    by = {r.product_id: r for r in docs.collect()}
    lamp = by["1"]
    assert (lamp.title, lamp.kind, lamp.source_platform, lamp.source_product_id, lamp.ok) == ("Lamp", "variable", "woocommerce", "77", True)
    # the form's set is the stronger one; what it lacks comes from structured data, by option value where axes agree
    assert [(v.sku, float(v.price), v.stock_status, [tuple(o) for o in v.options]) for v in lamp.variants] == [("F1", 21.0, "in_stock", [("Colour", "Red")]), (None, 22.0, "out_of_stock", [("Colour", "Blue")])]
    assert float(lamp.variants[0].compare_at_price) == 30.0 and lamp.provenance["variants"].source == "woo-variation-form"
    assert (lamp.weight, lamp.weight_unit, lamp.length, lamp.width, lamp.height, lamp.dimension_unit) == (25.0, "kg", 10.0, 20.5, 30.0, "cm")
    assert [(a.name, a["values"]) for a in lamp.attributes] == [("Material", ["Brass", "Glass"])]
    assert [i.url for i in lamp.images] == ["https://s.com/i/a_300x300.jpg", "https://s.com/i/b.jpg"] and lamp.featured_image_url == "https://s.com/i/a_300x300.jpg"
    assert lamp.description_html == "<p>Warm <b>light</b></p>" and any("weaker source" in n for n in lamp.extraction_notes)
    stool = by["2"]
    assert (stool.id, stool.title, float(stool.price), stool.currency, stool.kind) == ("old-1", "Stool", 12.5, "USD", "simple")
    assert [i.url for i in stool.images] == ["https://s.com/i/stool.jpg"] and stool.provenance["featuredImageUrl"].confidence == "medium" and any("search engines" in n for n in stool.extraction_notes)
    assert (by["3"].ok, by["3"].error_code) == (False, "NO_PRODUCT") and by["4"].title == "Deep"


def test_extracted_documents_can_be_checked_and_exported(docs):
    good = docs.where("ok").drop("product_id", "ok", "error_code", "looks_like_product", "page_chars")
    codes = {(r.code, r.product_id == "old-1") for r in validate.validate(good, "woocommerce").select("code", "product_id").collect()}
    assert ("VAL-04", True) in codes and ("VAL-07", True) not in codes
    headers, rows = export.build(good, ExportOptions(profile="woocommerce-default"))
    kinds = sorted(r.cells[headers.index("Type")] for r in rows.collect())
    assert kinds == ["simple", "simple", "variable", "variation", "variation"]


def test_variants_of_structured_data_alone(spark):
    page = f"<html><head><script type='application/ld+json'>{json.dumps(LD)}</script></head><body></body></html>"
    row = products.pages_to_products(spark.createDataFrame([(1, "https://s.com/lamp", page)], "page_id int, url string, html string")).first()
    assert [(v.sku, v.stock_status, v.price is None, v.image_url) for v in row.variants] == [("L1", "in_stock", False, "https://s.com/i/a_300x300.jpg"), ("L2", "preorder", True, None)]
    assert [(o.name, o["values"]) for o in row.options] == [("Color", ["Red", "Blue"])] and row.images[0].variant_ids == [row.variants[0].id] and row.kind == "variable"


def test_pages_as_a_stream(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://s.com/{i}", PLAIN) for i in range(6)], "page_id int, url string, html string")
    pages.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        jobs.collect_pages(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).select("source_url", "title").collect()
    assert sorted(r.source_url for r in out) == [f"https://s.com/{i}" for i in range(6)] and {r.title for r in out} == {"Stool"}


def test_a_layer_that_fails_is_a_note(spark):
    def bad(doc, url):
        raise KeyError("x")

    pages = spark.createDataFrame([(1, "https://s.com/a", PLAIN)], "page_id int, url string, html string")
    rows = extract.page_offers(pages, layers=[("bad", bad, False), *extract.LAYERS]).collect()
    assert [r.value for r in rows if r.field == "note"] == ["Layer bad failed: KeyError"] and any(r.field == "title" for r in rows)


def test_deep_markup_is_no_limit():
    deep = "<div>" * 5000 + "<p>x</p>" + "</div>" * 5000
    assert html.to_text(deep) == "x" and html.sanitise(deep)[1] == "x" and html.parse(deep).text == "x"


FETCHER = """
def answer(url):
    if "bad" in url:
        raise OSError("no route")
    return {"status": 404 if "gone" in url else 200, "content_type": "image/png" if url.endswith("png") else "text/html", "body": f"<h1>{url}</h1>"}
"""


def test_fetching(spark, tmp_path):
    (tmp_path / "a_fetcher.py").write_text(FETCHER)
    spark.sparkContext.addPyFile(str(tmp_path / "a_fetcher.py"))
    import a_fetcher

    urls = ["https://a.b/1", "https://a.b/gone", "https://a.b/x.png", "https://a.b/bad"]
    got = {r.url: r for r in fetch.fetch_pages(spark.createDataFrame([(u,) for u in urls], "url string"), a_fetcher.answer).collect()}
    assert got[urls[0]].body == "<h1>https://a.b/1</h1>" and (got[urls[1]].status, got[urls[1]].ok) == (404, False) and got[urls[2]].body == "" and got[urls[3]].status == 0
    spark.dataSource.register(fetch.PageSource)
    read = spark.read.format("pages").option("urls", "\n".join(urls)).option("partitions", "3").option("fetcher", "a_fetcher:answer").load()
    assert sorted((r.url, r.status) for r in read.collect()) == sorted((u, {1: 404, 3: 0}.get(i, 200)) for i, u in enumerate(urls))


def test_stored_data(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.range(5).select("id")
    fetch.replace_table(rows, at)
    fetch.replace_table(spark.read.parquet(at).where("id > 2"), at)
    assert spark.read.parquet(at).count() == 2 and spark.read.parquet(f"{at}.bak").count() == 5
    (tmp_path / "c.json").write_text('[{"a": 1}, {"a"')
    (tmp_path / "c.bak").write_text('[{"a": 1}, {"a": 2}]')
    found = lambda p, b=None: sorted(r.a for r in fetch.read_collection(spark, str(tmp_path / p), "a int", b and str(tmp_path / b)).collect())
    assert found("c.json", "c.bak") == [1, 2] and found("none.json") == [] and found("c.bak") == [1, 2]
    assert fetch.settings_over('{"max_retries": 5, "x": 1, "concurrency": "many"}').max_retries == 5 and fetch.settings_over("{").max_retries == 2
    robots = spark.createDataFrame([("https://a.b", "Disallow: /", 200), ("https://c.d", "x", 500)], "origin string, text string, status int")
    urls = spark.createDataFrame([("https://a.b/1",), ("https://c.d/1",), ("https://e.f/1",)], "url string")
    assert sorted((r.url, r.robots) for r in fetch.with_robots(urls, robots).collect()) == [("https://a.b/1", "Disallow: /"), ("https://c.d/1", None), ("https://e.f/1", None)]
    pics = spark.createDataFrame([("p", "u1"), ("p", "u2"), ("p", "u3")], "product_id string, url string")
    seen = spark.createDataFrame([("u1", 200, "image/png"), ("u2", 404, "text/html")], "url string, status int, content_type string")
    assert [r.problem for r in fetch.probed(pics, seen).orderBy("url").collect()] == [None, "The picture answers with status 404.", None]


def test_paths(spark):
    rows = spark.createDataFrame([("1", [("v1", "a"), ("v2", "b")], ("t",)), ("2", [], None)], "id string, variants array<struct<id:string,sku:string>>, seo struct<title:string>")
    out = paths.write_path(paths.write_path(rows, "1", "variants[v2].sku", "c"), "2", "seo.title", "x")
    got = [(r.a, r.b) for r in out.select(paths.read_path("variants[v2].sku").alias("a"), paths.read_path("seo.title").alias("b")).collect()]
    assert got == [("c", "t"), (None, None)]
    for path in ("nothing", "seo.nothing", "variants[v1].nothing"):
        assert paths.write_path(rows, "1", path, 1).collect() == rows.collect()


def test_a_broken_column_is_an_empty_cell(spark):
    """One that can't be resolved is empty everywhere, one that fails on a value in that row; the session stays strict."""
    rows = spark.createDataFrame([(1, None, "7"), (0, "x", "seven")], "a int, b string, c string")
    cells = export.safe_cells(rows, [F.col("a"), F.col("no_such"), F.col("b"), F.col("c").cast("int"), F.lit(8) / F.col("a")])
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert [r.cells for r in cells.orderBy("c").collect()] == [["1", "", "", "7", "8.0"], ["0", "", "x", "", ""]]
