import pytest
from pyspark.sql import functions as F

from merchloom.functions import html
from merchloom.operators import catalog, export, extract, merge, validate
from merchloom.schema import PRODUCT, VARIANT, ExportOptions, columns_of, field_names
from merchloom.sources import payloads, robots
from merchloom.streaming import jobs


def offers(spark, *rows):
    return spark.createDataFrame([("p", f, i, s, v) for i, (f, s, v) in enumerate(rows)], "product_id string, field string, seq int, source string, value string")


def test_merge_fold(spark):
    got = {r.field: r for r in merge.merge_offers(offers(spark, ("title", "html", "A"), ("title", "jsonld", "B"), ("title", "microdata", "C"), ("kind", "heuristic", "variable"), ("sku", "html", " "), ("price", "html", "10"), ("price", "jsonld", "10.0"), ("price", "html", "11"))).collect()}
    assert (got["title"].value, got["title"].source, got["title"].other_value) == ("B", "jsonld", "C")
    assert (got["kind"].value, got["kind"].other_value) == ("variable", None)
    assert "sku" not in got
    assert (got["price"].value, got["price"].source, got["price"].other_value) == ("10", "jsonld", "11")


def test_guarded_offers_fill_gaps_only(spark):
    first, late = offers(spark, ("title", "html", "A"), ("price", "html", "0")), offers(spark, ("title", "user", "Z"), ("price", "user", "5"), ("brand", "html", "B"))
    got = {r.field: r.value for r in merge.merge_guarded(first, late).collect()}
    assert got == {"title": "A", "price": "5", "brand": "B"}


def document(spark, **fields):
    row = {"id": "1", "ordinal": 1, "title": "T", "kind": "simple", "source_url": "https://s.com/1", "source_platform": "shopify", "stock_status": "unknown", "status": "unknown", "category_path": "C", "options": [], "attributes": [], "variants": [], "images": [], "tags": [], "provenance": {}, "extraction_notes": []} | fields
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {t}" for k, t in _types(row).items()))
    full = spark.createDataFrame([], PRODUCT)
    return full.unionByName(df, allowMissingColumns=True)


def _types(row):
    known = columns_of(PRODUCT)
    return {k: known[k] for k in row}


def variant(**v):
    return tuple(v.get(n) for n in field_names(VARIANT))


def candle(spark):
    from decimal import Decimal

    v = variant(id="v1", parent_id="1", position=1, options=[], sku="C-1", price=Decimal("18.5"), compare_at_price=Decimal("24"), inventory_quantity=7, weight=310.0, weight_unit="g", stock_status="in_stock", currency="USD")
    return document(spark, variants=[v])


def test_lone_variant_is_hoisted_for_one_target(spark):
    headers, rows = export.build(candle(spark), ExportOptions(profile="woocommerce-default"))
    cells = dict(zip(headers, rows.collect()[0].cells, strict=True))
    assert (cells["Regular price"], cells["Sale price"], cells["Stock"], cells["SKU"], cells["Weight (kg)"], cells["Type"]) == ("24", "18.5", "7", "C-1", "0.31", "simple")
    assert len(export.SHOPIFY_HEADERS) == 49 and len(export.SHOPIFY_MODERN_HEADERS) == 46 and len(export.WOO_HEADERS) == 39
    headers, rows = export.build(candle(spark), ExportOptions())
    cells = dict(zip(headers, rows.collect()[0].cells, strict=True))
    assert (cells["Option1 Name"], cells["Option1 Value"], cells["Variant Price"], cells["Variant Grams"], cells["Status"]) == ("Title", "Default Title", "18.50", "310", "active")


def test_nothing_to_export_is_an_error(spark, tmp_path):
    bare = document(spark, title=None)
    issues = validate.validate(bare, "shopify")
    codes = {r.code for r in issues.collect()}
    assert {"VAL-01", "VAL-02", "VAL-03", "VAL-06"} <= codes
    headers, rows, _ = export.export(bare, issues, ExportOptions())
    with pytest.raises(ValueError, match="nothing to export"):
        export.write_csv(headers, rows, str(tmp_path / "x"))


def test_csv_round_trip(spark, tmp_path):
    headers, rows = export.build(candle(spark), ExportOptions())
    export.write_csv(headers, rows, str(tmp_path / "out"), one_file=True)
    raw = (tmp_path / "out").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfHandle,") and raw.count(b"\r\n") == 2
    assert export.safe_file_name("a/b:c.csv", "x") == "a-b-c.csv" and export.safe_file_name("con", "x") == "con-export.csv" and export.safe_file_name(" . ", "x") == "x.csv"
    assert export.free_name({"a.csv", "a (2).csv"}, "a.csv", "t") == "a (3).csv"


def test_broken_rule_is_a_finding(spark):
    rule = validate.Rule("mine", "Mine", lambda target: [F.col("no_such_column")])
    assert [r.code for r in validate.validate(candle(spark), "shopify", [rule]).where("code = 'VAL-49'").collect()] == ["VAL-49"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /private/ok\n# x\nUser-agent: evil\nDisallow: /"
    files = spark.createDataFrame([("https://s.com", text)], "origin string, text string")
    urls = spark.createDataFrame([(u,) for u in ("https://s.com/private/x", "https://s.com/private/ok/1", "https://s.com/", "https://t.com/private")], "url string")
    got = {r.url: r.allowed for r in robots.permitted(urls, robots.parse_robots(files, "Good/1")).collect()}
    assert list(got.values()) == [got[u] for u in got] and got["https://s.com/private/x"] is False and got["https://s.com/private/ok/1"] and got["https://s.com/"] and got["https://t.com/private"]


def test_selectors_and_sanitiser():
    doc = html.parse("<ul><li class='a b'>1<li>2<li data-x='Foo'>3</ul><p>x<p id=q>y &amp; z<br><script>var a='<b>'</script>")
    ids = lambda s: [n.text for n in doc.select(s)]
    assert ids("li") == ["1", "2", "3"] and ids("li.a.b") == ["1"] and ids("li:nth-child(2n+1)") == ["1", "3"] and ids("[data-x=foo i]") == ["3"] and ids("li + li:not(:last-child)") == ["2"] and ids("#q") == ["y & z"] and ids("ul > li:first-child, p:has(br)") == ["1", "y & z"] and ids("li:unknown") == []
    clean, text, stripped, images = html.sanitise("<div onclick='x()'><script>1</script><p>Hi <a href='javascript:1'>a</a><img src='/i.png'></p><blink>b</blink></div>", "https://s.com/p/")
    assert "onclick" not in clean and "script" not in clean and 'src="https://s.com/i.png"' in clean and stripped and images == ["https://s.com/i.png"] and "b" in text


def test_extraction_layers(spark):
    page = """<html><head><meta property="og:title" content="Og"><meta property="product:price:amount" content="12,50"><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Ld","sku":"S1","offers":{"price":"13.00","priceCurrency":"EUR","availability":"https://schema.org/InStock"}},]}</script></head><body><h1>Head</h1></body></html>"""
    pages = spark.createDataFrame([(1, "https://s.com/a", page), (2, "https://s.com/b", None)], "page_id int, url string, html string")
    merged, _ = extract.extract(pages)
    got = {r.field: (r.value, r.source) for r in merged.where("product_id = '1'").collect()}
    assert got["title"] == ("Ld", "jsonld") and got["price"] == ("13.0", "jsonld") and got["currency"] == ("EUR", "jsonld") and got["stockStatus"] == ("in_stock", "jsonld") and got["sku"] == ("S1", "jsonld")
    out = {r.product_id: r.error_code for r in extract.outcome(merged, pages).collect()}
    assert out == {"1": None, "2": "NO_PRODUCT"}


def test_shop_payload(spark):
    body = '{"product":{"id":9,"title":"Tee","handle":"tee","price":4999,"options":[{"name":"Size"}],"variants":[{"id":1,"option1":"S","price":4999,"available":true,"grams":200},{"id":2,"option1":"M","price":5999,"compare_at_price":6999,"available":false}]}}'
    made, sets = payloads.shop_product(spark.createDataFrame([("a", body), ("b", "<html>")], "product_id string, body string"))
    got = {r.field: r.value for r in made.collect()}
    vs = sets.collect()[0].variants
    assert got["price"] == "49.99" and got["kind"] == "variable" and [float(v.price) for v in vs] == [49.99, 59.99] and vs[0].weight_unit == "g" and vs[1].stock_status == "out_of_stock"


def test_url_import_and_upsert(spark):
    texts = spark.createDataFrame([(1, "https://a.bc/x, a.bc/x\nnope;https://a.bc/y?utm_x=1")], "ordinal int, text string")
    assert [r.state for r in catalog.import_urls(texts).orderBy("pos").collect()] == ["added", "duplicate", "invalid", "added"]
    assert catalog.import_urls(texts.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 7).alias("url_id"), F.col("id").alias("seq"), F.element_at(F.array(*map(F.lit, ("start", "ok", "warn", "error", "reset"))), (F.col("id") * 13 % 5 + 1).cast("int")).alias("event"), F.lit(None).cast("string").alias("error"))
    rows.withColumn("url_id", F.col("url_id").cast("string")).repartitionByRange(4, "seq").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = jobs.url_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in")))
    seen: dict = {}

    def collect(df, _):
        seen.update({r.url_id: (r.state, r.attempts) for r in df.collect()})

    stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(collect).start().awaitTermination()
    batch = {r.url_id: (r.state, r.attempts) for r in jobs.url_states_batch(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert seen == batch
