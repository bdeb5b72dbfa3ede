"""Pages from a growing queue, one file from many tasks, tables in buckets, table functions, variants' offers."""

import os
import time

import pytest
from pyspark.sql import functions as F

from merchloom.functions import text as tf
from merchloom.operators import catalog, export, merge, paths, structured, table_functions
from merchloom.schema import PRODUCT, PROVENANCE, VARIANT, columns_of, struct_of
from merchloom.sources import buckets, fetch, one_file, queue

FETCHER = """
def answer(url):
    with open(CALLS, "a") as f:
        f.write(url + chr(10))
    if "bad" in url:
        raise OSError("no route")
    return {"status": 200, "content_type": "text/html", "body": "<h1>" + url + "</h1>"}
"""


def test_lines_between(tmp_path):
    """Whatever the ranges, each line comes once; one that isn't ended doesn't count yet."""
    at = str(tmp_path / "q")
    assert queue.whole_lines(at) == 0
    lines = [f"https://s.e/{'x' * (i % 7)}{i}" for i in range(200)] + ["é" * 70_000]
    with open(at, "w") as f:
        f.write("\n".join(lines) + "\n\nhalf")
    end = queue.whole_lines(at)
    assert end == os.path.getsize(at) - 4
    for step in (1, 17, 5000, end):
        if step == 1:
            ranges = [(a, a + 1) for a in range(0, 400)] + [(400, end)]
        else:
            ranges = [(a, min(end, a + step)) for a in range(0, end, step)]
        assert [x for a, b in ranges for x in queue.lines_between(at, a, b, 0)] == lines


def test_page_queue(spark, tmp_path):
    """The queue grows between runs; started again from its checkpoint, the stream asks for nothing twice."""
    calls = tmp_path / "calls"
    (tmp_path / "queue_fetcher.py").write_text(FETCHER.replace("CALLS", repr(str(calls))))
    spark.sparkContext.addPyFile(str(tmp_path / "queue_fetcher.py"))
    at = tmp_path / "queue"

    def run():
        s = queue.page_stream(spark, str(at), "queue_fetcher:answer", 3)
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.url, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    at.write_text("https://s.e/1\nhttps://s.e/2\nhttps://s.e/bad\nhttps://s.e/un")
    first = [("https://s.e/1", 200), ("https://s.e/2", 200), ("https://s.e/bad", 0)]
    assert run() == first
    with at.open("a") as f:
        f.write("ended\nhttps://s.e/1\n")
    assert run() == sorted([*first, ("https://s.e/1", 200), ("https://s.e/unended", 200)])
    assert run() == run()
    assert len(calls.read_text().splitlines()) == 5


def test_one_file(spark, tmp_path):
    """Byte for byte what one task would write; a job that fails leaves nothing, and nothing is overwritten unasked."""
    lines = spark.range(1000).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("line")).repartition(7).orderBy("id")
    lines.coalesce(1).select("line").write.option("lineSep", "\r\n").text(f"{tmp_path}/one")
    whole = next((tmp_path / "one").glob("part-*")).read_bytes()
    one_file.write_lines(lines.select("line"), f"{tmp_path}/file", "\r\n")
    assert (tmp_path / "file").read_bytes() == whole and sorted(os.listdir(tmp_path)) == ["file", "one"]
    with pytest.raises(Exception, match="there already"):
        one_file.write_lines(lines.select("line"), f"{tmp_path}/file")
    one_file.write_lines(lines.select("line").limit(0), f"{tmp_path}/file", overwrite=True)
    assert (tmp_path / "file").read_bytes() == b""
    broken = lines.select(F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("line")).alias("line"))
    with pytest.raises(Exception, match="broken"):
        one_file.write_lines(broken, f"{tmp_path}/never")
    assert sorted(os.listdir(tmp_path)) == ["file", "one"]


def test_export_in_order(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("ordinal"), F.lit(0).alias("idx"), F.array(F.concat(F.lit("a,"), F.col("id").cast("string")), F.lit("=x")).alias("cells")).repartition(6)
    export.write_csv(["A", "B"], rows, f"{tmp_path}/x.csv", one_file=True)
    assert (tmp_path / "x.csv").read_bytes() == b"\xef\xbb\xbfA,B\r\n" + b"".join(f"\"a,{i}\",'=x\r\n".encode() for i in range(300))
    assert sorted((r.A, r.B) for r in export.read_csv(spark, f"{tmp_path}/x.csv").collect())[0] == ("a,0", "'=x")


def test_buckets(spark, tmp_path):
    """Only touched buckets are written anew: files of the others keep their names."""
    at = f"{tmp_path}/t"
    rows = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit("old").alias("v"))
    buckets.write_buckets(rows, at, "id", 16)
    files = lambda: {d: sorted(f for f in os.listdir(f"{at}/{d}") if f.startswith("part")) for d in os.listdir(at) if d.startswith("bucket=")}
    before = files()
    assert len(before) == 16 and all(len(f) == 1 for f in before.values())
    changes = spark.createDataFrame([(5, "new", 2, "x"), (5, "newer", 3, "x"), (5000, "more", 1, "x"), (None, "none", 1, "x")], "id long, v string, seq int, other string")
    touched = buckets.upsert_buckets(changes, at, "id", 16)
    after = files()
    assert 1 <= len(touched) <= 3 and {d for d in before if before[d] != after[d]} == {f"bucket={b}" for b in touched}
    got = {r.id: r.v for r in buckets.read_buckets(spark, at).collect()}
    assert len(got) == 1001 and (got[5], got[5000], got[None], got[6]) == ("newer", "more", "none", "old")
    assert buckets.upsert_buckets(changes.limit(0), at, "id", 16) == [] and files() == after


def test_replaced_tables(spark, tmp_path):
    at = f"{tmp_path}/t"
    fetch.replace_table(spark.range(3), at)
    fetch.replace_table(spark.range(4), at)
    fetch.replace_table(spark.range(5), at)
    assert (fetch.read_table(spark, at).count(), spark.read.parquet(f"{at}.bak").count()) == (5, 4) and not os.path.exists(f"{at}.old")
    os.rename(at, f"{at}.bak2")  # a crash between the renames, the new table not whole
    assert fetch.read_table(spark, at).count() == 4
    os.rename(at, f"{at}.bak")
    spark.range(6).write.parquet(f"{at}.tmp")
    assert fetch.read_table(spark, at).count() == 6
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        fetch.read_table(spark, f"{at}/none")


def test_faults_of_a_collection_are_told(spark, tmp_path):
    assert fetch.read_collection(spark, f"{tmp_path}/none", "a int").count() == 0
    with pytest.raises(Exception, match="(?i)no filesystem|scheme|nosuch"):
        fetch.read_collection(spark, "nosuch://x/y", "a int")


def test_headers(spark):
    row = spark.range(1).select(fetch.lower_headers(F.create_map(F.lit("A-b"), F.lit("1"), F.lit("a-B"), F.lit("2"), F.lit("c"), F.lit(None))).alias("h")).first()
    assert row.h == {"a-b": "2", "c": None}


def test_schedule_with_arrivals(spark):
    """Against a lane walked one by one, on a host of several blocks."""
    rows = [(i, "h" if i % 5 else "k", (i * 7919) % 3_000_000) for i in range(9000)]
    got = {r.id: r.start_ms for r in catalog.schedule(spark.createDataFrame(rows, "id long, host string, at long"), "host", "id", 500, "at").collect()}
    free = {"h": 0, "k": 0}
    for i, host, at in rows:
        start = max(free[host], at)
        free[host] = start + 500
        assert got[i] == start


def test_table_functions(spark):
    def mine(doc, url):
        return [("title", "html", doc.first("h1").text), ("blank", "html", " ")]

    table_functions.register(spark, {"mine": mine})
    pages = spark.createDataFrame([("a", "u", "<h1>x</h1>"), (None, None, "<p>"), ("c", "u", None)], "name string, url string, html string")
    ask = lambda layer: spark.sql(f"SELECT * FROM layer_offers(TABLE({{pages}}) PARTITION BY (name), '{layer}')", pages=pages)
    got = ask("mine")
    assert got.schema.simpleString() == "struct<name:string,seq:int,field:string,source:string,value:string>"
    assert sorted(((r.name or ""), r.field, r.value) for r in got.collect()) == [("", "note", "Layer mine failed: AttributeError"), ("a", "title", "x"), ("c", "note", "Layer mine failed: AttributeError")]
    with pytest.raises(Exception, match="no layer 'other'"):
        ask("other")
    with pytest.raises(Exception, match="columns url and html"):
        spark.sql("SELECT * FROM layer_offers(TABLE({pages}), 'mine')", pages=pages.select("name"))
    table_functions.register(spark)
    rows = spark.createDataFrame([(1.5, "k"), (2.5, "k"), (0.5, "k"), (9.0, None)], "id double, key string")
    found = spark.sql("SELECT * FROM first_owner(TABLE({rows}) PARTITION BY (key) ORDER BY (id), 'X')", rows=rows)
    assert sorted(map(tuple, found.collect())) == [(1.5, 0.5, "X"), (2.5, 0.5, "X")]


def document(spark, **values):
    kinds = columns_of(PRODUCT)
    return spark.range(1).select(*[values.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def test_variant_offers(spark):
    variant = lambda ident, **known: struct_of(VARIANT, {"id": F.lit(ident)} | {n: F.lit(v) for n, v in known.items()})
    stamp = F.struct(F.lit("shopify-product-json").alias("source"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("struct<other_source:string,other_value:string>").alias("conflict"))
    doc = document(spark, id=F.lit("p"), variants=F.array(variant("a", price=5, stock_status="unknown"), variant("b", price=7, sku="B")), provenance=F.create_map(F.lit("variants[b].price"), stamp, F.lit("title"), stamp).cast(PROVENANCE))
    offers = spark.createDataFrame([
        ("p", "a", "price", 2, "html", "5.00"), ("p", "a", "price", 1, "jsonld", "6"), ("p", "a", "stockStatus", 1, "html", "in_stock"), ("p", "b", "price", 1, "jsonld", "8"), ("p", "b", "sku", 1, "html", " "), ("p", "b", "sku", 2, "heuristic", "B"), ("p", "b", "weight", 1, "html", "no number"), ("p", "none", "price", 1, "user", "1"), ("q", "a", "price", 1, "user", "1"), ("p", "a", "no_such", 1, "user", "1"),
    ], "product_id string, variant_id string, field string, seq int, source string, value string")
    out = merge.with_variant_offers(doc, offers).cache()
    row = out.first()
    a, b = row.variants
    assert (float(a.price), a.stock_status, float(b.price), b.sku, b.weight) == (6.0, "in_stock", 7.0, "B", None)
    told = {k: (p.source, p.confidence, p.conflict and tuple(p.conflict)) for k, p in row.provenance.items()}
    assert told["variants[a].price"] == ("jsonld", "high", ("html", "5.00")) and told["variants[a].stockStatus"][0] == "html"
    assert told["variants[b].price"] == ("shopify-product-json", "high", ("jsonld", "8")) and told["variants[b].sku"][0] == "heuristic" and "title" in told and "variants[none].price" not in told
    assert out.select(paths.read_path("provenance[variants[a].price].source"), paths.read_path("variants[a].price")).first()[0] == "jsonld"
    assert "variants[b].price" in [r.field for r in catalog.trace(out).collect()]
    assert merge.with_variant_offers(doc, offers.limit(0)).collect() == doc.collect() and out.columns == doc.columns


def test_places_in_paths(spark):
    doc = document(spark, id=F.lit("p"), images=F.array(F.struct(F.lit("u").alias("url"), F.lit(1).alias("position"), *[F.lit(None).alias(n) for n in ("alt", "title", "width", "height", "is_featured", "variant_ids", "source")])))
    changed = paths.write_path(doc, "p", "images.0.alt", "front")
    assert changed.select(paths.read_path("images.0.alt"), paths.read_path("images.3.alt")).first() == ("front", None)
    for path in ("images.0.none", "nothing.0.alt", "title.0.alt"):
        assert paths.write_path(doc, "p", path, "x").collect() == doc.collect()


LD = """<script type='application/ld+json'>{broken</script><SCRIPT type=application/ld+json>[{"@type":"WebPage","mainEntity":{"@graph":[{"@type":["Thing","Product"],"name":[" Big  lamp"],"sku":12,"brand":{"@value":"B"},"gtin8":"8","gtin13":13.5,"image":{"url":"/a.jpg"},"offers":{"@type":"AggregateOffer","lowPrice":1.50,"highPrice":"9","offers":[{"price":2,"priceCurrency":"EUR"}]}}]}},]</SCRIPT>"""


def test_structured_data_in_the_jvm(spark):
    pages = spark.createDataFrame([(1, LD), (2, None), (3, "<p>"), (4, '<script type="application/ld+json">{"@type":"Product","name":true,"offers":null,"hasVariant":"x"}</script>')], "page_id int, html string")
    got = structured.structured_products(pages)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    by = {r.page_id: r for r in got.collect()}
    assert set(by) == {1, 4}
    lamp = by[1]
    assert (lamp.title, lamp.sku, lamp.brand, lamp.gtin, lamp.images, lamp.price_min, lamp.price_max) == ("Big lamp", "12", "B", "13.5", ["/a.jpg"], "1.5", "9")
    assert [tuple(o) for o in lamp.offers] == [("2", "EUR", None)] and lamp.variants == []
    assert by[4].title is None


def test_words(spark):
    said = {"google.customLabel0": "google custom label0", "variants[v.1].pricePerUnit": "price per unit", "title": "title", "seo.metaDescription": "seo meta description"}
    rows = spark.createDataFrame([(k,) for k in said], "k string").select("k", tf.friendly_field(F.col("k")).alias("f")).collect()
    assert {r.k: r.f for r in rows} == said
    day = 86_400_000
    ages = {0: "just now", 50_000: "50 seconds ago", 90_000: "2 minutes ago", -90_000: "in 1 minute", -120_000: "in 2 minutes", day: "yesterday", -day: "tomorrow", 8 * day: "last week", 20 * day: "3 weeks ago", 31 * day: "last month", -400 * day: "next year", 800 * day: "2 years ago", 7_200_000: "2 hours ago", -3_600_000: "in 1 hour"}
    rows = spark.createDataFrame([(k,) for k in ages], "k long").select("k", tf.relative_time(F.timestamp_millis(F.lit(10**12)), F.timestamp_millis(F.col("k") + 10**12)).alias("f")).collect()
    assert {r.k: r.f for r in rows} == ages
    words = spark.createDataFrame([(5,), (1500,), (61_500,)], "k long").select(tf.duration_words(F.col("k"))).collect()
    assert [r[0] for r in words] == ["5 ms", "1.5 s", "1 min 1 s"]


def test_log_sink(spark, tmp_path):
    from merchloom.streaming import jobs

    spark.createDataFrame([("info", "a"), ("debug", "b"), ("error", "c")], "level string, text string").write.json(f"{tmp_path}/in")
    for _ in range(2):
        jobs.log_sink(spark.readStream.schema("level string, text string").json(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        time.sleep(0.1)
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "c"]
