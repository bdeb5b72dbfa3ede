"""Findings of the third round: queries against their SQL on small tables of our own."""

from collections import Counter
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from merchloom.functions import html
from merchloom.operators import export, merge, products, validate, views
from merchloom.plans import domain
from merchloom.schema import PRODUCT, VARIANT, columns_of, struct_of


def differences(spark, folder, name, **tables):
    """Rows that only Spark and only DuckDB give, of a query over tables of rows and a schema."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    theirs = con.sql(__spark_entry__.oracle_sql()[name])
    ours = Counter(tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).select(*theirs.columns).collect())
    wanted = Counter(theirs.fetchall())
    return ours - wanted, wanted - ours


def test_layer_titles_decode_one_reference(spark, tmp_path):
    titles = ["A &amp; B", "says &quot;x&quot;", "cut off &amp", "a && b", "&amp;quot; &lt;"]
    pages = [(i, f"https://s.com/{i}", f"<html><head><title>{t}</title></head></html>") for i, t in enumerate(titles)]
    assert differences(spark, tmp_path, "layer_titles", pages=(pages, "page_id long, url string, html string")) == (Counter(), Counter())


def test_time_functions_sizes_past_a_megabyte(spark, tmp_path):
    orders = [(k, datetime(1997, 3, 1)) for k in (0, 1023, 1024, 1280, 1_048_575, 1_048_576, 9_000_000, 2_000_000_000)]
    assert differences(spark, tmp_path, "time_functions", orders=(orders, "o_orderkey long, o_orderdate timestamp")) == (Counter(), Counter())


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


def catalogue(n):
    """Parts, two lines each but for every tenth."""
    part = [(k, f"name {k}", f"Brand#{k % 5}", f"T{k % 3}", k % 50 + 1, 900.0 + k) for k in range(n)]
    lines = [(k * 3 + i, k, k % 7, k % 7 + 1, 1.0 + k % 9, 10.0 + i, 0.01 * (k % 10), 0.01 * (k % 8), "ARN"[k % 3], "OF"[i]) for k in range(n) if k % 10 for i in range(2)]
    return {"part": (part, PART), "lineitem": (lines, LINE)}


def test_issues_ordered_gives_all_findings(spark, tmp_path):
    assert differences(spark, tmp_path, "issues_ordered", **catalogue(1200)) == (Counter(), Counter())
    assert __spark_entry__.queries()["issues_ordered"](spark, str(tmp_path)).count() > 500


def test_places_over_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "(id * 7919) % 97 AS k").repartition(7)
    got = views.placed(rows, "k", "id").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 5001)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    assert views.placed(rows.where("id < 0"), "k").count() == 0


@pytest.mark.parametrize("name", ["structured_data", "inline_products"])
def test_pages_of_one_file_are_read_on_all_cores(spark, tmp_path, name):
    tables = {"part": catalogue(100)["part"]}
    assert differences(spark, tmp_path, name, **tables) == (Counter(), Counter())
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    before = got._jdf.queryExecution().optimizedPlan().toString().split("Repartition", 1)[1]
    assert "Filter" not in before  # blocks are parsed after the rows are dealt, by the filter too


def test_documents_are_made_in_as_many_tasks_as_lines_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(domain, "TASK_LINES", 50)
    tables = catalogue(400)
    assert differences(spark, tmp_path, "worst_severity", **tables) == (Counter(), Counter())
    assert domain.keyed_variants(spark, str(tmp_path)).rdd.getNumPartitions() == -(-len(tables["lineitem"][0]) // 50)


def test_texts_of_a_batch_are_made_in_slices(spark):
    pages = [(i, None if i % 7 == 0 else f"<p>a {i}</p><ul><li>b &amp; c</ul>") for i in range(3 * html.SLICE + 5)]
    got = spark.createDataFrame(pages, "id long, html string").coalesce(1).select("id", "html", html.html_to_text("html").alias("text")).collect()
    assert len(got) == len(pages) and all(r.text == html.to_text(r.html) for r in got)


PLAIN = ["<p>a", "<br/>", "<a href='x&amp;y' B=1 c>", "</a >", "&lt", "<!-- c -->", "<script>a < b</script>", "<script>'</p>'</script>", "<title>t &amp; u</title>", "<td width=100>", "<li>", "</ul>", "<!DOCTYPE html>"]
OTHER = ["<p a=\xa0>", "<p a=x/>", "a < b", "</>", "<!-->", "<!-- --!> -->", "<textarea><p></textarea>", "<title><b></title>", "</script", "<p a='1'b=2>", "<?x>", "<![CDATA[x]]>", "<script><!-- </script>", "<p"]


def test_plain_markup_gives_the_general_parsers_tree():
    def general(text):
        b = html._Builder()
        b.feed(text)
        b.close()
        return b.tree.root

    def told(n):
        return n.tag, tuple(n.attrs.items()), n.data, tuple(told(c) for c in n.children)

    assert all(html._plain_tree(x) is not None for x in PLAIN) and all(html._plain_tree(x) is None for x in OTHER)
    pages = [a + b + c for a in PLAIN + OTHER for b in PLAIN + OTHER for c in PLAIN]
    read = [(x, t) for x in pages if (t := html._plain_tree(x)) is not None]
    assert len(read) > 1000 and all(told(t) == told(general(x)) for x, t in read)


def calls(df, name):
    """How often a plan, optimised, names an expression."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_gallery_and_folds_name_their_input_once(spark):
    found = "array(named_struct('url','https://s.com/a_small.jpg','alt','x','position',1,'is_featured',false,'source','html','ord',1), named_struct('url','https://s.com/a.jpg','alt','y','position',2,'is_featured',true,'source','jsonld','ord',2))"
    df = spark.range(1).select(F.expr(found).cast(f"array<{products.FOUND}>").alias("found")).repartition(1)
    got = df.select(products.gallery(F.col("found")).alias("g"))
    assert [(x.url, x.alt, x.is_featured, x.source) for x in got.first().g] == [("https://s.com/a.jpg", "x", True, "jsonld")]
    assert calls(got, "lower(regexp_replace") == 1  # identities are made once for each picture


@pytest.mark.parametrize("name", ["store_pages", "microdata_products"])
def test_page_queries_give_duckdbs_rows(spark, tmp_path, name):
    assert differences(spark, tmp_path, name, part=catalogue(60)["part"]) == (Counter(), Counter())


def test_variant_offers_scan_the_lines_once_for_offers(spark, tmp_path):
    assert differences(spark, tmp_path, "variant_offers", **catalogue(120)) == (Counter(), Counter())
    got = __spark_entry__.queries()["variant_offers"](spark, str(tmp_path))
    assert calls(got, "l_linenumber") and got._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def test_numbers_are_the_same_value_in_any_form(spark):
    pairs = [("1", "1.0", True), (" 1", "1 ", True), ("1e2", "100", True), ("+.5", "0.5", True), ("1d", "1", True), ("x", "y", False), ("x", " x ", True), ("inf", "Infinity", False), ("NaN", "nan", False), ("-1", "1", False), ("0x1p3", "8", True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    plain = F.coalesce(F.abs(F.col("a").try_cast("double") - F.col("b").try_cast("double")) < 1e-9, F.lit(False)) | (F.trim("a") == F.trim("b"))
    assert [(r.s, r.p) for r in df.select(merge.same_value(F.col("a"), F.col("b")).alias("s"), plain.alias("p")).collect()] == [(w, w) for *_, w in pairs]


def test_rules_on_variants_are_evaluated_once_by_row(spark, tmp_path):
    assert differences(spark, tmp_path, "validation_all", **catalogue(120)) == (Counter(), Counter())
    docs = domain.products(spark, str(tmp_path))
    plan = validate.product_findings(docs, "shopify")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("The product mixes currencies") == 1  # no filter makes the findings once more
    found = validate.product_findings(docs, "shopify").orderBy("ordinal", "n").collect()
    of_one = [r.code for r in found if r.ordinal == 12]
    assert of_one == sorted(of_one)  # numbered in the order of the rules


def test_exported_rows_do_not_hold_all_variants(spark, tmp_path):
    row = spark.range(1).select(*[F.lit(None).cast(k).alias(n) for n, k in columns_of(PRODUCT).items()])
    some = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: struct_of(VARIANT, {"id": i.cast("string")}))
    docs = row.withColumn("variants", some).withColumn("images", F.array().cast(columns_of(PRODUCT)["images"]))
    for rows, n in ((export.shopify_rows(docs), 9), (export.woo_rows(docs), 10)):
        assert [(r.idx, r.held) for r in rows.select("idx", F.size("variants").alias("held")).orderBy("idx").collect()] == [(i, 2) for i in range(n)]
