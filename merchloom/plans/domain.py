"""The driver's tables seen as a catalogue: parts are products, line items their variants.

PRODUCTS and VARIANTS are plain SQL that Spark and DuckDB read alike; they only lay out test data, gaps and faults included.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PRODUCT, VARIANT, columns_of, struct_of

PRODUCTS = """
SELECT CAST(p_partkey AS STRING) AS id, CAST(p_partkey AS BIGINT) AS ordinal, 'p1' AS project_id, p_brand AS category_id,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS category_path, p_type AS source_product_type, p_brand AS brand,
  CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_name END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN 'h-' || CAST(p_partkey % 500 AS STRING) END AS handle,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN '<p><b><i><u><s><em>' || p_name ELSE '<p>' || p_name || '</p>' END AS description_html,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(18,6)) END AS price,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'USD' END AS currency,
  CASE WHEN p_partkey % 6 = 0 THEN 'P' || CAST(p_partkey % 300 AS STRING) END AS sku,
  CASE WHEN p_partkey % 13 = 0 THEN 'unknown' WHEN p_partkey % 17 = 0 THEN 'simple' WHEN p_partkey % 19 = 0 THEN 'external' ELSE 'variable' END AS kind,
  CAST(p_size AS DOUBLE) AS weight,
  CASE p_partkey % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'lbs' WHEN 3 THEN 'stone' ELSE NULL END AS weight_unit,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS length, CASE WHEN p_partkey % 2 = 0 THEN 'inches' END AS dimension_unit,
  CAST(p_partkey % 4 AS INT) AS n_images,
  'https://shop.example/p/' || CAST(p_partkey % 1500 AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN '?v=1' ELSE '' END AS source_url,
  CASE WHEN p_partkey % 10 = 0 THEN 'unknown' ELSE 'shopify' END AS source_platform,
  CASE WHEN p_partkey % 12 = 0 THEN 'NoIndex, follow' END AS robots, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS seo_title,
  CASE WHEN p_partkey % 4 = 1 THEN '0123' END AS gtin, CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS disputed,
  CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END AS guessed, CASE WHEN p_partkey % 14 = 0 THEN 1 ELSE 0 END AS guessed_image,
  CASE WHEN p_partkey % 15 = 0 THEN 'Some variations were left out.' END AS note,
  CASE WHEN p_partkey % 29 = 0 THEN 4 WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS n_axes
FROM {part}
"""
VARIANTS = """
SELECT CAST(l_partkey AS STRING) AS product_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS position,
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_suppkey AS STRING) AS id,
  CASE WHEN l_orderkey % 501 = 0 THEN '-1' ELSE CAST(l_partkey AS STRING) END AS parent_id,
  CASE WHEN l_linenumber = 6 AND l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag,
  CASE WHEN l_linenumber = 7 OR (l_linenumber = 6 AND l_orderkey % 5 = 0) THEN NULL ELSE l_linestatus END AS status,
  CASE WHEN l_linenumber = 6 THEN NULL WHEN l_orderkey % 97 = 0 THEN ' S' || CAST(l_suppkey AS STRING) ELSE 'S' || CAST(l_suppkey AS STRING) END AS sku,
  CASE WHEN l_orderkey % 211 = 0 THEN NULL WHEN l_orderkey % 199 = 0 THEN CAST(-1 AS DECIMAL(18,6)) ELSE CAST(l_extendedprice AS DECIMAL(18,6)) END AS price,
  CASE WHEN l_discount > 0.04 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + CAST((l_tax - 0.04) * 100 AS DECIMAL(18,2)) AS DECIMAL(18,6)) END AS compare_at_price,
  CASE WHEN l_orderkey % 307 = 0 THEN -CAST(l_quantity AS BIGINT) WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS inventory_quantity,
  CASE l_returnflag WHEN 'A' THEN 'in_stock' WHEN 'R' THEN 'out_of_stock' ELSE 'unknown' END AS stock_status,
  CASE WHEN l_orderkey % 401 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE WHEN l_linenumber = 1 THEN 'https://cdn.example/p-' || CAST(l_partkey AS STRING) || '-1.jpg' WHEN l_linenumber = 2 THEN 'https://cdn.example/other.jpg' END AS image_url,
  l_quantity AS weight, CASE WHEN l_linenumber = 3 THEN NULL ELSE 'g' END AS weight_unit, l_orderkey AS orderkey
FROM {lineitem}
"""
#: Image i of a product: the third is the first again under a query, and some first ones have no web address.
IMAGE_URL = "CASE WHEN ordinal % 23 = 0 AND i = 1 THEN 'ftp://cdn.example/x.jpg' WHEN i = 3 THEN 'https://cdn.example/p-' || id || '-1.jpg?big' ELSE 'https://cdn.example/p-' || id || '-' || CAST(i AS STRING) || '.jpg' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PRODUCTS, part=table(spark, sf_dir, "part"))


def flat_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VARIANTS, lineitem=table(spark, sf_dir, "lineitem"))


#: Line items whose documents one task makes; what a task holds then stays the same however large the table is.
TASK_LINES = 200_000


def keyed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants with their part's key, dealt by it over as many tasks as they need: what groups them needs no other shuffle."""
    lines = table(spark, sf_dir, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(lines.count() / TASK_LINES))
    return spark.sql(VARIANTS.replace("l_orderkey AS orderkey", "l_orderkey AS orderkey, l_partkey AS partkey"), lineitem=lines.repartition(tasks, "l_partkey"))


def options() -> "F.Column":
    return F.filter(F.array(F.struct(F.lit("Flag").alias("name"), F.col("flag").alias("value")), F.struct(F.lit("Status").alias("name"), F.col("status").alias("value"))), lambda o: o["value"].isNotNull())


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product documents: one shuffle of the variants by product."""
    own = ("id", "parent_id", "position", "sku", "price", "compare_at_price", "inventory_quantity", "stock_status", "currency", "image_url", "weight", "weight_unit")
    v = keyed_variants(spark, sf_dir).select("partkey", "position", struct_of(VARIANT, {c: F.col(c) for c in own} | {"options": options()}).alias("v"))
    sets = v.groupBy("partkey").agg(F.sort_array(F.collect_list(F.struct("position", "v"))).getField("v").alias("variants"))
    flat = flat_products(spark, sf_dir)
    flat = flat.join(sets, flat["ordinal"] == sets["partkey"], "left").drop("partkey")
    kinds = columns_of(PRODUCT)
    image = lambda i: F.struct(F.expr(IMAGE_URL.replace("i = ", f"{i} = ").replace("CAST(i ", f"CAST({i} ")).alias("url"), F.lit(i).alias("position"))
    images = F.slice(F.array(*[image(i) for i in (1, 2, 3)]), 1, F.col("n_images"))
    axes = F.slice(F.array(*[F.struct(F.lit(n).alias("name"), F.array().cast("array<string>").alias("values"), F.lit(i + 1).alias("position")) for i, n in enumerate(("Flag", "Status", "Size", "Cut"))]), 1, F.col("n_axes"))
    prov = lambda source, confidence, conflict: F.struct(F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("note"), conflict.alias("conflict"))
    none = F.lit(None).cast("struct<other_source:string,other_value:string>")
    entries = F.array(
        F.when(F.col("disputed") == 1, F.struct(F.lit("price").alias("key"), prov("jsonld", "high", F.struct(F.lit("html").alias("other_source"), F.lit("1").alias("other_value"))).alias("value"))),
        F.when(F.col("guessed") == 1, F.struct(F.lit("title").alias("key"), prov("heuristic", "low", none).alias("value"))),
        F.when(F.col("guessed_image") == 1, F.struct(F.lit("featuredImageUrl").alias("key"), prov("heuristic", "low", none).alias("value"))),
    )
    given = {
        "variants": F.coalesce("variants", F.array().cast(f"array<{VARIANT}>")), "images": F.transform(images, lambda x: struct_of(kinds["images"][6:-1], {"url": x["url"], "position": x["position"], "is_featured": F.lit(False)})), "options": axes, "attributes": F.array(), "tags": F.array().cast("array<string>"),
        "provenance": F.map_from_entries(F.array_compact(entries)), "extraction_notes": F.array_compact(F.array("note")), "seo": struct_of(kinds["seo"], {"title": F.col("seo_title"), "robots": F.col("robots"), "meta_description": F.col("title")}),
        "google": struct_of(kinds["google"], {"gtin": F.col("gtin"), "brand": F.col("brand"), "condition": F.lit("unknown"), "ads_labels": F.array().cast("array<string>")}), "stock_status": F.lit("unknown"), "status": F.lit("unknown"), "featured_image_url": F.when(F.col("n_images") >= 2, F.expr("'https://cdn.example/p-' || id || '-2.jpg'")),
    }
    return flat.select(*[given.get(n, F.col(n) if n in flat.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def cte(*names: str) -> str:
    """The same tables for DuckDB: p, v, img, vo and n, or those of them that are named."""
    tables = {
        "p": PRODUCTS.format(part="part"), "v": VARIANTS.format(lineitem="lineitem"),
        "img": f"SELECT id AS product_id, i, {IMAGE_URL} AS url FROM (SELECT *, unnest(range(1, n_images + 1)) AS i FROM p)",
        "vo": "SELECT *, concat_ws('|', 'flag=' || lower(flag), 'status=' || lower(status)) AS sig, coalesce(nullif(concat_ws(' / ', flag, status), ''), 'default') AS told FROM v",
        "n": "SELECT p.id, count(v.id) AS n FROM p LEFT JOIN v ON v.product_id = p.id GROUP BY p.id",
    }
    return ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in tables.items() if not names or name in names)
