"""Queries by name, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as hf
from ..functions import money as mf
from ..functions import text as tf
from ..functions import units as uf
from ..functions import url as urlf
from ..operators import catalog, export, extract, merge, validate
from ..schema import ExportOptions
from ..sources import robots
from ..streaming import jobs
from .domain import cte, flat_products, flat_variants, options, products, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- lists, counts, histories -------------------------------------------------------------------------------------
ISSUES = """i AS MATERIALIZED (
 SELECT id AS product_id, 'CRITICAL' AS severity FROM p WHERE title IS NULL UNION ALL
 SELECT p.id, 'ERROR' FROM p WHERE price IS NULL AND NOT EXISTS (SELECT 1 FROM v WHERE v.product_id = p.id AND v.price IS NOT NULL) UNION ALL
 SELECT id, 'WARNING' FROM p WHERE n_images = 0 UNION ALL SELECT id, 'WARNING' FROM p WHERE category_path IS NULL UNION ALL
 SELECT id, 'INFO' FROM p WHERE description_html IS NULL)"""
RANK = "CASE severity WHEN 'INFO' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'CRITICAL' THEN 3 END"
LABEL = "CASE {} WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'CRITICAL' END"


def required_issues(docs: DataFrame) -> DataFrame:
    """Findings of the required-fields rule alone, for the other target (no handle rule)."""
    rule = [r for r in validate.RULES if r.id == "required-fields"]
    return validate.product_findings(docs, "woocommerce", rule).withColumn("acknowledged", F.lit(False))


@query(f"WITH {cte()}, {ISSUES} SELECT p.id, title, kind, {LABEL.format('max(' + RANK + ')')} AS worst_severity, count(i.product_id) AS issue_count FROM p LEFT JOIN i ON i.product_id = p.id WHERE contains(lower(source_url), '/p/1') GROUP BY p.id, title, kind, ordinal ORDER BY ordinal LIMIT 100 OFFSET 10")
def product_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = products(spark, sf_dir)
    return catalog.product_list(catalog.product_index(docs), required_issues(docs), search="/P/1", limit=100, offset=10).select("id", "title", "kind", "worst_severity", "issue_count")


@query(f"WITH {cte()} SELECT p.id, (SELECT count(*) FROM v WHERE v.product_id = p.id) AS variant_count, n_images AS image_count, (SELECT count(*) FROM v WHERE v.product_id = p.id AND sku IS NOT NULL) + (CASE WHEN p.sku IS NULL THEN 0 ELSE 1 END) AS n_skus FROM p")
def product_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.product_index(products(spark, sf_dir)).select("id", F.col("variant_count").cast("long").alias("variant_count"), "image_count", F.size("skus").cast("long").alias("n_skus"))


@query("SELECT n_nationkey AS category_id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS url_count, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS product_count FROM nation")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))
    urls, prods = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("category_id")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("category_id"))
    return catalog.category_counts(cats, urls, prods).select("category_id", "name", "url_count", "product_count")


@query("SELECT c_custkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE r_name || ' > ' || n_name END AS category_path FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def category_path_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cats = n.select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 != 0, F.concat("r_name", F.lit(" > "), "n_name")).alias("path"))
    return catalog.with_category_path(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "category_id"), cats).select("c_custkey", "category_path")


STATE_OF = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'completed' WHEN 'click' THEN 'warning' WHEN 'error' THEN 'failed' ELSE 'skipped' END"


@query(f"SELECT s AS state, (SELECT count(*) FROM events WHERE {STATE_OF} = s) AS n FROM (SELECT unnest(['pending','processing','completed','warning','failed','retrying','skipped','paused']) AS s)")
def url_state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.url_histogram(table(spark, sf_dir, "events").withColumn("state", F.expr(STATE_OF)))


@query(f"SELECT user_id, count(*) FILTER (WHERE s = 'completed') AS completed, count(*) FILTER (WHERE s = 'warning') AS warned, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'skipped') AS skipped, count(*) AS total FROM (SELECT user_id, {STATE_OF} AS s FROM events) GROUP BY user_id")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.job_summary(table(spark, sf_dir, "events").withColumn("state", F.expr(STATE_OF)), "user_id").drop("message")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def last_n_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.last_rows(table(spark, sf_dir, "orders"), "o_orderkey", 50).select("o_orderkey", "o_orderstatus", "o_totalprice")


LEVEL_OF = "CASE event_type WHEN 'view' THEN 'debug' WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'info' END"


@query(f"SELECT event_id, {LEVEL_OF} AS level FROM events WHERE {LEVEL_OF} IN ('warn', 'error')")
def log_level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.level_at_least(table(spark, sf_dir, "events").withColumn("level", F.expr(LEVEL_OF)), "warn").select("event_id", "level")


@query(f"SELECT event_id, {LEVEL_OF} AS level FROM events ORDER BY event_id DESC LIMIT 3000")
def log_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.compact_log(table(spark, sf_dir, "events").withColumn("level", F.expr(LEVEL_OF)), "event_id", 3000).select("event_id", "level")


@query("SELECT user_id AS job_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_progress(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "event_type", "value"))


@query(f"WITH {cte()}, {ISSUES} SELECT (SELECT count(*) FROM p) AS products, (SELECT count(*) FROM v) AS variants, (SELECT count(*) FROM events) AS urls, (SELECT count(DISTINCT product_id) FROM i WHERE severity <> 'INFO') AS needs_review, (SELECT max(o_orderkey) FROM orders) AS last_export")
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = products(spark, sf_dir)
    one = docs.agg(F.count("*").alias("products"), F.sum(F.size("variants")).alias("variants"))
    urls = table(spark, sf_dir, "events").agg(F.count("*").alias("urls"))
    review = required_issues(docs).where("severity <> 'INFO'").agg(F.count_distinct("product_id").alias("needs_review"))
    last = table(spark, sf_dir, "orders").agg(F.max_by("o_orderkey", "o_orderkey").alias("last_export"))
    key = F.lit(1).alias("k")
    parts = [d.select(key, "*") for d in (one, urls, review, last)]  # each is one row
    out = parts[0]
    for d in parts[1:]:
        out = out.join(d, "k")
    return out.drop("k")


# ---- URLs ---------------------------------------------------------------------------------------------------------
def _sql_normal(u: str) -> str:
    part = lambda i: f"regexp_extract({u}, '^([hH][tT][tT][pP][sS]?)://([^/?#\\s]+)([^?#\\s]*)(\\?[^#\\s]*)?(#\\S*)?$', {i})"
    pairs = f"list_filter(string_split(regexp_replace({part(4)}, '^\\?', ''), '&'), lambda q: q <> '' AND NOT regexp_matches(lower(regexp_extract(q, '^([^=]*)', 1)), '^(utm_.*|gclid|fbclid|msclkid|mc_(cid|eid)|_ga|ref|referrer|srsltid|igshid|ttclid)$'))"
    query_ = f"array_to_string(list_sort({pairs}), '&')"
    path = f"regexp_replace({part(3)}, '/+$', '')"
    return f"'https://' || regexp_replace(lower({part(2)}), '^www\\.', '') || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query_} = '' THEN '' ELSE '?' || {query_} END"


@query(f"SELECT page_id, {_sql_normal('url')} AS normalized_url FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urlf.normalize_url(F.col("url")).alias("normalized_url"))


@query(f"SELECT page_id, n AS normalized_url FROM (SELECT page_id, {_sql_normal('url')} AS n FROM pages) QUALIFY row_number() OVER (PARTITION BY n ORDER BY page_id) = 1")
def url_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", urlf.normalize_url(F.col("url")).alias("normalized_url"))
    return urls.groupBy("normalized_url").agg(F.min("page_id").alias("page_id"))


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS path FROM pages")
def url_host_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urlf.host_of(F.col("url")).alias("host"), urlf.path_and_query(F.col("url")).alias("path"))


@query("SELECT page_id, k AS url_key FROM (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '')) AS k FROM pages) QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id) > 1")
def url_dup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "pages").select("page_id", urlf.duplicate_key(F.col("url")).alias("url_key"))
    first = keyed.groupBy("url_key").agg(F.min("page_id").alias("first"))
    return keyed.join(first, "url_key").where("page_id > first").select("page_id", "url_key")


@query(f"WITH r AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'not an address' FROM pages WHERE page_id % 10 = 0), x AS (SELECT page_id, url, CASE WHEN contains(url, ' ') THEN NULL ELSE {_sql_normal('url')} END AS n FROM r), s AS (SELECT CASE WHEN n IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY n ORDER BY page_id) = 1 THEN 'added' ELSE 'duplicate' END AS state FROM x) SELECT state, count(*) AS n FROM s GROUP BY state")
def url_import_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("url", F.when(F.col("page_id") % 10 == 0, "\nnot an address").otherwise(""))
    return catalog.import_urls(table(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), text.alias("text"))).groupBy("state").agg(F.count("*").alias("n"))


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/\nAllow: /en/*page\nDisallow: /*ref=x$\n"


@query("WITH t AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS t FROM pages) SELECT page_id, CASE WHEN greatest(CASE WHEN starts_with(t, '/en/') THEN 4 ELSE 0 END, CASE WHEN ends_with(t, 'ref=x') THEN 8 ELSE 0 END) = 0 THEN true ELSE (CASE WHEN regexp_matches(t, '^/en/.*page') THEN 9 ELSE 0 END) >= greatest(CASE WHEN starts_with(t, '/en/') THEN 4 ELSE 0 END, CASE WHEN ends_with(t, 'ref=x') THEN 8 ELSE 0 END) END AS allowed FROM t")
def robots_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    files = pages.select(urlf.origin_of(F.col("url")).alias("origin")).distinct().withColumn("text", F.lit(ROBOTS))
    return robots.permitted(pages, robots.parse_robots(files, "collector/1.0")).select("page_id", "allowed")


@query("SELECT page_id, (row_number() OVER (PARTITION BY lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) ORDER BY page_id) - 1) * 1200 AS start_ms FROM pages")
def host_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.schedule(table(spark, sf_dir, "pages").select("page_id", urlf.host_of(F.col("url")).alias("host")), "host", "page_id", 1200).select("page_id", "start_ms")


# ---- pages --------------------------------------------------------------------------------------------------------
@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\\s+', ' ', 'g')) AS h1 FROM pages")
def html_title_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda t: F.coalesce(tf.clean_text(F.regexp_extract("html", f"<{t}>([^<]*)</{t}>", 1)), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", tag("title").alias("title"), tag("h1").alias("h1"))


@query("WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS link, count(*) AS n FROM l GROUP BY 1, 2")
def html_links_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), 1)).alias("href"))
    return links.groupBy("page_id", urlf.absolute_url(F.col("href"), F.col("url")).alias("link")).agg(F.count("*").alias("n"))


@query("SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*')) AS opens, len(regexp_extract_all(html, '</[a-zA-Z][a-zA-Z0-9]*')) AS closes FROM pages")
def html_tag_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<[a-zA-Z][a-zA-Z0-9]*")).cast("long").alias("opens"), F.regexp_count("html", F.lit("</[a-zA-Z][a-zA-Z0-9]*")).cast("long").alias("closes"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#039;', ''''), '&apos;', ''''), '&nbsp;', ' ') AS decoded FROM pages")
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tf.decode_named(F.col("html")).alias("decoded"))


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", hf.html_to_text("html").alias("text"))


@query()
def html_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", hf.sanitise_html("html", "url").alias("s")).select("page_id", "s.*")


@query("SELECT page_id, len(regexp_extract_all(html, '<li><a ')) AS n_links FROM pages")
def html_select_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(hf.select_nodes("nav > ul li > a[href^='/']")("html")).cast("long").alias("n_links"))


@query()
def page_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))[0]


@query("SELECT page_id, 'unknown' AS platform, 0.0::DOUBLE AS score FROM pages")
def platform_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", extract.detect_platform(F.col("html")).alias("d")).select("page_id", "d.platform", F.col("d.score").cast("double").alias("score"))


@query("SELECT page_id, regexp_matches(html, '\"@type\"\\s*:\\s*\"?Product') AS is_product FROM pages")
def product_page_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", extract.looks_like_product(F.col("html")).alias("is_product"))


# ---- scalars ------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tf.clean_text(F.col("text")).alias("cleaned"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugify_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tf.slugify_ascii(F.concat("p_name", F.lit(" "), "p_brand")).alias("slug"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2))::DOUBLE AS price, CASE l_linenumber % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency FROM lineitem")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_extendedprice").cast("decimal(18,2)")
    us = F.format_number(d, 2)
    eu = F.translate(us, ",.", ".,")
    raw = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("$"), us)).when(F.col("l_linenumber") % 3 == 1, F.concat(eu, F.lit(" €"))).otherwise(F.concat(F.lit("GBP "), d.cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mf.parse_money(raw).alias("price"), mf.currency_from(raw).alias("currency"))


@query(f"WITH {cte()} SELECT id, floor(weight * (CASE weight_unit WHEN 'kg' THEN 1000.0 WHEN 'lbs' THEN 453.59237 WHEN 'stone' THEN NULL ELSE 1.0 END) * 1000 + 0.5) / 1000 AS grams, floor(length * (CASE dimension_unit WHEN 'inches' THEN 2.54 ELSE 1.0 END) * 1000 + 0.5) / 1000 AS centimetres FROM p")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_products(spark, sf_dir).select("id", uf.to_grams(F.col("weight"), F.col("weight_unit")).alias("grams"), uf.to_centimetres(F.col("length"), F.col("dimension_unit")).alias("centimetres"))


TOLD = "CASE event_type WHEN 'signup' THEN 'On backorder' WHEN 'view' THEN '3 in stock' WHEN 'click' THEN 'Sold out' WHEN 'error' THEN 'Preorder now' ELSE 'ask us' END"


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'on_backorder' WHEN 'view' THEN 'in_stock' WHEN 'click' THEN 'out_of_stock' WHEN 'error' THEN 'preorder' ELSE 'unknown' END AS stock FROM events")
def stock_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tf.stock_from_text(F.expr(TOLD)).alias("stock"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


ERROR_OF = "CASE event_type WHEN 'signup' THEN 'HTTP 404 for page' WHEN 'view' THEN 'getaddrinfo ENOTFOUND shop' WHEN 'click' THEN 'HTTP 503' WHEN 'error' THEN 'The operation was aborted' ELSE 'odd' END"
CODE_OF = "CASE event_type WHEN 'signup' THEN 'NOT_FOUND' WHEN 'view' THEN 'DNS_FAILED' WHEN 'click' THEN 'SERVER_ERROR' WHEN 'error' THEN 'TIMEOUT' ELSE 'UNKNOWN' END"


@query(f"SELECT event_id, {CODE_OF} AS code FROM events")
def humanise_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tf.error_code(F.expr(ERROR_OF)).alias("code"))


@query(f"SELECT event_id, CASE WHEN user_id % 4 < 2 AND {CODE_OF} IN ('SERVER_ERROR', 'TIMEOUT', 'UNKNOWN') THEN 'retrying' ELSE 'failed' END AS state, CAST(4000 * pow(2, user_id % 4) AS BIGINT) AS wait_ms FROM events")
def retry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = F.col("user_id") % 4
    return table(spark, sf_dir, "events").select("event_id", catalog.next_state(F.lit(False), F.lit(0), attempts, tf.error_code(F.expr(ERROR_OF)), 2).alias("state"), mf.retry_after_ms(F.lit(None).cast("string"), 4000, attempts).alias("wait_ms"))


@query("SELECT doc_id, CASE WHEN regexp_matches(s, '[\",\\r\\n]|^\\s|\\s$') THEN '\"' || replace(s, '\"', '\"\"') || '\"' ELSE s END AS cell FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS s FROM documents)")
def csv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tf.csv_cell(F.col("text")).alias("cell"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(u, '-\\d{2,4}x\\d{2,4}(\\.[a-zA-Z]{3,4})$', '\\1'), '^https?://(www\\.)?', '')) AS identity FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '$', '-300x200.jpg') AS u FROM pages)")
def image_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("-300x200.jpg?v=2"))
    return table(spark, sf_dir, "pages").select("page_id", urlf.image_identity(u).alias("identity"))


# ---- merge --------------------------------------------------------------------------------------------------------
OFFERS = """
SELECT p_partkey AS product_id, 'title' AS field, 0 AS seq, 'html' AS source, p_name AS value FROM {part} UNION ALL
SELECT p_partkey, 'title', 1, 'heuristic', p_brand FROM {part} WHERE p_partkey % 2 = 0 UNION ALL
SELECT p_partkey, 'title', 2, 'jsonld', CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_type ELSE ' ' END FROM {part} UNION ALL
SELECT p_partkey, 'title', 3, 'jsonld', p_brand FROM {part} WHERE p_partkey % 5 = 0 UNION ALL
SELECT p_partkey, 'kind', 0, 'heuristic', 'variable' FROM {part} UNION ALL
SELECT p_partkey, 'kind', 1, CASE WHEN p_partkey % 2 = 0 THEN 'html' ELSE 'heuristic' END, 'simple' FROM {part} UNION ALL
SELECT l_partkey, 'price', l_orderkey * 10 + l_linenumber, CASE l_linenumber WHEN 1 THEN 'opengraph' WHEN 2 THEN 'microdata' WHEN 3 THEN 'jsonld' WHEN 4 THEN 'woo-rest' ELSE 'platform-api' END, CAST(CAST(l_quantity AS BIGINT) AS STRING) FROM {lineitem}
"""
# The closed form of the fold: w is the first offer of the highest rank; the value is w's, and the other one is the last that
# differs after it, or else the best before it.
WON = f"""WITH o AS MATERIALIZED (SELECT *, CASE source WHEN 'heuristic' THEN 10 WHEN 'opengraph' THEN 25 WHEN 'html' THEN 30 WHEN 'microdata' THEN 35 WHEN 'jsonld' THEN 55 WHEN 'woo-rest' THEN 80 WHEN 'platform-api' THEN 80 ELSE 0 END AS r FROM ({OFFERS.format(part='part', lineitem='lineitem')}) WHERE trim(value) <> ''),
w AS MATERIALIZED (SELECT *, first_value(seq) OVER x AS wseq, first_value(value) OVER x AS wvalue, first_value(source) OVER x AS wsource FROM o WINDOW x AS (PARTITION BY product_id, field ORDER BY r DESC, seq)),
g AS (SELECT product_id, field, any_value(wvalue) AS value, any_value(wsource) AS source,
 arg_max(source, seq) FILTER (WHERE seq > wseq AND trim(value) <> trim(wvalue)) AS later_source, arg_max(value, seq) FILTER (WHERE seq > wseq AND trim(value) <> trim(wvalue)) AS later_value,
 arg_max(source, r * 1000000000000 - seq) FILTER (WHERE seq < wseq) AS before_source, arg_max(value, r * 1000000000000 - seq) FILTER (WHERE seq < wseq) AS before_value FROM w GROUP BY product_id, field)"""
MERGED = f"{WON} SELECT product_id, field, value, source, CASE WHEN later_source IS NOT NULL THEN later_source WHEN trim(before_value) <> trim(value) THEN before_source END AS other_source, CASE WHEN later_source IS NOT NULL THEN later_value WHEN trim(before_value) <> trim(value) THEN before_value END AS other_value FROM g"


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OFFERS, part=table(spark, sf_dir, "part"), lineitem=table(spark, sf_dir, "lineitem"))


@query(MERGED)
def merge_ranked_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_offers(offers(spark, sf_dir)).select("product_id", "field", "value", "source", "other_source", "other_value")


@query(f"{WON} SELECT product_id, field, value FROM g")
def merge_best_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.best_values(offers(spark, sf_dir))


@query("SELECT p_brand AS brand, string_agg(v, '|' ORDER BY o) AS types FROM (SELECT p_brand, first(p_type ORDER BY p_partkey) AS v, min(p_partkey) AS o FROM part GROUP BY p_brand, lower(p_type)) GROUP BY p_brand")
def merge_string_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("value"))
    return merge.union_strings(rows, ("brand",)).select("brand", F.array_join("values", "|").alias("types"))


VARIANT_SETS = f"WITH {cte()}, s AS (SELECT product_id, CASE WHEN orderkey % 3 = 0 THEN 'jsonld' WHEN orderkey % 3 = 1 THEN 'woo-rest' ELSE 'platform-api' END AS source, id, orderkey FROM v), g AS (SELECT product_id, source, min(orderkey) AS seq, count(*) AS n FROM s GROUP BY 1, 2) SELECT product_id, source, n FROM g QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY CASE source WHEN 'jsonld' THEN 55 ELSE 80 END DESC, seq) = 1"


@query(VARIANT_SETS)
def variant_set_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = flat_variants(spark, sf_dir).withColumn("source", F.expr("CASE WHEN orderkey % 3 = 0 THEN 'jsonld' WHEN orderkey % 3 = 1 THEN 'woo-rest' ELSE 'platform-api' END"))
    sets = v.groupBy("product_id", "source").agg(F.min("orderkey").alias("seq"), F.array_sort(F.collect_list(F.struct(F.col("position").cast("int").alias("position"), "id"))).alias("variants"))
    return merge.replace_variant_sets(sets).select("product_id", "source", F.size("variants").cast("long").alias("n"))


@query(f"WITH {cte()}, cur AS (SELECT * FROM vo WHERE orderkey % 2 = 0), inc AS (SELECT product_id, sig, arg_min(sku, position) AS sku, arg_min(price, position) AS price FROM vo WHERE orderkey % 2 = 1 AND sig <> '' GROUP BY 1, 2), f AS (SELECT product_id, sig, first(sku ORDER BY position) AS sku, first(price ORDER BY position) AS price FROM vo WHERE orderkey % 2 = 1 AND sig <> '' GROUP BY 1, 2) SELECT cur.id, coalesce(cur.sku, f.sku) AS sku, coalesce(cur.price, f.price)::DOUBLE AS price FROM cur LEFT JOIN f ON f.product_id = cur.product_id AND f.sig = cur.sig")
def variant_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = flat_variants(spark, sf_dir).withColumn("options", options()).withColumn("source_variant_id", F.lit(None).cast("string"))
    return merge.fill_variant_gaps(v.where("orderkey % 2 = 0"), v.where("orderkey % 2 = 1"), ("sku", "price")).select("id", "sku", F.col("price").cast("double").alias("price"))


@query(f"WITH {cte()} SELECT id, sig AS signature FROM vo")
def option_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_variants(spark, sf_dir).select("id", tf.option_signature(options()).alias("signature"))


@query(f"WITH {cte()}, e AS (SELECT product_id, 'Flag' AS name, flag AS value, position * 2 AS o FROM v WHERE flag IS NOT NULL UNION ALL SELECT product_id, 'Status', status, position * 2 + 1 FROM v WHERE status IS NOT NULL), d AS (SELECT product_id, name, value, min(o) AS o FROM e GROUP BY 1, 2, 3) SELECT product_id, name, string_agg(value, '|' ORDER BY o) AS values_seen FROM d GROUP BY 1, 2")
def options_from_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = products(spark, sf_dir).where("size(variants) > 0")
    return docs.select(F.col("id").alias("product_id"), F.explode(merge.option_definitions(F.col("variants"))).alias("o")).select("product_id", "o.name", F.array_join("o.values", "|").alias("values_seen"))


@query(f"WITH {cte()} SELECT p.id, CASE WHEN kind IN ('grouped', 'external') THEN kind WHEN n > 1 AND n_axes > 0 THEN 'variable' WHEN n <= 1 THEN 'simple' ELSE 'variable' END AS kind FROM p JOIN n USING (id)")
def kind_finalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("id", merge.final_kind(F.col("kind"), F.col("variants"), F.col("options")).alias("kind"))


@query(f"WITH {cte()} SELECT p.id, CASE WHEN count(*) FILTER (WHERE stock_status = 'in_stock') > 0 THEN 'in_stock' WHEN count(v.id) > 0 AND count(*) FILTER (WHERE stock_status = 'out_of_stock') = count(v.id) THEN 'out_of_stock' ELSE 'unknown' END AS stock FROM p LEFT JOIN v ON v.product_id = p.id GROUP BY p.id")
def stock_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("id", merge.stock_rollup(F.col("variants")).alias("stock"))


@query(f"WITH {cte()} SELECT product_id, min(price)::DOUBLE AS price_min, max(price)::DOUBLE AS price_max, count(DISTINCT currency) AS currencies FROM v GROUP BY product_id")
def price_range_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_variants(spark, sf_dir).groupBy("product_id").agg(F.min("price").cast("double").alias("price_min"), F.max("price").cast("double").alias("price_max"), F.count_distinct("currency").alias("currencies"))


@query(f"WITH {cte()} SELECT id, CASE n_images WHEN 0 THEN NULL WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM p")
def featured_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("id", merge.featured_image(F.lit(None).cast("string"), F.col("images"))["confidence"].alias("confidence"))


# ---- validation ---------------------------------------------------------------------------------------------------
def _finding(code: str, severity: str, body: str, variant: str = "NULL", product: str = "p.id") -> str:
    return f"SELECT '{code}' AS code, {severity if severity.startswith('CASE') else repr(severity)} AS severity, {product} AS product_id, CAST({variant} AS VARCHAR) AS variant_id {body}"


PV = "FROM p JOIN vo v ON v.product_id = p.id JOIN n ON n.id = p.id"
LOST = "FROM p JOIN n USING (id)"
MISSING = "concat_ws(', ', CASE WHEN gtin IS NULL THEN 'GTIN' END, 'MPN', 'Google product category')"
FINDINGS = [
    _finding("VAL-01", "CRITICAL", "FROM p WHERE title IS NULL"),
    _finding("VAL-02", "ERROR", "FROM p WHERE price IS NULL AND NOT EXISTS (SELECT 1 FROM v WHERE v.product_id = p.id AND v.price IS NOT NULL)"),
    _finding("VAL-03", "WARNING", "FROM p WHERE n_images = 0"),
    _finding("VAL-04", "WARNING", "FROM p WHERE category_path IS NULL"),
    _finding("VAL-05", "INFO", "FROM p WHERE description_html IS NULL"),
    _finding("VAL-06", "ERROR", "FROM p WHERE handle IS NULL AND title IS NULL"),
    _finding("VAL-07", "WARNING", "FROM p WHERE kind = 'unknown'"),
    _finding("VAL-08", "ERROR", f"{LOST} WHERE kind = 'variable' AND n < 2"),
    _finding("VAL-09", "WARNING", f"{LOST} WHERE kind = 'simple' AND n > 1"),
    _finding("VAL-10", "ERROR", "FROM p WHERE n_axes > 3"),
    _finding("VAL-11", "WARNING", "FROM p WHERE weight_unit IS NULL OR weight_unit = 'stone' OR EXISTS (SELECT 1 FROM v WHERE v.product_id = p.id AND v.weight_unit IS NULL)"),
    _finding("VAL-12", "WARNING", "FROM p WHERE length IS NOT NULL AND dimension_unit IS NULL"),
    _finding("VAL-13", "CRITICAL", f"{PV} WHERE v.parent_id <> p.id", "v.id"),
    _finding("VAL-14", "ERROR", f"{PV} WHERE n.n > 1 AND sig = ''", "v.id"),
    _finding("VAL-15", "ERROR", f"FROM (SELECT v.*, p.id AS pid, row_number() OVER (PARTITION BY p.id, sig ORDER BY position) AS k {PV} WHERE n.n > 1 AND sig <> '') v WHERE k > 1", "v.id", "v.pid"),
    _finding("VAL-16", "CRITICAL", f"FROM (SELECT v.*, p.id AS pid, row_number() OVER (PARTITION BY p.id, lower(v.sku) ORDER BY position) AS k {PV} WHERE v.sku IS NOT NULL) v WHERE k > 1", "v.id", "v.pid"),
    _finding("VAL-17", "ERROR", f"{PV} WHERE v.price IS NULL", "v.id"),
    _finding("VAL-18", "ERROR", f"{PV} WHERE v.price < 0", "v.id"),
    _finding("VAL-19", "WARNING", f"{PV} WHERE v.compare_at_price <= v.price", "v.id"),
    _finding("VAL-20", "WARNING", f"{PV} WHERE v.inventory_quantity < 0 OR v.inventory_quantity > 1000000", "v.id"),
    _finding("VAL-21", "INFO", f"{PV} WHERE v.stock_status = 'unknown'", "v.id"),
    _finding("VAL-22", "ERROR", f"{PV} WHERE n.n > 1 AND n_axes > 0 AND (flag IS NULL OR status IS NULL OR n_axes > 2)", "v.id"),
    _finding("VAL-23", "WARNING", "FROM p JOIN (SELECT product_id FROM v GROUP BY 1 HAVING count(*) > 2 AND count(DISTINCT coalesce(price::VARCHAR, 'null')) = 1 AND count(DISTINCT coalesce(sku, 'null')) = 1 AND first(sku ORDER BY position) IS NOT NULL) x ON x.product_id = p.id"),
    _finding("VAL-24", "WARNING", f"{PV} WHERE v.image_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM img WHERE img.product_id = p.id AND img.url = v.image_url)", "v.id"),
    _finding("VAL-25", "INFO", "FROM p JOIN (SELECT product_id FROM v GROUP BY 1 HAVING count(*) > 1 AND count(image_url) > 0 AND count(image_url) < count(*)) x ON x.product_id = p.id"),
    _finding("VAL-26", "WARNING", "FROM p JOIN (SELECT product_id FROM v GROUP BY 1 HAVING count(image_url) > 2 AND count(DISTINCT image_url) = 1) x ON x.product_id = p.id"),
    _finding("VAL-27", "INFO", "FROM p WHERE n_images > 1 AND guessed_image = 1"),
    _finding("VAL-28", "ERROR", "FROM p JOIN (SELECT id FROM (SELECT id, currency FROM p UNION SELECT product_id, currency FROM v) WHERE currency IS NOT NULL GROUP BY id HAVING count(DISTINCT currency) > 1) x USING (id)"),
    _finding("VAL-29", "INFO", "FROM p WHERE currency IS NULL AND NOT EXISTS (SELECT 1 FROM v WHERE v.product_id = p.id AND v.currency IS NOT NULL)"),
    _finding("VAL-30", "WARNING", "FROM p JOIN (SELECT product_id, min(price) AS a, max(price) AS b FROM v GROUP BY 1) x ON x.product_id = p.id WHERE p.price < a - 0.01 OR p.price > b + 0.01"),
    _finding("VAL-31", "WARNING", "FROM p WHERE disputed = 1"),
    _finding("VAL-32", "INFO", "FROM p WHERE kind <> 'variable' AND sku IS NULL AND NOT EXISTS (SELECT 1 FROM v WHERE v.product_id = p.id AND v.sku IS NOT NULL)"),
    _finding("VAL-33", "WARNING", f"{PV} WHERE v.sku LIKE ' %'", "v.id"),
    _finding("VAL-34", "WARNING", "FROM p WHERE description_html LIKE '<p><b>%'"),
    _finding("VAL-36", "ERROR", "FROM p JOIN img ON img.product_id = p.id WHERE img.url NOT LIKE 'http%'"),
    _finding("VAL-37", "INFO", "FROM p JOIN (SELECT product_id FROM img GROUP BY 1 HAVING count(*) > count(DISTINCT regexp_replace(url, '\\?.*$', ''))) x ON x.product_id = p.id"),
    _finding("VAL-38", "INFO", "FROM p"),
    _finding("VAL-39", "INFO", "FROM p WHERE seo_title IS NULL AND title IS NULL"),
    _finding("VAL-40", "INFO", "FROM p WHERE length(title) > 320"),
    _finding("VAL-41", "INFO", "FROM p WHERE robots IS NOT NULL"),
    _finding("VAL-42", "WARNING", "FROM p WHERE guessed = 1"),
    _finding("VAL-43", "INFO", "FROM p WHERE source_platform = 'unknown'"),
    _finding("VAL-44", "INFO", "FROM p WHERE note IS NOT NULL"),
    _finding("VAL-45", "ERROR", "FROM (SELECT id, row_number() OVER (PARTITION BY lower(regexp_replace(source_url, '[?#].*$', '')) ORDER BY ordinal) AS k FROM p) p WHERE k > 1"),
    _finding("VAL-46", "ERROR", "FROM (SELECT id, h, row_number() OVER (PARTITION BY h ORDER BY ordinal) AS k FROM (SELECT id, ordinal, lower(coalesce(handle, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '-'))) AS h FROM p) WHERE h <> '') p WHERE k > 1"),
    _finding("VAL-47", "ERROR", "FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ordinal, spot) AS r, min(pid) OVER (PARTITION BY k) AS a, max(pid) OVER (PARTITION BY k) AS b FROM (SELECT id AS pid, ordinal, 0 AS spot, NULL AS vid, lower(trim(sku)) AS k FROM p UNION ALL SELECT p.id, p.ordinal, v.position, v.id, lower(trim(v.sku)) FROM p JOIN v ON v.product_id = p.id) WHERE k <> '') x WHERE r > 1 AND a <> b", "x.vid", "x.pid"),
    _finding("VAL-48", "CRITICAL", f"{PV} WHERE v.parent_id NOT IN (SELECT id FROM p)", "v.id"),
]
ALL = f"WITH {cte()}, f AS ({' UNION ALL '.join(FINDINGS)})"


def all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(products(spark, sf_dir), "shopify")


@query(f"{ALL} SELECT code, severity, product_id, variant_id FROM f")
def validation_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_issues(spark, sf_dir).select("code", "severity", "product_id", "variant_id")


@query(f"{ALL} SELECT count(*) AS issue_count, count(*) FILTER (WHERE severity = 'INFO') AS n_info, count(*) FILTER (WHERE severity = 'WARNING') AS n_warning, count(*) FILTER (WHERE severity = 'ERROR') AS n_error, count(*) FILTER (WHERE severity = 'CRITICAL') AS n_critical, count(*) FILTER (WHERE severity IN ('ERROR', 'CRITICAL')) AS blocking_export, count(DISTINCT CASE WHEN severity <> 'INFO' THEN product_id END) AS needs_review FROM f")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(all_issues(spark, sf_dir))


@query(f"{ALL} SELECT product_id, {LABEL.format('max(' + RANK + ')')} AS worst_severity, count(*) AS n_issues FROM f GROUP BY product_id")
def worst_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..schema import severity_label

    return validate.worst(all_issues(spark, sf_dir)).select("product_id", severity_label(F.col("worst_rank")).alias("worst_severity"), "n_issues")


def _rule_query(name: str, rule: str, codes: list[str]) -> None:
    some = [f for f in FINDINGS if f[8:14] in codes]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = products(spark, sf_dir)
        if rule == "duplicates":
            found = validate.duplicate_findings(docs, "shopify")
        elif rule == "orphan-variants":
            found = validate.orphan_findings(docs)
        else:
            found = validate.product_findings(docs, "shopify", [r for r in validate.RULES if r.id == rule])
        return found.where(F.col("code").isin(*codes)).select("code", "product_id", "variant_id")

    run.__name__ = name
    query(f"WITH {cte()}, f AS ({' UNION ALL '.join(some)}) SELECT code, product_id, variant_id FROM f")(run)


for _name, (_rule, _codes) in {
    "required_fields": ("required-fields", range(1, 7)), "product_type": ("product-type", range(7, 10)), "destination_limits": ("destination-limits", range(10, 13)), "variant_integrity": ("variant-integrity", range(13, 24)), "variant_images": ("variant-images", range(24, 28)),
    "price_consistency": ("price-consistency", range(28, 32)), "dup_handle_url": ("duplicates", (45, 46)), "dup_sku_across_products": ("duplicates", (47,)), "orphan_variants": ("orphan-variants", (48,)), "missing_axes": ("variant-integrity", (22,)), "dup_sku_within_product": ("variant-integrity", (16,)),
    "currency_mix": ("price-consistency", (28, 29)),
}.items():
    _rule_query(_name, _rule, [f"VAL-{c:02d}" for c in _codes])


@query(f"{ALL}, r AS (SELECT product_id, min({RANK}) AS least, max({RANK}) AS most FROM f GROUP BY product_id) SELECT severity, count(*) AS n FROM f GROUP BY severity")
def issues_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.severity_histogram(all_issues(spark, sf_dir))


# ---- export -------------------------------------------------------------------------------------------------------
@query(f"WITH {cte()}, {ISSUES}, w AS (SELECT product_id, max({RANK}) AS r FROM i GROUP BY 1) SELECT p.id, CASE WHEN r = 3 THEN 'critical issue' WHEN r = 2 THEN 'error' END AS skip_reason FROM p LEFT JOIN w ON w.product_id = p.id")
def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = products(spark, sf_dir)
    return export.gate(docs, required_issues(docs), ExportOptions()).select("id", "skip_reason")


@query(f"WITH {cte()}, {ISSUES}, w AS (SELECT product_id, max({RANK}) AS r FROM i GROUP BY 1), g AS (SELECT CASE WHEN r = 3 THEN 'critical issue' WHEN r = 1 THEN 'warning' END AS s FROM w), c AS (SELECT s, count(*) AS n FROM g WHERE s IS NOT NULL GROUP BY s) SELECT string_agg(n || ' × ' || s, '; ' ORDER BY n || ' × ' || s) AS skipped FROM c")
def export_skip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = products(spark, sf_dir)
    return export.skip_summary(export.gate(docs, required_issues(docs), ExportOptions(exclude_errors=False, exclude_warnings=True)))


HANDLE = "coalesce(nullif(trim(handle), ''), nullif(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), p.id)"
SHOP_ROWS = f"""WITH {cte('p', 'v', 'img')}, vk AS MATERIALIZED (SELECT *, product_id || ':' || position AS key, count(*) OVER (PARTITION BY product_id) AS n FROM v),
n AS MATERIALIZED (SELECT product_id AS id, max(n) AS n FROM vk GROUP BY product_id),
o AS MATERIALIZED (SELECT product_id, url, pos, product_id || ':' || pos AS key FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN i = 2 THEN 0 ELSE 1 END, i) AS pos FROM img)),
r AS MATERIALIZED (SELECT *, id || ':' || (k + 1) AS key FROM (SELECT p.*, coalesce(n.n, 0) AS nv, unnest(range(0, greatest(coalesce(n.n, 0), 1, n_images))) AS k FROM p LEFT JOIN n USING (id)))
SELECT p.id AS product_id, k AS idx, CASE WHEN k = 0 THEN 'primary' WHEN k < greatest(nv, 1) THEN 'variant' ELSE 'image' END AS row_type, {HANDLE} AS handle, coalesce(CASE WHEN nv = 0 AND k = 0 THEN p.sku ELSE v.sku END, '') AS sku,
 coalesce((CASE WHEN nv = 0 AND k = 0 THEN p.price ELSE v.price END)::DECIMAL(18,2)::VARCHAR, '') AS price, coalesce(v.compare_at_price::DECIMAL(18,2)::VARCHAR, '') AS compare, coalesce(v.inventory_quantity::VARCHAR, '') AS quantity,
 CASE WHEN k >= greatest(nv, 1) OR v.inventory_quantity IS NULL THEN '' ELSE 'deny' END AS policy, coalesce(o.url, '') AS image, coalesce(o.pos::VARCHAR, '') AS image_position,
 CASE WHEN k >= greatest(nv, 1) THEN '' ELSE coalesce(v.flag, v.status, CASE WHEN nv <= 1 THEN 'Default Title' END, '') END AS option1_value
FROM r p LEFT JOIN vk v ON v.key = p.key LEFT JOIN o ON o.key = p.key"""


def _cells(spark: SparkSession, sf_dir: str, options: ExportOptions, wanted: dict[str, str]) -> DataFrame:
    headers, rows = export.build(products(spark, sf_dir), options)
    at = {h: i for i, h in enumerate(headers)}
    return rows.select("product_id", F.col("idx").cast("long").alias("idx"), "row_type", *[F.get("cells", F.lit(at[h])).alias(n) for n, h in wanted.items()])


@query(SHOP_ROWS)
def export_shopify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, ExportOptions(), {"handle": "Handle", "sku": "Variant SKU", "price": "Variant Price", "compare": "Variant Compare At Price", "quantity": "Variant Inventory Qty", "policy": "Variant Inventory Policy", "image": "Image Src", "image_position": "Image Position", "option1_value": "Option1 Value"})


@query()
def export_shopify_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.build(products(spark, sf_dir), ExportOptions(profile="shopify-2024"))[1]


WOO_ROWS = f"""WITH {cte()}, r AS MATERIALIZED (SELECT p.*, n.n AS nv, (p.kind = 'variable' OR n.n > 1) AS many FROM p JOIN n USING (id)),
x AS MATERIALIZED (SELECT *, 0 AS k FROM r UNION ALL SELECT r.*, v.position FROM r JOIN v ON v.product_id = r.id WHERE many)
SELECT x.id AS product_id, k AS idx, CASE WHEN k = 0 THEN 'primary' ELSE 'variant' END AS row_type,
 CASE WHEN k > 0 THEN 'variation' WHEN x.kind IN ('variable', 'external') THEN x.kind WHEN many THEN 'variable' ELSE 'simple' END AS type,
 coalesce(CASE WHEN k > 0 THEN v.sku ELSE coalesce(x.sku, CASE WHEN NOT many AND nv = 1 THEN trim(s.sku) END, 'P-' || {HANDLE.replace('p.id', 'x.id')}) END, '') AS sku,
 CASE WHEN k > 0 THEN coalesce(x.sku, 'P-' || {HANDLE.replace('p.id', 'x.id')}) ELSE '' END AS parent,
 CASE WHEN k > 0 AND (v.flag IS NOT NULL OR v.status IS NOT NULL) THEN coalesce(title, '') || ' - ' || concat_ws(', ', v.flag, v.status) ELSE coalesce(title, '') END AS name,
 CASE WHEN k > 0 THEN CASE v.stock_status WHEN 'in_stock' THEN '1' WHEN 'out_of_stock' THEN '0' ELSE '' END WHEN NOT many AND nv = 1 THEN CASE s.stock_status WHEN 'in_stock' THEN '1' WHEN 'out_of_stock' THEN '0' ELSE '' END ELSE '' END AS in_stock
FROM x LEFT JOIN v ON v.product_id = x.id AND v.position = k AND k > 0 LEFT JOIN v s ON s.product_id = x.id AND s.position = 1"""


@query(WOO_ROWS)
def export_woo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, ExportOptions(profile="woocommerce-default"), {"type": "Type", "sku": "SKU", "parent": "Parent", "name": "Name", "in_stock": "In stock?"})


NUM = "coalesce(rtrim(rtrim({}::DECIMAL(24,6)::VARCHAR, '0'), '.'), '')"


@query(f"WITH {cte('p', 'v')}, w AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY product_id) AS n FROM v) SELECT v.product_id, position AS idx, {NUM.format('(CASE WHEN v.compare_at_price > v.price THEN v.compare_at_price ELSE v.price END)')} AS regular, {NUM.format('(CASE WHEN v.compare_at_price > v.price THEN v.price END)')} AS sale FROM w v JOIN p ON p.id = v.product_id WHERE p.kind = 'variable' OR v.n > 1")
def export_woo_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cells(spark, sf_dir, ExportOptions(profile="woocommerce-default"), {"regular": "Regular price", "sale": "Sale price"})
    return out.where("row_type = 'variant'").select("product_id", "idx", "regular", "sale")


@query(f"WITH {cte()} SELECT id, n_axes, CASE WHEN n_axes > 0 THEN 'Flag' END AS first_axis FROM p")
def export_woo_dynamic_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = export.attribute_axes()
    return products(spark, sf_dir).select("id", F.size(axes).alias("n_axes"), F.get(axes, F.lit(0))["name"].alias("first_axis"))


@query()
def export_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = products(spark, sf_dir)
    headers, rows, _ = export.export(docs, required_issues(docs), ExportOptions())
    return export.csv_lines(headers, rows)


# ---- other --------------------------------------------------------------------------------------------------------
@query("WITH a AS (SELECT c_nationkey AS page_id, c_mktsegment AS s, min(c_custkey) AS o FROM customer GROUP BY 1, 2), b AS (SELECT page_id, s, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY page_id) AS n FROM a) SELECT x.page_id, (x.i * x.n + y.i) AS idx, x.s || '/' || y.s AS combination FROM b x JOIN b y USING (page_id) WHERE x.i * x.n + y.i < 12")
def axis_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("page_id"), "c_mktsegment").agg(F.min("c_custkey").alias("o"))
    values = seen.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("o", "c_mktsegment"))).getField("c_mktsegment").alias("values"))
    axes = values.withColumn("pos", F.lit(0)).withColumn("name", F.lit("a")).unionByName(values.withColumn("pos", F.lit(1)).withColumn("name", F.lit("b")))
    return catalog.axis_combinations(axes, 12).select("page_id", F.col("idx").cast("long").alias("idx"), F.array_join(F.transform("combination", lambda c: c["value"]), "/").alias("combination"))


@query(f"WITH {cte()} SELECT id AS product_id, 'price' AS field, 'jsonld' AS source, 'high' AS confidence FROM p WHERE disputed = 1 UNION ALL SELECT id, 'title', 'heuristic', 'low' FROM p WHERE guessed = 1 UNION ALL SELECT id, 'featuredImageUrl', 'heuristic', 'low' FROM p WHERE guessed_image = 1")
def provenance_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.trace(products(spark, sf_dir)).select("product_id", "field", "source", "confidence")


@query("SELECT c_custkey FROM customer WHERE c_nationkey <> 3")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("project_id", F.col("c_nationkey").cast("string"))
    return catalog.delete_cascade({"urls": rows}, "3")["urls"].select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS category_id FROM customer")
def category_nullout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.null_out_category(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "category_id"), 3).select("c_custkey", "category_id")


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'New > Name' ELSE p_type END AS category_path FROM part")
def category_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "category_id").withColumnRenamed("p_type", "category_path")
    return catalog.rename_category(rows, "Brand#11", "Name", "New > Name").select("p_partkey", "category_path")


@query(f"WITH {cte()} SELECT id, CASE WHEN id = '42' THEN 'Patched' ELSE title END AS title FROM p")
def patch_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.patch(products(spark, sf_dir), "42", {"title": "Patched"}).select("id", "title")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return catalog.upsert(rows, rows.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


EVENT_OF = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'ok' WHEN 'click' THEN 'warn' WHEN 'error' THEN 'error' ELSE 'reset' END"


@query(f"SELECT user_id AS url_id, CASE last WHEN 'start' THEN 'processing' WHEN 'ok' THEN 'completed' WHEN 'warn' THEN 'warning' WHEN 'error' THEN CASE WHEN attempts <= 2 THEN 'retrying' ELSE 'failed' END ELSE 'pending' END AS state, attempts FROM (SELECT user_id, arg_max({EVENT_OF}, event_id) AS last, CAST(count(*) FILTER (WHERE e = 'start' AND event_id > r) AS INT) AS attempts FROM (SELECT *, {EVENT_OF} AS e, coalesce(max(CASE WHEN {EVENT_OF} = 'reset' THEN event_id END) OVER (PARTITION BY user_id), -1) AS r FROM events) GROUP BY user_id)")
def url_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("url_id"), F.col("event_id").alias("seq"), F.expr(EVENT_OF).alias("event"), F.lit(None).cast("string").alias("error"))
    return jobs.url_states_batch(rows).select("url_id", "state", "attempts")
