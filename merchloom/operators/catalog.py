"""Catalogue upkeep: lists, counts, histories, URL imports, updates and deletions as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_retryable, stable_id
from ..functions.url import coerce_url, is_probably_url, normalize_url
from ..schema import LOG_LEVELS, SEVERITIES, URL_STATES, severity_label
from .validate import worst


def product_index(products: DataFrame) -> DataFrame:
    """One narrow row for each product: what lists need without the documents."""
    own = ("source_platform", "stock_status", "category_path", "featured_image_url")
    skus = F.filter(F.concat(F.array("sku"), F.transform("variants", lambda v: v["sku"])), lambda s: F.trim(s) != "")
    return products.select("id", "ordinal", "project_id", "category_id", "title", "source_url", "kind", "price", "currency", "scraped_at", F.size("variants").alias("variant_count"), F.size("images").alias("image_count"), skus.alias("skus"), *own)


def product_matches(index: DataFrame, project_id: str | None = None, category_id: str | None = None, kind: str | None = None, search: str | None = None) -> DataFrame:
    """The rows that a list has, in no order; what its pages are counted by. Null filters do not filter."""
    # a category of None, like the other two, does not filter; a product without a category is in no category's list
    for column, value in (("project_id", project_id), ("category_id", category_id), ("kind", kind)):
        if value is not None:
            index = index.where(F.col(column) == value)
    if search:
        needle = search.lower()
        index = index.where(F.lower("title").contains(needle) | F.lower("source_url").contains(needle) | F.exists("skus", lambda s: F.lower(s).contains(needle)))
    return index


def product_list(index: DataFrame, issues: DataFrame, project_id: str | None = None, category_id: str | None = None, kind: str | None = None, search: str | None = None, needs_review: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of products, newest first, with their worst severity and number of issues."""
    index = product_matches(index, project_id, category_id, kind, search)
    state = worst(issues, unacknowledged=False).withColumnRenamed("product_id", "id")
    out = index.join(state, "id", "left").withColumn("worst_severity", severity_label(F.col("worst_rank"))).withColumn("issue_count", F.coalesce("n_issues", F.lit(0)))
    if needs_review:
        out = out.where("worst_rank >= 1")
    return out.drop("worst_rank", "n_issues").orderBy(F.desc(F.coalesce(F.col("scraped_at").cast("string"), F.lit(""))), "ordinal").offset(offset).limit(limit)


def import_urls(texts: DataFrame, text: str = "text", order: str = "ordinal", loose: bool = False) -> DataFrame:
    """Addresses in pasted or filed text: ordinal, pos, raw, url, normalized_url, state in added, duplicate, invalid.

    Split at line ends, commas, semicolons and tabs (files at quotes too, where only what looks like an address counts).
    The first of each identity is added. Partial aggregation finds it, so one frequent address is no burden.
    """
    raw = texts.select(order, F.posexplode(F.split(text, "[\\r\\n,;\\t" + ("\"'" if loose else "") + "]+")).alias("pos", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    if loose:
        raw = raw.where(is_probably_url(F.col("raw")) | coerce_url(F.col("raw")).isNotNull())
    urls = raw.withColumn("url", coerce_url(F.col("raw"))).withColumn("normalized_url", normalize_url(F.col("url")))
    first = urls.where("url IS NOT NULL").groupBy("normalized_url").agg(F.min(F.struct(order, "pos")).alias("first"))
    out = urls.join(first, "normalized_url", "left")
    state = F.when(F.col("url").isNull(), "invalid").when(F.struct(order, "pos") == F.col("first"), "added").otherwise("duplicate")
    return out.withColumn("state", state).select(order, "pos", "raw", "url", "normalized_url", "state")


def dense_counts(rows: DataFrame, column: str, values: tuple[str, ...], name: str = "n") -> DataFrame:
    """A count for each of some fixed values, zeros kept."""
    wide = rows.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(v).alias(column), F.col(v).alias(name)) for v in values])).alias("x")).select("x.*")


def url_histogram(urls: DataFrame) -> DataFrame:
    return dense_counts(urls, "state", URL_STATES)


def severity_histogram(issues: DataFrame) -> DataFrame:
    return dense_counts(issues, "severity", SEVERITIES)


def category_counts(categories: DataFrame, urls: DataFrame, products: DataFrame) -> DataFrame:
    """Each category with its numbers of URLs and products, by position: aggregate first, then join."""
    count = lambda df, name: df.groupBy("category_id").agg(F.count("*").alias(name))
    out = categories.join(count(urls, "url_count"), "category_id", "left").join(count(products, "product_count"), "category_id", "left")
    return out.fillna(0, ["url_count", "product_count"]).orderBy("position")


def with_category_path(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds category_path: the category's path, else its name; null without a category."""
    return rows.join(categories.select("category_id", F.coalesce("path", "name").alias("category_path")), "category_id", "left")


def last_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last n by an ordinal, newest first: a bounded top-k, no full sort."""
    return rows.orderBy(F.desc(order)).limit(n)


def level_at_least(logs: DataFrame, least: str) -> DataFrame:
    return logs.where(F.col("level").isin(*LOG_LEVELS[LOG_LEVELS.index(least) :]))


def next_state(outcome_ok: Column, n_warnings: Column, attempts: Column, error_code: Column, max_retries: int) -> Column:
    """What a URL becomes after an attempt: completed, warning, retrying (while attempts last and it can help), failed."""
    again = (attempts < max_retries) & is_retryable(error_code)
    return F.when(outcome_ok & (n_warnings > 0), "warning").when(outcome_ok, "completed").when(again, "retrying").otherwise("failed")


def recovered(urls: DataFrame) -> DataFrame:
    """After a crash: what was being worked on is pending again."""
    return urls.withColumn("state", F.when(F.col("state").isin("processing", "retrying"), "pending").otherwise(F.col("state")))


def job_scope(urls: DataFrame, url_ids: list[str] | None = None, category_ids: list[str] | None = None) -> DataFrame:
    """URLs of a job: by ids, else by categories, else all; state pending, or skipped for those already completed."""
    if url_ids:
        urls = urls.where(F.col("id").isin(*url_ids))
    elif category_ids:
        urls = urls.where(F.col("category_id").isin(*category_ids))
    return urls.withColumn("job_state", F.when(F.col("state") == "completed", "skipped").otherwise("pending"))


def job_summary(rows: DataFrame, by: str) -> DataFrame:
    """Counters and a sentence for each job; rows have state."""
    count = lambda s, n: F.count_if(F.col("state") == s).alias(n)
    out = rows.groupBy(by).agg(count("completed", "completed"), count("warning", "warned"), count("failed", "failed"), count("skipped", "skipped"), F.count("*").alias("total"))
    done = F.col("completed") + F.col("warned")
    bit = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    return out.withColumn("message", F.concat(F.lit("Finished: "), F.concat_ws(", ", F.concat(done.cast("string"), F.lit(" collected")), bit("warned", " with warnings"), bit("failed", " failed"), bit("skipped", " done before")), F.lit(".")))


def schedule(urls: DataFrame, host: str, order: str, gap_ms: int, arrival: str | None = None) -> DataFrame:
    """Earliest start of each request when a host gets one every gap_ms and none before its arrival (ms; 0 without one).

    A start is the rank's slot plus the largest delay so far, arrival less slot. Ranks and delays come from blocks of the
    order first and then from within a block, so a host with a third of all URLs is no single task.
    """
    block = F.floor(F.col(order) / 4096)
    sizes = urls.groupBy(host, block.alias("block")).agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(host).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = sizes.withColumn("before", F.sum("size").over(earlier) - F.col("size"))
    ranked = urls.withColumn("block", block).withColumn("r", F.row_number().over(Window.partitionBy(host, "block").orderBy(order)))
    ranked = ranked.join(before, [host, "block"]).withColumn("start_ms", (F.col("before") + F.col("r") - 1) * gap_ms).drop("before", "size")
    if arrival is None:
        return ranked.drop("block", "r")
    late = F.col(arrival) - F.col("start_ms")
    most = ranked.groupBy(host, "block").agg(F.max(late).alias("late"))
    most = most.select(host, "block", F.max("late").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.max(late).over(Window.partitionBy(host, "block").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("own", own).join(most, [host, "block"])
    return out.withColumn("start_ms", F.col("start_ms") + F.greatest("own", "before")).drop("block", "r", "own", "before")


def delete_cascade(tables: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """Every table without one project's rows."""
    return {n: t.where(~F.col("id" if n == "projects" else "project_id").eqNullSafe(project_id)) for n, t in tables.items()}


def null_out_category(rows: DataFrame, category_id: str) -> DataFrame:
    return rows.withColumn("category_id", F.when(F.col("category_id") != category_id, F.col("category_id")))


def rename_category(products: DataFrame, category_id: str, name: str, path: str | None) -> DataFrame:
    return products.withColumn("category_path", F.when(F.col("category_id") == category_id, path or name).otherwise(F.col("category_path")))


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace those with their key, the rest stay: anti-join and union."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def insert_new(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Adds rows whose key is not there yet."""
    return current.unionByName(rows.join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def get_or_create_categories(categories: DataFrame, names: DataFrame) -> DataFrame:
    """Adds (project_id, name) that no category has by lower-case name; positions follow the siblings'."""
    new = names.groupBy("project_id", F.lower("name").alias("k")).agg(F.min_by("name", "ordinal").alias("name"), F.min("ordinal").alias("ordinal"))
    new = new.join(categories.select("project_id", F.lower("name").alias("k")), ["project_id", "k"], "left_anti")
    have = categories.groupBy("project_id").agg(F.count("*").alias("have"))
    at = Window.partitionBy("project_id").orderBy("ordinal")
    new = new.join(have, "project_id", "left").select(stable_id("cat", "project_id", "k").alias("category_id"), "project_id", "name", F.lit(None).cast("string").alias("path"), (F.coalesce("have", F.lit(0)) + F.row_number().over(at) - 1).cast("int").alias("position"))
    return categories.unionByName(new)


def patch(products: DataFrame, product_id: str, fields: dict[str, object]) -> DataFrame:
    """A user's values for one product, with provenance to say so."""
    hit = F.col("id") == product_id
    stamp = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.struct(F.lit("user").alias("source"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("struct<other_source:string,other_value:string>").alias("conflict")) for _ in fields]))
    for name, value in fields.items():
        products = products.withColumn(name, F.when(hit, F.lit(value).cast(products.schema[name].dataType)).otherwise(F.col(name)))
    kept = F.map_filter("provenance", lambda k, _: ~k.isin(*fields))
    return products.withColumn("provenance", F.when(hit, F.map_concat(kept, stamp)).otherwise(F.col("provenance")))


def trace(products: DataFrame) -> DataFrame:
    """Provenance as rows, by field name."""
    rows = products.select(F.col("id").alias("product_id"), F.explode("provenance").alias("field", "p"))
    conflict = F.when(F.col("p.conflict").isNotNull(), F.concat(F.lit("also "), "p.conflict.other_value", F.lit(" from "), "p.conflict.other_source"))
    return rows.select("product_id", "field", "p.source", "p.confidence", F.concat_ws("; ", "p.note", conflict).alias("note")).orderBy("product_id", "field")


def axis_combinations(axes: DataFrame, limit: int = 60) -> DataFrame:
    """All combinations of each page's few option axes, the last axis fastest; the first `limit` with their index.

    axes: (page_id, pos, name, values). The product is built inside a row by folding arrays that are cut at every step,
    so it never exceeds the limit.
    """
    kind = "array<array<struct<name:string,value:string>>>"
    whole = axes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "values"))).alias("axes"))
    start = F.array(F.array().cast("array<struct<name:string,value:string>>")).cast(kind)
    grow = lambda s, a: F.slice(F.flatten(F.transform(s, lambda c: F.transform(a["values"], lambda v: F.concat(c, F.array(F.struct(a["name"].alias("name"), v.alias("value"))))))), 1, limit).cast(kind)
    return whole.select("page_id", F.posexplode(F.aggregate("axes", start, grow)).alias("idx", "combination"))
