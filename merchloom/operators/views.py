"""What lists and dashboards show, and the updates that their actions make: filters, joins, counts and heads as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import SEVERITIES, severity_rank
from ..storage import shared_folder
from .export import PROFILES, csv_lines, emits_variations

#: The choice "no category" in a list's filter.
NO_CATEGORY = "__none__"


# ---- filters ----------------------------------------------------------------------------------------------------------
def issues_of(issues: DataFrame, severity: str | None = None, product_id: str | None = None) -> DataFrame:
    """Findings of one severity, of one product, or both; None does not filter."""
    for column, value in (("severity", severity), ("product_id", product_id)):
        if value is not None:
            issues = issues.where(F.col(column) == value)
    return issues


def active(projects: DataFrame) -> DataFrame:
    return projects.where(~F.coalesce("archived", F.lit(False)))


def urls_of(urls: DataFrame, category: object = NotImplemented, states: tuple[str, ...] | None = None) -> DataFrame:
    """URLs in scope: any category where none is asked for, those without one for None or NO_CATEGORY; of some states."""
    if category is not NotImplemented:
        urls = urls.where(F.col("category_id").eqNullSafe(F.lit(None if category == NO_CATEGORY else category).cast(urls.schema["category_id"].dataType)))
    return urls.where(F.col("state").isin(*states)) if states else urls


def failed(urls: DataFrame) -> DataFrame:
    return urls_of(urls, states=("failed", "retrying"))


def is_pending() -> Column:
    """Neither completed nor completed with warnings."""
    return ~F.col("state").isin("completed", "warning")


def latest(rows: DataFrame, order: str, condition: Column) -> DataFrame:
    """The last row by an ordinal that meets a condition: none or one, by partial aggregation."""
    return rows.where(condition).agg(F.max_by(F.struct("*"), order).alias("x")).where("x IS NOT NULL").select("x.*")


# ---- joins ------------------------------------------------------------------------------------------------------------
def with_product(urls: DataFrame, products: DataFrame) -> DataFrame:
    """URLs with the product that their page gave before: the first by ordinal with that address, else the one they name."""
    first = products.groupBy("project_id", "normalized_url").agg(F.min_by("id", "ordinal").alias("known_id"))
    out = urls.join(first, ["project_id", "normalized_url"], "left")
    return out.withColumn("existing_product_id", F.coalesce("known_id", "product_id")).drop("known_id")


def with_url_entry(products: DataFrame, urls: DataFrame) -> DataFrame:
    """Products with the first URL entry of their address; null without one."""
    first = urls.groupBy("project_id", "normalized_url").agg(F.min_by("id", "ordinal").alias("url_id"))
    return products.join(first, ["project_id", "normalized_url"], "left")


def with_title(issues: DataFrame, products: DataFrame) -> DataFrame:
    """Findings with their product's title; a finding on no product is about the whole project."""
    titles = products.select(F.col("id").alias("product_id"), "title")
    return issues.join(titles, "product_id", "left").withColumn("title", F.when(F.col("product_id").isNull(), "Whole project").otherwise(F.col("title")))


# ---- counts and heads --------------------------------------------------------------------------------------------------
def severity_columns(issues: DataFrame) -> DataFrame:
    """One row for each product: a count for each severity, zeros kept, the worst first."""
    counts = issues.groupBy("product_id").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES], F.max(severity_rank(F.col("severity"))).alias("worst_rank"))
    return counts.orderBy(F.desc("worst_rank"), "product_id")


def recent(rows: DataFrame, n: int = 8, at: str = "finished_at", tie: str = "id") -> DataFrame:
    """The last n that have finished, newest first: a bounded top-k."""
    return rows.where(F.col(at).isNotNull()).orderBy(F.desc(at), F.desc(tie)).limit(n)


def export_notes(included: DataFrame) -> DataFrame:
    """One row: products whose rows need a generated key, and products without a category."""
    keyless = (F.coalesce(F.trim("sku"), F.lit("")) == "") & (emits_variations() | (F.coalesce(F.trim(F.get("variants", F.lit(0))["sku"]), F.lit("")) == ""))
    bare = F.coalesce(F.trim("category_path"), F.trim("source_product_type"), F.lit("")) == ""
    return included.agg(F.count_if(keyless).alias("generated_keys"), F.count_if(bare).alias("without_category"))


def preview(rows: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first n rows of an export, and one row with the number of all."""
    return rows.orderBy("ordinal", "idx").limit(n), rows.agg(F.count("*").alias("total_rows"))


def export_record(gated: DataFrame, rows: DataFrame, headers: list[str], profile: str) -> DataFrame:
    """One row on an export: products and rows written, products skipped, bytes of the file, status."""
    lines = csv_lines(headers, rows)
    size = lines.agg(F.sum(F.octet_length("line") + 2).cast("long").alias("byte_size"), (F.count("*") - 1).alias("row_count"))
    counts = gated.agg(F.count_if(F.col("skip_reason").isNull()).alias("product_count"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped_count"))
    one = F.lit(1).alias("one")
    out = counts.select("*", one).join(size.select("*", one), "one").drop("one")
    status = F.when(F.col("skipped_count") > 0, "partial").otherwise("complete")
    return out.select(F.lit(PROFILES[profile].format).alias("format"), F.lit(profile).alias("profile_id"), "product_count", "row_count", "skipped_count", status.alias("status"), "byte_size")


def profile_list(spark: SparkSession) -> DataFrame:
    """The export profiles: id, format, label, number of fixed columns."""
    from ..schema import ExportOptions

    rows = [(p.id, p.format, p.label, len(p.columns(ExportOptions(profile=p.id)))) for p in PROFILES.values()]
    return spark.createDataFrame(rows, "id string, format string, label string, n_columns int")


# ---- updates ----------------------------------------------------------------------------------------------------------
def replace_issues(issues: DataFrame, project_id: str, new: DataFrame) -> DataFrame:
    """A project's findings replaced by those of a new run; what was acknowledged is open again."""
    return issues.where(~F.col("project_id").eqNullSafe(F.lit(project_id))).unionByName(new.withColumn("acknowledged", F.lit(False)), allowMissingColumns=True)


def after_product_delete(products: DataFrame, urls: DataFrame, issues: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without some products (gone: id): their URLs are pending again, with no attempts and no product; their findings go."""
    ids = gone.select("id").distinct()
    kept = products.join(ids, "id", "left_anti")
    hit = ids.select(F.col("id").alias("product_id"), F.lit(True).alias("hit"))
    back = urls.join(hit, "product_id", "left")
    reset = lambda c, v: F.when(F.col("hit"), F.lit(v)).otherwise(F.col(c)).alias(c)
    changed = {"state": reset("state", "pending"), "attempts": reset("attempts", 0), "product_id": F.when(F.col("hit").isNull(), F.col("product_id")).alias("product_id")}
    back = back.select(*[changed.get(c, F.col(c)) for c in urls.columns])
    return kept, back, issues.join(ids.withColumnRenamed("id", "product_id"), "product_id", "left_anti")


def create_job(urls: DataFrame, job_id: str, url_ids: list[str] | None = None, category_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """URLs of a new job, set back to pending, and the job's row: total, skipped (those already completed), state."""
    from .catalog import job_scope

    scoped = job_scope(urls, url_ids, category_ids)
    job = scoped.agg(F.count("*").alias("total"), F.count_if(F.col("job_state") == "skipped").alias("skipped")).select(F.lit(job_id).alias("id"), F.lit("queued").alias("state"), "total", "skipped")
    todo = scoped.where("job_state = 'pending'").withColumn("state", F.lit("pending")).withColumn("attempts", F.lit(0)).drop("job_state")
    return todo, job


#: Actions on a job: from which state to which.
TRANSITIONS = {"pause": {"running": "paused"}, "resume": {"paused": "running"}, "cancel": {"running": "cancelled", "paused": "cancelled", "queued": "cancelled"}, "crash": {"running": "paused"}}


def job_after(state: Column, action: Column) -> Column:
    """A job's state after an action; an action that does not fit changes nothing."""
    out = F.when(F.lit(False), F.lit(""))
    for name, moves in TRANSITIONS.items():
        for old, new in moves.items():
            out = out.when((action == name) & (state == old), new)
    return out.otherwise(state)


def remaining(urls: DataFrame, job_urls: DataFrame) -> DataFrame:
    """What a resumed job still has to do, from the states of its URLs."""
    return urls.join(job_urls.select("id"), "id", "left_semi").where(is_pending() & ~F.col("state").isin("failed", "skipped"))


def cached(fetches: DataFrame) -> DataFrame:
    """One answer for each address: the latest that was good (status 2xx or 3xx)."""
    good = fetches.where((F.col("status") >= 200) & (F.col("status") < 400))
    return good.groupBy("url").agg(F.max_by(F.struct(*[c for c in fetches.columns if c != "url"]), "ordinal").alias("x")).select("url", "x.*")


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that were added, removed or changed between two states of a table: one full join on the key and a hash of the rest."""
    rest = sorted(c for c in new.columns if c != key)
    state = lambda df, name: df.select(key, F.xxhash64(*rest).alias(name))
    both = state(old, "before").join(state(new, "after"), key, "full")
    what = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.withColumn("change", what).where("change IS NOT NULL").select(key, "change")


def add_note(notes: Column, message: Column) -> Column:
    """A note appended once."""
    return F.array_union(F.coalesce(notes, F.array().cast("array<string>")), F.array_compact(F.array(message)))


def group_positions(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Positions 1.. within each group."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(order)))


# ---- places -----------------------------------------------------------------------------------------------------------
def placed(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Adds each row's place from 1 in an order over all rows.

    Ranges of the order are sorted in tasks of their own and written to the shared folder once; where each begins is told by
    the counts of those before it. Only that list, one row for each range, is seen by one task.
    """
    spark, at = rows.sparkSession, shared_folder(rows.sparkSession)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(at)
    ranges = spark.read.parquet(at).withColumn("_range", F.shiftright("_at", 33))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = ranges.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranges.join(F.broadcast(starts), "_range").withColumn(name, place).drop("_range", "_at", "_before")
