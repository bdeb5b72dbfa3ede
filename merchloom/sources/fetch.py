"""Fetched pages as data: what of an answer counts, checks of pictures, stored settings, and a page source for any fetcher.

The network itself is a parameter: a function from an address to an answer, which Spark calls in parallel by partitions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import Settings

PAGE = "url string, final_url string, status int, ok boolean, content_type string, body string"
Fetch = Callable[[str], dict]


def kept_body(content_type: Column, body: Column) -> Column:
    """An answer's text, for the types that are text; '' for the rest."""
    return F.when(content_type.rlike(r"(?i)text|json|xml|javascript"), body).otherwise("")


def lower_headers(headers: Column) -> Column:
    """Header names in lower case; of names that differ only in case, the last one's value."""
    names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    values = F.map_values(headers)
    last = lambda k: F.element_at(F.filter(values, lambda _, i: F.get(names, i) == k), -1)
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda k: F.struct(k.alias("key"), last(k).alias("value"))))


def picture_problem(status: Column, content_type: Column) -> Column:
    """What is wrong with a picture's answer, or null: not found, or no picture."""
    good = (status == 206) | ((status >= 200) & (status < 300))
    return F.when(status.isNull(), "The picture was not reached.").when(~good, F.concat(F.lit("The picture answers with status "), status.cast("string"), F.lit("."))).when(~content_type.rlike(r"(?i)^image/|octet-stream"), F.concat(F.lit("The address gives "), content_type, F.lit(", no picture.")))


def probed(images: DataFrame, probes: DataFrame) -> DataFrame:
    """Pictures (product_id, url) with their probe's problem; one that nobody probed has none."""
    out = images.join(probes.select("url", "status", "content_type", F.lit(True).alias("seen")), "url", "left")
    return out.withColumn("problem", F.when(F.col("seen"), picture_problem(F.col("status"), F.col("content_type")))).drop("seen", "status", "content_type")


def best_page(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """Pages with their rendered form where there is one, and where it came from."""
    r = rendered.select("url", F.col("html").alias("rendered_html"))
    return pages.join(r, "url", "left").withColumn("was_rendered", F.col("rendered_html").isNotNull()).withColumn("html", F.coalesce("rendered_html", "html")).drop("rendered_html")


def with_robots(urls: DataFrame, files: DataFrame) -> DataFrame:
    """URLs with their origin's robots text; null where it was not reached, and then everything is allowed."""
    from ..functions.url import origin_of

    good = files.where((F.col("status") >= 200) & (F.col("status") < 300)).groupBy("origin").agg(F.first("text").alias("robots"))
    return urls.join(good, origin_of(F.col("url")) == good["origin"], "left").drop("origin")


def settings_over(stored: str | None) -> Settings:
    """Stored settings (JSON) over the defaults; what is unknown or broken counts as not stored."""
    try:
        given = json.loads(stored or "{}")
    except ValueError:
        given = {}
    known = {f.name for f in fields(Settings)}
    own = {k: v for k, v in given.items() if k in known and isinstance(v, int)} if isinstance(given, dict) else {}
    return Settings(**(asdict(Settings()) | own))


def read_collection(spark: SparkSession, path: str, schema: str, backup: str | None = None) -> DataFrame:
    """A stored JSON collection (an array or lines); where it is missing, blank or broken, its backup, else nothing.

    Only a path that is not there counts as missing: any other fault, as one of permissions, is raised. The table is read
    once to see whether a row is broken.
    """
    for where in (path, backup):
        if where is None:
            continue
        try:
            df = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(where)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        bad = df.agg(F.count("_corrupt").alias("bad"), F.count("*").alias("n"), F.max(F.xxhash64("*")).alias("read")).first()
        if bad.n and not bad.bad:
            return df.drop("_corrupt")
    return spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and what makes paths for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def replace_table(df: DataFrame, path: str) -> None:
    """A table written beside the old one and then put in its place; the old one stays as .bak until the next time.

    The old backup goes last. Between the two renames there is no table at the path; read_table puts it back then.
    """
    df.write.mode("overwrite").parquet(f"{path}.tmp")
    fs, at = _files(df.sparkSession, path)
    if fs.exists(at(path)):
        if fs.exists(at(f"{path}.bak")):
            fs.delete(at(f"{path}.old"), True)
            fs.rename(at(f"{path}.bak"), at(f"{path}.old"))
        fs.rename(at(path), at(f"{path}.bak"))
    fs.rename(at(f"{path}.tmp"), at(path))
    fs.delete(at(f"{path}.old"), True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that replace_table keeps; where a crash left none at the path, the new one if it is whole, else the backup."""
    fs, at = _files(spark, path)
    if not fs.exists(at(path)):
        whole = [p for p in (f"{path}.tmp", f"{path}.bak", f"{path}.old") if fs.exists(at(f"{p}/_SUCCESS"))]
        if whole:
            fs.rename(at(whole[0]), at(path))
    return spark.read.parquet(path)


def answer_row(url: str, fetch: Fetch) -> tuple:
    """A row of PAGE: an exception is an answer with status 0 and never ends the run; only texts keep their body."""
    try:
        answer = fetch(url)
    except Exception as e:
        answer = {"status": 0, "body": f"{type(e).__name__}: {e}", "content_type": "text/plain"}
    status, kind = int(answer.get("status") or 0), answer.get("content_type") or ""
    text = answer.get("body") if any(x in kind.lower() for x in ("text", "json", "xml", "javascript")) else ""
    return url, answer.get("final_url") or url, status, 200 <= status < 300, kind, text


def fetch_pages(urls: DataFrame, fetch: Fetch, url_col: str = "url", retries: int = 2) -> DataFrame:
    """Rows of PAGE for a table of addresses: each fetched once by its task, again while an answer is 429 or 503.

    Hosts are not spared here: streaming.lanes does that.
    """

    def one(url: str) -> tuple:
        row = answer_row(url, fetch)
        for _ in range(retries):
            if row[2] not in (0, 429, 503):
                break
            row = answer_row(url, fetch)
        return row

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([one(u) for u in batch["url"]], columns=["url", "final_url", "status", "ok", "content_type", "body"])

    return urls.select(F.col(url_col).alias("url")).mapInPandas(run, PAGE)


class PageSource(DataSource):
    """spark.read.format("pages"): the addresses in option `urls` (one a line), in `partitions` parts, by option `fetcher`.

    fetcher names a function as "module:name"; a test or a collector brings its own.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = [u.strip() for u in options.get("urls", "").splitlines() if u.strip()]
        self.parts, self.fetcher = int(options.get("partitions", "1")), options["fetcher"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(max(1, min(self.parts, len(self.urls))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, name = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        n = max(1, min(self.parts, len(self.urls)))
        for url in self.urls[partition.value :: n]:
            yield answer_row(url, fetch)
