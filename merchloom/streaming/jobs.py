"""Collection runs as streams: URL states, latest progress, rolling logs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import RETRYABLE
from ..operators.catalog import level_at_least

STATE = "url_id string, state string, attempts int, last_error string"


def advance(state: str, attempts: int, event: str, error: str | None, max_retries: int) -> tuple[str, int]:
    """The state machine: pending, processing, then completed, warning, retrying while that can help, or failed."""
    if event == "start":
        return "processing", attempts + 1
    if event == "ok":
        return "completed", attempts
    if event == "warn":
        return "warning", attempts
    if event == "error":
        can = error is None or error in RETRYABLE
        return ("retrying" if can and attempts <= max_retries else "failed"), attempts
    if event == "reset":
        return "pending", 0
    return state, attempts


def url_states(events: DataFrame, max_retries: int = 2) -> DataFrame:
    """Streaming rows (url_id, seq, event, error) to each URL's state after every micro-batch, keyed state kept between them.

    Events of one URL are applied in the order of seq within a batch; the state outlives a restart from the checkpoint.
    """

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts, error = state.get if state.exists else ("pending", 0, None)
        rows = pd.concat(list(batches)).sort_values("seq")
        for event, err in zip(rows["event"], rows["error"], strict=True):
            err = None if pd.isna(err) else err
            now, attempts = advance(now, attempts, event, err, max_retries)
            error = err if event == "error" else None if event in ("ok", "reset") else error
        state.update((now, attempts, error))
        yield pd.DataFrame({"url_id": [key[0]], "state": [now], "attempts": [attempts], "last_error": [error]})

    return events.groupBy("url_id").applyInPandasWithState(step, STATE, "state string, attempts int, last_error string", "update", GroupStateTimeout.NoTimeout)


def url_states_batch(events: DataFrame, max_retries: int = 2) -> DataFrame:
    """The batch twin: an ordered fold of each URL's few events."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "event", "error")))
    start = F.struct(F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"))

    def step(s, e):  # noqa: ANN001, ANN202
        can = e["error"].isNull() | e["error"].isin(*RETRYABLE)
        state = F.when(e["event"] == "start", "processing").when(e["event"] == "ok", "completed").when(e["event"] == "warn", "warning").when(e["event"] == "error", F.when(can & (s["attempts"] <= max_retries), "retrying").otherwise("failed")).when(e["event"] == "reset", "pending").otherwise(s["state"])
        attempts = F.when(e["event"] == "start", s["attempts"] + 1).when(e["event"] == "reset", 0).otherwise(s["attempts"])
        error = F.when(e["event"] == "error", e["error"]).when(e["event"].isin("ok", "reset"), None).otherwise(s["last_error"])
        return F.struct(state.alias("state"), attempts.alias("attempts"), error.alias("last_error"))

    return events.groupBy("url_id").agg(F.aggregate(ordered, start, step).alias("x")).select("url_id", "x.*")


def latest_progress(events: DataFrame, job: str = "job_id", at: str = "seq") -> DataFrame:
    """The last event of each job; the same on a stream (complete or update mode) and on a table."""
    rest = [c for c in events.columns if c not in (job, at)]
    return events.groupBy(job).agg(F.max_by(F.struct(*rest), at).alias("e"), F.max(at).alias(at)).select(job, at, "e.*")


def log_sink(logs: DataFrame, path: str, checkpoint: str, least: str = "info"):  # noqa: ANN201
    """Appends log rows of a level at least to a table; exactly once by the checkpoint."""
    return level_at_least(logs, least).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def compact_log(logs: DataFrame, order: str, rows: int = 3000) -> DataFrame:
    """The newest rows, as a rolling log keeps them."""
    return logs.orderBy(F.desc(order)).limit(rows)


def collect_pages(pages: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Fetched pages to product documents as they come: each micro-batch is one folder, written again as a whole if it is repeated.

    Pausing is stopping the query; started again with its checkpoint, it goes on where it was.
    """
    from ..operators.products import pages_to_products

    def step(batch: DataFrame, number: int) -> None:
        pages_to_products(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
