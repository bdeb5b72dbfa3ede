"""Polite fetching as keyed state: a lane for each host, and a cache of its answers.

Both run as transformWithState, so they outlive restarts, and need the RocksDB state store (`use_rocksdb`). A lane is a
queue in map state with its head and tail beside it; a timer of the lane starts the next address. Times are those of the
watermark or of the clock, by the time mode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.url import host_of

#: What a lane takes: an address that arrives (kind add), or what one answered (kind answer).
LANE_EVENT = "kind string, ordinal long, url string, at_ms long, status int, retry_after int"
START = "host string, ordinal long, url string, attempt int, start_ms long"
#: A host may ask for a longer pause than that; it gets this one.
LONGEST_PAUSE_MS = 60_000
SLOW_DOWN = (429, 503)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers, map state and expiry need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def pause_ms(retry_after: int | None, attempt: int, backoff_ms: int) -> int:
    """How long a host that wants a pause is left alone: what it says in seconds, up to a bound, else longer each time."""
    return min(retry_after * 1000, LONGEST_PAUSE_MS) if retry_after and retry_after > 0 else backoff_ms * 2**attempt


class HostLane(StatefulProcessor):
    """One host: an address starts gap_ms after the one before it, and no sooner than it arrived.

    An answer of 429 or 503 puts its address at the head again while retries last and holds the lane; with at_once, no more
    than that many addresses are under way, and each answer frees a place.
    """

    def __init__(self, gap_ms: int, retries: int, backoff_ms: int, at_once: int | None, clock: bool) -> None:
        self.gap, self.retries, self.backoff, self.at_once, self.clock = gap_ms, retries, backoff_ms, at_once, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "place long", "ordinal long, url string, attempt int, ready_ms long")
        self.under_way = handle.getMapState("under_way", "ordinal long", "url string, attempt int")
        self.lane = handle.getValueState("lane", "head long, tail long, next_ms long, active int, timer_ms long")

    def _now(self, times) -> int:  # noqa: ANN001
        return times.getCurrentProcessingTimeInMs() if self.clock else times.getCurrentWatermarkInMs()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        head, tail, next_ms, active, timer = self.lane.get() if self.lane.exists() else (0, 0, 0, 0, -1)
        for r in sorted(rows, key=lambda r: (r.kind != "answer", r.ordinal)):
            if r.kind == "add":
                self.queue.updateValue((tail,), (r.ordinal, r.url, 0, r.at_ms))
                tail += 1
                continue
            if not self.under_way.containsKey((r.ordinal,)):
                continue
            url, attempt = self.under_way.getValue((r.ordinal,))
            self.under_way.removeKey((r.ordinal,))
            active -= 1
            if self.at_once is not None:
                next_ms = max(next_ms, r.at_ms)  # the place is free from then on
            if r.status in SLOW_DOWN and attempt < self.retries:
                next_ms = max(next_ms, r.at_ms + pause_ms(r.retry_after, attempt, self.backoff))
                head -= 1
                self.queue.updateValue((head,), (r.ordinal, url, attempt + 1, r.at_ms))
        yield from self._started(key, [head, tail, next_ms, active, timer], self._now(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        head, tail, next_ms, active, _ = self.lane.get()
        yield from self._started(key, [head, tail, next_ms, active, -1], max(self._now(timerValues), expiredTimerInfo.getExpiryTimeInMs()))

    def _started(self, key: tuple, lane: list[int], now: int) -> Iterator[Row]:
        """Starts what is due, and sets the timer for what comes next."""
        head, tail, next_ms, active, timer = lane
        due = None
        while head < tail and (self.at_once is None or active < self.at_once):
            ordinal, url, attempt, ready = self.queue.getValue((head,))
            due = max(next_ms, ready)
            if due > now:
                break
            self.queue.removeKey((head,))
            if self.at_once is not None or self.retries:
                self.under_way.updateValue((ordinal,), (url, attempt))
            head, active, next_ms, due = head + 1, active + 1, due + self.gap, None
            yield Row(host=key[0], ordinal=ordinal, url=url, attempt=attempt, start_ms=next_ms - self.gap)
        if due is not None and due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.lane.update((head, tail, next_ms, active, timer))

    def close(self) -> None:
        pass


def host_lanes(events: DataFrame, gap_ms: int = 1200, retries: int = 0, backoff_ms: int = 4000, at_once: int | None = None, clock: bool = False) -> DataFrame:
    """A stream of LANE_EVENT rows to the addresses that start, with their start times (START), one lane for each host.

    Without a clock, time is the stream's watermark on a column that the caller marks, which must grow from batch to batch
    (rows behind it are late, and Spark drops them): starts up to it are given, with the times that catalog.schedule gives
    for a table. With one, they are given as the clock reaches them. retries or at_once
    need the answers to come back as rows. A lane's queue is state on disk; only a micro-batch's rows of one host are
    sorted in memory, so bound the batches at their source.
    """
    keyed = events.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    lane = HostLane(gap_ms, retries, backoff_ms, at_once, clock)
    return keyed.groupBy("host").transformWithState(lane, START, "append", "processingTime" if clock else "eventTime")


ANSWERED = "url string, ordinal long, from_cache boolean, status int, body string"


class PageCache(StatefulProcessor):
    """One host's answers, kept for a time: map state by address with expiry, and list state with the order they came in."""

    def __init__(self, fetch: Callable[[str], dict], keep_ms: int, most: int) -> None:
        self.fetch, self.keep_ms, self.most = fetch, keep_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answers = handle.getMapState("answers", "url string", "status int, body string", self.keep_ms)
        self.order = handle.getListState("order", "url string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        for r in sorted(rows, key=lambda r: r.ordinal):
            if self.answers.containsKey((r.url,)):
                status, body = self.answers.getValue((r.url,))
                yield Row(url=r.url, ordinal=r.ordinal, from_cache=True, status=status, body=body)
                continue
            try:
                answer = self.fetch(r.url)
            except Exception as e:
                answer = {"status": 0, "body": f"{type(e).__name__}: {e}"}
            status, body = int(answer.get("status") or 0), answer.get("body")
            if 200 <= status < 400 and body:
                self._keep(r.url, status, body)
            yield Row(url=r.url, ordinal=r.ordinal, from_cache=False, status=status, body=body)

    def _keep(self, url: str, status: int, body: str) -> None:
        kept = [u for (u,) in self.order.get() if u != url]
        for old in kept[: max(0, len(kept) + 1 - self.most)]:
            self.answers.removeKey((old,))
        self.answers.updateValue((url,), (status, body))
        self.order.put([(u,) for u in [*kept, url][-self.most :]])

    def close(self) -> None:
        pass


def cached_pages(asks: DataFrame, fetch: Callable[[str], dict], keep_ms: int, most: int = 200) -> DataFrame:
    """A stream of asked addresses (url, ordinal) to their answers (ANSWERED): fetched, or kept from before.

    Good answers with a body are kept for keep_ms, the newest `most` of each host; others are asked for again. A host's
    addresses are asked one after another by the task that has its state. Expiry goes by the clock, for which Spark makes
    empty batches without end; a run by availableNow ends if spark.sql.streaming.noDataMicroBatches.enabled is false.
    """
    keyed = asks.select("url", F.col("ordinal").cast("long").alias("ordinal"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    return keyed.groupBy("host").transformWithState(PageCache(fetch, keep_ms, most), ANSWERED, "append", "processingTime")
