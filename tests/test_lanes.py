"""Host lanes and the page cache as streams."""

import time

import pytest
from pyspark.sql import functions as F

from merchloom.operators import catalog
from merchloom.streaming import lanes

ADD = "kind string, ordinal long, url string, at_ms long, status int, retry_after int, t_ms long"


@pytest.fixture(autouse=True)
def rocks(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    lanes.use_rocksdb(spark)
    spark.conf.set(names[2], "2")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def put(spark, rows, folder, name, schema=ADD):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/{name}")


def run(spark, stream, out, checkpoint):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(60)
    return spark.read.parquet(out).collect()


def events(spark, folder):
    e = spark.readStream.schema(ADD).json(f"{folder}/*")
    return e.withColumn("t", F.timestamp_millis("t_ms")).drop("t_ms").withWatermark("t", "0 seconds")


def test_starts_equal_the_batch_schedule(spark, tmp_path):
    """Two micro-batches and a restart; the last row moves the watermark past all starts."""
    queue = [("add", i, f"https://h{i % 3 if i % 2 else 0}.example/{i}", 0, None, None, 1 + i // 25) for i in range(40)]
    out = lambda: run(spark, lanes.host_lanes(events(spark, tmp_path)), f"{tmp_path}/out", f"{tmp_path}/ck")
    put(spark, queue[:25], tmp_path, "q1")
    out()
    put(spark, [*queue[25:], ("add", 1000, "https://last.example/", 0, None, None, 10_000_000)], tmp_path, "q2")
    got = {r.ordinal: r.start_ms for r in out() if r.ordinal < 1000}
    table = spark.createDataFrame([(q[1], q[2]) for q in queue], "ordinal long, url string").withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    assert got == {r.ordinal: r.start_ms for r in catalog.schedule(table, "host", "ordinal", 1200).collect()}


def test_slow_down_and_places(spark, tmp_path):
    """One place: the next starts when the answer is there; 429 with Retry-After holds the lane and comes again first."""
    make = lambda: lanes.host_lanes(events(spark, tmp_path), gap_ms=1000, retries=1, at_once=1)
    out = lambda: sorted((r.start_ms, r.ordinal, r.attempt) for r in run(spark, make(), f"{tmp_path}/out", f"{tmp_path}/ck") if r.host == "s.example")
    put(spark, [("add", 1, "https://s.example/a", 0, None, None, 1), ("add", 2, "https://s.example/b", 0, None, None, 1)], tmp_path, "q1")
    assert out() == [(0, 1, 0)]
    put(spark, [("answer", 1, "https://s.example/a", 500, 429, 5, 2), ("add", 9, "https://t.example/", 0, None, None, 9000)], tmp_path, "q2")
    assert out() == [(0, 1, 0), (5500, 1, 1)]
    put(spark, [("answer", 1, "https://s.example/a", 9500, 429, None, 9500), ("answer", 7, "https://s.example/b", 9500, 200, None, 9500)], tmp_path, "q3")  # no retry is left; nobody asked 7
    assert out() == [(0, 1, 0), (5500, 1, 1), (9500, 2, 0)]


def test_pauses():
    assert [lanes.pause_ms(*x) for x in ((5, 0, 4000), (90, 0, 4000), (None, 0, 4000), (0, 2, 4000), (-1, 1, 10))] == [5000, 60_000, 4000, 16_000, 20]


def test_clock(spark, tmp_path):
    """By the clock, each start waits for its time."""
    put(spark, [("add", i, "https://s.example/", 0, None, None, 0) for i in range(3)], tmp_path, "q1")
    stream = lanes.host_lanes(spark.readStream.schema(ADD).json(f"{tmp_path}/q*").drop("t_ms"), gap_ms=300, clock=True)
    q = stream.writeStream.format("memory").queryName("clocked").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(60):
            if spark.table("clocked").count() == 3:
                break
            time.sleep(0.5)
        assert [r.start_ms for r in spark.table("clocked").orderBy("ordinal").collect()] == [0, 300, 600]
    finally:
        q.stop()


def test_cache(spark, tmp_path):
    """An answer is reused, bad ones are not kept, the oldest goes when there are too many, and all go in time."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    ask = "url string, ordinal long"
    calls = str(tmp_path / "calls")

    def fetch(url):
        with open(calls, "a") as f:
            f.write(url + "\n")
        return {"status": 500 if url.endswith("bad") else 200, "body": "x"}

    out = lambda: {r.ordinal: (r.from_cache, r.status) for r in run(spark, lanes.cached_pages(spark.readStream.schema(ask).json(f"{tmp_path}/q*"), fetch, 30_000, most=2), f"{tmp_path}/out", f"{tmp_path}/ck")}
    put(spark, [("https://s.e/a", 1), ("https://s.e/a", 2), ("https://s.e/bad", 3), ("https://s.e/bad", 4)], tmp_path, "q1", ask)
    began = time.time()
    assert out() == {1: (False, 200), 2: (True, 200), 3: (False, 500), 4: (False, 500)}
    put(spark, [("https://s.e/a", 5), ("https://s.e/b", 6), ("https://s.e/c", 7), ("https://s.e/a", 8)], tmp_path, "q2", ask)
    got = out()
    assert time.time() - began < 30 and [got[i][0] for i in (5, 6, 7, 8)] == [True, False, False, False]
    time.sleep(31)
    put(spark, [("https://s.e/c", 9), ("https://s.e/c", 10)], tmp_path, "q3", ask)
    got = out()
    assert (got[9][0], got[10][0]) == (False, True)
    assert open(calls).read().count("/a\n") == 2
