"""Shared helpers of the corpus operators: table access, shared-folder tables, text blocks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a text table that go to a Python worker at once; long texts make larger batches costly.
BATCH_ROWS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by a path that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker gets at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, one of our own if this machine is all."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="merchloom-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a shared folder through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Shared:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    They stay until the session ends, as results are read from them late; who has written a result releases what made it.
    """

    _open: ClassVar[list[Shared]] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/merchloom-{uuid.uuid4().hex}"
        Shared._open.append(self)
        atexit.register(self._at_exit)

    @classmethod
    def opened(cls) -> int:
        return len(cls._open)

    @classmethod
    def release(cls, since: int) -> None:
        """Remove the tables of all that were opened since opened() gave that number."""
        while len(cls._open) > since:
            one = cls._open.pop()
            atexit.unregister(one._at_exit)
            remove(one.spark, one.root)

    def _at_exit(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # the session is already gone; its folder goes with it
            pass

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_by(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """As keep, in one folder for each value of a column."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").partitionBy(column).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")


def ranked(df: DataFrame, group: str, order: list[str], shared: Shared, name: str) -> DataFrame:
    """Adds place, the rank from 0 within the group in ascending order (nulls first), and total, the group's rows; group has no nulls.

    Rows are ranged over tasks by group and order, written, and each task's part of a group counted, so that one group
    may hold any share of the rows. Equal rows lie in any order.
    """
    at, rest = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = shared.keep(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()), name)
    parts = rows.groupBy(group, at.alias("_part")).agg(F.count("*").alias("_n"), F.min(rest).alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select(group, "_part", (F.sum("_n").over(earlier) - F.col("_n") - F.col("_first")).alias("_base"), F.sum("_n").over(Window.partitionBy(group)).alias("total"))
    return rows.withColumn("_part", at).join(parts, [group, "_part"]).withColumn("place", F.col("_base") + rest).drop("_at", "_part", "_base")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


#: Keys of rows without an id begin here, so that they come after all others.
NO_ID = 1 << 62


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "row_key") -> DataFrame:
    """Adds a whole number that tells rows apart and keeps their order: by id, then by a hash of the text, rows without an id last.

    Where no id has several texts, and ids are whole numbers, the key is the id itself, and for rows without one a hash of
    the text that comes after all ids. Else it is the rank of (id, hash) among all of them: ids of any size and kind keep
    their order, for the price of one range partitioning of ids and a join. Rows that share both share their key. Whether
    ids repeat is counted over all rows, with one shuffle of ids.
    """
    text = F.xxhash64(text_col)
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole:
        doc_id = F.col(id_col).cast("long")
        ids = docs.where(F.col(id_col).isNotNull()).groupBy(doc_id.alias("id")).agg(F.min(text).alias("least"), F.max(text).alias("most"))
        seen = ids.agg(F.max((F.col("least") < F.col("most")) | (F.col("id") >= NO_ID)).alias("clash")).first()
        if not seen.clash:
            return docs.withColumn(name, F.coalesce(doc_id, F.lit(NO_ID) + text.bitwiseAND(F.lit(NO_ID - 1))))
    pairs = docs.select(F.lit(0).alias("_all"), F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("_id"), text.alias("_hash")).distinct()
    places = ranked(pairs, "_all", ["_none", "_id", "_hash"], Shared(docs.sparkSession), "row_keys").select("_id", "_hash", F.col("place").alias(name))
    keyed = docs.withColumn("_text", text)
    return keyed.join(places, keyed[id_col].eqNullSafe(places["_id"]) & (keyed["_text"] == places["_hash"])).drop("_id", "_hash", "_text")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]]
    return raw, starts - starts[0]


def slices(offsets: np.ndarray, limit: int):
    """Ranges of rows with about `limit` bytes each; a longer row comes alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Odd base of the polynomial hash and a random value for every byte.
BASE = np.uint64(0xC6A4A7935BD1E995)
with np.errstate(over="ignore"):
    BYTE = mix((np.arange(1, 257, dtype=np.uint64) * MULT) ^ np.uint64(0x5851F42D4C957F2D))
    INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int, name: str) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, np.uint64)
        with np.errstate(over="ignore"):
            have[1:] = base
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _powers[name] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of BYTE[data[j]] * BASE ** j over j < i."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[data] * powers(BASE, len(data), "base"), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], independent of where it stands."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix), "inverse")[start])


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word [^\\x20\\x09-\\x0D]+, and the index of each text's first word (n + 1 values)."""
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    if len(data):
        before[1:] = inside[:-1]
        cut = offsets[:-1]
        before[cut[cut < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = inside[1:]
        cut = offsets[1:] - 1
        after[cut[cut >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z; bytes of other characters never fall in that range."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out
