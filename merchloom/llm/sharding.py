"""Operator 12: a uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Every input partition permutes its rows locally. How many of them go to each shard is drawn exactly: given the shards'
sizes, the counts of a uniform random permutation are multivariate hypergeometric, so a matrix of partitions by shards is
drawn whose rows add up to the partitions and whose columns add up to the shards. The draw goes down a tree with FAN
partitions to a node: each node shares what its parent was given among its children, in a task of its own. Rows are then
exchanged, and permuted again within their shard, in buckets, so no shard has to fit into a task.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared

SHARDS = 8
#: Children of a node of the tree over partitions.
FAN = 256
#: Rows of a bucket in the second permutation, about.
BUCKET_ROWS = 8192
SEED = 12


def shard_sizes(n: int, shards: int) -> list[int]:
    """Counts at most one apart."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def hypergeometric(total: int, marked: int, drawn: int, u: float) -> int:
    """Marked among `drawn` of `total`, `marked` of them marked: the inverse of the distribution at u in [0, 1).

    Weights relative to the mode are built outwards by their ratios, over 12 standard deviations on each side; beyond
    those lies less mass than a double can tell from none.
    """
    low, high = max(0, drawn - (total - marked)), min(drawn, marked)
    if low == high:
        return low
    mode = min(max((drawn + 1) * (marked + 1) // (total + 2), low), high)
    reach = int(12 * math.sqrt(drawn * (marked / total) * ((total - marked) / total) * ((total - drawn) / max(total - 1, 1)))) + 8
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((marked - up) * (drawn - up) / ((up + 1) * (total - marked - drawn + up + 1)))
    below = np.cumprod(down * (total - marked - drawn + down) / ((marked - down + 1) * (drawn - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    mass = np.cumsum(weights)
    return mode - len(below) + min(int(np.searchsorted(mass, u * mass[-1], side="right")), len(weights) - 1)


def draw_rows(quota: list[int], counts: list[int], rng: np.random.Generator) -> list[list[int]]:
    """A matrix with these column sums and row sums: each row takes its share of what the columns still hold."""
    left, rows = list(quota), []
    for count in counts:
        total, drawn, row = sum(left), count, []
        for held in left:
            k = hypergeometric(total, held, drawn, rng.random())
            row.append(k)
            total, drawn = total - held, drawn - k
        left = [a - b for a, b in zip(left, row, strict=True)]
        rows.append(row)
    return rows


def _share(level: int, seed: int) -> object:
    """The children of one node, each with its count, to rows of the matrix."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("child").to_numpy())
        children, counts = (table.column(c).to_numpy()[order].tolist() for c in ("child", "n"))
        parent = table.column("node")[0].as_py()
        rng = np.random.Generator(np.random.Philox(int.from_bytes(blake2b(f"{seed}:{level}:{parent}".encode(), digest_size=8).digest(), "big")))
        return pa.table({"node": pa.array(children, pa.int64()), "quota": pa.array(draw_rows(table.column("quota")[0].as_py(), counts, rng), pa.list_(pa.int64()))})

    return run


def communication_matrix(counts: DataFrame, sizes: list[int], shared: Shared, seed: int = SEED, fan: int = FAN) -> DataFrame:
    """Rows (part, n) of input partitions to rows (part, quota): how many of their rows each shard gets.

    quota adds up to n over shards, and to `sizes` over partitions. A task holds one node: its children by the shards.
    """
    spark = counts.sparkSession
    most = counts.agg(F.max("part")).first()[0] or 0
    height = 1
    while fan**height <= most:
        height += 1
    above = spark.createDataFrame([(0, list(sizes))], "node long, quota array<long>")
    for level in range(height - 1, -1, -1):
        children = counts.groupBy(F.floor(F.col("part") / fan**level).alias("child")).agg(F.sum("n").alias("n")).withColumn("node", F.floor(F.col("child") / fan))
        above = children.join(above, "node").groupBy("node").applyInArrow(_share(level, seed), "node long, quota array<long>")
        above = shared.keep(above, f"matrix-{level}")  # drawn once, whatever is lost later
    return above.withColumnRenamed("node", "part")


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows and columns of `docs`, with shard and slot: a uniform random order, cut into shards of equal size.

    Counts of shards are at most one apart; slots are gapless from 0 in each shard. Rows are told apart by where they
    stand, so repeated rows, and rows with nulls in any column, are placed one by one. An empty table gives no rows;
    with fewer rows than shards the last ones are empty. Reruns agree where Spark splits the input alike. Columns shard
    and slot of `docs` itself are replaced.
    """
    shared = Shared(docs.sparkSession)
    docs = docs.drop("shard", "slot")
    place = F.monotonically_increasing_id()
    local = docs.withColumn("_part", F.spark_partition_id().cast("long")).withColumn("_turn", F.xxhash64(F.lit(seed), place)).sortWithinPartitions("_turn")
    local = local.withColumn("_rank", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("_turn")
    rows = shared.keep(local, "permuted")  # places and ranks stay as they are from here on
    counts = shared.keep(rows.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n")), "counts")
    n = counts.agg(F.sum("n")).first()[0] or 0
    matrix = communication_matrix(counts, shard_sizes(n, shards), shared, seed)
    ends = F.aggregate("quota", F.array().cast("array<bigint>"), lambda a, q: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + q)))
    dealt = rows.join(matrix.select(F.col("part").alias("_part"), ends.alias("_ends")), "_part")
    dealt = dealt.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank")))).drop("_ends")
    buckets = max(1, -(-n // (shards * BUCKET_ROWS)))
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), "_part", "_rank"), F.lit(buckets)))
    sizes = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    bases = sizes.select("shard", "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
    turn = Window.partitionBy("shard", "_bucket").orderBy(F.xxhash64(F.lit(seed), F.lit("turn"), "_part", "_rank"), "_part", "_rank")
    out = dealt.withColumn("_at", F.row_number().over(turn).cast("long")).join(bases, ["shard", "_bucket"])
    return out.select(*docs.columns, "shard", (F.col("_base") + F.col("_at") - 1).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; its files hold the rows in the order of their slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
