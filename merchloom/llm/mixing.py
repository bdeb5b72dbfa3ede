"""Operator 2: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame operations only. Each source's documents are dealt into permuted blocks of about a thousand. A source
whose target is r times its size takes floor(r) whole copies of every block and, for the rest, whole blocks in
permuted order with one last block in part. The drawn block copies of all sources are split among the output
shards by a binary tree: every node halves its copies exactly, and how many of each source go left is a
multivariate-hypergeometric draw. Each shard then takes its quota of every source's copies in another permuted
order, and its documents get a shuffled position of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_DOCS = 1000
#: Copies of a source at most.
MOST_COPIES = 3
#: Levels of the tree: 2 ** LEVELS output shards.
LEVELS = 4
SEED = "mix-1"


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def _number(digest: Column) -> Column:
    """A whole number below 2 ** 32 from a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target to rows (source, source_size): by code point, null last, weights 1, 2, 3 repeating.

    Targets share all of the sizes by weight but stop at MOST_COPIES times the size; the level at which the other
    sources stand is the largest that any prefix of the sources, ordered by size over weight, would leave.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("cap_key", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    cap = F.lit(MOST_COPIES) * F.col("source_size")
    out = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    out = out.withColumn("cap_key", F.col("source_size") * F.when(F.col("weight") == 1, 6).when(F.col("weight") == 2, 3).otherwise(2))
    rest = F.sum("source_size").over(everything) - (F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - cap)
    open_weight = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", rest.cast("double") / open_weight)
    out = out.withColumn("level", F.max("level").over(everything))
    return out.withColumn("target", F.least(cap.cast("double"), F.col("level") * F.col("weight"))).drop("cap_key", "level")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked among `drawn` of `total`, `marked` of them marked: the inverse of the distribution at u in [0, 1).

    Weights relative to the mode are built outwards by their ratio over 12 standard deviations on each side.
    """
    zero = F.lit(0).cast("long")
    known = F.struct(*[x.cast("double").alias(n) for n, x in (("t", total), ("m", marked), ("d", drawn))], u.alias("u"))

    def ratio(v: Column, k: Column) -> Column:  # weight of k + 1 over weight of k
        return (v.m - k) * (v.d - k) / ((k + 1) * (v.t - v.m - v.d + k + 1))

    def bounded(v: Column) -> Column:
        sd = F.sqrt(v.d * v.m * (v.t - v.m) * (v.t - v.d) / F.greatest(v.t * v.t * (v.t - 1), F.lit(1.0)))
        low, high = F.greatest(F.lit(0.0), v.d - (v.t - v.m)), F.least(v.d, v.m)
        mode = F.least(F.greatest(F.floor((v.d + 1) * (v.m + 1) / (v.t + 2)).cast("double"), low), high)
        return F.struct(v.alias("v"), mode.cast("long").alias("mode"), F.least(high - mode, F.ceil(12 * sd) + 8).cast("long").alias("up"), F.least(mode - low, F.ceil(12 * sd) + 8).cast("long").alias("down"))

    def run(x: Column, n: Column, step: Callable[[Column, Column], Column]) -> Column:
        """Weights of n values next to the mode, one after another."""
        start = F.struct(F.lit(1.0).alias("w"), F.array().cast("array<struct<k:bigint,w:double>>").alias("a"))
        grow = lambda s, i: _let(F.struct((s.w * step(x, i)).alias("w")), lambda y: F.struct(y.w.alias("w"), F.concat(s.a, F.array(F.struct(i.alias("k"), y.w.alias("w")))).alias("a")))
        return F.aggregate(F.slice(F.sequence(zero, n), 2, n.cast("int")), start, grow).a

    def invert(x: Column) -> Column:
        above = F.transform(run(x, x.up, lambda x, i: ratio(x.v, x.mode + i - 1)), lambda y: F.struct((x.mode + y.k).alias("k"), y.w.alias("w")))
        below = F.transform(run(x, x.down, lambda x, i: 1 / ratio(x.v, x.mode - i)), lambda y: F.struct((x.mode - y.k).alias("k"), y.w.alias("w")))
        return _let(F.concat(F.reverse(below), F.array(F.struct(x.mode.alias("k"), F.lit(1.0).alias("w"))), above), lambda weights: pick(weights, x.v.u))

    def pick(weights: Column, u: Column) -> Column:
        mass = F.aggregate(weights, F.lit(0.0), lambda s, y: s + y.w)
        start = F.struct((u * mass).alias("left"), F.element_at(weights, -1).k.alias("k"), F.lit(False).alias("done"))
        return F.aggregate(weights, start, lambda s, y: F.struct((s.left - y.w).alias("left"), F.when(s.done, s.k).otherwise(y.k).alias("k"), (s.done | (s.left - y.w < 0)).alias("done"))).k

    return _let(known, lambda v: _let(bounded(v), invert))


def _draw_at(level: int) -> Callable[[Column, Column], Column]:
    """Step over a node's sources: each takes its share of what is still to be drawn for the left half."""

    def draw(s: Column, x: Column) -> Column:
        u = _number(_hash("split", F.lit(level), F.col("node"), x.key)).cast("double") / float(1 << 32)
        taken = _hypergeometric(s.total, x.n, s.drawn, u)
        return _let(taken, lambda k: F.struct((s.total - x.n).alias("total"), (s.drawn - k).alias("drawn"), F.concat(s.left, F.array(k)).alias("left")))

    return draw


def splitting_tree(copies: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows (key, n) to rows (key, shard, quota): exact halves at every node, hypergeometric by source.

    Quotas add up to n for each source, and shards differ by at most one copy at every node.
    """
    nodes = copies.agg(F.sort_array(F.collect_list(F.struct("key", F.col("n").cast("long").alias("n")))).alias("all")).select(F.lit(0).cast("long").alias("node"), "all")
    for level in range(levels):
        whole = F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x.n)
        odd_left = _number(_hash("half", F.lit(level), F.col("node"))) % 2  # which half gets the odd copy
        left_size = F.floor((whole + odd_left) / 2).cast("long")
        start = F.struct(whole.alias("total"), left_size.alias("drawn"), F.array().cast("array<bigint>").alias("left"))

        nodes = nodes.withColumn("left", F.aggregate("all", start, _draw_at(level)).left)
        halves = [F.zip_with("all", "left", lambda x, k: F.struct(x.key.alias("key"), k.alias("n"))), F.zip_with("all", "left", lambda x, k: F.struct(x.key.alias("key"), (x.n - k).alias("n")))]
        nodes = nodes.select(F.explode(F.array(*[F.struct((F.col("node") * 2 + i).alias("node"), h.alias("all")) for i, h in enumerate(halves)])).alias("x")).select("x.node", "x.all")
    return nodes.select(F.col("node").alias("shard"), F.explode("all").alias("x")).select("x.key", "shard", F.col("x.n").alias("quota"))


def _before(rows: DataFrame, order: str, amount: Column, name: str) -> DataFrame:
    """Adds the sum of `amount` over the rows of one key that come before, in the order of a hex digest.

    Sums over ranges of the digest come first, so a key that holds most rows is ordered in 256 parts and in no one task.
    """
    ranged = rows.withColumn("range", F.substring(order, 1, 2)).withColumn("amount", amount)
    sums = ranged.groupBy("key", "range").agg(F.sum("amount").alias("in_range"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("key", "range", (F.sum("in_range").over(earlier) - F.col("in_range")).alias("earlier"))
    within = Window.partitionBy("key", "range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = ranged.withColumn("here", F.sum("amount").over(within) - F.col("amount"))
    return here.join(sums, ["key", "range"]).withColumn(name, F.col("earlier") + F.col("here")).drop("range", "amount", "here", "earlier")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", levels: int = LEVELS) -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target, taken, shards, position.

    shards holds the output shard of every copy that the mix takes; in each of them documents stand by position,
    which is a hash. Null and empty texts have size 0 and are never taken; a null source is a source of its own,
    last in order. Rows with equal ids are ordered by size, and equal rows are interchangeable. An empty table
    gives no rows. Reruns agree, for every choice is a hash of ids. Other columns are ignored. One source may hold
    most rows: its documents are spread over blocks before anything is ordered, and its blocks over ranges. Sources
    themselves are few: their names and sizes pass through one task, as their targets depend on all of them.
    """
    shared = Shared(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = shared.keep(sized, "sized")
    stats = source_targets(sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))).drop("source", "weight")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    stats = stats.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS).cast("long"))
    stats = shared.keep(stats, "stats")
    place = _hash("doc", F.coalesce(F.col("id").cast("string"), F.lit("null")))
    dealt = sized.join(stats, "key").withColumn("place", place).withColumn("block", _number(F.col("place")) % F.col("n_blocks"))

    blocks = dealt.groupBy("key", "block").agg(F.sum("size").alias("block_size"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("order", _hash("block", F.col("key"), F.col("block")))
    blocks = _before(blocks, "order", F.col("block_size"), "before")
    copies = blocks.select("key", "block", "block_size", "whole", "rest", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("copy"))
    quota = F.when(F.col("copy") < F.col("whole"), F.col("block_size").cast("double")).otherwise(F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0.0)), F.col("block_size").cast("double")))
    copies = copies.withColumn("quota", quota).where("quota > 0")
    copies = shared.keep(copies.select("key", "block", "copy", "quota", (F.col("quota") < F.col("block_size")).alias("part")), "copies")

    quotas = splitting_tree(copies.groupBy("key").agg(F.count("*").alias("n")), levels)
    bounds = quotas.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("q"))
    ends = F.aggregate("q", F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a")), lambda s, x: F.struct((s.s + x.quota).alias("s"), F.concat(s.a, F.array(s.s + x.quota)).alias("a"))).a
    drawn = _before(copies.withColumn("turn", _hash("draw", F.col("key"), F.col("block"), F.col("copy"))), "turn", F.lit(1).cast("long"), "ahead").withColumn("rank", F.col("ahead") + 1)
    drawn = drawn.join(bounds.select("key", ends.alias("ends")), "key").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
    per_block = drawn.groupBy("key", "block").agg(
        F.sort_array(F.collect_list(F.when(~F.col("part"), F.col("shard")))).alias("full_shards"),
        F.max(F.when(F.col("part"), F.struct("quota", "shard"))).alias("partial"),
    )
    out = dealt.join(per_block, ["key", "block"], "left")
    in_part = out.where("partial IS NOT NULL")
    running = F.sum("size").over(Window.partitionBy("key", "block").orderBy("place", "size", "id").rowsBetween(Window.unboundedPreceding, 0))
    in_part = in_part.withColumn("extra", (running - F.col("size") / 2 <= F.col("partial.quota")) & (F.col("size") > 0))
    out = out.where("partial IS NULL").withColumn("extra", F.lit(False)).unionByName(in_part)
    full = F.coalesce("full_shards", F.array().cast("array<int>"))
    shards = F.when(F.col("size") == 0, F.array().cast("array<int>")).when(F.col("extra"), F.concat(full, F.array(F.col("partial.shard")))).otherwise(full)
    out = out.withColumn("shards", shards)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"), "shards", F.col("place").alias("position"))


#: The contract's rows in DuckDB: everything but the shards.
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('{SEED}:doc:' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
sources AS (SELECT key, first(source) AS source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY key),
weighted AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM sources),
keyed AS (SELECT *, source_size * (CASE weight WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 2 END) AS cap_key FROM weighted),
levelled AS (
  SELECT *, (sum(source_size) OVER () - (sum(3 * source_size) OVER (ORDER BY cap_key, source IS NULL, source ROWS UNBOUNDED PRECEDING) - 3 * source_size))::DOUBLE
         / sum(weight) OVER (ORDER BY cap_key, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM keyed),
targeted AS (SELECT *, least((3 * source_size)::DOUBLE, max(l) OVER () * weight) AS target FROM levelled),
stats AS (
  SELECT *, target - whole * source_size AS rest, ceil(n_docs / {BLOCK_DOCS}.0)::BIGINT AS n_blocks
  FROM (SELECT *, (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS whole FROM targeted)),
dealt AS (
  SELECT d.*, s.source_size, s.target, s.whole, s.rest, ('0x' || substr(d.place, 1, 8))::BIGINT % s.n_blocks AS block
  FROM sized d JOIN stats s USING (key)),
blocks AS (
  SELECT key, block, sum(size) AS block_size, first(rest) AS rest, md5('{SEED}:block:' || key || ':' || block) AS ord FROM dealt GROUP BY key, block),
quotas AS (
  SELECT key, block, block_size, least(greatest(rest - (sum(block_size) OVER (PARTITION BY key ORDER BY ord ROWS UNBOUNDED PRECEDING) - block_size), 0), block_size) AS quota FROM blocks),
running AS (
  SELECT d.*, q.quota, q.block_size, sum(size) OVER (PARTITION BY d.key, d.block ORDER BY place, size, doc_id ROWS UNBOUNDED PRECEDING) AS r
  FROM dealt d JOIN quotas q ON d.key = q.key AND d.block = q.block)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN quota > 0 AND (quota >= block_size OR r - size / 2.0 <= quota) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""
