"""Operator 6: near-duplicate groups by min-max hashing.

Every permutation of a text's shingles gives two signature values, its least and its greatest, so a signature of
2 * PERMUTATIONS values costs half the hash evaluations. Signatures are banded; texts with equal shingle sets are
one class and only its representative goes on. Members of a band's bucket are first compared with a few leaders of
the bucket, then, where a bucket still holds several components, with each other across components. Candidates that
two-bit sketches of the signature rule out are not compared; all others are compared on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow_batches, lower_bytes, mix, prefix_hash, range_hash, row_keys, slices, text_bytes, word_bounds

SHINGLE, PERCENT = 5, 80
#: 192 permutations: a least and a greatest value each, 384 in all; the first 192 make 32 bands of 6. Two texts at the
#: threshold of 0.8 share no band with a chance of (1 - 0.8 ** 6) ** 32, below one in ten thousand.
PERMUTATIONS, BANDS, BAND_ROWS = 192, 32, 6
#: Sketches: the lowest two bits of each of the values, in WORDS words of low bits and as many of high ones. Pairs that
#: agree in this many deviations less than texts at the threshold do are not compared.
WORDS, DEVIATIONS = 2 * PERMUTATIONS // 64, 3.5
#: Orders in which a bucket's least member is a leader: by id, then by hash.
ORDERS = (0, 1, 2)
#: Shingles that one task holds to compare with one leader.
GROUP_SHINGLES = 20_000
BLOCK = 1 << 20
SKETCH = tuple(f"s{i + 1}" for i in range(2 * WORDS))
LOW, HIGH = SKETCH[:WORDS], SKETCH[WORDS:]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's k-word shingles, ascending within a text, and the n + 1 offsets.

    A text of fewer words is one shingle, a text without words none.
    """
    low = lower_bytes(data)
    starts, ends, first = word_bounds(low, offsets)
    words = range_hash(prefix_hash(low), starts, ends)
    n = len(offsets) - 1
    count = np.diff(first)
    shingles = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), shingles)
    cuts = np.concatenate([[0], np.cumsum(shingles)])
    at = first[:-1][owner] + np.arange(len(owner)) - cuts[:-1][owner]
    length = np.minimum(count[owner], k)
    acc = np.zeros(len(owner), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            here = i < length
            acc[here] = mix(acc[here] * np.uint64(0x9E3779B97F4A7C15) + words[at[here] + i] + np.uint64(i + 1))
    order = np.lexsort((acc, owner))
    acc, owner = acc[order], owner[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    acc, owner = acc[new], owner[new]
    return acc, np.searchsorted(owner, np.arange(n + 1))


def _odd(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(salt)) | np.uint64(1)


def signatures(hashes: np.ndarray, cuts: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Least and greatest value of each text under each permutation: shape (2 * permutations, texts with shingles)."""
    starts = cuts[:-1]
    out = np.empty((2 * permutations, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(zip(_odd(permutations, 1), _odd(permutations, 2), strict=True)):
            x = (hashes ^ b) * a
            out[2 * i] = np.minimum.reduceat(x, starts)
            out[2 * i + 1] = np.maximum.reduceat(x, starts)
    return out


def least_agree(percent: int, deviations: float | None = DEVIATIONS) -> int:
    """Two-bit values in which compared texts agree at least: equal ones, and a quarter of the others by chance."""
    if deviations is None:
        return 0
    p, n = percent / 100 + (1 - percent / 100) / 4, 2 * PERMUTATIONS
    return math.floor(n * p - deviations * math.sqrt(n * p * (1 - p)))


def _signature_rows(k: int) -> object:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets, BLOCK):
                hashes, cuts = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                size = np.diff(cuts)
                have = size > 0
                bands = np.zeros((hi - lo, BANDS), np.int64)
                prints, sketch = np.zeros((2, hi - lo), np.int64), np.zeros((len(SKETCH), hi - lo), np.int64)
                if have.any():
                    starts = cuts[:-1][have]
                    sig = mix(signatures(hashes, np.append(starts, len(hashes))))
                    with np.errstate(over="ignore"):
                        for b in range(BANDS):
                            acc = np.full(sig.shape[1], b + 1, np.uint64)
                            for r in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
                                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig[r])
                            bands[have, b] = acc.view(np.int64)
                        for i, salt in enumerate((3, 5)):
                            prints[i, have] = np.add.reduceat(mix(hashes * np.uint64(2 * salt + 1) + np.uint64(salt)), starts).view(np.int64)
                        for i in range(len(SKETCH)):
                            acc = np.zeros(sig.shape[1], np.uint64)
                            for bit in range(64):
                                acc |= (sig[64 * (i % WORDS) + bit] >> np.uint64(i // WORDS) & np.uint64(1)) << np.uint64(bit)
                            sketch[i, have] = acc.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * BANDS, BANDS), pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(size), *map(pa.array, prints), *map(pa.array, sketch), lists],
                    ["id", "own", "n", "f1", "f2", *SKETCH, "bands"],
                )

    return run


def _verified(k: int, percent: int) -> object:
    """Rows of one group (a leader and some of its candidates) to the candidates that it is linked with."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("role", "ascending")]).combine_chunks()
        data, offsets = text_bytes(table.column("text"))
        hashes, cuts = shingle_hashes(data, offsets, k)
        leader = hashes[cuts[0] : cuts[1]]
        ids = table.column("id").to_pylist()
        linked = []
        for i in range(1, len(ids)):
            own = hashes[cuts[i] : cuts[i + 1]]
            both = len(np.intersect1d(leader, own, assume_unique=True))
            if 100 * both >= percent * (len(leader) + len(own) - both):
                linked.append(ids[i])
        return pa.table({"a": pa.array([ids[0]] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return run


class _Groups:
    """Links between representatives, and the component each belongs to so far."""

    def __init__(self, docs: DataFrame, shared: Shared, shingle: int, percent: int) -> None:
        self.docs, self.shared, self.shingle, self.percent, self.step = docs, shared, shingle, percent, 0
        self.links: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.step += 1
        return self.shared.keep(df, f"{name}{self.step}")

    def drop(self, name: str, step: int) -> None:
        """Remove a table that nothing reads any more."""
        self.shared.drop(f"{name}{step}")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b, na, nb), every one decided on the whole shingle sets.

        A leader's candidates are dealt into groups of bounded size, and the leader's text goes to each of them.
        """
        spread = F.greatest(F.lit(1), F.ceil(F.col("weight") / GROUP_SHINGLES)).cast("long")
        weights = pairs.groupBy("a").agg(F.sum(F.col("nb") + 8).alias("weight")).select("a", spread.alias("parts"))
        dealt = self.keep(pairs.join(weights, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "dealt")
        roles = dealt.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("role")).unionByName(dealt.select(F.col("a").alias("id"), "a", "part", F.lit(0).alias("role")).distinct())
        rows = roles.join(self.docs, "id").select("a", "part", "role", "id", "text")
        return self.keep(rows.groupBy("a", "part").applyInArrow(_verified(self.shingle, self.percent), "a long, b long"), "links")

    def components(self) -> DataFrame:
        """Least representative that links reach, for every linked one: labels spread, then jump, until none changes."""
        links = self.links[0]
        for more in self.links[1:]:
            links = links.unionByName(more)
        edges = self.keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        labels = self.keep(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("c")), "labels")
        edges_step, labels_step = self.step - 1, self.step
        while True:
            near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("c").alias("m"))
            spread = labels.join(near, labels["id"] == near["a"]).select("id", F.least("c", "m").alias("n"), "c")
            spread = self.keep(spread, "spread")
            jump = spread.select(F.col("id").alias("n"), F.col("n").alias("j"))
            new = self.keep(spread.join(jump, "n", "left").select("id", F.least("n", F.coalesce("j", "n")).alias("c"), F.col("c").alias("old")), "labels")
            self.drop("labels", labels_step)
            self.drop("spread", self.step - 1)
            labels, labels_step = new.select("id", "c"), self.step
            if new.where("c <> old").isEmpty():
                self.drop("edges", edges_step)
                return labels


def near_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", deviations: float | None = DEVIATIONS) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Null and empty texts have no shingles and stay alone; a
    text of fewer words than a shingle is one. Rows with equal sets are linked. Ids are whole numbers. Rows that share an
    id but not a text are told apart; component_id is the least id that links reach, null where only rows without an id
    are linked, of which the one that comes first by a hash is kept. Texts are read whole. Other columns are ignored.

    Within a bucket leaders are compared with all members first. Members that are still in different components, and
    that sketches cannot tell apart, are then compared in pairs: texts that are all just under the threshold to each
    other have as many such pairs as a join on similarity must look at. `deviations` is the sketches' margin; None
    compares every pair of a bucket's components.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = Shared(spark)
    keyed = row_keys(docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")), "own", name="id")
    texts = keyed.select("id", "text", F.col("own").cast("long").alias("own"))
    sig = shared.keep(texts.mapInArrow(_signature_rows(shingle), f"id long, own long, n long, f1 long, f2 long, {', '.join(f'{c} long' for c in SKETCH)}, bands array<long>"), "signatures")
    sets = ["n", "f1", "f2"]
    reps = sig.where("n > 0").groupBy(*sets).agg(F.min("id").alias("rep"), F.min("own").alias("own"), *[F.first(c).alias(c) for c in (*SKETCH, "bands")])
    reps = shared.keep(reps, "representatives")
    keys = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    crowded = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    members = shared.keep(keys.join(crowded.hint("merge"), "key").join(reps.drop("f1", "f2", "own").hint("merge"), "rep"), "members")
    candidates = members.select(F.col("rep").alias("id")).distinct()
    groups = _Groups(shared.keep(texts.select("id", "text").join(candidates.hint("merge"), "id").groupBy("id").agg(F.first("text").alias("text")), "texts"), shared, shingle, percent)

    def sides(lead: DataFrame, rest: DataFrame, tested: DataFrame | None) -> DataFrame:
        """Pairs of one bucket, once each, that size and sketches do not rule out."""
        a, b = lead.alias("x"), rest.alias("y")
        differ = [F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}")).bitwiseOR(F.col(f"x.{q}").bitwiseXOR(F.col(f"y.{q}")))) for p, q in zip(LOW, HIGH, strict=True)]
        agree = 2 * PERMUTATIONS - sum(differ[1:], differ[0])
        small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
        cond = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") != F.col("y.rep")) & (100 * small >= percent * large) & (agree >= least_agree(percent, deviations))
        if "c" in lead.columns:
            # Both lists hold every bucket that two components share, so the first shared band is enough: each pair is made once.
            shared_band = F.coalesce(*[F.when(F.col("x.bands")[i] == F.col("y.bands")[i], F.lit(i)) for i in range(BANDS)])
            cond = cond & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.c") != F.col("y.c")) & (shared_band == F.col("x.band"))
        pairs = a.join(b, cond).select(F.least("x.rep", "y.rep").alias("p"), F.greatest("x.rep", "y.rep").alias("q"), F.when(F.col("x.rep") < F.col("y.rep"), F.col("x.n")).otherwise(F.col("y.n")).alias("np"), F.when(F.col("x.rep") < F.col("y.rep"), F.col("y.n")).otherwise(F.col("x.n")).alias("nq"))
        pairs = pairs.groupBy("p", "q").agg(F.first("np").alias("na"), F.first("nq").alias("nb")).select(F.col("p").alias("a"), F.col("q").alias("b"), "na", "nb")
        return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")

    def leaders(of: DataFrame) -> DataFrame:
        """For each bucket its least member in several orders, and the one whose sketch is nearest to the bucket's majority.

        Copies with edits of their own differ from each other twice as much as from what they were copied from; the
        member that agrees most with the majority is the least edited, and links most of the bucket in one step.
        """
        cols = ["rep", "n", *SKETCH]
        bits = [F.sum(F.getbit(c, F.lit(i))).alias(f"{c}_{i}") for c in LOW for i in range(64)]
        sums = of.groupBy("key").agg(F.count("*").alias("m"), *bits).where("m > 2")
        majority = [F.lit(0).cast("long") for _ in LOW]
        for j, c in enumerate(LOW):
            for i in range(64):
                majority[j] = majority[j].bitwiseOR(F.when(2 * F.col(f"{c}_{i}") > F.col("m"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        sums = groups.keep(sums.select("key", *[x.alias(f"m{j}") for j, x in enumerate(majority)]), "majority")
        far = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"m{j}"))) for j, c in enumerate(LOW)), F.lit(0))
        central = of.join(sums, "key").groupBy("key").agg(F.min(F.struct(far.alias("o"), *cols)).alias("l")).select("key", *[F.col(f"l.{c}").alias(c) for c in cols])
        picks = [F.min(F.struct((F.col("rep") if o == 0 else F.xxhash64("rep", F.lit(o))).alias("o"), *cols)).alias(f"l{o}") for o in ORDERS]
        each = of.groupBy("key").agg(*picks).select("key", F.explode(F.array(*[F.struct(*[F.col(f"l{o}.{c}").alias(c) for c in cols]) for o in ORDERS])).alias("l"))
        return each.select("key", "l.*").unionByName(central).distinct()

    def pending() -> DataFrame:
        """Members of buckets that still hold more than one component."""
        labelled = members.join(groups.components(), members["rep"] == F.col("id"), "left").select(*[members[c] for c in members.columns], F.coalesce("c", "rep").alias("c"))
        several = labelled.groupBy("key").agg((F.min("c") != F.max("c")).alias("several")).where("several").drop("several")
        return groups.keep(labelled.join(several, "key"), "pending")

    first = groups.keep(sides(leaders(members), members, None), "pairs")
    groups.links.append(groups.compare(first))
    rest = pending()
    second = groups.keep(sides(rest, rest, first.select("a", "b")), "pairs")
    groups.links.append(groups.compare(second))
    found = groups.components()

    linked = found.withColumnRenamed("id", "rep").join(reps.select("rep", "own"), "rep")
    least = linked.groupBy("c").agg(F.min("own").alias("least"))
    named = linked.join(least, "c").select("rep", "c", "least", F.lit(True).alias("linked"))
    classes = sig.where("n > 0").select("id", "own", *sets).join(reps.select(*sets, "rep", F.col("own").alias("first")), sets).join(named, "rep", "left")
    classes = classes.select("id", "own", "n", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"), F.coalesce("c", "rep").alias("c"))
    alone = sig.where("n = 0").select("id", "own", "n", F.col("own").alias("component_id"), F.col("id").alias("c"))
    out = classes.unionByName(alone)
    kept = F.when(F.col("own").isNull(), F.col("component_id").isNull() & (F.col("id") == F.col("c"))).otherwise(F.col("own") == F.col("component_id"))
    return out.select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


#: The query's rows in DuckDB, by all pairs that share a shingle (4 words).
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
