"""Operator 7: repeated byte strings by a sampled, range-partitioned suffix order.

A byte is removed if some string of LENGTH bytes that covers it also starts earlier. Sorting every suffix would move
the corpus many times over, so suffixes are taken at positions that the text itself selects: of every window of LENGTH
bytes, the leftmost of its GRAM-byte strings with the least hash is its anchor, and equal windows have equal anchors.
The windows around one anchor form an entry whose leading token is the anchor's hash and whose second token is the hash
of all bytes of those windows. Entries are range-partitioned by splitters sampled from these tokens, ordered within each
bucket by multikey quicksort, and compared with their neighbours, across bucket boundaries too. Equal entries repeat as a
whole; both their tokens, 128 bits, are equal. Where one leading token has several second tokens, one entry of each is
compared window by window, in the same way, by a token of 64 bits for each window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow_batches, mix, prefix_hash, range_hash, row_keys, slices, text_bytes

LENGTH, GRAM = 100, 32
#: Bytes of text that are hashed at once; longer texts come in overlapping pieces.
BLOCK = 1 << 20
#: Entries in a bucket, about: it is ordered in one worker's memory.
BUCKET = 1_500_000
#: Rows that the quicksort orders at once.
SMALL = 4096
ENTRY = "lead long, ctx long, doc long, pos long, len int"


def _windows(cuts: np.ndarray, length: int) -> np.ndarray:
    """Whether a window that starts at a byte stays inside its text."""
    ok = np.ones(cuts[-1], bool)
    for end, begin in zip(cuts[1:], cuts[:-1], strict=True):
        ok[max(begin, end - length + 1) : end] = False
    return ok


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def entries_of(data: np.ndarray, cuts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Entries of some texts end to end: lead, ctx, start of the first window, number of windows."""
    if len(data) < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    prefix = prefix_hash(data)
    grams = range_hash(prefix, np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    anchor = _least(grams >> bits << bits | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    anchor = anchor.astype(np.int64)
    starts = np.flatnonzero(_windows(cuts, length)[: len(anchor)])
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    own = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first, count = starts[at], np.diff(np.append(at, len(starts)))
    with np.errstate(over="ignore"):
        ctx = mix(range_hash(prefix, first, first + count + length - 1) + (count * 1024 + own[at] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return grams[own[at]], ctx, first, count


def _pieces(offsets: np.ndarray, length: int, block: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, first byte, last byte + 1): rows together, or a long row's overlapping parts."""
    for lo, hi in slices(offsets, block):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= 2 * block:
            yield lo, hi, a, b
        else:
            for at in range(a, b - length + 1, block):
                yield lo, hi, at, min(b, at + block + length - 1)


def _entry_rows(length: int, gram: int) -> object:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, a, b in _pieces(offsets, length, BLOCK):
                cuts = np.clip(offsets[lo : hi + 1], a, b) - a
                lead, ctx, first, count = entries_of(data[a:b], cuts, length, gram)
                row = np.searchsorted(cuts, first, side="right") - 1
                doc = ids[lo:hi][row]
                pos = first + a - offsets[lo:hi][row]
                yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(doc, pa.int64()), pa.array(pos, pa.int64()), pa.array(count, pa.int32())], ["lead", "ctx", "doc", "pos", "len"])

    return run


def multikey_order(keys: tuple[np.ndarray, ...], small: int = SMALL) -> np.ndarray:
    """The order of rows by several keys, by multikey quicksort: rows are strings whose characters are the keys.

    A range is parted in three by a pivot of the first key in which it is not yet known to be equal; the middle part goes on
    with the next key. Small ranges are ordered at once.
    """
    n, last = len(keys[0]), len(keys)
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == last:
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort([k[part] for k in keys[depth:][::-1]])]
            continue
        x = keys[depth][part]
        sample = np.sort(x[:: max(1, (hi - lo) // 255)])
        pivot = sample[len(sample) // 2]
        less, more = x < pivot, x > pivot
        a, c = part[less], part[more]
        order[lo:hi] = np.concatenate([a, part[~(less | more)], c])
        todo += [(lo, lo + len(a), depth), (lo + len(a), hi - len(c), depth + 1), (hi - len(c), hi, depth)]
    return order


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of one bucket, in no order, to those that share their leading token, and two rows about its boundaries.

    again: an equal entry stands earlier; several: the leading token has other second tokens too. A leading token at
    the bucket's edge may go on beyond it, so its entries are all kept and count as several.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return
    block = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in whole]) for i in range(5)]
    del whole
    order = multikey_order(tuple(block[:4]))
    lead, ctx, doc, pos, length = (x[order] for x in block)
    n = len(lead)
    new_lead = np.ones(n, bool)
    new_lead[1:] = lead[1:] != lead[:-1]
    new = new_lead.copy()
    new[1:] |= ctx[1:] != ctx[:-1]
    of = np.cumsum(new) - 1
    first_doc, first_pos = doc[new][of], pos[new][of]
    again = (doc != first_doc) | (pos != first_pos)
    group = np.cumsum(new_lead) - 1
    starts = np.flatnonzero(new_lead)
    size = np.diff(np.append(starts, n))
    kinds = np.add.reduceat(new.astype(np.int64), starts)
    edge = (group == 0) | (group == group[-1])
    keep, several = (size[group] > 1) | edge, (kinds[group] > 1) | edge

    def rows(columns: list[np.ndarray], again: np.ndarray, several: np.ndarray, kind: int) -> pa.RecordBatch:
        types = (pa.int64(),) * 4 + (pa.int32(),)
        fixed = [pa.array(np.full(len(again), x, np.int32)) for x in (kind, part)]
        return pa.RecordBatch.from_arrays([*fixed, *[pa.array(x, t) for x, t in zip(columns, types, strict=True)], pa.array(again), pa.array(several)], ["kind", "part", "lead", "ctx", "doc", "pos", "len", "again", "several"])

    yield rows([x[keep] for x in (lead, ctx, doc, pos, length)], again[keep], several[keep], 0)
    for kind, i in ((1, 0), (2, n - 1)):  # the first token, and the last one with the first entry that is equal to it
        yield rows([np.array([x]) for x in (lead[i], ctx[i], first_doc[i], first_pos[i], 0)], np.array([False]), np.array([False]), kind)


def neighbours(entries: DataFrame, about: int, shared: Shared, name: str) -> DataFrame:
    """Entries that share their leading token with another, marked as in _runs, right across boundaries too.

    Spark samples the splitters; the whole key is in the order, so one frequent token spreads over buckets. There are so
    many buckets that `about` entries make about BUCKET in each. Each bucket tells its first and last token, and the
    driver joins up what crosses them: two rows a bucket.
    """
    spark = entries.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-about // BUCKET))
    found = shared.keep(entries.repartitionByRange(parts, "lead", "ctx", "doc", "pos").mapInArrow(_runs, f"kind int, part int, {ENTRY}, again boolean, several boolean"), name)
    edges: dict[int, dict[int, tuple]] = {}
    for r in found.where("kind > 0").collect():
        edges.setdefault(r.part, {})[r.kind] = (r.lead, r.ctx, r.doc, r.pos)
    fixes, running = [], None
    for part in sorted(edges):
        first, end = edges[part][1], edges[part][2]
        if running is not None and first[:2] == running[:2]:
            fixes.append((part, *running))
            if end[:2] != running[:2]:
                running = end
        else:
            running = end
    found = found.where("kind = 0").drop("kind")
    if not fixes:
        return found.drop("part")
    fix = F.broadcast(spark.createDataFrame(fixes, "part int, f_lead long, f_ctx long, f_doc long, f_pos long"))
    crosses = (F.col("f_lead") == F.col("lead")) & (F.col("f_ctx") == F.col("ctx"))
    later = (F.col("f_doc") != F.col("doc")) | (F.col("f_pos") != F.col("pos"))
    return found.join(fix, "part", "left").withColumn("again", F.col("again") | F.coalesce(crosses & later, F.lit(False))).select(*[c for c in found.columns if c != "part"])


def _window_rows(length: int) -> object:
    """Texts with some of their entries to one row for each window of those."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer((batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                spans = batch.column(2)[i].values
                pos, count = (spans.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
                starts = np.unique(np.repeat(pos - np.cumsum(count) + count, count) + np.arange(count.sum()))
                starts = starts[starts + length <= len(data)]
                if not len(starts):
                    continue
                hashes = range_hash(prefix_hash(data), starts, starts + length)
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, batch.column(0)[i].as_py(), np.int64)), pa.array(starts), pa.array(np.ones(n, np.int32))], ["lead", "ctx", "doc", "pos", "len"])

    return run


def _cut_rows(length: int, keep: bool) -> object:
    """Texts with their repeated windows to what is left of them."""
    import hashlib

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                spans = batch.column(2)[i].values
                pos, count = (spans.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
                order = np.argsort(pos, kind="stable")
                begin, end = pos[order], np.minimum(pos[order] + count[order] + length - 1, len(raw))
                reach = np.maximum.accumulate(end)
                new = np.ones(len(begin), bool)
                new[1:] = begin[1:] > reach[:-1]
                at = np.flatnonzero(new)
                stop = reach[np.append(at[1:], len(begin)) - 1]
                kept = b"".join(raw[a:b] for a, b in zip([0, *stop.tolist()], [*begin[at].tolist(), len(raw)], strict=True))
                out.append((hashlib.sha256(raw).hexdigest(), int((stop - begin[at]).sum()), len(at), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep else None))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", "sha", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the text
    that is left, without the characters that a cut goes through.

    Null and empty texts, and texts shorter than `length`, lose nothing. Earlier means a smaller id, or the same id and
    an earlier start; ids are whole numbers. Rows that share an id but not a text are texts of their own, in the order of
    a hash; rows without an id come after all others, in such an order too. Rows that share id and text are judged
    alike, as one text. Repeats within a text, overlapping ones too, count. Texts are read whole; other columns are
    ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = Shared(spark)
    keyed = row_keys(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", name="doc")
    texts = keyed.select("doc", "text")
    long_enough = texts.where(F.octet_length("text") >= length)
    entries = long_enough.mapInArrow(_entry_rows(length, gram), ENTRY)
    size = long_enough.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = neighbours(entries, 2 * size // (length - gram + 2), shared, "entries")
    alone = found.where("several AND NOT again").groupBy("doc").agg(F.array_distinct(F.collect_list(F.struct("pos", "len"))).alias("spans"))
    windows = alone.join(long_enough, "doc").select("doc", "text", "spans")
    n_windows = found.where("several AND NOT again").agg(F.sum("len")).first()[0] or 0
    single = neighbours(windows.mapInArrow(_window_rows(length), ENTRY), n_windows, shared, "windows")
    again = found.where("again").select("doc", "pos", "len").unionByName(single.where("again").select("doc", "pos", "len"))
    spans = again.groupBy("doc").agg(F.collect_list(F.struct("pos", "len")).alias("spans"))
    cut = long_enough.join(spans, "doc").select("doc", "text", "spans").mapInArrow(_cut_rows(length, keep_text), "doc long, sha string, n_removed long, n_spans long, kept_sha256 string, kept string")
    cut = cut.groupBy("doc", "sha").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "kept")])
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = keyed.select("id", "doc", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"), *(["text"] if keep_text else []))
    out = rows.join(cut, ["doc", "sha"], "left")
    zero = F.lit(0).cast("long")
    columns = [F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select(*columns, *([F.coalesce("kept", "text").alias("kept")] if keep_text else []))


#: The query's rows in DuckDB, by all windows of all documents.
SQL = rf"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(octet_length(b) - {LENGTH - 1}, 0))) AS i FROM d)),
f AS (SELECT g, min(struct_pack(doc_id := doc_id, i := i)) AS first FROM w GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE (doc_id, i) <> (first.doc_id, first.i)),
e AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, true) AS new FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS z FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM e) GROUP BY doc_id, k),
n AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM (SELECT * FROM s UNION ALL SELECT doc_id, octet_length(b), octet_length(b) FROM d)),
t AS (SELECT k.doc_id, string_agg(substr(d.h, 2 * a::BIGINT + 1, 2 * (z - a)::BIGINT), '' ORDER BY a) AS x FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(t.x)) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) JOIN t USING (doc_id)
"""
