"""Operator 8: toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digit substitutions), an Aho-Corasick automaton finds lexicon entries that
start at a word's start, hits inside an exception phrase do not count, and the sum of the weights, normalised by
the text's length, is turned into a probability. Entries are seed words and word stems mined from labelled texts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

# Seed words, phrases in which a seed word is harmless, and look-alike characters.
SEEDS = ("idiot", "moron", "stupid", "trash", "scum", "loser", "pathetic", "worthless", "disgusting", "clown")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "loser bracket")
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
GREEK = dict(zip("αβεηικμνορτυχ", "abenikmvoptux", strict=True))
CYRILLIC = dict(zip("авсеонкмртухіјѕԁһ", "abceohkmptyxijsdh", strict=True))

#: Labelled rows that the lexicon and the calibration are fitted on at most, half of each label.
SAMPLE_ROWS = 20_000
#: What the lexicon takes from that sample: at most so many entries, the heaviest first; words and stems that stand after at
#: least so many different words (a word that one group of copies shares stands after few) and weigh at least so much. Of the
#: words before an entry no more than CONTEXTS are counted, as LEAST_CONTEXTS settle the question.
MAX_ENTRIES = 5_000
LEAST_CONTEXTS = 6
LEAST_WEIGHT = 2.5
STEM = range(3, 9)
CONTEXTS = 16


def _fold_table() -> dict[int, str]:
    table = {i: " " for i in range(128) if not chr(i).isalpha()}
    for chars in (GREEK, CYRILLIC):
        for a, b in chars.items():
            table[ord(a)] = table[ord(a.upper())] = b
    for a, b in DIGITS.items():
        table[ord(a)] = b
    for i in range(26):
        table[0xFF21 + i] = table[0xFF41 + i] = chr(97 + i)  # full width
    for zero_width in (0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD):
        table[zero_width] = ""
    return table


_FOLD = _fold_table()


def fold(text: str) -> str:
    """Words in one form, one space before each and one at the end."""
    plain = text.lower().translate(_FOLD)
    return f" {' '.join(plain.split())} "


class Model(NamedTuple):
    """entries: folded pattern (with its leading space) and weight; the rest: logistic calibration."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    bias: float
    by_sum: float
    by_rate: float


class Matcher:
    def __init__(self, entries: Iterable[tuple[str, float]], exceptions: Iterable[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, weight in entries:
            self.automaton.add_word(pattern, (len(pattern), weight))
        for phrase in exceptions:
            self.automaton.add_word(fold(phrase), (len(fold(phrase)), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def sums(self, text: str) -> tuple[float, int, int]:
        """Sum of weights, hits, words. At one word's start the longest entry counts, once."""
        folded = fold(text)
        words = folded.count(" ") - 1 if len(folded) > 2 else 0
        if not words or not len(self.automaton):
            return 0.0, 0, words
        best: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(folded):
            if weight is None:
                harmless.append((end - length + 1, end))
            else:
                best[end - length + 1] = weight  # a longer entry from the same start comes later
        if harmless:
            best = {at: w for at, w in best.items() if not any(a <= at < b for a, b in harmless)}
        return float(sum(best.values())), len(best), words


def features(total: float, words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100.0 * total / words) if words else 0.0


def probability(model: Model, total: float, words: int) -> float:
    a, b = features(total, words)
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, model.bias + model.by_sum * a + model.by_rate * b))))


def _word_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of this part: texts of label 1 and 0 that have it, and hashes of the words before it in label 1."""
    import xxhash

    seen: dict[str, list] = defaultdict(lambda: [0, 0, set()])
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = fold(text or "").split()
            for w in set(words):
                seen[w][1 - toxic] += 1
            if toxic:
                for before, w in zip(["", *words], words, strict=False):
                    kept = seen[w][2]
                    if len(kept) < 4 * CONTEXTS:
                        kept.add(xxhash.xxh64_intdigest(before) >> 1)
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([sorted(x[2])[:CONTEXTS] for x in seen.values()], pa.list_(pa.int64()))],
            ["word", "pos", "neg", "contexts"],
        )


def _mined(sample: DataFrame, n_pos: int, n_neg: int) -> list[tuple[str, float]]:
    """Words and word stems that are far more frequent in label 1 and stand there in many surroundings.

    The surroundings keep words that only a group of copies shares out of the lexicon.
    """
    words = sample.select("text", "toxic").mapInArrow(_word_rows, "word string, pos long, neg long, contexts array<long>")

    def merged(df: DataFrame, key: str) -> DataFrame:
        contexts = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("contexts")))), 1, CONTEXTS)
        return df.groupBy(key).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), contexts.alias("contexts"))

    by_word = merged(words, "word")
    patterns = F.array(F.concat(F.lit(" "), "word", F.lit(" ")), *[F.when(F.length("word") > k, F.concat(F.lit(" "), F.substring("word", 1, k))) for k in STEM])
    by_pattern = merged(by_word.where("pos > 0").select(F.explode(F.array_compact(patterns)).alias("pattern"), "pos", F.lit(0).cast("long").alias("neg"), "contexts"), "pattern").where(F.size("contexts") >= LEAST_CONTEXTS)
    against = by_word.where("neg > 0").select(F.explode(F.array_compact(patterns)).alias("pattern"), "neg").groupBy("pattern").agg(F.sum("neg").alias("against"))
    weight = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.coalesce("against", F.lit(0)) + 0.5) / (n_neg + 1))
    best = by_pattern.drop("neg").join(against, "pattern", "left").withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
    rows = best.orderBy(F.col("weight") * F.sqrt("pos"), ascending=False).limit(MAX_ENTRIES).select("pattern", "weight").collect()
    chosen: dict[str, float] = {}
    for pattern, w in sorted((r.pattern, r.weight) for r in rows):  # a stem comes before its longer forms
        if not any(chosen.get(pattern[:k], -1e9) >= w - 1.5 for k in range(2, len(pattern))):
            chosen[pattern] = w
    return list(chosen.items())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and calibration from at most `rows` labelled rows, half of each label, chosen by hash of the id.

    The bound is this parameter. Without labels of both kinds, the seeds stand alone with a plain calibration.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("id").cast("string"))
    picked = [known.where(F.col("toxic") == k).orderBy(order, "id").limit(rows // 2) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select("text", "toxic")
    counts = {r.toxic: r.n for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    seeds = [(f" {w}", 5.0) for w in SEEDS]
    if not counts.get(0) or not counts.get(1):
        return Model(tuple(seeds), EXCEPTIONS, -4.0, 2.0, 0.5)
    mined = _mined(sample, counts[1], counts[0])
    have = [p.strip() for p, _ in mined]
    entries = tuple(mined) + tuple((p, w) for p, w in seeds if not any(p.strip().startswith(h) for h in have))

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries, EXCEPTIONS)
        for b in batches:
            found = [matcher.sums(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.int64()), b.column(1)], ["total", "words", "toxic"])

    got = sample.mapInArrow(sums, "total double, words long, toxic int").groupBy("total", "words", "toxic").count().orderBy("total", "words", "toxic").collect()
    x = np.array([features(r.total, r.words) for r in got for _ in range(r["count"])])
    y = np.array([float(r.toxic) for r in got for _ in range(r["count"])])
    bias, by_sum, by_rate = _logistic(x, y)
    return Model(entries, EXCEPTIONS, float(bias), float(by_sum), float(by_rate))


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, score, predicted, n_hits, n_words.

    Null and empty texts have no hits and the score of a text without any. Every row is scored alone and whole,
    so repeated rows agree; null ids stay null; other columns are ignored, whatever their names.
    """
    arrow_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.entries, model.exceptions)
        for b in batches:
            found = [matcher.sums(t.as_py() or "") for t in b.column(1)]
            scores = pa.array([probability(model, total, words) for total, _, words in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), scores, pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], ["id", "score", "n_hits", "n_words"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, score double, n_hits long, n_words long")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits", "n_words")
