"""Operator 4: quality rules from tokeniser fertility.

A public vocabulary with byte fallback is run over every whole text. Three figures judge it: characters per
token, the share of tokens that are byte fallbacks, and the entropy of the text's tokens relative to the most
that its length allows. A text outside the band of its language (or, where the language has none, its script)
is rejected. Base rules on length and repetition come first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, mix, prefix_hash, range_hash, slices, text_bytes, word_bounds

SYMBOLS = "#*$%&|<>"
#: Distinct words whose pieces one Python worker remembers.
REMEMBER = 400_000
#: Bytes of text that are judged at once.
BLOCK = 1 << 20


class Band(NamedTuple):
    """What is accepted: characters per token, byte-fallback share at most, relative entropy at least.

    These are the bounds for long texts; those of a text of n tokens are wider by SPREAD / sqrt(n), for its figures vary so.
    """

    low_chars: float
    high_chars: float
    high_fallback: float
    low_entropy: float


#: Bands by language, then by script. Those of languages are fitted (fit_bands) on the labelled good texts of sf0.1; those of
#: scripts are wide, for no labelled text has them.
BANDS = {
    "en": Band(1.85, 4.60, 0.02, 0.70),
    "fr": Band(1.75, 4.60, 0.02, 0.69),
    "de": Band(1.80, 4.60, 0.02, 0.70),
    "es": Band(1.70, 4.60, 0.02, 0.68),
    "latin": Band(1.30, 6.00, 0.05, 0.50),
    "greek": Band(0.50, 6.00, 0.20, 0.45),
    "cyrillic": Band(0.80, 6.00, 0.10, 0.45),
    "hebrew": Band(0.40, 6.00, 0.40, 0.40),
    "arabic": Band(0.40, 6.00, 0.40, 0.40),
    "indic": Band(0.25, 6.00, 0.70, 0.35),
    "thai": Band(0.25, 6.00, 0.70, 0.35),
    "han": Band(0.25, 3.00, 0.70, 0.40),
    "kana": Band(0.25, 3.00, 0.70, 0.40),
    "hangul": Band(0.25, 3.00, 0.70, 0.40),
    "other": Band(0.25, 6.00, 0.80, 0.35),
}
# First and last code point of the letters by which a script is told.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),), "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x77F),), "indic": ((0x900, 0xDFF),), "thai": ((0xE00, 0xE7F),), "han": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF)), "kana": ((0x3040, 0x30FF),), "hangul": ((0xAC00, 0xD7AF), (0x1100, 0x11FF)),
}
#: Tokens from which a text's entropy no longer grows with its length.
SATURATED = 512
#: How much a bound gives way on a text of one token; on one of n it is this over the root of n.
SPREAD = Band(2.0, 2.0, 0.5, 0.3)


class _Pieces(dict):
    """Pieces of a word, by the vocabulary, when first asked for."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        super().__init__()
        self.encode = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.encode.get_piece_size()
        self.fallback = np.array([self.encode.is_byte(i) or self.encode.is_unknown(i) for i in range(n)])

    def __missing__(self, word: str) -> np.ndarray:
        ids = np.array(self.encode.encode(word, num_threads=1), np.int32)
        if len(self) >= REMEMBER:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


def fertility(words: list[str], n_chars: int, pieces: _Pieces) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share, relative entropy of the tokens."""
    if not words:
        return 0, 0.0, 0.0, 0.0
    ids = np.concatenate([pieces[w] for w in words])
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    c = np.bincount(ids)
    p = c[c > 0] / n
    most = math.log2(min(n, SATURATED))
    entropy = float(-(p * np.log2(p)).sum()) / most if most > 0 else 1.0
    return n, n_chars / n, float(pieces.fallback[ids].mean()), entropy


def script_of(text: str) -> str:
    """The script that most letters have, of equals the first of SCRIPTS; "other" where none has any."""
    if text.isascii():
        return "latin"
    count: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            count[next((s for s, spans in SCRIPTS.items() if any(a <= ord(c) <= b for a, b in spans)), "other")] += n
    return max(count, key=lambda s: (count[s], -list((*SCRIPTS, "other")).index(s))) if count else "other"


def accepted(figures: tuple[int, float, float, float], band: Band) -> bool:
    n, chars, fallback, entropy = figures
    if not n:
        return False
    give = 1 / math.sqrt(n)
    return band.low_chars - SPREAD.low_chars * give <= chars <= band.high_chars + SPREAD.high_chars * give and fallback <= band.high_fallback + SPREAD.high_fallback * give and entropy >= band.low_entropy - SPREAD.low_entropy * give


def fit_bands(judged: DataFrame, labels: DataFrame, docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", label_col: str = "quality", share: float = 0.005, least: int = 200) -> dict[str, Band]:
    """Bands of languages from the rows of quality_rules whose label is good: the figures that `share` of them lie beyond.

    Quantiles are taken over all labelled good rows of at least `least` tokens, by language; a language without any gets none.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct()
    rows = judged.where(~F.col("base_failed") & (F.col("n_tokens") >= least)).join(good, judged[id_col] == good["id"]).join(docs.select(F.col(id_col).alias("of"), F.col(lang_col).alias("lang")).distinct(), F.col("id") == F.col("of"))
    at = lambda c, q: F.percentile(c, F.lit(q))
    found = rows.where("lang IS NOT NULL").groupBy("lang").agg(at("chars_per_token", share).alias("a"), at("chars_per_token", 1 - share).alias("b"), at("fallback_share", 1 - share).alias("c"), at("token_entropy", share).alias("d"))
    return {r.lang: Band(r.a, r.b, r.c, r.d) for r in found.collect()}


def repeated_words(hashes: np.ndarray, window: int = 8) -> int:
    """Words that lie in a window found at least twice, its first occurrence included."""
    n = len(hashes)
    if n <= window:
        return 0
    with np.errstate(over="ignore"):
        acc = hashes[: n - window + 1].copy()
        for i in range(1, window):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - window + 1 + i]
    _, back, count = np.unique(mix(acc), return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[back] > 1)
    if not len(again):
        return 0
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


_pieces: dict[str, _Pieces] = {}


def quality_rules(docs: DataFrame, model: str, bands: dict[str, Band] = BANDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per row of `docs`: the base counts, the three fertility figures, base_failed and kept.

    Null and empty texts have no words and fail the base rules. Every text is held to its band, a short one to a wider
    one. An unknown or null language takes the band of the text's script. Repeated rows and ids are judged
    alone, texts are read whole, and other columns are ignored, whatever their names.
    """
    arrow_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, in_band boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _pieces:
            _pieces[model] = _Pieces(model)
        pieces = _pieces[model]
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            langs = batch.column(2).to_pylist()
            for lo, hi in slices(offsets, BLOCK):
                part, cuts = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = word_bounds(part, cuts)
                hashes = range_hash(prefix_hash(part), starts, ends)
                out: list[tuple] = []
                for i in range(hi - lo):
                    text = part[cuts[i] : cuts[i + 1]].tobytes().decode("utf-8", "replace")
                    words = text.translate(_SPLIT).split(" ") if first[i + 1] > first[i] else []
                    words = [w for w in words if w]
                    chars = sum(map(len, words))
                    figures = fertility(words, chars, pieces)
                    band = bands.get(langs[lo + i]) or bands[script_of(text)]
                    out.append((len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(hashes[first[i] : first[i + 1]]), *figures, accepted(figures, band)))
                columns = [pa.array(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["id", *_NAMES])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")).alias("lang"))
    out = rows.mapInArrow(run, schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("id").alias(id_col), *base, failed.alias("base_failed"), (~failed & F.col("in_band")).alias("kept"), "n_tokens", "chars_per_token", "fallback_share", "token_entropy")


_SPLIT = {i: " " for i in range(9, 14)}
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "fallback_share", "token_entropy", "in_band"]
