"""Operator 1: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

#: Distinct words whose counts one Python worker remembers; beyond it the memory starts anew.
REMEMBER = 1_000_000
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_WORD_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging: always the adjacent pair of lowest rank, leftmost first.

    A heap holds the pairs that can merge, a doubly linked list the symbols; an entry whose pair has
    changed meanwhile is skipped. The count is initial symbols minus merges.
    """
    n = len(symbols)
    left, right, merges = list(range(-1, n - 1)), [*range(1, n), -1], 0
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        merges += 1
        right[i] = k = right[j]
        right[j] = -1
        if k >= 0:
            left[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        if (p := left[i]) >= 0 and (r := ranks.get((symbols[p], symbols[i]))) is not None:
            heapq.heappush(heap, (r, p, symbols[p], symbols[i]))
    return n - merges


class _Counts(dict):
    """Tokens of a word, counted when first asked for."""

    def __init__(self, ranks: dict[tuple[str, str], int], suffix: str) -> None:
        super().__init__()
        self.ranks, self.suffix = ranks, suffix
        codes = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that stand for themselves
        spare = (x for x in range(256) if x not in set(codes))
        self.byte = {b: chr(b) for b in codes} | {b: chr(256 + i) for i, b in enumerate(spare)}

    def __missing__(self, word: str) -> int:
        symbols = [self.byte[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.suffix
        n = merged_length(symbols, self.ranks)
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = n
        return n


def counter(vocabulary: str) -> Callable[[str], int]:
    """Token count of a text under a byte-pair vocabulary file (.json) with word ends and lower-casing.

    Special strings of the file count as one token each wherever they stand in the text.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    counts = _Counts({m: i for i, m in enumerate(merges)}, spec["model"].get("end_of_word_suffix") or "")
    special = [t["content"] for t in spec["added_tokens"]]
    special_rx = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    get = counts.__getitem__

    def plain(text: str) -> int:
        if text.isascii():
            return sum(map(get, _WORD_ASCII.findall(text.lower())))
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # sigma: by character, not by place in the word
        return sum(map(get, _WORD.findall(text)))

    def count(text: str) -> int:
        if special_rx is None or "<|" not in text:
            return plain(text)
        parts = special_rx.split(text)
        return sum(map(plain, parts)) + len(parts) - 1

    return count


_counters: dict[str, Callable[[str], int]] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Null and empty texts have no bytes and no tokens. Rows with the same id or text stay separate rows; a
    null id stays null. Texts are counted whole, however long. Other columns are ignored, so their names may
    clash with ours. The vocabulary file must lie at the same path on every worker, as an installed package does.
    """
    arrow_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = counter(vocabulary)
        count = _counters[vocabulary]
        for b in batches:
            tokens = pa.array([count(t) if t else 0 for t in (x.as_py() for x in b.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), tokens], ["id", "n_bytes", "n_tokens"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
