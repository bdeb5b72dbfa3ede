"""Operator 3: benchmark decontamination by a prefix-filtered set join.

DataFrame operations only. A benchmark window is a set of words that must all occur, so in an order by rarity its
prefix is one word: the window's rarest. Only document words that are the prefix of some window become candidates;
each window's place of its prefix word and its length bound where the window can stand, and the words there are
compared with the window's. Rarity is counted over all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Shared, row_keys

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Benchmark words that are matched inside each row at most; beyond, they are matched by a shuffle join.
IN_ROW_WORDS = 20_000


def words_of(text: Column) -> Column:
    """Words [0-9a-z and beyond ASCII]+ after lower-casing A-Z; null has none."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(low, F.lit("")), GAP), lambda w: w != "")


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows with the items that have them: words, n, items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, in_row_words: int = IN_ROW_WORDS) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, items (sorted strings), contaminated.

    An item of fewer words than a window is one window; an item without words has none. Null and empty texts have
    no words and no hits. Windows that several items share name all of them. Rows are judged one by one, those that
    share an id, and those without one, too: they are told apart by their texts. Empty tables give no rows, or
    rows without hits. Column names of either table may clash; other columns are ignored. Nothing is pruned but
    what cannot match, so a frequent passage costs its occurrences and no more.
    """
    shared = Shared(docs.sparkSession)
    windows = shared.keep(windows_of(benchmark, item_col, item_text_col, window).withColumn("window_id", F.monotonically_increasing_id()), "windows")
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    rows = row_keys(docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")), "own_id", name="id")
    base = rows.select("own_id", "id", words_of(F.col("text")).alias("words"))

    def matching(of: DataFrame) -> tuple[list[str] | None, DataFrame]:
        """The words, where there are few enough to match inside rows."""
        few = [r.word for r in of.limit(in_row_words + 1).collect()]
        return (few if len(few) <= in_row_words else None), of

    few, many = matching(vocabulary)
    if few is None:
        found = base.select(F.explode("words").alias("word")).join(many, "word", "left_semi")
    else:
        found = base.select(F.explode(F.filter("words", lambda w: w.isin(few))).alias("word"))
    rarity = found.groupBy("word").agg(F.count("*").alias("freq"))
    placed = windows.select("window_id", F.posexplode("words").alias("offset", "word")).join(rarity, "word")
    # a window with a word that no document has cannot occur: it lacks a row here
    whole = placed.groupBy("window_id").agg(F.count("*").alias("have"), F.min(F.struct("freq", "word", "offset")).alias("rarest"))
    prefix = whole.join(windows, "window_id").where("have = n").select(F.col("rarest.word").alias("word"), F.col("rarest.offset").alias("offset"), "words", "n", "items")
    prefix = shared.keep(prefix, "prefix")
    few, many = matching(prefix.select("word").distinct())
    around = lambda i: F.struct(  # noqa: E731  a candidate's word, place, and the words that a window there could cover
        F.element_at("words", i).alias("word"), i.alias("place"), F.greatest(i - (window - 1), F.lit(1)).alias("from"), F.slice("words", F.greatest(i - (window - 1), F.lit(1)), 2 * window - 1).alias("near")
    )
    if few is None:
        places = base.select("id", F.posexplode("words").alias("p", "word")).join(many, "word", "left_semi").groupBy("id").agg(F.collect_list(F.col("p") + 1).alias("places"))
        near = base.join(places, "id")
        near = near.select("id", F.explode(F.transform(F.filter(F.array_distinct("places"), lambda i: i <= F.size("words")), around)).alias("x"))
        counts = base.select("own_id", "id", F.size("words").cast("long").alias("n_words"))
    else:
        # one pass over the texts for both: the words around candidates are few
        places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(few), i + 1)), lambda i: i.isNotNull())
        read = shared.keep(base.select("own_id", "id", F.size("words").cast("long").alias("n_words"), F.transform(places, around).alias("around")), "near")
        near, counts = read.select("id", F.explode("around").alias("x")), read.select("own_id", "id", "n_words")
    near = near.select("id", "x.word", "x.place", "x.from", "x.near")
    start = F.col("place") - F.col("offset")
    stands = (start >= F.col("from")) & (F.slice("near", F.greatest(start - F.col("from") + 1, F.lit(1)), F.col("n")) == F.col("words"))
    hits = near.join(prefix, "word").where(stands).select("id", start.alias("start"), "n", "items")
    per_doc = hits.groupBy("id").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.start + s.n - 1))))
    per_doc = per_doc.select(F.col("id").alias("hit_id"), F.size(covered).cast("long").alias("n_hit"), "items")
    out = counts.join(per_doc, counts["id"] == per_doc["hit_id"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("own_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


#: The query's rows in DuckDB, by all windows of all documents.
SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
