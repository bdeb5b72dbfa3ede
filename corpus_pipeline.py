"""Five stages over the corpus: toxicity, near duplicates, repeated passages, decontamination, mixing.

Each stage works on all that the one before it kept, and its decisions take effect. Rows
without a doc_id, and rows of one doc_id, are told apart by their texts. Empty and null texts pass the first four stages; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchloom.llm import decontamination, mixing, near_dedup, suffix_dedup
from merchloom.llm import toxicity as toxic
from merchloom.llm.common import Shared, remainder, row_keys, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select("row_key").distinct(), "row_key", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.3; the model learns from the labelled rows outside the held-out quarter."""
    known = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2)
    model, keyed = toxic.fit(docs, known), row_keys(docs)
    return _without(keyed, toxic.toxicity(keyed, model, id_col="row_key").where("predicted = 1")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five-word shingles, similarity 0.8), once where its row repeats; all rows without text."""
    keyed = row_keys(docs)
    left = _without(keyed, near_dedup.near_groups(keyed, id_col="row_key").where("NOT kept"))
    filled = F.coalesce(F.length("text"), F.lit(0)) > 0
    return left.where(filled).dropDuplicates(["row_key"]).unionByName(left.where(~filled)).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a character that a cut goes through is dropped. Emptied texts go."""
    keyed = row_keys(docs)
    cut = suffix_dedup.repeated_bytes(keyed, id_col="row_key", keep_text=True).where("n_removed > 0").groupBy("row_key").agg(F.first("kept").alias("left"))
    out = keyed.join(cut, "row_key", "left").where("left IS NULL OR length(left) > 0")
    n_chars = F.when(F.col("left").isNotNull(), F.length("left").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.coalesce("left", "text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    keyed = row_keys(docs)
    return _without(keyed, decontamination.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col="row_key").where("contaminated")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document, and the output shards of its copies."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("decontamination", drop_contaminated), ("mixing", mix)]
#: SQL can express neither a fitted lexicon nor near duplicates of it; tests compare the near-duplicate and decontamination
#: stages and a small run with the rows that must stay.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written to the shared folder and read again; what it needed is then removed."""
    shared = Shared(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        since = Shared.opened()
        docs = shared.keep(stage(spark, docs, sf_dir), name)
        Shared.release(since)
        if before is not None:
            shared.drop(before)
        before = name
    return docs
