"""Stages of the corpus pipeline on rows that share a doc_id or have no text."""

import corpus_pipeline
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
A, B, C = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
PASSAGE = " ".join(f"pass{i}" for i in range(20))


def kept(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


@pytest.mark.parametrize("add", [0, 1 << 40])
def test_rows_of_one_id_are_told_apart(spark, tmp_path, add):
    ids = [(1, A), (2, B), (2, C), (2, C), (3, A), (4, PASSAGE), (4, "clean words"), (5, None), (5, ""), (None, None), (None, None), (None, ""), (None, ""), (None, "own")]
    rows = [(None if i is None else i + add, t) for i, t in ids]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    near = kept(corpus_pipeline.drop_near_duplicates(spark, docs, ""))
    # of the two documents with A the first stays; C's repeated row stays once; the rest stays
    rest = sorted((str(i), str(t)) for n, (i, t) in enumerate(rows) if n not in (0, 3, 4))
    first = [x for x in near if x[1] == A]
    assert len(first) == 1 and first[0][0] == str(1 + add)
    assert sorted(x for x in near if x[1] != A) == rest
    spark.createDataFrame([(7, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = kept(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)))
    assert clean == sorted((str(i), str(t)) for i, t in rows if t != PASSAGE)


def test_run(spark, tmp_path):
    rows = [(1, A), (2, A), (3, PASSAGE + " more"), (4, "clean words"), (5, None), (6, ""), (7, B), (7, C)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "size").collect()
    assert sorted((r.doc_id, r["size"]) for r in out) == sorted((i, len((t or "").split())) for i, t in rows if i not in (2, 3))
