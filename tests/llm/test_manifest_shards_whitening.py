"""Merkle manifests, shards and whitening against plain versions, with their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchloom.llm import merkle_manifest, sharding, whitening
from merchloom.llm.common import Shared, ascii_lower, ranked, remainder

DOCS = "doc_id long, source string, lang string, n_chars long, text string, root string, place long, leaf string"


def doc_rows():
    rng = random.Random(3)
    out = [(i, "big", "en", i, f"Text {rng.random()} É") for i in range(700)] + [(1000 + i, f"s{i % 3}", None, None, f"W{i}") for i in range(40)]
    out += [(5000, None, "de", 3, "No source"), (5001, "", "de", 3, ""), (5002, "alone", None, None, None), (None, "big", "en", 1, "no id"), (None, None, None, None, None)]
    out += [(7, "big", "en", 7, "another text"), (1000, "s0", None, None, "W0"), (1000, "s0", None, None, "W0"), (6000, "s1", "en", 1, "Long " * 100_000)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", -1, "y") for r in doc_rows()], DOCS).repartition(5)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row, low=False):
    values = [None if v is None else str(v) for v in row]
    if low and values[4] is not None:
        values[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in values[4])
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_tree(leaves, arity):
    """Root, and for each leaf its runs from the bottom up: (run, place in it)."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for i, p in enumerate(at):
            paths[i].append((runs[p // arity], p % arity))
        at, level = [p // arity for p in at], [sha("".join(r)) for r in runs]
    return level[0], paths


def plain_manifest(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = plain_tree([x[2] for x in groups[name]], arity)
    root, over = plain_tree([trees[s][0] for s in names], arity)
    out = []
    for s, upper in zip(names, over, strict=True):
        for (_, _, leaf, r), own in zip(groups[s], trees[s][1], strict=True):
            path = own + upper
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            cur, proof = leaf_of(r, hit), ""
            for run, p in path:
                cur, proof = sha("".join([*run[:p], cur, *run[p + 1 :]])), proof + "".join(run[:p] + run[p + 1 :])
            out.append((r[0], leaf, trees[s][0], root, sha(proof), cur, cur == root))
    return out


def proven(docs, arity=16):
    tampered = merkle_manifest.leaf_digest([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in merkle_manifest.FIELDS])
    return merkle_manifest.verified_proofs(docs, changed=F.when(remainder(F.col("doc_id"), 5) == 0, tampered), arity=arity)


@pytest.mark.parametrize("arity", [16, 3])
def test_manifest(docs, arity):
    got = proven(docs, arity)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == Counter(plain_manifest(doc_rows(), arity))
    assert {r[6] for r in rows} == {True, False}


def test_manifest_nodes(docs):
    """Every parent is the digest of its children, and all parents are there."""
    nodes = merkle_manifest.manifest(docs, arity=4).nodes().collect()
    assert len({(r.tree, r.level, r.place) for r in nodes}) == len(nodes)
    have = {(r.tree, r.level, r.place): r.children for r in nodes}
    for (tree, level, place), children in have.items():
        if level > 1:
            assert children == [sha("".join(have[tree, level - 1, place * 4 + i])) for i in range(len(children))]


def test_manifest_small(docs):
    assert proven(docs.limit(0)).count() == 0
    alone = docs.where("doc_id = 5002")
    row = proven(alone).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha("") and row.verified


def test_cascade_any_order():
    """Events in any order give the same links; what a task can't complete stays open."""
    leaves = [("t", 50, 0, i, sha(str(i)), i, None) for i in range(50)]
    whole = sorted(merkle_manifest.cascade(leaves, {}, 4))
    random.Random(1).shuffle(leaves)
    assert sorted(merkle_manifest.cascade(leaves, {}, 4)) == whole
    partial = {}
    part = list(merkle_manifest.cascade(leaves[:20], partial, 4))
    assert all(r[0] == merkle_manifest.LINK for r in part) and partial


def test_ranked(spark):
    rows = [("a", i % 7, i) for i in range(500)] + [("b", None, 1), ("b", 2, 2)]
    got = ranked(spark.createDataFrame(rows, "g string, k int, v int"), "g", ["k", "v"], Shared(spark), "r").collect()
    want = {(g, k, v): (p, sum(x[0] == g for x in rows)) for g in "ab" for p, (_, k, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])))}
    assert {(r.g, r.k, r.v): (r.place, r.total) for r in got} == want


def hypergeometric_mass(total, marked, drawn, k):
    return math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)


def test_hypergeometric():
    """Equal steps of u meet each value as often as its probability asks for; huge numbers stay in their bounds."""
    for total, marked, drawn in ((10, 4, 5), (7, 7, 3), (9, 2, 0), (60, 21, 30)):
        got = Counter(sharding.hypergeometric(total, marked, drawn, (i + 0.5) / 20_000) for i in range(20_000))
        assert all(abs(got[k] / 20_000 - hypergeometric_mass(total, marked, drawn, k)) < 1e-3 for k in got) and sum(got.values()) == 20_000
    big = sharding.hypergeometric(10**12, 10**11, 10**6, 0.5)
    assert abs(big - 10**5) < 2


def test_draw_rows():
    """Row and column sums are exact, and each matrix has its multivariate hypergeometric probability."""
    rng, seen = np.random.default_rng(2), Counter()
    for _ in range(20_000):
        m = sharding.draw_rows([2, 2, 1], [2, 3], rng)
        assert [sum(r) for r in m] == [2, 3] and [sum(c) for c in zip(*m, strict=True)] == [2, 2, 1]
        seen[tuple(m[0])] += 1
    want = {a: math.comb(2, a[0]) * math.comb(2, a[1]) * math.comb(1, a[2]) / math.comb(5, 2) for a in seen}
    assert abs(sum(want.values()) - 1) < 1e-9
    assert all(abs(seen[a] / 20_000 - p) < 0.015 for a, p in want.items())


def test_matrix(spark):
    """Through several levels of the tree, rows and columns add up."""
    counts = [(i, random.Random(i).randint(0, 50)) for i in range(150) if i % 7]
    sizes = sharding.shard_sizes(sum(n for _, n in counts), 5)
    got = {r.part: r.quota for r in sharding.communication_matrix(spark.createDataFrame(counts, "part long, n long"), sizes, Shared(spark), fan=4).collect()}
    assert {p: sum(q) for p, q in got.items()} == dict(counts)
    assert [sum(q[s] for q in got.values()) for s in range(5)] == sizes


def test_shards(spark, docs, tmp_path):
    shared = docs.withColumn("shard", F.lit("old")).withColumn("slot", F.lit("old"))
    got = sharding.shuffle_into_shards(shared)
    assert got.columns == [*docs.columns, "shard", "slot"]
    rows = got.select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[4]) for r in doc_rows())
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert got.limit(0).count() == sharding.shuffle_into_shards(docs.limit(0)).count() == 0
    few = sharding.shuffle_into_shards(docs.where("doc_id < 3")).select("shard", "slot").collect()
    assert sorted(map(tuple, few)) == [(0, 0), (1, 0), (2, 0)]
    sharding.write_shards(got.select("doc_id", "shard", "slot"), f"{tmp_path}/out")
    assert Counter(r.shard for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sizes


def test_shards_uniform(spark):
    """Over seeds, every row of a small table meets every place alike, wherever its partition is; buckets of one shard too."""
    rows = spark.range(4).repartition(2)
    seen = Counter()
    for seed in range(24):
        seen.update((r.id, r.shard, r.slot) for r in sharding.shuffle_into_shards(rows, shards=2, seed=seed).collect())
    assert sum((seen[i, s, p] - 6) ** 2 / 6 for i in range(4) for s in range(2) for p in range(2)) < 30  # 9 degrees of freedom


def test_shards_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    rows = sharding.shuffle_into_shards(spark.range(1000), shards=3).collect()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(334 if s == 0 else 333))
    order = [r.id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(1000))[0, 1]) < 0.12


def vectors():
    rng = np.random.default_rng(4)
    scale = np.array([3.0, 2.0, 1.5, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4])
    own = [[float(c) for c in v] for v in rng.standard_normal((400, 10)) * scale]
    out = [(i, v) for i, v in enumerate(own)] + [(1000 + i, own[0]) for i in range(200)]
    out += [(2000, None), (2001, [None] * 10), (2002, [1.0] * 9 + [None]), (2003, [float("nan")] * 10), (2004, [1.0] * 9 + [float("inf")]), (None, own[1]), (2005, [1.0, 2.0]), (2006, []), (7, own[2])]
    return out


def plain_whitening(rows, k):
    kept = [(i, [*v, *[0.0] * (10 - len(v))]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in kept], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - sums / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    white = (x - sums / n).astype(float) @ axes / np.sqrt(values)
    return [(i, n, int(((n * r - sums) ** 2).sum()), w) for (i, _), r, w in zip(kept, x, white, strict=True)], values / np.trace(centred.T @ centred / n)


def test_whitening(spark):
    rows = vectors()
    table = spark.createDataFrame([(i, v, "c", -1.0) for i, v in rows], "vec_id long, embedding array<float>, component string, whitened double").repartition(3)
    got = whitening.whiten(table).collect()
    want, shares = plain_whitening(rows, 4)
    assert len(got) == 4 * len(want) and {r.component for r in got} == {1, 2, 3, 4}
    assert got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    signs = [np.sign(next(r for r in by[0] if r.component == c).whitened * want[0][3][c - 1]) for c in range(1, 5)]
    for i, n, deviation, w in want:
        for c in range(4):
            mine = [r for r in by[i] if r.component == c + 1]
            assert any(abs(r.whitened * signs[c] - w[c]) < 1e-9 and r.deviation == deviation and r.n == n and abs(r.explained - shares[c]) < 1e-12 for r in mine)


def test_whitening_small(spark):
    schema = "vec_id long, embedding array<double>"
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert make([]) == make([(1, None)]) == make([(1, [])]) == make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    line = make([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])])  # one dimension varies: one component
    assert [(r.vec_id, r.component, r.n) for r in sorted(line)] == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    assert sorted(round(abs(r.whitened), 12) for r in line) == [1.0, 1.0, 1.0]
    with pytest.raises(Exception, match="no long|overflow|OVERFLOW"):
        make([(1, [1e15, 0.0]), (2, [-1e15, 1.0])])


def test_subspace_iteration():
    """Flat and steep spectra, ties and rank: residuals certify what the whole decomposition gives."""
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    for spectrum in (np.linspace(1.0, 0.9, 80), 0.5 ** np.arange(80), np.array([5.0, 5.0, 5.0, 1.0, *[0.5] * 76]), np.array([3.0, 2.0, *[0.0] * 78])):
        whole = (turn * spectrum) @ turn.T
        values, axes, passes = whitening.subspace_iteration(lambda q, whole=whole: whole @ q, 80, 4)
        assert np.allclose(values, np.sort(spectrum)[::-1][:4], atol=1e-12) and passes < 60
        assert np.allclose(whole @ axes, axes * values, atol=1e-12) and np.allclose(axes.T @ axes, np.eye(4), atol=1e-9)
