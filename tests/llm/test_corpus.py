"""Edge cases of every operator, and brute-force versions on small tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from merchloom.llm import context_tree, decontamination, html_extraction, license_scan, mixing, near_dedup, quality_rules, suffix_dedup, token_counts, toxicity
from merchloom.llm.common import row_keys

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, score string, n_words string"
PASSAGE = " ".join(f"pass{i}" for i in range(40))


def rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "straße", "été", "delta,", "<|endoftext|>", "x1", "idiot"]
    out = [(0, None), (1, ""), (2, "one"), (3, " \n\t "), (4, "Beta " * 3000)]
    out += [(10 + i, " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 120)))) for i in range(30)]
    out += [(50 + i, PASSAGE + f" tail{i} " + " ".join(rng.choice(words) for _ in range(20))) for i in range(4)]
    out += [(60 + i, out[10][1]) for i in range(5)] + [(70, out[10][1] + " more"), (2, "one"), (None, "no id here")]
    return out


def shared_ids():
    """Two texts under one id, two under none, and one of each twice."""
    plain = " ".join(f"plain{i}" for i in range(40))
    return [(5, PASSAGE), (5, plain), (5, plain), (None, PASSAGE + " end"), (None, "nothing of it"), (None, "nothing of it"), (9, PASSAGE + " more")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i in (2, 3) else f"s{(i or 0) % 3}", 1, -1, "x", "y") for i, t in rows()], DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_token_counts(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect())
    assert got == sorted((i is None, i or 0, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows())
    assert token_counts.token_counts(empty, path).count() == 0


def test_mixing(docs, empty):
    out = mixing.mix_sources(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows()}
    assert sorted(r.size for r in out) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows()) and all(r.taken <= 3 * r.size for r in out)
    total = sum(r.size for r in out)
    targets = {r.target for r in out}
    assert abs(sum(targets) - total) < 1e-6 * total and max(size.values()) == 3000
    again = sorted((str(r.doc_id), r.taken, r.shards) for r in mixing.mix_sources(docs).collect())
    assert again == sorted((str(r.doc_id), r.taken, r.shards) for r in out)
    assert all(len(r.shards) * r.size == r.taken for r in out) and mixing.mix_sources(empty).count() == 0


def brute_targets(sizes):
    """Targets by refilling, source by source, until none is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            return full | {s: left * weight[s] / total for s in rest}
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 10, None: 5}, {"a": 10, "b": 20, "c": 30}, {"a": 0, "b": 7, None: 900}, {None: 12}, {"a": 5, "b": 10, "c": 15, "d": 400}])
def test_mixing_targets_and_takes(spark, sizes):
    """Null sources, sources that stop at three times their size, ties in size over weight; sums near the targets."""
    rows_, n = [], 0
    for s, size in sizes.items():
        for k in range(0, size, 5):
            n += 1
            rows_.append((n, " ".join(["w"] * min(5, size - k)), s))
        rows_.append((n := n + 1, None, s))
    out = mixing.mix_sources(spark.createDataFrame(rows_, "doc_id long, text string, source string")).collect()
    want, source = brute_targets(sizes), {i: s for i, _, s in rows_}
    for s in sizes:
        own = [r for r in out if source[r.doc_id] == s]
        assert all(abs(r.target - want[s]) < 1e-6 * (1 + want[s]) and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 5 and all(r.taken == len(r.shards) * r.size for r in own)
        assert len({r.position for r in own}) == len(own) and all(0 <= x < 1 << mixing.LEVELS for r in own for x in r.shards)


def test_splitting_tree(spark):
    counts = {"a": 700, "b": 41, "c": 0, "d": 1, "e": 333}
    rows_ = mixing.splitting_tree(spark.createDataFrame(list(counts.items()), "key string, n long"), 4).collect()
    quota = {(r.key, r.shard): r.quota for r in rows_}
    assert all(sum(quota[k, s] for s in range(16)) == n for k, n in counts.items()) and min(quota.values()) >= 0
    size = [sum(quota[k, s] for k in counts) for s in range(16)]
    for level in range(1, 5):  # at every node the two halves differ by one copy at most
        width = 16 >> level
        halves = [sum(size[i * width : (i + 1) * width]) for i in range(1 << level)]
        assert all(abs(halves[i] - halves[i + 1]) <= 1 for i in range(0, len(halves), 2))
    assert sorted((r.key, r.shard, r.quota) for r in mixing.splitting_tree(spark.createDataFrame(list(counts.items())[::-1], "key string, n long"), 4).collect()) == sorted((r.key, r.shard, r.quota) for r in rows_)


def test_hypergeometric_draw(spark):
    """The draw inverts the exact distribution, at 2,000 even points of u."""
    for total, marked, drawn in ((20, 7, 10), (50, 50, 25), (9, 0, 4), (31, 3, 15), (400, 130, 200)):
        u = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
        args = [F.lit(x).cast("long") for x in (total, marked, drawn)]
        got = {r.k: r["count"] for r in u.select(mixing._hypergeometric(*args, F.col("u")).alias("k")).groupBy("k").count().collect()}
        for k in range(max(0, drawn - (total - marked)), min(marked, drawn) + 1):
            p = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
            assert abs(got.pop(k, 0) / 2000 - p) < 0.0011
        assert not got


def brute_hits(text, items):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text)) if w]
    hit, found = set(), set()
    for item, t in items:
        iw = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) if w]
        for k in range(max(1, len(iw) - 9) if iw else 0):
            window = iw[k : k + 10]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [20_000, 0])
def test_decontamination(spark, docs, empty, limit):
    items = [(7, PASSAGE[:150]), (8, "one"), (9, None), (10, ""), (11, "Beta beta BETA " * 5), (12, PASSAGE[:150]), (13, "words that no document has at all in it")]
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in decontamination.decontaminate(docs, bench, in_row_words=limit).collect())
    assert got == sorted((str(i), *brute_hits(t, items)) for i, t in rows())
    assert decontamination.decontaminate(empty, bench).count() == 0 and decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_shared_ids(spark):
    bench = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    for name, kind in (("doc_id", "long"), ("doc_id", "string")):
        docs = spark.createDataFrame([(None if i is None else str(i) if kind == "string" else i, t) for i, t in shared_ids()], f"{name} {kind}, text string")
        for limit in (20_000, 0):
            got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in decontamination.decontaminate(docs, bench, in_row_words=limit).collect())
            assert got == sorted((str(i), *brute_hits(t, [(7, PASSAGE)])) for i, t in shared_ids())


def test_quality_rules(docs, empty):
    out = {(str(r.doc_id), r.n_words): r for r in quality_rules.quality_rules(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for i, t in rows():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        again = set()
        seen = {}
        for k in range(len(words) - 7):
            seen.setdefault(tuple(words[k : k + 8]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                again.update(x for k in places for x in range(k, k + 8))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = out[(str(i), len(words))]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(words) < 20 or 100 * len(again) > 30 * len(words)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_context_tree(docs, empty):
    out = context_tree.tree_scores(docs, F.col("doc_id") % 2 == 0).collect()
    assert len(out) == len(rows()) and all(r.score <= 0 and r.base_score <= 0 for r in out)
    blank = [r for r in out if r.doc_id in (0, 1, 3)]
    assert {r.n_tokens for r in blank} == {1} and len({round(r.base_score, 9) for r in blank}) == 1
    assert context_tree.tree_scores(empty, F.lit(True)).count() == 0
    nothing = context_tree.tree_scores(docs.where("doc_id = 2"), F.lit(False)).first()
    assert abs(nothing.score + 4 * 8 * 0.30103) < 1e-3 and nothing.n_known == 0


def brute_base(texts, trained):
    """n_tokens, n_known, train_tokens and base score of each text, by a plain count of words and ends."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for t in texts]
    count = {}
    for words, learnt in zip(tokens, trained, strict=True):
        for w in words if learnt else []:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    return [(len(x), sum(w in count for w in x), n, sum(math.log10((count.get(w, 0) + 1) / (n + 1 * (v + 1))) for w in x)) for x in tokens]


def test_context_tree_base_score(spark, docs):
    def check(texts, trained, got):
        want = sorted((str(i), *b) for i, b in zip((i for i, _ in texts), brute_base([t for _, t in texts], trained), strict=True))
        have = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
        assert [x[:4] for x in have] == [x[:4] for x in want] and all(abs(a[4] - b[4]) < 1e-9 * (1 + abs(b[4])) for a, b in zip(have, want, strict=True))

    few = [(1, "a b a"), (2, "c")]
    got = context_tree.tree_scores(spark.createDataFrame(few, "doc_id long, text string"), F.lit(True)).collect()
    check(few, [True, True], got)
    assert abs(next(r.base_score for r in got if r.doc_id == 1) + 2.433177) < 1e-6
    rng = random.Random(8)
    many = [(i, " ".join(rng.choice("uvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for i in range(100)]
    check(many, [i % 3 > 0 for i, _ in many], context_tree.tree_scores(spark.createDataFrame(many, "doc_id long, text string"), F.col("doc_id") % 3 > 0).collect())
    check(rows(), [i is not None and i % 2 == 0 for i, _ in rows()], context_tree.tree_scores(docs, F.col("doc_id") % 2 == 0).collect())


def brute_tree(trained, scored, depth=4):
    """log10 probability of each scored text by a context tree that is kept whole, node by node."""

    def path(text):
        b = bytes([0xFE] * depth) + low(text).encode() + b"\xff"
        for i in range(depth, len(b)):
            for bit in range(8):
                yield [(b[i - d : i], bit, b[i] >> (8 - bit)) for d in range(depth + 1)], b[i] >> (7 - bit) & 1

    counts = {}
    for text in trained:
        for nodes, bit in path(text):
            for node in nodes:
                counts.setdefault(node, [0, 0])[bit] += 1
    below, odds = {}, {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        zero, one = counts[node]
        own = math.lgamma(zero + 0.5) + math.lgamma(one + 0.5) - math.lgamma(zero + one + 1) - math.log(math.pi)
        weighted = own
        if len(node[0]) < depth:
            children = below[node]
            odds[node] = own - children
            weighted = max(own, children) + math.log1p(math.exp(-abs(own - children))) - math.log(2)
        if node[0]:
            above = (node[0][1:], *node[1:])
            below[above] = below.get(above, 0) + weighted
    out = []
    for text in scored:
        total = 0
        for nodes, bit in path(text):
            p = 0.5
            for node in reversed(nodes):
                if node in counts:
                    share = 1 / (1 + math.exp(-max(-700, min(700, odds.get(node, 700)))))
                    p = share * (counts[node][1] + 0.5) / (sum(counts[node]) + 1) + (1 - share) * p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_context_tree_keeps_every_node(spark, docs):
    ids = [i for i, _ in rows()]
    want = brute_tree([t for i, t in rows() if i is not None and i % 2 == 0], [t for _, t in rows()])
    got = context_tree.tree_scores(docs, F.col("doc_id") % 2 == 0).collect()
    pairs = zip(sorted((str(r.doc_id), r.score) for r in got), sorted(zip(map(str, ids), want, strict=True)), strict=True)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-4 * (1 + abs(b[1])) for a, b in pairs)
    # texts of more than 2,000,000 nodes, nearly all of them visited once
    rng = random.Random(3)
    letters = [chr(c) for c in range(33, 127) if not 65 <= c <= 90]
    long = "".join(rng.choice(letters) for _ in range(150_000))
    texts = [(1, long), (2, long[70_000:70_400]), (3, "no such passage")]
    grams, times = np.unique(context_tree.grams_of(*context_tree.text_bytes(pa.array([long])), 4)[0], return_counts=True)
    assert sum(len(x[0]) for x in context_tree.tree_levels(grams, times, 4)[2:]) > 2_000_000
    got = {r.doc_id: r.score for r in context_tree.tree_scores(spark.createDataFrame(texts, "doc_id long, text string"), F.col("doc_id") == 1).collect()}
    assert all(abs(got[i] - x) < 1e-4 * abs(x) for (i, _), x in zip(texts, brute_tree([long], [t for _, t in texts]), strict=True))


def test_near_groups(docs, empty):
    got = {(str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_groups(docs, shingle=4).collect()}
    sets = {}
    for i, t in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    ids = [i for i in sets if i is not None and sets[i]]
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    new, old = min(comp[a], comp[b]), max(comp[a], comp[b])
                    comp = {k: new if v == old else v for k, v in comp.items()}
                    changed = True
    assert got == {(str(i), len(sets[i]), str(comp[i]), comp[i] == i) for i in sets}
    assert near_dedup.near_groups(empty).count() == 0


def test_near_groups_of_shared_ids(spark):
    docs = spark.createDataFrame(shared_ids(), "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_groups(docs, shingle=4).collect())
    # PASSAGE and its two longer forms are one group; the other texts stay apart from it, whatever their ids
    assert got == sorted([("5", 37, "5", True), ("5", 37, "5", True), ("5", 37, "5", True), ("None", 38, "5", False), ("None", 1, "None", True), ("None", 1, "None", True), ("9", 38, "5", False)])
    wide = docs.withColumn("doc_id", F.col("doc_id") + F.lit(1 << 40))
    assert {r.component_id for r in near_dedup.near_groups(wide, shingle=4).where("n_shingles = 38").collect()} == {5 + (1 << 40)}


def test_near_groups_lose_no_link(spark):
    """Copies with more and more words changed: every pair of 80 % is linked, with sketches and without."""
    rng = random.Random(11)
    texts = []
    for g in range(12):
        base = [f"w{g}x{i}" for i in range(120)]
        for k in range(14):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            texts.append((g * 100 + k, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = {i: i for i in sets}
    for _ in range(20):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for deviations in (near_dedup.DEVIATIONS, None):
        assert {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, deviations=deviations).collect()} == comp


@pytest.mark.parametrize("add", [0, 1 << 30, 1 << 40, (1 << 62) - 10])
def test_order_of_ids_of_any_size(spark, add):
    """One id with two texts changes nothing for the others: the least id keeps its passage, whatever its size."""
    texts = [(5 + add + i, PASSAGE) for i in range(10)] + [(70 + add, "own words"), (70 + add, "other words")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    cut = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_bytes(docs).where("n_bytes > 100").collect()}
    assert cut == {5 + add + i: len(PASSAGE) if i else 0 for i in range(10)}
    assert {r.component_id for r in near_dedup.near_groups(docs, shingle=4).where("n_shingles = 37").collect()} == {5 + add}


def test_row_keys_of_other_ids(spark):
    """Ids that are no whole numbers keep their order too; rows without one come last."""
    rows = [("b", "x"), ("a", "z"), ("a", "y"), ("a", "y"), (None, "n"), ("c", None)]
    got = row_keys(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == 6 and len({r.row_key for r in got}) == 5
    assert [r.doc_id for r in sorted(got, key=lambda r: r.row_key)] == ["a", "a", "a", "b", "c", None]


def test_mixing_equals_sql(spark, docs):
    """The contract's columns, row by row, as DuckDB gives them; each shard's words and copies add up to what is taken."""
    import duckdb

    rows = [(r.doc_id, r.text, r.source) for r in docs.where("doc_id IS NOT NULL AND doc_id <> 2").collect()]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    want = sorted((i, n, s, round(t, 6), k) for i, n, s, t, k in con.execute(mixing.SQL).fetchall())
    got = mixing.mix_sources(docs.where("doc_id IS NOT NULL AND doc_id <> 2")).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == want
    assert all(len(r.shards) * r["size"] == r.taken and all(0 <= s < 2**mixing.LEVELS for s in r.shards) for r in got)


def test_repeated_bytes_of_shared_ids(spark):
    docs = spark.createDataFrame(shared_ids(), "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.repeated_bytes(docs).collect())
    size = len(PASSAGE)
    # of rows with one id and one text all are one text; PASSAGE stands first under 5, and the others lose it
    plain = len(shared_ids()[1][1])
    assert got == sorted([("5", size, 0), ("5", plain, 0), ("5", plain, 0), ("None", size + 4, size + 1), ("None", 13, 0), ("None", 13, 0), ("9", size + 5, size)])


def test_repeated_bytes(docs, empty):
    texts = {}
    for i, t in rows():
        texts[i] = (t or "").encode()
    first, flags = {}, {i: bytearray(len(b)) for i, b in texts.items()}
    for i in sorted(texts, key=lambda x: (x is None, x or 0)):
        b = texts[i]
        for k in range(len(b) - 99):
            if first.setdefault(b[k : k + 100], (i, k)) != (i, k):
                flags[i][k : k + 100] = b"\1" * 100
    want = {str(i): (len(b), sum(flags[i]), len(re.findall(b"\1+", bytes(flags[i]))), hashlib.sha256(bytes(x for x, f in zip(b, flags[i], strict=True) if not f)).hexdigest()) for i, b in texts.items()}
    got = suffix_dedup.repeated_bytes(docs).collect()
    assert len(got) == len(rows()) and {str(r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert suffix_dedup.repeated_bytes(empty).count() == 0
    whole = suffix_dedup.repeated_bytes(docs, keep_text=True).where("doc_id = 10").first()
    assert whole.kept == dict(rows())[10]


def test_multikey_order():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 3), (1, 3), (50, 2), (3000, 3), (3000, 1 << 40), (20_000, 40)):
        keys = tuple(rng.integers(-kinds, kinds, n) for _ in range(4))
        for small in (2, 16, 4096):
            got = suffix_dedup.multikey_order(keys, small)
            assert sorted(got.tolist()) == list(range(n)) and [tuple(k[i] for k in keys) for i in got] == sorted(zip(*keys, strict=True))


def test_suffix_buckets_agree(docs, monkeypatch):
    """Many small buckets, so that equal entries and hot tokens cross their boundaries."""
    whole = sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in suffix_dedup.repeated_bytes(docs).collect())
    monkeypatch.setattr(suffix_dedup, "BUCKET", 40)
    assert sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in suffix_dedup.repeated_bytes(docs).collect()) == whole


def test_suffix_pieces_agree(docs, monkeypatch):
    whole = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.repeated_bytes(docs).collect())
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    assert sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.repeated_bytes(docs).collect()) == whole


def test_toxicity(spark, docs, empty):
    model = toxicity.Model(((" idiot", 5.0), (" trash", 5.0)), ("trash can",), -4.0, 2.0, 0.5)
    cases = spark.createDataFrame([(1, "you 1d10t"), (2, "the trаsh"), (3, "a trash can"), (4, None), (5, ""), (6, "fine words here")], "doc_id long, text string")
    got = {r.doc_id: r.n_hits for r in toxicity.toxicity(cases, model).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}
    labels = docs.select("doc_id", F.col("text").contains("idiot").cast("int").alias("toxic")).dropna()
    fitted = toxicity.fit(docs, labels)
    scores = toxicity.toxicity(docs, fitted).collect()
    assert len(scores) == len(rows()) and all(0 <= r.score <= 1 for r in scores) and toxicity.toxicity(empty, fitted).count() == 0
    assert toxicity.fit(empty, labels.limit(0)).entries
    assert zlib.crc32(b"7") % 4 == docs.sparkSession.range(1).select((F.crc32(F.lit("7").cast("binary")) % 4).alias("x")).first().x


def test_html_extraction(spark):
    w = html_extraction.fit_weights()
    page = "<nav><a>Home</a></nav><article><h1>T</h1><p>One &amp; <b>tw</b>o.<p>Three<div class='ad'>Buy</div><script>x='</p>'</script></article><div class=comments><p>First!</p></div><footer>F</footer>"
    assert html_extraction.main_text(page, w) == "T One & two. Three"
    got = html_extraction.extract_text(spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", page), (3, "u", page)], "page_id int, url string, html string")).collect()
    assert [r.n_chars for r in got] == [0, 0, 18, 18]
    assert html_extraction.extract_text(spark.createDataFrame([], "page_id int, url string, html string, text int")).count() == 0


def test_html_region_is_the_scan():
    w = html_extraction.fit_weights()
    text = "<p>The river carries water from the hills to the sea.<br>Old maps show where it ran before the town was built.</p>"
    plain = "The river carries water from the hills to the sea. Old maps show where it ran before the town was built."
    # an article tag elsewhere does not replace the region of greatest sum
    assert html_extraction.main_text(f"<body><article><a>Teaser</a></article><ul><li><a>One</a></li><li><a>Two</a></li></ul><div>{text}</div></body>", w) == plain
    # without article tags, a short title and a line break stay in
    assert html_extraction.main_text("<body><nav><a>Home</a></nav><div><h1>Rivers</h1><p><b>Rivers.<br>" + text + "</div><footer>F</footer></body>", w) == f"Rivers Rivers. {plain}"
    # an article that the region cuts through comes whole
    assert html_extraction.main_text(f"<body><article><header><h1>On it</h1><div>By A</div></header>{text}</article><div><a>More</a></div></body>", w) == f"On it By A {plain}"


def test_license_scan(spark, docs, empty):
    s = license_scan.Scanner(license_scan.TEMPLATES)
    for name, texts in license_scan.TEMPLATES.items():
        for t in texts:
            assert name in s.best("some words before\n" + t + "\nand after", 0.9)[5]
    assert s.best("nothing of the kind", 0.9)[0] is None and license_scan.align(["a", "b", "c", "d"], ["x", "a", "c", "b", "d"]) in ([(0, 1), (1, 3), (3, 4)], [(0, 1), (2, 2), (3, 4)])
    assert license_scan.scan_licenses(docs).count() == len(rows()) and license_scan.scan_licenses(empty).count() == 0


def test_license_after_words_of_its_own():
    s = license_scan.Scanner(license_scan.TEMPLATES)
    cases = [("This is ours. This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", 3), ("All content 2024 All rights reserved.", "All-Rights-Reserved", 3), ("Licensed by X. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", 3), ("Seats reserved. All rights reserved.", "All-Rights-Reserved", 2)]
    for text, name, first in cases:
        assert s.best(text, 0.9)[:2] == (name, 1.0) and s.best(text, 0.9)[3] == first
    for name, texts in license_scan.TEMPLATES.items():
        for t in texts:
            # its own words before and after it, near and far, in either order
            w = t.split()
            for before in (w[:1], w[:2], w[-2:], [*w[:1], "x", "y"], [*w[:3], "x"]):
                got = s.best(" ".join([*before, *w, "x", *before]), 0.9)
                assert name in got[5] and got[1] == 1.0
    # one word of it changed, its last word again behind it
    one = "This work is licensed under a Creative Commons Attribution 3.0 International License. License"
    assert s.best(one, 0.9)[0] == "CC-BY-4.0" and s.best("rights all reserved and reserved all rights", 0.9)[5] == []


def test_context_tree_scores_by_rare_deep_nodes(spark):
    rng = random.Random(3)
    letters = [chr(c) for c in range(33, 127) if not 65 <= c <= 90]
    long = "".join(rng.choice(letters) for _ in range(150_000))
    grams, times = np.unique(context_tree.grams_of(*context_tree.text_bytes(pa.array([long, long])), 4)[0], return_counts=True)
    whole = context_tree.Tree(*context_tree.weigh(context_tree.tree_levels(grams, times, 4))[:3], 4)
    want = whole.log10(context_tree.grams_of(*context_tree.text_bytes(pa.array([long[:400]])), 4)[0]).sum()
    docs = spark.createDataFrame([(1, long), (1, long), (2, long[:400])], "doc_id long, text string")
    got = context_tree.tree_scores(docs, F.col("doc_id") == 1).where("doc_id = 2").first().score
    assert abs(got - want) < 1e-4 * abs(want) and got > -400  # the upper depths alone give about -739
