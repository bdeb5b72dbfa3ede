"""The methods of operators 4, 8, 9 and 10 against brute-force versions, and their verdicts on labelled rows."""

import itertools
import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from merchloom.llm import html_extraction, license_scan, quality_rules, toxicity
from merchloom.llm.common import remainder, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.01"
EN = "The old harbour lies below the town, and in the evening people walk along the water while boats come home with their nets full of fish."


# ---- quality rules ----------------------------------------------------------------------------------------------------
def brute_verdict(text, lang, bands):
    """Figures and verdict of a text, word by word with the library itself."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = [i for w in words for i in sp.encode(w)]
    again, seen = set(), {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    for places in seen.values():
        again |= {x for k in places for x in range(k, k + 8)} if len(places) > 1 else set()
    if len(words) < 20 or 100 * len(again) > 30 * len(words):
        return len(ids), False
    n = len(ids)
    chars = sum(map(len, words)) / n
    fallback = sum(sp.is_byte(i) or sp.is_unknown(i) for i in ids) / n
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) / math.log2(min(n, 512))
    low, high, most, least = bands.get(lang) or bands[quality_rules.script_of(text)]
    a, b, c, d = (x / math.sqrt(n) for x in quality_rules.SPREAD)
    return n, low - a <= chars <= high + b and fallback <= most + c and entropy >= least - d


def test_quality_verdict(spark):
    rng = random.Random(4)
    texts = [EN, EN * 5, " ".join(rng.choice("qwxzjk") * 9 for _ in range(60)), " ".join(str(rng.random()) for _ in range(40)), "слово за словом идёт по старой дороге " * 2 + "и вечером возвращается домой с полной корзиной ягод и грибов из дальнего леса", "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生自会那后能对着事其里所去行过家十用发天如然作方成者多日都三小军二无同么经法当起与好看学进种将还分此心前面又定见只主没公从 " * 30, "αυτή είναι μια μικρή ιστορία για έναν άνθρωπο " * 4, "aaa " * 200, "x", "", None, " ".join(f"{a}{b}" for a, b in itertools.product("abcdefgh", "ijklmnop")), "\U0001f600 " * 80, EN + " " + " ".join(["#$%&"] * 30)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(itertools.product(texts, ("en", "xx", None)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_tokens, r.kept) for r in quality_rules.quality_rules(docs, MODEL).collect()}
    assert got == {i: brute_verdict(t, lang, quality_rules.BANDS) for i, t, lang in rows}
    assert len({kept for _, kept in got.values()}) == 2
    assert [quality_rules.script_of(t) for t in ("abc é", "слово a", "αβγ", "漢字かなカナ", "한국", "हिन्दी", "!? 12 €", "ab вг")] == ["latin", "cyrillic", "greek", "kana", "hangul", "indic", "other", "latin"]


def test_fitted_bands(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.sample(EN.split() * 20, 250)), "en" if i % 3 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    judged = quality_rules.quality_rules(docs, MODEL)
    bands = quality_rules.fit_bands(judged, labels, docs, share=0.1, least=50)
    rows = [r for r in judged.join(docs, "doc_id").collect() if not r.base_failed]
    assert set(bands) == {"en", "fr"} == {r.lang for r in rows} and bands == quality_rules.fit_bands(judged, labels.unionByName(labels), docs, share=0.1, least=50)
    for lang, band in bands.items():
        own = [r for r in rows if r.lang == lang]
        want = [np.quantile([r.chars_per_token for r in own], q) for q in (0.1, 0.9)] + [np.quantile([r.fallback_share for r in own], 0.9), np.quantile([r.token_entropy for r in own], 0.1)]
        assert np.allclose(band, want)
    assert quality_rules.fit_bands(judged, labels.limit(0), docs) == {}


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the test tables")
def test_quality_on_labelled_rows(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    rows = quality_rules.quality_rules(docs, MODEL).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.9 and kept[0] < 0.6


# ---- toxicity -----------------------------------------------------------------------------------------------------------
def brute_sums(text, entries, exceptions):
    """Sum of weights, hits and words: every entry at every place, the longest at one start, none inside an exception."""
    folded = toxicity.fold(text)
    best = {}
    for pattern, weight in entries:
        for at in range(len(folded)):
            if folded.startswith(pattern, at) and (at not in best or len(pattern) > len(best[at][0])):
                best[at] = (pattern, weight)
    for phrase in map(toxicity.fold, exceptions):
        for at in range(len(folded)):
            if folded.startswith(phrase, at):
                best = {k: v for k, v in best.items() if not at <= k < at + len(phrase) - 1}
    return sum(w for _, w in best.values()), len(best), len(folded.split())


def test_toxicity_scores_like_brute_force(spark):
    rng = random.Random(9)
    entries = ((" idiot", 5.0), (" id", 1.5), (" trash", 4.0), (" trash heap ", 6.0), (" scum ", 3.0), (" a", 0.25))
    exceptions = ("trash can", "pond scum", "idiot proof")
    words = ["idiot", "1d10t", "IDIOTS", "trash", "tr@sh", "can", "heap", "scum", "pond", "proof", "fine", "аpple", "Σκ", "ida", "ｔｒａｓｈ", "scums"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randint(0, 40))) for _ in range(120)] + ["", None, "idiot " * 60_000, "trash can" * 2, "​i​diot"]
    model = toxicity.Model(entries, exceptions, -3.0, 1.7, 0.4)
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    for i, t in enumerate(texts):
        if t and len(t) > 10_000:
            assert got[i].n_hits == 60_000 and got[i].score > 0.99
            continue
        total, hits, n = brute_sums(t or "", entries, exceptions)
        score = 1 / (1 + math.exp(3.0 - 1.7 * math.log1p(total) - 0.4 * (math.log1p(100 * total / n) if n else 0)))
        assert (got[i].n_hits, got[i].n_words) == (hits, n) and abs(got[i].score - score) < 1e-12 and got[i].predicted == (score >= 0.3)


def test_toxicity_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "a calm day") for i in range(20)], "doc_id long, text string")
    for one in (0, 1):
        model = toxicity.fit(docs, docs.select("doc_id", F.lit(one).alias("toxic")))
        assert len(model.entries) == len(toxicity.SEEDS)
        assert {r.predicted for r in toxicity.toxicity(docs, model).where("doc_id % 2 = 0").collect()} == {0}


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the test tables")
def test_toxicity_held_out(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = toxicity.fit(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    rows = toxicity.toxicity(docs, model).join(labels, "doc_id").where(remainder(F.col("doc_id"), 4) == 2).groupBy("toxic").agg(F.avg("predicted").alias("hit")).collect()
    hit = {r.toxic: r.hit for r in rows}
    assert hit[1] > 0.8 and hit[0] < 0.05


# ---- HTML -----------------------------------------------------------------------------------------------------------------
def test_region_is_the_best_of_all(spark):
    """The one scan finds the greatest sum that any contiguous pieces have."""
    w = html_extraction.fit_weights()
    rng = random.Random(12)
    kinds = [("t", "div"), ("t", "/p"), ("t", "li"), ("t", "article"), ("w", "p"), ("w", "a"), ("x", "div"), ("w", "td")]
    for _ in range(300):
        parts = [html_extraction.Piece(*rng.choice(kinds), "word " * rng.randint(1, 9), True) for _ in range(rng.randint(0, 14))]
        lo, hi = html_extraction.main_region(parts, w)
        score = [html_extraction.piece_score(p, w) for p in parts]
        best = max((sum(score[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)), default=0)
        assert abs(sum(score[lo:hi]) - max(best, 0)) < 1e-9


def test_html_edges(spark):
    w = html_extraction.fit_weights()
    deep = "<div>" * 4000 + "<p>" + EN + "</p>" + "</div>" * 4000
    long = "<body><nav><a>Home</a></nav><article>" + "".join(f"<p>{EN} {i}</p>" for i in range(20_000)) + "</article><footer>F</footer></body>"
    assert html_extraction.main_text(deep, w) == EN
    assert html_extraction.main_text(long, w) == " ".join(f"{EN} {i}" for i in range(20_000))
    # of two regions of one score the first is given
    twice = f"<body><div><p>{EN}</p></div>{'<ul><li><a>x</a></li></ul>' * 30}<div><p>{EN}</p></div></body>"
    assert html_extraction.main_text(twice, w) == EN
    broken = ["<p>a < b &amp; c &#x41; &bogus; <", "<<<>>><p", "&#0;&#xD800;", "<script>alert(1)", "<!-- x", "<p" * 50]
    pages = spark.createDataFrame([(i, "u", h, "t", 7) for i, h in enumerate([*broken, None, "", twice, twice])], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extraction.extract_text(pages).collect())
    assert len(got) == 10 and all(n == len(t) for _, t, n in got) and got[8][1] == got[9][1] == EN and got[6][1] == got[7][1] == ""


def test_marks_are_whole_names():
    w = html_extraction.fit_weights()
    page = "<body><nav><a>Home</a></nav><article><p>{0}</p><div class='{1}'><p>{0} Inside.</p></div><p>{0}</p></article><footer>F</footer></body>"
    for name in ("notice-of-award", "promo-code-guide", "login-tutorial", "social-history", "banner-image", "cookie-recipe", "comment-on-kant", "header-files", "x-ads-y"):
        assert html_extraction.main_text(page.format(EN, name), w) == f"{EN} {EN} Inside. {EN}", name
    for name in ("ad", "ads", "ad-slot-3", "site-header", "comments-list", "newsletter_signup", "share-buttons", "main related-posts", "reader-comments"):
        assert html_extraction.main_text(page.format(EN, name), w) == f"{EN} {EN}", name


# ---- licenses -------------------------------------------------------------------------------------------------------------
def test_alignment(spark):
    """Aligned places match, ascend on both sides, and hold as long a run of anchors as brute force finds."""
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))
        places = sorted((rng.randint(0, 20), rng.randint(0, 20)) for _ in range(rng.randint(0, 9)))
        places = [(i, y) for i, (_, y) in enumerate(places)]
        best = max((len(c) for n in range(len(places) + 1) for c in itertools.combinations(places, n) if all(x[1] < y[1] for x, y in itertools.pairwise(c))), default=0)
        run = license_scan._increasing(places)
        assert len(run) == best and all(x[1] < y[1] for x, y in itertools.pairwise(run))


def test_license_edges(spark):
    s = license_scan.Scanner(license_scan.TEMPLATES)
    mit, bsd, isc = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["BSD-3-Clause"][0], license_scan.TEMPLATES["ISC"][0]
    both = s.best(f"{mit[1]}\n\n{EN * 3}\n\n{isc}", 0.9)
    assert {"MIT", "ISC"} <= set(both[5]) and both[1] == 1.0
    assert "BSD-3-Clause" in s.best(license_scan.TEMPLATES["BSD-2-Clause"][0], 0.9)[5] and s.best(bsd, 0.9)[1] == 1.0
    # ties in coverage go to the template with more words aligned
    assert s.best(f"{license_scan.TEMPLATES['All-Rights-Reserved'][0]} {isc}", 0.9)[0] == "ISC"
    long = EN * 8000 + license_scan.TEMPLATES["GPL-3.0"][1] + EN * 8000
    docs = spark.createDataFrame([(1, long, "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "rights " * 20_000, "x")], "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.license, r.first_word) for r in license_scan.scan_licenses(docs).collect())
    assert got == [(1, "GPL-3.0", len(license_scan.words_of(EN)) * 8000), (2, None, -1), (3, None, -1), (3, None, -1), (4, None, -1)]


def all_stretches(scanner, text, least):
    """License by license, the most words aligned in any stretch that begins and ends with a word of the template."""
    words = license_scan.words_of(text)
    most = {}
    for name, template in scanner.templates:
        own = [i for i, w in enumerate(words) if w in template]
        for lo, hi in itertools.combinations_with_replacement(own, 2):
            if hi - lo < len(template) / least + 1e-9:
                pairs = license_scan.align(template, words[lo : hi + 1])
                if len(pairs) >= least * len(template) - 1e-9 and len(pairs) >= least * (pairs[-1][1] - pairs[0][1] + 1):
                    most[name] = max(most.get(name, (0, 0)), (len(pairs) / len(template), len(pairs)))
    return most


@pytest.mark.parametrize("least", [0.6, 0.75, 0.9, 1.0])
def test_bounds_of_license_places_lose_none(least):
    rng = random.Random(5)
    found = 0
    for _ in range(150):
        letters = "abcdefghijklmnop"[: rng.randint(3, 16)]
        templates = {f"L{k}": (" ".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 8, 14)))),) for k in range(3)}
        s = license_scan.Scanner(templates)
        text = []
        for _ in range(rng.randint(0, 3)):
            text += [rng.choice(letters + "xyz") for _ in range(rng.randint(0, 6))]
            w = rng.choice(list(templates.values()))[0].split()
            text += [x for x in w if rng.random() > 0.12 for x in ([x] if rng.random() > 0.1 else [x, rng.choice(letters + "xyz")])]
        want = all_stretches(s, " ".join(text), least)
        name, coverage, matched, first, last, names = s.best(" ".join(text), least)
        assert names == sorted(want) and (coverage, matched) == max(want.values(), default=(0.0, 0)), (templates, text)
        assert name is None or (want[name] == (coverage, matched) and 0 <= first <= last)
        found += len(names)
    assert found > 50


def test_long_texts_of_template_words():
    """20,000 words of a template, shuffled one by one and in runs, give nothing, in a time that grows with the text."""
    rng = random.Random(6)
    s = license_scan.Scanner(license_scan.TEMPLATES)
    words = license_scan.words_of(license_scan.TEMPLATES["MIT"][1])
    for run in (1, 5, 12):
        runs = [words[i : i + run] for i in range(0, len(words), run)] * (20_000 // len(words))
        rng.shuffle(runs)
        text = " ".join(w for r in runs for w in r)
        began = time.process_time()
        assert "MIT" not in s.best(text, 0.9)[5]
        assert time.process_time() - began < 5
