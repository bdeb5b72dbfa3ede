"""Operator 9: main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, with weights that labelled pages
settle; words that stand in menus, adverts and the like score negative too, and the tags by which a page bounds its own
article may score positive. One scan finds the contiguous region of greatest sum, and its text is given without what
such places hold.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

# Tags whose content is no text, tags that stand for page furniture, tags inside a line, tags that bound
# an article, tags without an end, words in class, id or role that mark furniture, and words that say only where or in
# what form a piece stands.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas head title textarea select".split())
FURNITURE = frozenset("nav footer aside form menu dialog button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
BOUNDS = frozenset("article main /article /main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices overlay pagination pager popup promo promotion promoted related recommended replies respond share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription toolbar widget widgets topbar bottombar skip alert reader-comments".split()
)
PLACES = frozenset(
    "area bar block bottom box buttons center column container content desktop element fixed form global group holder home icons inner item items js left line link links list main mobile module outer page panel posts primary right root row secondary section "
    "site slot sticky text thread title top unit wrap wrapper zone".split()
)
#: Tags that a start tag ends when they are still open.
ENDS = {"p": frozenset({"p"}), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"})}
PARAGRAPH_ENDERS = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z0-9]+")


class Piece(NamedTuple):
    """kind: "w" text in content, "x" text in furniture, "t" a tag; name: the tag, or the block that holds the text."""

    kind: str
    name: str
    text: str
    breaks: bool


def _marked(attributes: str) -> bool:
    """Whether class, id or role name a piece of page furniture: a mark, alone or beside other marks, places and numbers.

    A mark beside any other word tells of a subject ("notice-of-award", "login-tutorial") and counts for nothing.
    """
    for m in _ATTR.finditer(attributes):
        for word in (m[2] or m[3] or m[4] or "").lower().split():
            parts = _PART.findall(word)
            if word in MARKS or (any(x in MARKS for x in parts) and all(x in MARKS or x in PLACES or x.isdigit() for x in parts)):
                return True
    return False


def pieces(page: str) -> list[Piece]:
    """The page as text and tags in order; what is hidden is left out, references are decoded."""
    out: list[Piece] = []
    open_tags: list[tuple[str, bool]] = []  # name, whether it is furniture
    furniture = content = 0
    at = 0

    def pop(index: int) -> None:
        nonlocal furniture, content
        for name, marked in open_tags[index:]:
            furniture -= marked
            content -= name in ("article", "main")
        del open_tags[index:]

    def text(raw: str) -> None:
        if raw:
            block = next((n for n, _ in reversed(open_tags) if n not in INLINE), "body")
            link = any(n == "a" for n, _ in open_tags[-4:])
            out.append(Piece("x" if furniture else "w", "a" if link else block, entities.unescape(raw), False))

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in HIDDEN and name != "head" and not closing:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else (len(page) if name in ("script", "style", "textarea") else at)
            continue
        breaks = name not in INLINE
        if closing:
            index = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == name), None)
            if index is not None:
                pop(index)
            out.append(Piece("t", f"/{name}", "", breaks))
            continue
        enders = ENDS.get(name, frozenset()) | (frozenset({"p"}) if name in PARAGRAPH_ENDERS else frozenset())
        while open_tags and (open_tags[-1][0] in enders or (open_tags[-1][0] in INLINE and breaks and any(n in enders for n, _ in open_tags[-3:]))):
            pop(len(open_tags) - 1)
        out.append(Piece("t", name, "", breaks))
        if name not in VOID and not m[3].rstrip().endswith("/"):
            marked = name in FURNITURE or (name == "header" and not content) or (name not in ("body", "html", "article", "main") and _marked(m[3]))
            open_tags.append((name, marked))
            furniture += marked
            content += name in ("article", "main")
    text(page[at:])
    return out


#: Labelled pages: what stands between the two marks is the main text.
LABELLED = (
    "<body><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><div>[[<h1>On rivers</h1><p>Rivers carry water from the hills to the sea and shape the land on their way.</p><p>Old maps show where they ran before the towns were built.</p>]]</div><div><ul><li><a>Other news</a></li><li><a>Archive</a></li><li><a>Contact us</a></li></ul></div><footer>All rights reserved 2020</footer></body>",
    "<body><div><a>Start</a> <a>Shop</a> <a>Help</a></div><table><tr><td><a>Links</a><br><a>More</a></td><td>[[<p>The museum opens at nine and closes late in summer, when the evenings are long.</p><p>Guides speak several languages.</p><ul><li>Bring water and a hat for the garden walk.</li><li>Children enter free of charge on Sundays.</li></ul>]]</td></tr></table><div><a>Imprint</a> | <a>Privacy</a></div></body>",
    "<body><header><img><h2>Daily</h2></header>[[<article><h1>Bread</h1><p>Good bread needs flour, water, salt and patience; <b>time</b> does most of the work.</p><blockquote>My grandmother never weighed anything.</blockquote><p>Let the dough rest overnight in a cool place.</p></article>]]<aside><h3>Related</h3><ul><li><a>Cakes</a></li><li><a>Pies</a></li></ul></aside><footer><p>Imprint</p></footer></body>",
    "<body><ul><li><a>A</a></li><li><a>B</a></li><li><a>C</a></li></ul><div>[[<p>It rained for a week, and the road to the village was closed until the bridge had been repaired.</p>]]</div><form><input><button>Send</button></form><div><a>Top</a></div></body>",
    "<body><div><a>Home</a></div>[[<main><h1>Harbour</h1><p>The boats leave early.<br>The nets are mended at noon.<br>In the evening the quay is full of people.</p></main>]]<div><a>Imprint</a></div></body>",
)


class Weights(NamedTuple):
    """Score of a word by the block that holds it, and of a tag by its name; the rest have the default."""

    words: dict[str, float]
    tags: dict[str, float]
    word: float
    link: float
    furniture: float
    tag: float


def fit_weights(labelled: Iterable[str] = LABELLED) -> Weights:
    """Weights from pages whose main text stands between [[ and ]]: log odds of standing inside, by kind."""
    inside, outside = Counter(), Counter()
    for page in labelled:
        depth = False
        for p in pieces(page):
            for part in re.split(r"(\[\[|\]\])", p.text) if p.kind != "t" else [None]:
                if part in ("[[", "]]"):
                    depth = part == "[["
                    continue
                key = ("t", p.name) if p.kind == "t" else (p.kind, p.name)
                (inside if depth else outside)[key] += 1 if part is None else len(part.split())

    def odds(key: tuple[str, str]) -> float:
        return math.log((inside[key] + 0.5) / (outside[key] + 0.5))

    every = set(inside) | set(outside)
    words = {n: max(0.2, min(2.0, odds((k, n)) / 2)) for k, n in every if k == "w" and n != "a"}
    tags = {n: min(-0.2, max(-4.0, odds((k, n)) - 1.5)) for k, n in every if k == "t"}
    tags |= {n: max(-4.0, min(4.0, odds(("t", n)))) for n in BOUNDS}
    return Weights(words, tags, 0.6, -0.4, -0.7, -1.0)


#: What a piece of furniture weighs at most, so that one in the midst of an article does not cut it: as much as a few tags.
MOST_FURNITURE = 6.0


def piece_score(p: Piece, weights: Weights) -> float:
    """A tag's weight, or that of a text's words."""
    if p.kind == "t":
        return weights.tags.get(p.name, weights.tag)
    n = len(p.text.split())
    if p.kind == "x":
        return max(n * weights.furniture, -MOST_FURNITURE)
    return n * (weights.link if p.name == "a" else weights.words.get(p.name, weights.word))


def main_region(parts: list[Piece], weights: Weights) -> tuple[int, int]:
    """Start and end of the contiguous pieces with the greatest sum, by one scan; (0, 0) if no sum is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, p in enumerate(parts):
        if total <= 0:
            total, start = 0.0, i
        total += piece_score(p, weights)
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def widened(parts: list[Piece], lo: int, hi: int) -> tuple[int, int]:
    """The region with the rest of each article that it cuts through (of each <main>, on pages without an article)."""
    name = "article" if any(p.kind == "t" and p.name == "article" for p in parts) else "main"
    began: list[int] = []
    first, last = lo, hi
    for i, p in enumerate(parts):
        if p.kind == "t" and p.name == name:
            began.append(i)
        elif p.kind == "t" and p.name == f"/{name}" and began:
            start = began.pop()
            if start < hi and lo <= i:
                first, last = min(first, start), max(last, i + 1)
    return first, last


def main_text(page: str | None, weights: Weights) -> str:
    """Text of the main region: one space for white space inside a block and between blocks."""
    if not page:
        return ""
    parts = pieces(page)
    lo, hi = widened(parts, *main_region(parts, weights))
    return " ".join("".join(" " if p.breaks else p.text for p in parts[lo:hi] if p.kind != "x").split())


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """One row per row of `pages`: id, url, text, n_chars (code points).

    Null and empty pages, and pages without text, give an empty text. Broken markup is read as far as it goes: an
    unclosed tag ends with its parent, a tag without its bracket is dropped. Rows are read one by one and whole;
    repeated rows agree; other columns are ignored, whatever their names.
    """
    arrow_batches(pages.sparkSession)
    weights = weights or fit_weights()
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), weights) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {id_type}, url {url_type}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
