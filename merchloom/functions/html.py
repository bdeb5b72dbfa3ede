"""HTML trees and CSS selectors in Python, for the few functions that Catalyst cannot express; used by Arrow UDFs."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import merge
from html import escape, unescape
from html import parser as html_parser
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags without an end; tags that an opening tag ends; raw-text tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, **{b: {"p"} for b in _BLOCKS}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}


class Node:
    """An element, or text where tag is None."""

    __slots__ = ("attrs", "children", "data", "end", "index", "parent", "place", "tag")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, data: str = "") -> None:
        self.tag, self.attrs, self.data = tag, attrs or {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.index: Index | None = None
        self.place = self.end = 0

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def top(self) -> Node:
        n = self
        while n.parent is not None:
            n = n.parent
        return n

    def changed(self) -> None:
        """To be called before the tree around this node changes: its index no longer holds."""
        self.top().index = None

    def set(self, name: str, value: str) -> None:
        self.changed()
        self.attrs[name] = value

    def remove(self) -> None:
        if self.parent:
            self.changed()
            self.parent.children.remove(self)
            self.parent = None

    def unwrap(self) -> None:
        """The children in the element's place."""
        if self.parent:
            self.changed()
            at = self.parent.children.index(self)
            for c in self.children:
                c.parent = self.parent
            self.parent.children[at : at + 1] = self.children
            self.parent, self.children = None, []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if n.tag is not None:
                yield n
                stack.extend(reversed(n.children))

    def leaves(self, skip: tuple[str, ...] = ()) -> Iterator[Node]:
        """Text nodes below, in document order, but not those in the tags to skip; depth is no limit."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if n.tag is None:
                yield n
            elif n.tag not in skip:
                stack.extend(reversed(n.children))

    @property
    def text(self) -> str:
        """Text below, without scripts and styles."""
        return self.data if self.tag is None else "".join(n.data for n in self.leaves(("script", "style")))

    @property
    def raw(self) -> str:
        return "".join(n.data for n in self.leaves())

    def attr(self, name: str) -> str | None:
        return self.attrs.get(name)

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag is not None]

    def closest(self, selector: str) -> Node | None:
        n: Node | None = self
        while n is not None and not (n.tag and matches(n, selector)):
            n = n.parent
        return n

    def select(self, selector: str) -> list[Node]:
        """Elements below that match, in document order."""
        top = self.top()
        if top.index is None:
            top.index = Index(top)
        s, lists = compiled(selector), top.index.lists
        for key in s.keys:
            if key in lists:
                return [n for n in top.index.below(self, s.keys) if s(n)]
        return []

    def first(self, selector: str) -> Node | None:
        return next(self.found(selector), None)

    def found(self, selector: str) -> Iterator[Node]:
        """Matches one by one: only nodes that the index names for a selector's last compound are looked at."""
        top = self.top()
        if top.index is None:
            top.index = Index(top)
        s = compiled(selector)
        for n in top.index.below(self, s.keys):
            if s(n):
                yield n

    def html(self) -> str:
        """The element itself, serialised."""
        return _serialised([self])

    def inner(self) -> str:
        return _serialised(self.children)


#: What an index is asked for: a kind (tag, id, class, attr, value, all) and what it must be.
Key = tuple[str, object]


class Index:
    """The elements of a tree by tag, id, class, attribute and attribute value, in document order.

    Every element knows its place in that order and where its descendants end, so what lies below a node is a range of
    each list. An index holds until the tree changes.
    """

    def __init__(self, top: Node) -> None:
        self.lists: dict[Key, list[Node]] = {}
        self.places: dict[Key, list[int]] = {}
        every: list[Node] = []
        put = self.lists.setdefault
        stack: list[tuple[Node, bool]] = [(top, False)]
        top.place = -1
        while stack:
            n, left = stack.pop()
            if left:
                n.end = len(every)
                continue
            if n is not top:
                n.place = len(every)
                every.append(n)
                put(("tag", n.tag), []).append(n)
                for name, value in n.attrs.items():
                    put(("attr", name), []).append(n)
                    put(("value", (name, value)), []).append(n)
                    if name == "class":
                        for c in dict.fromkeys(value.split()):
                            put(("class", c), []).append(n)
            below = [(c, False) for c in reversed(n.children) if c.tag is not None]
            if below:
                stack.append((n, True))
                stack += below
            else:
                n.end = len(every)
        self.lists["all", None] = every

    def below(self, node: Node, keys: tuple[Key, ...]) -> Iterable[Node]:
        """Elements below a node that any of the keys names, in document order and each once."""
        parts = [part for key in keys if key in self.lists and (part := self._range(node, key))]
        if len(parts) < 2:
            return parts[0] if parts else ()
        return self._merged(parts)

    @staticmethod
    def _merged(parts: list[list[Node]]) -> Iterator[Node]:
        last = -1
        for n in merge(*parts, key=lambda n: n.place):
            if n.place != last:
                last = n.place
                yield n

    def _range(self, node: Node, key: Key) -> list[Node]:
        have = self.lists.get(key)
        if not have:
            return []
        if node.place < 0:
            return have
        if key not in self.places:
            self.places[key] = [n.place for n in have]
        at = self.places[key]
        return have[bisect_right(at, node.place) : bisect_left(at, node.end)]


def _serialised(nodes: list[Node]) -> str:
    """Markup of some nodes: a stack holds what is still to be written."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(nodes))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag is None:
            plain = n.parent is not None and n.parent.tag in ("script", "style")
            out.append(n.data if plain else escape(n.data, quote=False))
        else:
            attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in n.attrs.items())
            out.append(f"<{n.tag}{attrs}>")
            if n.tag not in VOID:
                stack.append(f"</{n.tag}>")
                stack.extend(reversed(n.children))
    return "".join(out)


class _Tree:
    """A tree that grows by starts, ends and texts."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.open = [self.root]

    def start(self, tag: str, known: dict[str, str], alone: bool = False) -> None:
        closes, have = CLOSES.get(tag), self.open
        if closes:
            scope = SCOPES.get(tag, ())
            for i in range(len(have) - 1, 0, -1):
                if have[i].tag in scope:
                    break
                if have[i].tag in closes:
                    del have[i:]
                    break
        node = have[-1].add(Node(tag, known))
        if not alone and tag not in VOID:
            have.append(node)

    def end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def text(self, data: str) -> None:
        self.open[-1].add(Node(None, data=data))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree = _Tree()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]], alone: bool = False) -> None:
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        self.tree.start(tag, known, alone)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs, alone=True)

    def handle_endtag(self, tag: str) -> None:
        self.tree.end(tag)

    def handle_data(self, data: str) -> None:
        self.tree.text(data)


# Markup that every reader takes alike: a text, then an end, a start, a doctype or the beginning of a comment.
_PLAIN = re.compile(
    r"""([^<]*)(?:</([a-zA-Z][a-zA-Z0-9-]*)[ \t\r\n]*>|<([a-zA-Z][a-zA-Z0-9-]*)((?:[ \t\r\n]+[a-zA-Z][a-zA-Z0-9_:.-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'`=<>/]+(?=[ \t\r\n>])))?)*)[ \t\r\n]*(/?)>|<![dD][oO][cC][tT][yY][pP][eE][a-zA-Z0-9 ]*>|(<!--))"""
)
_PLAIN_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9_:.-]*)(?:=(?:"([^"]*)"|'([^']*)'|([^ \t\r\n]+)))?""")
_ENDS = {tag: re.compile(rf"</\s*{tag}([ \t\r\n]*>)?", re.I) for tag in ("script", "style", "title")}
#: Tags whose content readers do not take alike.
_DISPUTED = frozenset("iframe noembed noframes plaintext textarea xmp".split())
_attribute_text = getattr(html_parser, "_unescape_attrvalue", unescape)


def _plain_tree(text: str) -> Node | None:
    """The tree of a page whose markup is all plain, in a tenth of a general parser's steps; None for any other."""
    tree, at, n = _Tree(), 0, len(text)
    step = _PLAIN.match
    while at < n:
        m = step(text, at)
        if m is None:
            if text.find("<", at) >= 0:
                return None
            tree.text(unescape(text[at:]))
            break
        data, end, start, attrs, alone, comment = m.groups()
        at = m.end()
        if data:
            tree.text(unescape(data) if "&" in data else data)
        if end:
            tree.end(end.lower())
        elif start:
            tag, known = start.lower(), {}
            if tag in _DISPUTED:
                return None
            if attrs:
                for name, *values in _PLAIN_ATTRIBUTE.findall(attrs):
                    value = values[0] or values[1] or values[2]
                    known.setdefault(name.lower(), _attribute_text(value) if "&" in value else value)
            tree.start(tag, known, alone == "/")
            if tag in _ENDS and not alone:
                stop = _ENDS[tag].search(text, at)
                content = text[at : stop.start()] if stop else ""
                if stop is None or not stop[1] or stop[0][2].isspace() or ("<" if tag == "title" else "<!--") in content:
                    return None
                if content:
                    tree.text(unescape(content) if tag == "title" else content)
                tree.end(tag)
                at = stop.end()
        elif comment:
            stop = text.find("-->", at)
            if stop < 0 or text.startswith((">", "->"), at) or "--!" in text[at:stop]:
                return None
            at = stop + 3
    return tree.root


def parse(text: str | None, document: bool = True) -> Node:
    """A tree from any markup; stray ends are ignored, and a document has html, head and body."""
    root = _plain_tree(text or "")
    if root is None:
        b = _Builder()
        b.feed(text or "")
        b.close()
        root = b.tree.root
    if not document:
        return root
    top = next((c for c in root.children if c.tag == "html"), None)
    if top is None:
        top = Node("html")
        for c in list(root.children):
            top.add(c)
        root.children = []
        root.add(top)
    if not any(c.tag == "body" for c in top.children):
        head, body = next((c for c in top.children if c.tag == "head"), Node("head")), Node("body")
        for c in top.children:
            if c is not head:
                body.add(c)
        top.children = []
        top.add(head)
        top.add(body)
    elif not any(c.tag == "head" for c in top.children):
        head = Node("head")
        head.parent = top
        top.children.insert(0, head)
    return root


Test = Callable[[Node], bool]
_SIMPLE = re.compile(r"""(?P<all>\*)|(?P<tag>[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<uq>[^\s\]]+))\s*(?P<ci>[iI])?\s*)?\]|:(?P<pseudo>[\w-]+)(?P<open>\()?""")


_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


def _argument(s: str, at: int) -> int:
    depth = 1
    while at < len(s) and depth:
        depth += (s[at] == "(") - (s[at] == ")")
        at += 1
    return at


def _split(s: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(s):
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 0:
            parts.append(s[last:i])
            last = i + 1
    return [p.strip() for p in (*parts, s[last:]) if p.strip()]


def _nth(arg: str) -> Callable[[int], bool]:
    arg = arg.strip().lower()
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"([+-]?\d*)n\s*([+-]\s*\d+)?", arg)
    if not m:
        return lambda i: arg.isdigit() and i == int(arg)
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int((m[2] or "0").replace(" ", ""))
    return lambda i: (i - b) % a == 0 and (i - b) // a >= 0 if a else i == b


def _siblings(n: Node) -> list[Node]:
    return n.parent.elements() if n.parent else [n]


def _pseudo(name: str, arg: str | None) -> Test:
    if name in ("not", "is", "where"):
        inner = [compiled(p) for p in _split(arg or "")]
        return (lambda n: not any(t(n) for t in inner)) if name == "not" else (lambda n: any(t(n) for t in inner))
    if name == "has":
        return lambda n: n.first(arg or "") is not None
    if name == "contains":
        needle = (arg or "").strip().strip("\"'")
        return lambda n: needle in n.text
    if name == "nth-child":
        fits = _nth(arg or "")
        return lambda n: fits(_siblings(n).index(n) + 1)
    same = lambda n: [x for x in _siblings(n) if x.tag == n.tag]
    return {
        "first-child": lambda n: _siblings(n)[0] is n, "last-child": lambda n: _siblings(n)[-1] is n, "only-child": lambda n: len(_siblings(n)) == 1, "first-of-type": lambda n: same(n)[0] is n, "last-of-type": lambda n: same(n)[-1] is n,
        "empty": lambda n: not n.children, "root": lambda n: n.tag == "html",
    }.get(name, lambda n: False)


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    name = name.lower()
    v = value.lower() if fold else value

    def test(n: Node) -> bool:
        have = n.attrs.get(name)
        if have is None or op is None:
            return have is not None
        have = have.lower() if fold else have
        if op == "=":
            return have == v
        if op == "~=":
            return v in have.split()
        if op == "|=":
            return have == v or have.startswith(v + "-")
        return bool(v) and {"^=": have.startswith(v), "$=": have.endswith(v), "*=": v in have}[op]

    return test


#: Which part of a compound names the fewest elements, as a rule.
TELLING = ("id", "value", "class", "attr", "tag", "all")


def _compound(s: str, at: int) -> tuple[Test, Key, int]:
    """A compound's predicate, the most telling key of what it can match, and where it ends."""
    tests: list[Test] = []
    keys: list[Key] = [("all", None)]
    while at < len(s) and (m := _SIMPLE.match(s, at)):
        at = m.end()
        if m["tag"]:
            keys.append(("tag", m["tag"].lower()))
            tests.append(lambda n, t=m["tag"].lower(): n.tag == t)
        elif m["id"]:
            keys.append(("value", ("id", m["id"])))
            tests.append(lambda n, i=m["id"]: n.attrs.get("id") == i)
        elif m["cls"]:
            keys.append(("class", m["cls"]))
            tests.append(lambda n, c=m["cls"]: c in n.attrs.get("class", "").split())
        elif m["attr"]:
            name, value = m["attr"].lower(), next((x for x in (m["dq"], m["sq"], m["uq"]) if x is not None), "")
            keys.append(("value", (name, value)) if m["op"] == "=" and not m["ci"] else ("attr", name))
            tests.append(_attribute(name, m["op"], value, bool(m["ci"])))
        elif m["pseudo"]:
            arg = None
            if m["open"]:
                end = _argument(s, at)
                arg, at = s[at : end - 1], end
            tests.append(_pseudo(m["pseudo"].lower(), arg))
    key = min(keys, key=lambda k: TELLING.index(k[0]))
    return (tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)), key, at


def _complex(s: str) -> tuple[Test, Key | None]:
    """One selector as a predicate that goes from its last compound to the left, and the key of that compound; None: nothing matches."""
    steps: list[tuple[str, Test]] = []
    nothing: tuple[Test, None] = (lambda n: False), None
    at, combinator, key = 0, " ", None
    s = s.strip()
    while at < len(s):
        test, key, end = _compound(s, at)
        if end == at:
            return nothing
        steps.append((combinator, test))
        m = _COMBINATOR.match(s, end)
        if not m:
            at = end
            if at < len(s):
                return nothing
            break
        combinator, at = m[1] or " ", m.end()
    if not steps:
        return nothing

    def match(n: Node, i: int) -> bool:
        how, test = steps[i]
        if not test(n):
            return False
        if i == 0:
            return True
        if how in (">", " "):
            p = n.parent
            while p is not None and p.tag != "#root":
                if match(p, i - 1):
                    return True
                if how == ">":
                    return False
                p = p.parent
            return False
        before = _siblings(n)
        before = before[: before.index(n)]
        return any(match(x, i - 1) for x in (before[-1:] if how == "+" else before))

    return (lambda n: match(n, len(steps) - 1)) if len(steps) > 1 else steps[0][1], key


class Selector:
    """A selector list: a predicate, and the keys under which an index has all elements that may match."""

    __slots__ = ("keys", "tests")

    def __init__(self, text: str) -> None:
        parts = [x for x in map(_complex, _split(text)) if x[1] is not None]
        self.tests = [t for t, _ in parts]
        keys = tuple(dict.fromkeys(k for _, k in parts))
        self.keys: tuple[Key, ...] = (("all", None),) if ("all", None) in keys else keys

    def __call__(self, n: Node) -> bool:
        for t in self.tests:
            if t(n):
                return True
        return False


@lru_cache(maxsize=500)
def compiled(selector: str) -> Selector:
    """A selector list, compiled; what is not understood matches nothing."""
    return Selector(selector)


def matches(node: Node, selector: str) -> bool:
    return compiled(selector)(node)


# What a description may keep, and what is taken out of it with all it holds.
ALLOWED = frozenset(
    "p br hr div span section article h1 h2 h3 h4 h5 h6 strong b em i u s strike del ins mark small sub sup ul ol li dl dt dd blockquote pre code q cite abbr table thead tbody tfoot tr th td caption colgroup col a img figure figcaption picture source video audio".split()
)
ATTRIBUTES = {"a": "href title target rel", "img": "src alt title width height srcset loading", "source": "src srcset type media", "video": "src controls poster width height", "audio": "src controls", "td": "colspan rowspan", "th": "colspan rowspan scope", "col": "span", "colgroup": "span"}
DROPPED = (
    "script, style, noscript, iframe, object, embed, form, input, button, select, textarea, svg, canvas, template, link, meta, [id*=gtm i], [class*=gtm i], [class*=analytics i], [id*=analytics i], [class*=tracking i], [class*=pixel i], [class*=cookie i], "
    "[class*=add-to-cart i], [class*=addtocart i], [class*=share i], [class*=breadcrumb i], [class*=review-form i], [class*=wishlist i], img[width='1'][height='1'], img[src*='facebook.com/tr'], img[src*='google-analytics']"
)
_DANGEROUS = re.compile(r"^\s*(javascript|vbscript|data:text/html)", re.I)
_BREAKING = frozenset([*_BLOCKS, "li", "tr", "dt", "dd", "figcaption", "caption"])


def sanitise(html: str | None, base: str = "") -> tuple[str | None, str | None, bool, list[str]]:
    """A description made safe: html, text, whether something was taken out, addresses of its images."""
    if html is None or not html.strip():
        return None, None, False, []
    root = parse(html, document=False)
    stripped = False
    for n in root.select(DROPPED):
        n.remove()
        stripped = True
    for n in list(root.walk()):
        if n.tag not in ALLOWED:
            n.unwrap()
            stripped = True
            continue
        allowed = {"title", *ATTRIBUTES.get(n.tag or "", "").split()}
        for name in [k for k, v in n.attrs.items() if k not in allowed or _DANGEROUS.match(v or "")]:
            del n.attrs[name]  # an index may still name it; the selector's own test decides
            stripped = True
        for name in ("href", "src", "poster"):
            if base and n.attrs.get(name):
                n.set(name, urljoin(base, n.attrs[name]))
    for n in reversed(list(root.walk())):
        if n.tag in ("div", "span", "p", "section") and not n.elements() and not n.text.strip():
            n.remove()
    images = [n.attrs["src"] for n in root.select("img[src]")]
    out = root.inner().strip()
    return out or None, to_text(out) or None, stripped, images


def to_text(html: str | None) -> str:
    """Readable text: lines for blocks, bullets for list items, at most one empty line."""
    if not html:
        return ""
    out: list[str] = []

    stack: list[Node | str] = list(reversed(parse(html, document=False).children))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag is None:
            out.append(re.sub(r"\s+", " ", n.data))
        elif n.tag == "br":
            out.append("\n")
        elif n.tag not in ("script", "style"):
            out.append("• " if n.tag == "li" else "")
            stack.append("\n" if n.tag in _BREAKING else "")
            stack.extend(reversed(n.children))
    lines = [re.sub(r"[ \t ]+", " ", x).strip() for x in "".join(out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


#: Pages whose texts are held as Python strings at a time.
SLICE = 64


@F.arrow_udf(T.StringType())
def html_to_text(html: pa.Array) -> pa.Array:
    """Texts of pages: of a batch only its Arrow form is held whole, and a slice of it as strings."""
    parts = [pa.array([to_text(h) for h in html.slice(at, SLICE).to_pylist()], pa.string()) for at in range(0, len(html), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


_CLEAN = T.StructType([T.StructField("html", T.StringType()), T.StructField("text", T.StringType()), T.StructField("stripped", T.BooleanType()), T.StructField("images", T.ArrayType(T.StringType()))])
_NODE = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("text", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))])


@F.pandas_udf(_CLEAN)
def sanitise_html(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sanitise(h, b or "") for h, b in zip(html, base, strict=True)], columns=["html", "text", "stripped", "images"])


def select_nodes(selector: str):  # noqa: ANN201
    """UDF: matching elements as array<struct<idx,tag,text,attrs>>."""

    @F.pandas_udf(T.ArrayType(_NODE))
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: [{"idx": i, "tag": n.tag, "text": " ".join(n.text.split()), "attrs": n.attrs} for i, n in enumerate(parse(h).select(selector))])

    return run
