"""Selectors through the index against a plain look at every element."""

import random

import pytest

from merchloom.functions.html import Node, parse, sanitise

PAGE = """<html lang="en-GB"><head><title>T</title><meta property="og:title" content="A"><meta property="OG:x" content="B"></head><body class="woo  shop"><div id="main" class="a b"><p class="price">1</p><p>two <b>bold</b></p><ul><li class="x">1</li><li>2</li><li class="x y">3</li><li></li></ul></div>
<div class="A"><section data-k="one two" data-l="en"><img src="/a.png" width='1'><img src="/b.jpg"><span>only</span></section></div><div><a href="http://x/y" title="Say &quot;hi&quot;">link</a></div><h1>H</h1><p class="b">last</p></body></html>"""


def elements(n):
    return [c for c in n.children if c.tag is not None]


def below(n):
    for c in elements(n):
        yield c
        yield from below(c)


def up(n):
    while n.parent is not None and n.parent.tag != "#root":
        n = n.parent
        yield n


def has(n, c):
    return c in (n.attrs.get("class") or "").split()


def before(n):
    own = elements(n.parent)
    return own[: next(i for i, x in enumerate(own) if x is n)]


def nth(n):
    return len(before(n)) + 1


FORMS = [
    ("*", lambda n: True), ("p", lambda n: n.tag == "p"), ("P", lambda n: n.tag == "p"), ("#main", lambda n: n.attrs.get("id") == "main"), (".a", lambda n: has(n, "a")), (".a.b", lambda n: has(n, "a") and has(n, "b")), ("li.x.y", lambda n: n.tag == "li" and has(n, "x") and has(n, "y")), ("[data-k]", lambda n: "data-k" in n.attrs),
    ('meta[property="og:title"]', lambda n: n.tag == "meta" and n.attrs.get("property") == "og:title"), ('[property="og:X" i]', lambda n: (n.attrs.get("property") or "").lower() == "og:x"), ("[data-k~=two]", lambda n: "two" in (n.attrs.get("data-k") or "").split()), ("[lang|=en]", lambda n: (n.attrs.get("lang") or "").startswith("en-")),
    ("[src^='/a']", lambda n: (n.attrs.get("src") or "").startswith("/a")), ("[src$=jpg]", lambda n: (n.attrs.get("src") or "").endswith("jpg")), ("[class*=ric]", lambda n: "ric" in (n.attrs.get("class") or "")), ("img[width='1']", lambda n: n.attrs.get("width") == "1"), ("[class*='']", lambda n: False),
    ("div p", lambda n: n.tag == "p" and any(x.tag == "div" for x in up(n))), ("body > p", lambda n: n.tag == "p" and n.parent.tag == "body"), ("p + p", lambda n: n.tag == "p" and bool(before(n)) and before(n)[-1].tag == "p"), ("h1~p", lambda n: n.tag == "p" and any(x.tag == "h1" for x in before(n))), ("body div > ul li.x + li", lambda n: n.tag == "li" and bool(before(n)) and has(before(n)[-1], "x")),
    (".b, #main, img", lambda n: has(n, "b") or n.attrs.get("id") == "main" or n.tag == "img"), ("li:not(.x)", lambda n: n.tag == "li" and not has(n, "x")), (":is(h1, b)", lambda n: n.tag in ("h1", "b")), (":where(.x, .y):not(.y)", lambda n: (has(n, "x") or has(n, "y")) and not has(n, "y")), ("div:has(img)", lambda n: n.tag == "div" and any(x.tag == "img" for x in below(n))),
    ("p:contains(bold)", lambda n: n.tag == "p" and "bold" in n.text), ("li:nth-child(2)", lambda n: n.tag == "li" and nth(n) == 2), ("li:nth-child(odd)", lambda n: n.tag == "li" and nth(n) % 2 == 1), ("li:nth-child(2n)", lambda n: n.tag == "li" and nth(n) % 2 == 0), ("li:nth-child(-n+2)", lambda n: n.tag == "li" and nth(n) <= 2),
    ("li:first-child", lambda n: n.tag == "li" and nth(n) == 1), ("li:last-child", lambda n: n.tag == "li" and elements(n.parent)[-1] is n), ("b:only-child", lambda n: n.tag == "b" and len(elements(n.parent)) == 1), ("img:first-of-type", lambda n: n.tag == "img" and not any(x.tag == "img" for x in before(n))), ("p:last-of-type", lambda n: n.tag == "p" and [x for x in elements(n.parent) if x.tag == "p"][-1] is n),
    ("li:empty", lambda n: n.tag == "li" and not n.children), (":root", lambda n: n.tag == "html"), ("nothing", lambda n: False), (".a >", lambda n: False), ("p:unknown", lambda n: False), ("!", lambda n: False), ("", lambda n: False), ("[title='Say \"hi\"']", lambda n: n.attrs.get("title") == 'Say "hi"'),
]


@pytest.mark.parametrize(("selector", "fits"), FORMS)
def test_forms(selector, fits):
    doc = parse(PAGE)
    if selector == ".a >":  # an open end: the compound before it counts
        assert {n.tag for n in doc.select(selector)} <= {"div"}
        return
    whole = [n for n in below(doc) if fits(n)]
    assert doc.select(selector) == whole and doc.first(selector) is (whole[0] if whole else None)
    for scope in doc.select("div, section, ul, body"):  # below a node: a range of the index
        assert scope.select(selector) == [n for n in below(scope) if fits(n)]


def test_index_follows_changes():
    doc = parse(PAGE)
    doc.select(".x")[0].remove()
    assert len(doc.select(".x")) == 1
    doc.first("#main").unwrap()
    assert doc.first("#main") is None and [n.parent.tag for n in doc.select("p")] == ["body"] * 3
    doc.first("h1").set("id", "new")
    assert doc.first("#new").tag == "h1"
    gone = doc.first("section")
    gone.remove()
    assert gone.parent is None and len(gone.select("img")) == 2 and not doc.select("img")


def test_random_trees():
    rng = random.Random(8)
    tags, classes = ["div", "p", "span", "b"], ["a", "b", "c"]
    for _ in range(30):
        nodes = [Node("#root")]
        for _ in range(60):
            nodes.append(rng.choice(nodes).add(Node(rng.choice(tags), {"class": " ".join(rng.choices(classes, k=rng.randint(0, 3))), "k": rng.choice("xy")})))
        for selector, fits in ((".a.b", lambda n: has(n, "a") and has(n, "b")), ("div > .c", lambda n: has(n, "c") and n.parent.tag == "div"), ("p [k=x], b", lambda n: n.tag == "b" or (n.attrs["k"] == "x" and any(u.tag == "p" for u in up(n)))), ("span ~ div", lambda n: n.tag == "div" and any(x.tag == "span" for x in before(n)))):
            for scope in nodes:
                assert scope.select(selector) == [n for n in below(scope) if fits(n)]


def test_sanitised_with_index():
    html, text, stripped, images = sanitise('<div><p class="share">no</p><script>x</script><a href="/y" onclick="z">y</a><img src="p.png" width="1" height="1"><img src="q.png"></div>', "https://s.com/d/")
    assert (html, text, stripped, images) == ('<div><a href="https://s.com/y">y</a><img src="https://s.com/d/q.png"></div>', "y", True, ["https://s.com/d/q.png"])
