"""Main text of web pages by a maximum-scoring subsequence of tokens.

A page is a sequence of words and tags.  Words score positive, by the kind of block they stand in;
tags score negative, each by its name; one linear scan finds the contiguous region of the highest sum,
which is the content.  The weights are fitted by a structured perceptron on labelled pages of
many shapes (`labelled_pages`: with and without article elements, in tables, with headers in the article, with a form
around the page, with teaser cards, comments, adverts and notices), until the scan finds their regions.

Words of menus, headers, footers, sidebars, notices, adverts, forms and reader comments score nothing, a tag for each
of their blocks counts against a region that spans them, and they are dropped from it.  Such an element is known by
its name, its role, or by class and id: one of `STRONG` among the words is enough, one of `WEAK` counts if the
others only name boxes.  A form that holds most of the page's words is no such element.  Scripts, styles,
comments and what isn't shown never become tokens.

Defined results: null and empty pages give an empty text; truncated pages end where they
end; a page without any markup is one block; a page in which no block scores positive gives all that isn't dropped;
repeated rows get equal results; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, pick, table, texts_of

#: Element names of HTML by their part in a page.
RAW = {"script", "style", "textarea", "iframe", "noembed", "noframes", "title"}
UNSEEN = {"head", "noscript", "template", "svg", "object", "select", "datalist", "canvas", "audio", "video", "dialog"}
HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
EDGES = {"nav", "footer", "aside", "menu", "search"}
ROLES = {"banner", "complementary", "contentinfo", "dialog", "alertdialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
#: Words of class and id that mark an element by themselves, that mark it if all others only name boxes, and that name boxes.
STRONG = {"ad", "ads", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disqus", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "promo", "promoted", "promotion", "replies", "sharing", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "toolbar", "topbar"}
WEAK = {"banner", "footer", "header", "login", "notice", "notices", "related", "search", "share", "skip", "social", "widget", "widgets"}
BOXES = {"area", "bar", "block", "bottom", "box", "buttons", "col", "column", "container", "content", "field", "fixed", "form", "global", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "right", "row", "section", "site", "slot", "sticky", "top", "unit", "wrap", "wrapper"}

_ATTRS = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+|=)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})(?:>|\Z)", re.S)
_ATTR = re.compile(r"""[\s/]*+([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?+""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    """Text between two block tags, with what surrounds it."""

    text: str
    words: int
    linked: int  # words in links
    tags: tuple[str, ...]  # tags since the block before
    edge: bool  # in an element that isn't the article by its name or marks
    article: bool  # inside article or main


class Open(NamedTuple):
    """An element that is open, with what holds inside of it."""

    name: str
    edge: bool = False
    article: bool = False
    unseen: bool = False
    form: int = 0  # which form of the page


def _marked(name: str, attrs: str, article: bool) -> bool:
    """Do the attributes of an element say that it isn't the article?"""
    if not attrs or attrs.isspace():
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            return True
        if key == "role" and value.strip().lower() in ROLES:
            return True
        if key in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in _NAME.findall(one)}
                if words & STRONG or (words & WEAK and words <= WEAK | BOXES and not (article and "header" in words)):
                    return True
    return False


def _parsed(page: str) -> list[tuple[Block, int]]:
    """The blocks of a page that have text, with the number of the form they stand in."""
    out: list[tuple[Block, int]] = []
    stack = [Open("")]
    open_: Counter = Counter()
    parts: list[str] = []
    tags: list[str] = []
    links, linked, at, forms = 0, 0, 0, 0

    def flush() -> None:
        nonlocal parts, tags, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                top = stack[-1]
                out.append((Block(text, text.count(" ") + 1, linked, tuple(tags), top.edge, top.article), top.form))
                tags = []
            parts = []
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].unseen:
            parts.append(raw)
            if links:
                linked += len(raw.split())

    def close(name: str) -> None:
        while open_[name]:
            last = stack.pop().name
            open_[last] -= 1
            if last == name:
                break

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, closing = m[2].lower(), bool(m[1])
        if open_["head"] and name not in HEAD and (name != "head" or closing):
            close("head")
        if name in RAW:
            if not closing:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                if stack[-1].unseen or name in HEAD:
                    continue
                tags.append(name)
            continue
        if name in UNSEEN:
            if closing:
                close(name)
            elif not m[3].endswith("/"):
                if name == "dialog":
                    flush()
                stack.append(stack[-1]._replace(name=name, unseen=True))
                open_[name] += 1
            continue
        if open_["svg"] and name in BLOCKS and not closing:  # a drawing ends where text begins
            close("svg")
        if stack[-1].unseen and not (closing and open_[name]):
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name == "br":
            say(" ")
        if name not in BLOCKS:
            if not closing:
                tags.append(name)
            continue
        flush()
        tags.append(("/" if closing else "") + name)
        if name in VOID:
            continue
        if closing:
            close(name)
            links = 0
            continue
        if name in ("p", "li") and stack[-1].name == name:  # an open one ends where the next begins
            stack.pop()
            open_[name] -= 1
        top = stack[-1]
        edge = name in EDGES or (name == "header" and not top.article) or (name not in ("body", "html", "article", "main") and _marked(name, m[3], top.article))
        if name == "form":
            forms += 1
        stack.append(Open(name, edge or top.edge, top.article or name in ("article", "main"), False, forms if name == "form" else top.form))
        open_[name] += 1
    tail = page[at:]
    say(tail[: tail.rfind("<")] if re.search(r"<[/a-zA-Z!][^>]*\Z", tail) else tail)
    flush()
    return out


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text; those of forms are edges, unless the form holds most of the words that aren't."""
    found = _parsed(page)
    inside: Counter = Counter()
    for b, form in found:
        if not b.edge:
            inside[form] += b.words
    small = {form for form, n in inside.items() if form and 2 * n <= inside.total()}
    return [b._replace(edge=True) if form in small else b for b, form in found]


def _kinds(found: list[Block]) -> list[str]:
    """What each block's words are scored by; outside: not in the article element, where that holds most of the words."""
    total = sum(b.words for b in found if not b.edge)
    whole = 2 * sum(b.words for b in found if b.article and not b.edge) > total
    out = []
    for b in found:
        where = "edge" if b.edge else ("article" if b.article else "outside") if whole else "plain"
        out.append(where if b.edge else f"{where} {'long' if b.words >= 8 else 'short'}{' links' if 2 * b.linked > b.words else ''}")
    return out


def _features(b: Block, kind: str) -> Counter:
    """Of one block: its tags, and its words (a long block's count with their root)."""
    out = Counter(b.tags)
    out["(edge)" if b.edge else kind] += 1 if b.edge else math.sqrt(b.words)
    return out


class Weights(NamedTuple):
    of: dict[str, float]  # tags and kinds of words
    tag: float  # a tag that no labelled page has

    def score(self, b: Block, kind: str) -> float:
        of = self.of.get
        return sum(of(t, self.tag) for t in b.tags) + (of("(edge)") if b.edge else self.of[kind] * math.sqrt(b.words))


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous part with the highest sum, the first and longest of equal ones; (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best or total == best and total > 0 and found[0] == start:
            best, found = total, (start, k + 1)
    return found


KINDS = [f"{w} {s}{k}" for w in ("article", "outside", "plain") for s in ("long", "short") for k in ("", " links")]


def learn(pages: list[tuple[str, set[str]]], rounds: int = 60, rate: float = 0.05, margin: float = 2.0) -> Weights:
    """Weights by a structured perceptron: where the scan's region isn't the labelled one, weights move from the one to the other.

    A page is its HTML and the first words of the article's blocks.  While it learns, each block outside the labelled
    region scores `margin` more and each inside less, so that the region is found with something to spare.  Words stay
    positive and tags negative; the result is the mean over all steps.
    """
    rows = []
    for page, gold in pages:
        found = blocks(page)
        inside = [k for k, b in enumerate(found) if b.text.split(" ", 1)[0] in gold]
        rows.append((found, _kinds(found), (inside[0], inside[-1] + 1)))
    tags = sorted({t for found, _, _ in rows for b in found for t in b.tags} | {"(edge)"})
    start = {k: (0.6 if "plain" in k else 1.0) if "long" in k else 0.3 for k in KINDS if "links" not in k and "outside" not in k}
    w = dict.fromkeys(tags, -0.2) | dict.fromkeys(KINDS, 0.05) | start
    features = [[_features(b, k) for b, k in zip(found, kinds)] for found, kinds, _ in rows]
    mean: Counter = Counter()
    for _ in range(rounds):
        for row, (found, _, (a, b)) in enumerate(rows):
            scores = [sum(w[x] * n for x, n in f.items()) + (-margin if a <= k < b else margin) * (not found[k].edge) for k, f in enumerate(features[row])]
            c, d = best_region(scores)
            if (a, b) != (c, d):
                for (x, y), sign in (((a, b), rate), ((c, d), -rate)):
                    for f in features[row][x:y]:
                        for name, n in f.items():
                            w[name] += sign * n
                for name in w:
                    w[name] = max(0.01, w[name]) if name in KINDS else min(-0.02, max(-3.0, w[name]))
            mean.update(w)
    of = {name: x / (rounds * len(rows)) for name, x in mean.items()}
    known = [x for name, x in of.items() if name not in KINDS and name != "(edge)"]
    return Weights(of, sum(known) / len(known))


def labelled_pages(count: int = 160, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Made-up pages of many shapes, each with the first words of its article's blocks."""
    r = random.Random(seed)
    number = iter(range(1 << 30))
    out = []
    for _ in range(count):
        gold: set[str] = set()
        shape = r.randrange(8)

        def say(n: int, mine: bool = False) -> str:
            first = f"w{next(number)}"
            if mine:
                gold.add(first)  # noqa: B023
            return " ".join([first, *("".join(r.choice("aeionrst") for _ in range(r.randrange(2, 9))) for _ in range(n - 1))])

        def links(n: int) -> str:
            return "".join(f"<a href='/{k}'>{say(r.randrange(1, 4))}</a>" if r.random() < 0.5 else f"<li><a href='/{k}'>{say(r.randrange(1, 4))}</a></li>" for k in range(n))

        def few(choices: list, least: int, most: int) -> str:
            return "".join(r.choice(choices)() for _ in range(r.randint(least, most)))

        top = [
            lambda: f"<nav><ul>{links(r.randrange(2, 8))}</ul></nav>", lambda: f"<header>{links(3)}<h1>{say(3)}</h1></header>", lambda: f"<div class='ad'>{say(r.randrange(4, 20))}</div>",
            lambda: f"<div id='cookie-notice'><p>{say(r.randrange(8, 30))}</p></div>", lambda: f"<div class='top'>{links(r.randrange(2, 9))}</div>", lambda: f"<form action='/search'><input name='q'>{say(2)}</form>",
            lambda: f"<div><ul>{links(r.randrange(3, 12))}</ul></div>", lambda: f"<p>{say(r.randrange(1, 4))}</p><hr>", lambda: f"<table><tr><td>{say(1)}</td><td>{links(2)}</td></tr></table>"]
        body = [
            lambda: f"<p>{say(r.randrange(12, 90), True)}</p>", lambda: f"<p>{say(r.randrange(12, 90), True)}</p>", lambda: f"<p>{say(r.randrange(12, 60), True)} <b>{say(2)}</b> <a href='/x'>{say(2)}</a></p>",
            lambda: f"<p>{say(r.randrange(8, 40), True)}</p>", lambda: f"<h2>{say(r.randrange(1, 6), True)}</h2><p>{say(r.randrange(12, 70), True)}</p>", lambda: "<ul>" + "".join(f"<li>{say(r.randrange(3, 20), True)}</li>" for _ in range(3)) + "</ul>",
            lambda: f"<blockquote>{say(r.randrange(8, 30), True)}</blockquote>", lambda: f"<div>{say(r.randrange(12, 60), True)}</div>", lambda: f"<p>{say(r.randrange(2, 7), True)}</p><p>{say(r.randrange(20, 60), True)}</p>"]
        if shape < 3:
            body += [lambda: f"<section><h3>{say(r.randrange(1, 4), True)}</h3><div><p>{say(r.randrange(1, 4), True)}</p></div></section>", lambda: f"<p><a href='/z'>{say(r.randrange(2, 12), True)}</a></p>",
                     lambda: f"<table><tbody><tr><td>{say(1, True)}</td><td>{say(r.randrange(1, 4), True)}</td></tr></tbody></table>"]
        noise = [lambda: f"<div class='ad-slot'>{say(r.randrange(3, 15))}</div>", lambda: f"<aside><p>{say(r.randrange(3, 20))}</p></aside>", lambda: f"<div class='share'>{links(3)}</div>", lambda: f"<form><p>{say(5)}</p><button>{say(1)}</button></form>"]
        end = [
            lambda: f"<div class='related'>{links(4)}</div>", lambda: f"<section id='comments'><p>{say(r.randrange(5, 40))}</p><p>{say(r.randrange(5, 40))}</p></section>", lambda: f"<div class='newsletter'>{say(r.randrange(4, 12))}</div>",
            lambda: f"<div class='sidebar'><p>{say(3)}</p>{links(3)}</div>", lambda: f"<div><h3>{say(2)}</h3><ul>{links(r.randrange(3, 9))}</ul></div>", lambda: f"<div>{say(r.randrange(1, 5))}</div>", lambda: f"<div>{links(r.randrange(2, 6))}</div>"]
        teaser = [lambda: f"<article><a href='/y'>{say(r.randrange(3, 7))}</a></article>"]

        def text() -> str:
            title = f"<h1>{say(r.randrange(2, 9), True)}</h1>" if r.random() < 0.8 else ""
            if r.random() < 0.3:
                title = f"<div class='article-header'>{title}<p>{say(r.randrange(2, 6), True)}</p></div>"
            inner = "".join(few(body, 1, 3) + (few(noise, 1, 1) if r.random() < 0.3 else "") for _ in range(r.randrange(1, 4)))
            return f"{title}<p>{say(r.randrange(20, 60), True)}</p>{inner}" + ("" if shape < 3 else f"<p>{say(r.randrange(10, 40), True)}</p>")

        article = text()
        article = [f"<article>{article}</article>", f"<main>{article}</main>", f"<main><article>{article}</article></main>", f"<div class='content'>{article}</div>", f"<div>{article}</div>",
                   f"<section>{article}</section>", f"<table><tr><td>{article}</td></tr></table>", f"<div id='post'><div>{article}</div></div>"][shape]
        after = few(end, 1, 4) + (few(teaser, 1, 3) if shape > 2 and r.random() < 0.3 else "") + f"<footer>{say(r.randrange(3, 12))}</footer>"
        page = f"{few(top, 1, 4)}{article}{after}"
        if r.random() < 0.2:
            page = f"<form id='aspnet'>{page}</form>"
        out.append((f"<html><head><title>{say(4)}</title></head><body>{page}</body></html>", gold))
    return out


@cache
def weights() -> Weights:
    return learn(labelled_pages())


def extract(page: str, w: Weights | None = None) -> str:
    """The main text of a page: blocks of the best region, one a line, without the elements that aren't the article."""
    found = blocks(page)
    w = w or weights()
    a, b = best_region([w.score(x, k) for x, k in zip(found, _kinds(found))])
    return "\n".join(x.text for x in (found[a:b] if b else found) if not x.edge)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars.  The weights (a number for each tag) are fitted once and go along with the tasks."""
    w = weights()

    def run(batch: pa.RecordBatch) -> dict:
        texts = [extract(t, w) for t in texts_of(batch.column(2))]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

    return map_batches(pick(pages, "page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_extract": query}
