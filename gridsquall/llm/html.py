"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is read into a tree (unclosed, stray and implied end tags are tolerated).  Each
block element has features: its tag and attribute tokens, scored by how they occurred in
training; text, link, tag and punctuation densities of its subtree; depth; its share and
place among its siblings; and the same of its parent.  Trees give the probability that
the element belongs to the article.  Decoding is one pass up the tree and one down: the
most probable labelling in which nothing below a rejected element is kept.

There are no labelled pages, so the model is fitted on pages that this module composes:
layouts with menus, headers, footers, side bars, notices, adverts, forms, related links
and comments around an article, with and without speaking tags and names.

Defined results: a null or empty page, or one without article text, gives an empty text;
repeated rows count each; very long pages are read whole; elements nested deeper than
``MAX_DEPTH`` are read as children of that depth.  Only the named columns are read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from gridsquall.llm import boost
from gridsquall.llm.common import runs

#: Comments, declarations, and tags.  An attribute is a name with or without a value, in quotes or
#: up to white space: a quote inside a value without quotes is a character like any other, and
#: one that is never closed ends at the tag's end.  No part of a tag is read twice.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+)>",
    re.S,
)
#: A slash that belongs to a value without quotes does not close the element.
SLASH_IN_VALUE = re.compile(r"=\s*[^\s\"'>][^\s>]*/\Z")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select head".split())
#: Those that are code, so that without an end tag the rest of the page is theirs; of others only the tag is skipped then.
CODE = frozenset("script style".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
CONTROLS = frozenset("form button input select textarea fieldset".split())
MAX_DEPTH = 200


class Page:
    """Block elements in document order, and pieces of text with the element each is in."""

    def __init__(self, source: str):
        self.tag, self.tokens, self.parent, self.depth, self.tags = ["#"], [()], [-1], [0], [0]
        self.text: list[tuple[int, str, bool]] = []  # element, text, inside a link
        self.controls = [0]
        self.implied = -1  # a body element without a tag
        stack: list[tuple[str, int]] = [("#", 0)]  # open tags with the block element they are in
        links, at, n = 0, 0, len(source)
        unclosed: set[str] = set()

        places: dict[str, list[int]] = {}  # where each open tag lies in the stack
        blocks = [0]  # and where those lie that are not inline

        def close(k: int) -> None:
            nonlocal links
            for t, _ in reversed(stack[k:]):
                places[t].pop()
                links -= t == "a"
            while len(blocks) > 1 and blocks[-1] >= k:
                blocks.pop()
            del stack[k:]

        def last(tags: frozenset | set) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def close_open(tags: frozenset | set, stop: set | frozenset) -> None:
            k = last(tags)
            if k and k > last(stop - tags):
                close(k)

        def body(parent: int) -> int:
            """The body element, added where its tag is left out."""
            if "body" not in self.tag:
                self.implied = len(self.tag)
                for values, x in ((self.tag, "body"), (self.tokens, ()), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.tags, 0), (self.controls, 0)):
                    values.append(x)
            return self.tag.index("body")

        while at < n:
            m = TOKEN.search(source, at) if source.find(">", at) >= 0 or source.find("<!--", at) >= 0 else None
            chunk = source[at : m.start() if m else n]
            if chunk:
                block = stack[-1][1]
                if self.tag[block] in ("#", "html") and chunk.strip():
                    block = body(block)
                self.text.append((block, entities.unescape(chunk), links > 0))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag, block = m[2].lower(), stack[-1][1]
            if m[1]:
                k = last({tag})
                if k and (tag not in INLINE or k > blocks[-1]):
                    close(k)
                continue
            ended = m[3].endswith("/") and not SLASH_IN_VALUE.search(m[3])
            if tag in RAW:
                alone = ended or tag in unclosed
                end = None if alone else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if not alone and not end:
                    unclosed.add(tag)  # not searched again, so that many of them stay linear
                at = end.end() if end else (n if tag in CODE and not alone else at)
                self.controls[block] += tag in CONTROLS
                continue
            if tag in CLOSES_P:
                close_open({"p"}, {"button", "table", "td", "article", "div", "section"})
            if tag in SAME and tag != "p":
                close_open(SAME[tag], SCOPE.get(tag, set()))
            if tag == "br":
                self.text.append((block, " ", links > 0))
            self.tags[block] += 1
            self.controls[block] += tag in CONTROLS
            if tag in VOID or ended:
                continue
            if tag not in INLINE:
                if self.depth[block] < MAX_DEPTH:
                    names = [t for a in ATTRIBUTE.finditer(m[3]) for t in WORD.findall((a[2] or a[3] or a[4] or "").lower())]
                    if HIDDEN.search(m[3]):
                        names.append("hidden")
                    self.tag.append(tag)
                    self.tokens.append(tuple(names))
                    self.parent.append(block)
                    self.depth.append(self.depth[block] + 1)
                    self.tags.append(0)
                    self.controls.append(0)
                    block = len(self.tag) - 1
            links += tag == "a"
            places.setdefault(tag, []).append(len(stack))
            if tag not in INLINE:
                blocks.append(len(stack))
            stack.append((tag, block))

    def blocks(self) -> list[tuple[int, str]]:
        """Runs of text of one element, white space turned into single spaces."""
        out, k = [], 0
        while k < len(self.text):
            j = k
            while j < len(self.text) and self.text[j][0] == self.text[k][0]:
                j += 1
            t = SPACE.sub(" ", "".join(x[1] for x in self.text[k:j])).strip()
            if t:
                out.append((self.text[k][0], t))
            k = j
        return out


def sums_up(parent: list[int], own: np.ndarray) -> np.ndarray:
    """Sums of a value over each subtree (children come after their parent)."""
    total = own.tolist()
    for k in range(len(parent) - 1, 0, -1):
        total[parent[k]] += total[k]
    return np.array(total)


NAMES = 26


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """A row of numbers for each block element."""
    n = len(page.tag)
    parent = np.array(page.parent)
    chars, linked, marks, words, pieces = (np.zeros(n) for _ in range(5))
    for k, t, in_link in page.text:
        size = len(t) - t.count(" ")
        chars[k] += size
        linked[k] += size * in_link
        marks[k] += t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count("。")
        words[k] += t.count(" ")
        pieces[k] += size > 0
    own = chars.copy()
    chars, linked, marks, words, pieces, tags, controls = (sums_up(page.parent, v) for v in (chars, linked, marks, words, pieces, np.array(page.tags, float) + 1, np.array(page.controls, float)))
    paragraphs = sums_up(page.parent, np.array([float(t == "p") for t in page.tag]))
    tag = np.array([odds.get("<" + t, 0.0) for t in page.tag])
    name = np.array([sum(odds.get(t, 0.0) for t in ts) for ts in page.tokens])
    low = np.array([min((odds.get(t, 0.0) for t in ts), default=0.0) for ts in page.tokens])
    path, worst = name + tag, np.minimum(low, tag)
    for k in range(1, n):
        path[k] += path[parent[k]]
        worst[k] = min(worst[k], worst[parent[k]])
    up = np.maximum(parent, 0)
    order = np.zeros(n)
    count = np.zeros(n)
    for k in range(1, n):
        order[k] = count[parent[k]]
        count[parent[k]] += 1
    whole = max(1.0, chars[0])
    before = np.cumsum(own) - own
    density, links = chars / np.maximum(tags, 1), linked / np.maximum(chars, 1)
    depth = np.array(page.depth, float)
    return np.stack(
        [tag, name, low, path, worst, np.log1p(chars), density, links, marks / np.maximum(words, 1), np.log1p(words), controls / np.maximum(tags, 1), depth, chars / np.maximum(chars[up], 1), chars / whole, order, order / np.maximum(count[up], 1), count, count[up], paragraphs, paragraphs / np.maximum(tags, 1), before / whole, own / np.maximum(chars, 1), tag[up], name[up], density[up], links[up]],
        1,
    )


def decode(page: Page, logit: np.ndarray) -> np.ndarray:
    """The most probable choice of kept elements in which every kept one has a kept parent."""
    logit = np.clip(logit, -8, 8)
    yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    keep, drop = yes.tolist(), no.tolist()
    keep[0], drop[0] = 0.0, -1e9  # the page itself
    for k in range(len(keep) - 1, 0, -1):
        p = page.parent[k]
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    kept = np.zeros(len(keep), bool)
    kept[0] = True
    for k in range(1, len(keep)):
        kept[k] = kept[page.parent[k]] and keep[k] >= drop[k]
    return kept


@dataclass
class Extractor:
    odds: dict[str, float]
    trees: boost.Trees

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s or "") for s in sources]
        rows = [features(p, self.odds) for p in pages]
        z = self.trees.logits(np.concatenate(rows)) if rows else np.zeros(0)
        out, at = [], 0
        for p in pages:
            n = len(p.tag)
            kept = decode(p, z[at : at + n])
            bare = n == 1 or not any(t != "html" and t != "body" for t in p.tag[1:])
            out.append(" ".join(t for k, t in p.blocks() if kept[k] or bare and k == p.implied))
            at += n
        return out


class Composer:
    """Makes pages with known article elements, marked by an attribute that is not a feature."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, a: int, b: int) -> str:
        return " ".join("".join(self.r.choice("abcdefghilmnoprstu") for _ in range(self.r.randrange(2, 10))) for _ in range(self.r.randrange(a, b)))

    def sentence(self, most: int = 20) -> str:
        return self.words(2, most).capitalize() + self.r.choice([".", ".", ".", "!", "?", ","])

    def prose(self, a: int = 1, b: int = 8) -> str:
        return " ".join(self.sentence() if self.r.random() < 0.9 else f'<a href="/x">{self.words(1, 4)}</a>' for _ in range(self.r.randrange(a, b)))

    def links(self, a: int, b: int) -> str:
        sep = self.r.choice(["<li>%s</li>", "<li>%s", "%s | ", "<span>%s</span> "])
        inner = "".join(sep % f'<a href="/{self.words(1, 2)}">{self.words(1, 4)}</a>' for _ in range(self.r.randrange(a, b)))
        return f"<ul>{inner}</ul>" if "li" in sep else inner

    def box(self, tags: list[str], names: list[str], inner: str, good: bool = False) -> str:
        r = self.r
        tag = r.choice(tags)
        name = r.choice(names) if r.random() < (0.75 if tag == "div" else 0.4) else ""
        if name and r.random() < 0.3:
            name += r.choice(["-", "_", " "]) + r.choice(["wrap", "inner", "box", "area", "top", "main", "block"])
        attr = f' {r.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attr}{' data-good' if good else ''}>{inner}</{tag}>"

    def article(self) -> str:
        r = self.r
        parts = [f"<h1>{self.words(2, 9)}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.25:
            parts.append(f'<p class="{r.choice(["byline", "lead", "intro", "summary"])}">{self.sentence()}</p>')
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            p = r.choice(["<p>", "<p>", '<p class="text">']) + r.choice(["", "", "", "<b>", "<em>"]) + self.prose(1, r.choice([2, 4, 9]))
            parts.append(r.choice([p + "</p>", p + "</p>", p + "</p>", p, p + "<br>"]))
            if r.random() < 0.2:
                parts.append(r.choice([f"<h2>{self.words(1, 6)}</h2>", f"<ul><li>{self.sentence()}</li><li>{self.sentence()}</ul>", f"<blockquote>{self.prose()}</blockquote>", f"<pre>{self.words(5, 30)}</pre>", f"<table><tr><td>{self.words(1, 3)}<td>{self.words(1, 3)}</tr></table>", f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"]))
            if r.random() < 0.12:
                parts.append(self.box(["div", "aside"], ["ad", "advert", "promo", "share", "related", "newsletter"], r.choice([self.sentence(8), self.links(2, 5)])))
        inner = "".join(parts)
        if r.random() < 0.3:
            inner = f"<div{r.choice(['', ' class=body', ' class=text'])}>{inner}</div>"
        return self.box(["article", "article", "main", "div", "section"], ["content", "article", "post", "entry", "story", "main", "text", "page"], inner, good=True)

    def clutter(self) -> str:
        r = self.r
        kind = r.randrange(9)
        if kind == 0:
            return self.box(["nav", "nav", "div", "ul"], ["nav", "menu", "navbar", "navigation", "breadcrumb", "topbar"], self.links(2, 12))
        if kind == 1:
            return self.box(["div", "div", "aside", "section"], ["ad", "ads", "advert", "banner", "sponsor", "promo"], r.choice([self.sentence(), self.prose(1, 4), self.links(1, 3)]))
        if kind == 2:
            return self.box(["aside", "aside", "div"], ["sidebar", "side", "widget", "related", "recommended", "popular"], f"<h3>{self.words(1, 4)}</h3>" * r.randrange(2) + r.choice([self.links(2, 9), f"<p>{self.prose(1, 3)}</p>"]))
        if kind == 3:
            return self.box(["div", "div", "section"], ["cookie", "notice", "consent", "popup", "modal", "alert", "gdpr"], f"<p>{self.prose(1, 3)}</p><button>{self.words(1, 2)}</button>" if r.random() < 0.7 else self.prose(1, 3))
        if kind == 4:
            return self.box(["form", "form", "div"], ["form", "search", "login", "subscribe", "newsletter", "signup"], f"<label>{self.words(1, 3)}</label><input type=text><button>{self.words(1, 2)}</button>{self.sentence(8) if r.random() < 0.4 else ''}")
        if kind == 5:
            one = lambda: self.box(["div", "li", "article"], ["comment", "reply", "comment"], f"<b>{self.words(1, 3)}</b><p>{self.prose(1, 4)}</p>")
            return self.box(["section", "div", "div", "ol"], ["comments", "comment", "discussion", "replies", "respond"], f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(r.randrange(1, 5))))
        if kind == 6:
            return self.box(["div", "div"], ["share", "social", "tags", "meta", "toolbar"], self.links(2, 6))
        if kind == 7:
            return self.box(["header", "header", "div"], ["header", "masthead", "top", "logo"], r.choice([f"<h2>{self.words(1, 4)}</h2>", self.words(1, 5)]) + (self.links(2, 8) if r.random() < 0.5 else ""))
        return self.box(["footer", "footer", "div"], ["footer", "foot", "copyright", "legal", "bottom"], r.choice([f"&copy; {self.sentence()}", f"<p>{self.prose(1, 4)}</p>", self.links(2, 9), f"&copy; {self.prose(1, 4)}"]))

    def page(self) -> str:
        r = self.r
        before = "".join(self.clutter() for _ in range(r.randrange(0, 5)))
        after = "".join(self.clutter() for _ in range(r.randrange(0, 5)))
        body = before + self.article() + after
        if r.random() < 0.4:
            body = self.box(["div"], ["wrapper", "container", "page", "site", "layout"], body)
        if r.random() < 0.1:
            body = f"<table><tr><td>{self.links(2, 6)}</td><td data-good>{self.article()}</td></tr></table>"
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{body}</body></html>"


def truth(source: str, page: Page) -> np.ndarray:
    """Whether each block element of a composed page holds the article or is part of it."""
    opened = [m for m in TOKEN.finditer(source) if m[2] and not m[1]]
    marked = [("data-good" in m[3], m[2].lower()) for m in opened if m[2].lower() not in INLINE | VOID | RAW]
    if len(marked) != len(page.tag) - 1:
        raise ValueError("elements differ")
    n = len(page.tag)
    good = np.zeros(n, bool)
    bad_names = {"ad", "advert", "promo", "share", "related", "newsletter"}
    for k in range(1, n):
        p = page.parent[k]
        inner_bad = good[p] and page.tag[k] in ("div", "aside") and (page.tag[k] == "aside" or bool(bad_names & set(page.tokens[k])))
        good[k] = marked[k - 1][0] or (good[p] and not inner_bad)
    holds = good.copy()
    for k in range(n - 1, 0, -1):
        holds[page.parent[k]] |= holds[k]
    return holds


def train_extractor(pages: int = 400, seed: int = 3) -> Extractor:
    """Fits the tag and name scores and the trees on composed pages."""
    made = Composer(seed)
    sources = [made.page() for _ in range(pages)]
    read = [Page(s) for s in sources]
    labels = [truth(s, p) for s, p in zip(sources, read, strict=True)]
    seen: dict[str, list[int]] = {}
    for p, y in zip(read, labels, strict=True):
        for k in range(1, len(p.tag)):
            for t in {"<" + p.tag[k], *p.tokens[k]}:
                seen.setdefault(t, [0, 0])[int(y[k])] += 1
    odds = {t: float(np.log((b + 2) / (a + 2))) for t, (a, b) in seen.items()}
    for tag in ("nav", "footer", "aside", "form", "header"):
        odds.setdefault("<" + tag, -3.0)
    odds["hidden"] = -4.0
    x = np.concatenate([features(p, odds)[1:] for p in read])
    y = np.concatenate([y[1:] for y in labels]).astype(float)
    return Extractor(odds, boost.train(x, y))


def extract_text(pages: DataFrame, extractor: Extractor, *, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The kept columns and ``text`` of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(extractor)
    rows = pages.select(*keep, html_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != html_col) + ", text string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, len(keep)):
            texts = sent.value.texts(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(work, schema)
