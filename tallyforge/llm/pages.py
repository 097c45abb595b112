"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Method. A page is parsed tolerantly into block nodes and runs of text. Each node gets features: its tag, tokens of its
class, id and role, depth, place among its siblings, amounts and shares of text, links and punctuation in its subtree.
Boosted trees, fitted here on generated pages whose labels are known by construction (``FIT_PAGES`` of them, a fixed
seed), give each node the odds of being content. Decoding then takes the most likely labelling in which nothing below a
dropped node is kept, by one pass up the tree. Kept runs give the text: character references decoded, white space
inside a block made one space, blocks in page order, one line each.

Rows are independent: no shuffle. Nothing is cut or capped.

A form that holds most of a page's text and parts of a page or long paragraphs (as server frameworks write around the whole
body) is page structure: it counts as a plain container and its children are decoded. Every other form is dropped like
the rest of the boilerplate. The headers that go are those of the page: a header inside the article that holds its title is
part of the article, and what else stands there (authors, dates, links) is decoded by itself.

Defined cases. Null and empty html, and pages without content: empty text. Pages cut off in the middle: what is there;
an unfinished tag at the end is dropped. A script or style without an end tag runs to the end of the page, as in a
browser; of every other element without an end tag the tag alone is dropped, never what follows it. Null ids and urls pass
through. Repeated rows: alike. Very long pages are parsed whole. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FIT_PAGES = 500
TREES, DEPTH, BINS, RATE = 50, 4, 24, 0.3
#: Log odds by which a node must be against keeping before it is dropped from kept surroundings.
MARGIN = 1.0

#: Elements by role in parsing.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source svg path".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are left out with all that they hold; of these, the ones whose text goes on to the end of the page if
#: they are not closed; tags that are nothing by themselves (their end tags may be left out).
RAW = set("script style textarea title noscript template iframe svg select datalist math object xmp noembed noframes".split())
CODE = {"script", "style"}
FRAME = {"html", "head", "body"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: A start tag of these ends an open paragraph.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
FENCE = set("div article section main aside nav header footer body td th ul ol dl table form blockquote figure".split())
TAGS = ["p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "dl", "#run", "button", "fieldset", "details", "dialog"]
BAD = "nav menu footer header sidebar side ad ads advert advertisement banner promo sponsor sponsored cookie consent notice popup modal comment comments respond reply disqus share social related recommend newsletter subscribe signup login form search breadcrumb breadcrumbs pagination pager widget toolbar tags meta copyright legal alert gdpr overlay author bio".split()
#: Parts of a page, which no form to be filled in holds, and the words of a paragraph that such a form does not hold either.
PARTS = set("article main nav header footer section aside".split())
LONG = 20
GOOD = "article content main post body entry story text page hentry blog prose".split()

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_END = {t: re.compile(rf"</{t}(?:\s[^>]*)?>", re.I) for t in RAW}
_WORDS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "text", "link", "depth", "hidden")

    def __init__(self, tag, parent, tokens=frozenset(), hidden=False):
        self.tag, self.parent, self.children, self.tokens = tag, parent, [], tokens
        self.text, self.link, self.hidden = "", 0, hidden
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


def _attributes(source: str) -> tuple[frozenset, bool]:
    tokens: set[str] = set()
    hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", source))
    for m in _ATTRIBUTE.finditer(source):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() in ("class", "id", "role", "itemprop", "aria-label"):
            tokens.update(_WORDS.findall(value))
        elif m[1].lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return frozenset(tokens), hidden


def parse(source: str) -> Node:
    """The tree of block nodes; runs of text are leaves '#run'."""
    root = Node("#root", None)
    here, run, linked, links, at = root, [], 0, 0, 0
    open_ended: set[str] = set()

    def flush():
        nonlocal run, linked
        text = " ".join(_html.unescape("".join(run)).split())
        if text:
            leaf = Node("#run", here)
            leaf.text, leaf.link = text, linked
        run, linked = [], 0

    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at:
            piece = source[at : m.start()]
            run.append(piece)
            linked += len(piece) if links else 0
        at = m.end()
        if not m[2]:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if not m[4]:  # cut off inside a tag
            break
        if tag in RAW and not end:
            if m[3].rstrip().endswith("/"):
                continue
            stop = None if tag in open_ended else _END[tag].search(source, at)
            if stop:
                at = stop.end()
            elif tag in CODE:
                at = len(source)
            else:
                open_ended.add(tag)
            continue
        if tag == "option" and not end:  # outside a list of choices; its end tag may be left out
            following = source.find("<", at)
            at = following if following >= 0 else len(source)
            continue
        if tag in RAW or tag in FRAME or tag == "option":
            flush()
            continue
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                links = 0 if end else 1
            continue
        if tag in VOID:
            flush()
            continue
        flush()
        if end:
            x = here
            while x.parent and x.tag != tag:
                if tag == "p" and x.tag in FENCE or x.tag in ("td", "th") and tag not in ("tr", "table", "tbody", "body", "html"):
                    x = None
                    break
                x = x.parent
            if x is not None and x.parent:
                here = x.parent
            continue
        links = 0
        closes = CLOSES.get(tag, set())
        if closes or tag in ENDS_P:
            x = here
            while x.parent and x.tag not in FENCE - closes:
                if x.tag in closes or x.tag == "p" and tag in ENDS_P:
                    here = x.parent
                    if x.tag == "p":
                        break
                x = x.parent
        tokens, hidden = _attributes(m[3]) if m[3].strip() else (frozenset(), False)
        here = Node(tag, here, tokens, hidden)
    else:
        if at < len(source):
            run.append(source[at:])
    flush()
    return root


def _structural(nodes: list[Node], parents: list[int], chars: list[int]) -> list[int]:
    """The forms that hold over half of the page's text and parts of a page or long paragraphs."""
    forms = {k for k, n in enumerate(nodes) if n.tag == "form" and 2 * chars[k] > chars[0]}
    found = set()
    if forms:
        for k, n in enumerate(nodes):
            if n.tag in PARTS or n.text.count(" ") + 1 >= LONG and nodes[parents[k]].tag == "p":
                p = parents[k]
                while p >= 0 and p not in found:
                    if p in forms:
                        found.add(p)
                    p = parents[p]
    return sorted(found)


_TAG = {t: i for i, t in enumerate(TAGS)}
WIDTH = len(TAGS) + 23


def measure(root: Node) -> tuple[list[Node], list[int], np.ndarray]:
    """Nodes in page order (the root first), parents by number, and their features."""
    nodes, parents, stack = [], [], [(root, -1)]
    while stack:
        n, p = stack.pop()
        k = len(nodes)
        nodes.append(n)
        parents.append(p)
        stack.extend((c, k) for c in reversed(n.children))
    size = len(nodes)
    # chars, linked chars, tags, runs, punctuation, words, paragraphs of each subtree
    sums = [[len(n.text), min(n.link, len(n.text)), 1, n.tag == "#run", len(_PUNCTUATION.findall(n.text)) if n.text else 0, n.text.count(" ") + 1 if n.text else 0, n.tag == "p"] for n in nodes]
    for k in range(size - 1, 0, -1):
        s, t = sums[k], sums[parents[k]]
        for i in range(7):
            t[i] += s[i]
    total = max(1, sums[0][0])
    for k in _structural(nodes, parents, [s[0] for s in sums]):
        nodes[k].tag, nodes[k].tokens = "div", frozenset()
    x = np.zeros((size, WIDTH), np.float32)
    own_bad, own_good, above_bad, above_good, inside, before = [0] * size, [0] * size, [0] * size, [0] * size, [False] * size, 0
    place: dict[int, int] = {}
    for k, n in enumerate(nodes):
        p = parents[k]
        own_bad[k] = sum(t in _BAD for t in n.tokens)
        own_good[k] = sum(t in _GOOD for t in n.tokens)
        if p >= 0:
            apart = nodes[p].tag in ("nav", "footer", "aside", "form", "button", "dialog") or nodes[p].tag == "header" and not inside[p]
            above_bad[k] = above_bad[p] + own_bad[p] + apart
            inside[k] = inside[p] or nodes[p].tag in ("article", "main")
            above_good[k] = above_good[p] + own_good[p] + (nodes[p].tag in ("article", "main"))
        chars, linked, tags, runs, marks, words, paragraphs = sums[k]
        siblings = len(nodes[p].children) if p >= 0 else 1
        at = place.get(p, 0)
        place[p] = at + 1
        t = _TAG.get(n.tag)
        if t is not None:
            x[k, t] = 1
        x[k, len(TAGS) :] = (
            n.depth, chars, linked / max(1, chars), chars / tags, chars / max(1, runs), marks / max(1, words), words, paragraphs, chars / total, before / total,
            at, siblings, at / siblings, own_bad[k], own_good[k], above_bad[k], above_good[k], inside[k], n.hidden, sums[p][0] / total if p >= 0 else 1, sums[p][1] / max(1, sums[p][0]) if p >= 0 else 0,
            _TAG.get(nodes[p].tag, len(TAGS)) if p >= 0 else -1, chars / max(1, sums[p][0]) if p >= 0 else 1,
        )
        before += len(n.text)
    return nodes, parents, x


_BAD, _GOOD = frozenset(BAD), frozenset(GOOD)


class Boosted:
    """Gradient-boosted trees for a binary label, on binned features, grown level by level."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE):
        self.depth = depth
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        n, width = b.shape
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(n, self.base)
        self.trees = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            cell = np.zeros(n, np.int64)
            splits = []
            for level in range(depth):
                count = 1 << level
                best = np.full(count, 1e-6)
                choice = np.zeros((count, 2), np.int64)
                choice[:, 1] = bins
                for j in range(width):
                    if not len(self.edges[j]):
                        continue
                    key = cell * bins + b[:, j]
                    gs = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(axis=1)
                    hs = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(count), k]
                    better = top > best
                    best[better] = top[better]
                    choice[better, 0], choice[better, 1] = j, k[better]
                splits.append(choice)
                cell = 2 * cell + (b[np.arange(n), choice[cell, 0]] > choice[cell, 1])
            leaves = 1 << depth
            value = rate * np.bincount(cell, g, leaves) / (np.bincount(cell, h, leaves) + 1)
            f += value[cell]
            self.trees.append((splits, value))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") if len(e) else np.zeros(len(x), np.int64) for j, e in enumerate(self.edges)])

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the label."""
        b = self._bin(x)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for splits, value in self.trees:
            cell = np.zeros(len(x), np.int64)
            for choice in splits:
                cell = 2 * cell + (b[rows, choice[cell, 0]] > choice[cell, 1])
            f += value[cell]
        return f


def decode(parents: list[int], odds: np.ndarray) -> np.ndarray:
    """The most likely labels in which a kept node's ancestors are kept: what a subtree gains if kept, from the leaves up."""
    gain = odds.astype(float) + MARGIN
    gain[0] = 0.0
    for k in range(len(parents) - 1, 0, -1):
        if gain[k] > 0:
            gain[parents[k]] += gain[k]
    keep = np.zeros(len(parents), bool)
    keep[0] = True
    for k in range(1, len(parents)):
        keep[k] = keep[parents[k]] and gain[k] > 0
    return keep


def generate(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the texts of its content blocks."""
    marks = iter(range(10**6))
    syllables = rng.choice(["an er in on the ing ly ed".split(), "que re la ou pa ment es".split(), "der ie ung ver ein ch ä".split(), "ción os la ra do ñ mente".split()])

    def words(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "", "", ".", ","]) for _ in range(n))

    def label(n):
        return f"{words(n)} {next(marks)}"

    content: list[str] = []

    def block(tag, n, inside=""):
        text = label(n)
        content.append(text)
        open_ = rng.choice(["", "", "", "<b>", "<em>", "<a href='/x'>"]) if tag == "p" else ""
        close = "" if tag in ("p", "li") and rng.random() < 0.15 and not open_ else f"</{tag}>"
        return f"<{tag}{inside}>{open_}{text}{'<br>' if rng.random() < 0.2 and tag == 'p' else ''}{open_.replace('<', '</').split(' ')[0].rstrip('>') + '>' if open_ and rng.random() < 0.8 else ''}{close}"

    def links(n, wrap="li"):
        inner = "".join(f"<{wrap}><a href='/{i}'>{label(rng.randrange(1, 3))}</a></{wrap}>" for i in range(n))
        return f"<ul>{inner}</ul>" if wrap == "li" else inner

    def attribute(*names):
        return f' {rng.choice(["class", "id", "class"])}="{rng.choice(names)}"' if rng.random() < 0.85 else ""

    def boiler():
        kind = rng.randrange(12)
        if kind == 0:
            return f"<nav{attribute('menu', 'main-nav')}>{links(rng.randrange(3, 12))}</nav>"
        if kind == 1:
            return f"<div{attribute('ad', 'ads', 'advert-box', 'banner', 'sponsored')}>{label(rng.randrange(3, 25))}</div>"
        if kind == 2:
            return f"<aside{attribute('sidebar', 'related')}><h3>{label(2)}</h3>{links(rng.randrange(2, 8))}<p>{label(rng.randrange(3, 30))}</p></aside>"
        if kind == 3:
            return f'<div class="{rng.choice(["cookie-notice", "notice", "alert", "consent-banner", "gdpr"])}"><p>{label(rng.randrange(8, 40))}</p><button>{label(1)}</button></div>'
        if kind == 4:
            return f"<form{attribute('search', 'newsletter', 'login')}><label>{label(2)}</label><input name=q><button>{label(1)}</button><p>{label(rng.randrange(3, 15))}</p></form>"
        if kind in (5, 6):
            tag = rng.choice(["section", "div", "ol", "ul"])
            item = "li" if tag in ("ol", "ul") else rng.choice(["div", "article"])
            body = "".join(f"<{item}{attribute('comment', 'reply')}><h4>{label(2)}</h4><p>{label(rng.randrange(5, 60))}</p></{item}>" for _ in range(rng.randrange(1, 8)))
            return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "respond", "disqus"])}">{body}</{tag}>'
        if kind == 7:
            return f"<div{attribute('share', 'social', 'related', 'breadcrumbs', 'pagination', 'tags')}>{links(rng.randrange(2, 7), rng.choice(['li', 'span']))}</div>"
        if kind == 8:
            name = rng.choice(["div", "div", "h1"])
            return f"<header{attribute('site-header', 'header')}><{name}>{label(2)}</{name}>{links(rng.randrange(2, 8))}</header>"
        if kind == 9:
            return f"<footer{attribute('footer', 'site-footer')}><p>&copy; {label(rng.randrange(2, 14))}</p>{links(rng.randrange(0, 5)) if rng.random() < 0.5 else ''}</footer>"
        if kind == 10:
            return f'<div class="{rng.choice(["sidebar", "widget", "promo"])}"><h3>{label(2)}</h3><p>{label(rng.randrange(4, 40))}</p></div>'
        return f'<div class="{rng.choice(["modal", "popup", "newsletter", "subscribe"])}"><h2>{label(3)}</h2><p>{label(rng.randrange(4, 30))}</p></div>'

    def article():
        out = [block(rng.choice(["h1", "h1", "h2"]), rng.randrange(2, 14))] if rng.random() < 0.85 else []
        if out and rng.random() < 0.35:
            line = f'<{rng.choice(["p", "div"])} class="{rng.choice(["meta", "author", "byline author"])}">{label(rng.randrange(2, 6))}' if rng.random() < 0.5 else ""
            out = [f"<header{rng.choice(['', attribute('entry-header', 'post-header', 'article-header')])}>{out[0]}{line}{'</' + line[1 : line.index(' ')] + '>' if line else ''}</header>"]
        for _ in range(rng.choice([1, 2, 4, 8, 16])):
            kind = rng.random()
            if kind < 0.7:
                out.append(block("p", rng.choice([1, 3, 10, 30, 60, 120])))
            elif kind < 0.76:
                out.append(block(rng.choice(["h2", "h3"]), rng.randrange(1, 8)))
            elif kind < 0.84:
                tag = rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(block("li", rng.randrange(1, 25)) for _ in range(rng.randrange(2, 6))) + f"</{tag}>")
            elif kind < 0.88:
                out.append("<blockquote>" + block("p", rng.randrange(5, 50)) + "</blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join("<tr>" + block("td", 2) + block("td", 3) + "</tr>" for _ in range(rng.randrange(1, 5))) + "</table>")
            elif kind < 0.94:
                out.append("<figure><img src=x>" + block("figcaption", rng.randrange(3, 12)) + "</figure>")
            else:
                out.append(boiler())
        return "".join(out)

    before = "".join(boiler() for _ in range(rng.randrange(0, 5)))
    tag, name = rng.choice([("article", ""), ("article", ""), ("article", attribute("post", "entry")), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="post-body"'), ("section", ' class="article-text"'), ("div", ' class="entry-content"')])
    main = f"<{tag}{name}>{article()}</{tag}>"
    if rng.random() < 0.4:
        main = f"<div{attribute('page', 'wrapper', 'container')}>{main}{''.join(boiler() for _ in range(rng.randrange(0, 3)))}</div>"
    after = "".join(boiler() for _ in range(rng.randrange(0, 5)))
    body = before + main + after
    if rng.random() < 0.12:
        body = f'<form method="post" action="/x" id="{rng.choice(["form1", "aspnetForm", "mainform"])}"><div><input type="hidden" name="state"></div>{body}</form>'
    page = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"
    return (page[: rng.randrange(len(page) // 2, len(page))] if rng.random() < 0.1 else page), content


@lru_cache(maxsize=1)
def model() -> Boosted:
    """The trees, fitted on generated pages: a node is content if all the text below it is."""
    rng = random.Random(20)
    xs, ys = [], []
    for _ in range(FIT_PAGES):
        page, content = generate(rng)
        nodes, parents, x = measure(parse(page))
        wanted = set(content)
        good, runs = [0] * len(nodes), [0] * len(nodes)
        for k in range(len(nodes) - 1, -1, -1):
            if nodes[k].tag == "#run":
                runs[k], good[k] = 1, int(nodes[k].text in wanted)
            if k:
                runs[parents[k]] += runs[k]
                good[parents[k]] += good[k]
        rows = [k for k in range(1, len(nodes)) if runs[k]]
        xs.append(x[rows])
        ys += [float(good[k] > 0 if nodes[k].tag != "#run" else good[k]) for k in rows]
    return Boosted(np.concatenate(xs), np.array(ys))


def texts(sources: list[str | None], boosted: Boosted) -> list[str]:
    """The main text of each page."""
    parsed = [measure(parse(s or "")) for s in sources]
    odds = boosted.odds(np.concatenate([x for _, _, x in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for nodes, parents, x in parsed:
        keep = decode(parents, odds[at : at + len(x)])
        at += len(x)
        out.append("\n".join(n.text for n, k in zip(nodes, keep.tolist(), strict=True) if k and n.text))
    return out


def _extracting(boosted: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = texts(part.column(2).to_pylist(), boosted)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``."""
    return pages.select("page_id", "url", "html").mapInArrow(_extracting(model()), "page_id long, url string, text string, n_chars long")
