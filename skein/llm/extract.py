"""HTML main text by minimum cut.

A page's text blocks are the nodes. A classifier gives each block the log-odds that it is content, which becomes a capacity from the
source (content) or to the sink (boilerplate); neighbours in page order and blocks under the same element are joined by
smoothness edges. The maximum flow separates content from boilerplate: a block stays if the source still reaches it. So a one-word
paragraph between long ones stays though it looks like a menu entry, and a long line among menu entries goes.

The classifier is a logistic regression over length, links, punctuation, depth, tags and name parts of a block, and the edges' strengths are
those that label best; both are fitted here, on the driver, on ``PAGES`` marked pages that ``marked_pages`` lays out from a seed. No word
list decides alone: two lists (elements and name parts that tend to hold boilerplate) are features among others.

Defined cases: a null or empty page has empty text; markup may be broken anywhere (open tags, stray marks, quotes); comments,
scripts, styles and other raw elements hold no text, drawings neither; formulas and what stands in for an object or media are text; repeated rows are extracted each; an empty table gives an empty result;
further columns pass through.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?![a-zA-Z])[^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z))""",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")

RAW = frozenset("script style noscript template textarea title iframe select svg noframes noembed xmp".split())
#: Of these, what has other elements inside: without an end tag only the tag itself is skipped, not the rest of the page.
NESTING = frozenset("noscript template select svg".split())
MATH = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts "
    "mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = MATH | frozenset(
    "audio canvas object param source track video a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements and name parts of what isn't the article.
BAD_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
BAD_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer "
    "comment comments disqus reply replies respond share sharing social cookie cookies consent notice alert newsletter subscribe signup login search related recommended popup "
    "modal widget pagination pager copyright toolbar masthead complementary contentinfo gdpr".split()
)
PAGES = 160  # marked pages that the classifier and the edges are fitted on
UNIT = 64  # capacity of a log-odds of 1
CERTAIN = 16.0  # log-odds beyond this count as this
#: Strengths that are tried for edges to the next block, to the next under the same element, and to the next under the element above that.
NEXT_EDGES, PARENT_EDGES, GRAND_EDGES = (0.25, 0.5, 1.0, 2.0), (1.0,), (0.5, 1.0, 2.0, 4.0)

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Block:
    __slots__ = ("text", "parent", "grand", "bad_tag", "bad_name", "inside", "links", "tag", "depth", "inline")

    def __init__(self, *values):
        for name, value in zip(self.__slots__, values, strict=True):
            setattr(self, name, value)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    # of open elements: tag, number, among bad elements, among bad names, inside an article
    stack = [("", 0, False, False, False)]
    held: list[tuple[str, bool]] = []
    at, made, links = 0, 1, 0

    def flush():
        if not held:
            return
        text = " ".join(_html.unescape("".join([t for t, _ in held])).split())
        if text:
            linked = sum(len(t.strip()) for t, is_link in held if is_link)
            own = [e for e in stack if e[0] not in INLINE]
            tag, number, bad_tag, bad_name, inside = own[-1]
            grand = own[-2][1] if len(own) > 1 else -1
            out.append(Block(text, number, grand, bad_tag, bad_name, inside, min(1.0, linked / len(text)), tag, len(own) - 1, len(held) - 1))
        held.clear()

    for_pos = _TAG.search
    while True:
        m = for_pos(page, at)
        if not m:
            if at < len(page):
                held.append((page[at:], links > 0))
            break
        if m.start() > at:
            held.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    links -= sum(e[0] == "a" for e in stack[i:])
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break  # an inline end doesn't close a block
            continue
        if (tag == "svg" or tag in MATH) and m[3].endswith("/"):
            continue  # only these may close themselves
        if tag in RAW:
            if tag not in INLINE and tag in ("title", "noscript"):
                flush()
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else at if tag in NESTING else len(page)
            continue
        if tag in INLINE:
            if tag == "br":
                held.append((" ", False))
            if tag not in VOID:
                _, number, bad_tag, bad_name, inside = stack[-1]
                stack.append((tag, number, bad_tag, bad_name or _named_bad(m[3]), inside))
                links += tag == "a"
            continue
        flush()
        if tag in VOID:
            continue
        # a new block ends an open paragraph, and an item its sibling
        closing = ("p",) if tag not in ("li", "dd", "dt", "tr", "td", "th", "option") else (tag, "p")
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in closing:
                links -= sum(e[0] == "a" for e in stack[i:])
                del stack[i:]
                break
            if stack[i][0] not in INLINE and stack[i][0] not in ("p",):
                break
        _, _, bad_tag, bad_name, inside = stack[-1]
        inside_now = inside or tag in ("article", "main")
        bad_tag = bad_tag or tag in BAD_TAGS or (tag == "header" and not inside_now)
        bad_name = bad_name or (tag not in ("body", "html", "article", "main") and _named_bad(m[3]))
        stack.append((tag, made, bad_tag, bad_name, inside_now))
        made += 1
    flush()
    return out


def _named_bad(attributes: str) -> bool:
    if not attributes or len(attributes) < 4:
        return False
    for m in _NAMES.finditer(attributes):
        if not BAD_NAMES.isdisjoint(_PARTS.findall((m[1] or m[2] or m[3] or "").lower())):
            return True
    return False


def features(found: list[Block]) -> np.ndarray:
    """A row for each block of a page."""
    articles = any(b.inside for b in found)
    rows = []
    for b in found:
        n = b.text.count(" ") + 1
        marks = sum(map(b.text.count, ",.;:!?"))
        rows.append(
            (
                1.0, math.log1p(n), min(n, 30) / 30, b.links, float(b.links > 0.5), min(1.0, marks / n), float(b.text[-1] in ".!?\"'»”"), float(b.bad_tag), float(b.bad_name), float(b.inside),
                float(articles and not b.inside), float(b.tag in _HEADINGS), float(b.tag == "p"), float(b.tag in ("li", "td", "dd", "dt")), min(b.depth, 20) / 10, min(1.0, b.inline / n),
            )
        )
    return np.array(rows)


class Model:
    """Weights of the classifier and strengths of the three sorts of edges."""

    def __init__(self, weights: np.ndarray, strengths: tuple[float, float, float]):
        self.weights, self.strengths = weights, strengths

    def log_odds(self, found: list[Block]) -> list[float]:
        return np.clip(features(found) @ self.weights, -CERTAIN, CERTAIN).tolist()

    def labels(self, found: list[Block]) -> list[bool]:
        """Which blocks are content."""
        terminals = [(max(0, round(UNIT * x)), max(0, -round(UNIT * x))) for x in self.log_odds(found)]
        return minimum_cut(terminals, edges(found, self.strengths))


def edges(found: list[Block], strengths: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """(block, block, capacity): neighbours in the page, and neighbours under one element and under the one above it. Only blocks that markup
    says the same of are joined: an advert in an article pulls nobody out of it."""
    follows, parent, grand = (round(UNIT * x) for x in strengths)
    out, parents, grands = [], {}, {}
    said = [(b.inside, b.bad_tag, b.bad_name) for b in found]
    for i, b in enumerate(found):
        if i and said[i - 1] == said[i]:
            out.append((i - 1, i, follows))
        for last, key, strength in ((parents, (b.parent, said[i]), parent), (grands, (b.grand, said[i]), grand)):
            if key in last:
                out.append((last[key], i, strength))
            last[key] = i
    return out


def minimum_cut(terminals: list[tuple[int, int]], links: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut. terminals: (from source, to sink); links: (u, v, capacity both ways).

    Blocking flows: nodes are layered by their distance from what the source still feeds, and paths go from layer to layer until none is left.
    """
    n = len(terminals)
    into = [max(0, s - t) for s, t in terminals]  # what both terminals share flows straight through
    outof = [max(0, t - s) for s, t in terminals]
    room: list[int] = []  # of arc 2k from u to v, and of arc 2k + 1 back
    head: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n)]
    for u, v, c in links:
        arcs[u].append(len(room))
        arcs[v].append(len(room) + 1)
        room += (c, c)
        head += (v, u)
    while True:
        layer = [-1] * n
        here = [u for u in range(n) if into[u]]
        for u in here:
            layer[u] = 0
        depth, reached = 0, False
        while here and not reached:
            depth, after = depth + 1, []
            for u in here:
                reached = reached or outof[u] > 0
                for e in arcs[u]:
                    v = head[e]
                    if room[e] and layer[v] < 0:
                        layer[v] = depth
                        after.append(v)
            here = after
        if not reached:
            return [x >= 0 for x in layer]
        at = [0] * n
        for start in range(n):
            while into[start] and layer[start] == 0:
                path, u = [], start
                while not outof[u]:
                    while at[u] < len(arcs[u]):
                        e = arcs[u][at[u]]
                        if room[e] and layer[head[e]] == layer[u] + 1:
                            break
                        at[u] += 1
                    else:  # a dead end: back one step
                        layer[u] = n + 1
                        if not path:
                            break
                        u = head[path.pop() ^ 1]
                        continue
                    path.append(e)
                    u = head[e]
                if not outof[u]:
                    break
                flow = min([into[start], outof[u], *[room[e] for e in path]])
                into[start] -= flow
                outof[u] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def marked_pages(n: int, seed: int = 0) -> list[tuple[str, list[str]]]:
    """(html, the article's blocks) of n invented pages in several layouts: with elements that say what they are, with names that do, and
    with neither; short and long paragraphs, lists and quotations, menus, adverts, forms, notices, reader comments."""
    r = random.Random(seed)
    parts = ["".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiouäéíó") for _ in range(r.randint(1, 4))) for _ in range(600)]
    words = lambda a, b: " ".join(r.choice(parts) for _ in range(r.randint(a, b)))
    line = lambda a, b: words(a, b).capitalize() + r.choice(["", ".", ".", ".", "!"])
    prose = lambda: " ".join(line(4, 14) for _ in range(r.randint(1, 7)))
    link = lambda t: f'<a href="/{t}">{t}</a>'

    def menu(tag: str) -> str:
        items = [link(words(1, 3)) for _ in range(r.randint(3, 8))]
        return "".join(f"<{tag}>{x}</{tag}>" for x in items) if tag != "li" else "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"

    out = []
    for _ in range(n):
        kind, kept = r.choice("elements names plain".split()), []

        def block(tag: str, text: str, kept=kept) -> str:
            kept.append(" ".join(text.split()))
            first, _, rest = text.partition(" ")
            inner = r.choice([text, text, text, f"<b>{first}</b> {rest}", f"{link(first)} {rest}", link(text) if len(text) < 30 else text])
            return f"<{tag}>{inner}</{tag}>"

        body = [block("h1", words(2, 9))]
        for _ in range(r.randint(1, 9)):
            body.append(block("p", r.choice([prose, prose, prose, lambda: line(1, 5)])()))
            if r.random() < 0.2:
                body.append(block("h2", words(1, 5)))
            if r.random() < 0.12:
                body.append("<ul>" + "".join(block("li", line(1, 9)) for _ in range(r.randint(2, 5))) + "</ul>")
            if r.random() < 0.1:
                body.append("<blockquote>" + block("p", prose()) + "</blockquote>")
        named = lambda name, inner: f'<div class="{name}">{inner}</div>'
        ad, notice, comments = prose(), line(4, 16), "".join(f"<p>{prose()}</p>" for _ in range(r.randint(1, 4)))
        form = f"<label>{words(1, 3)}</label><button>{words(1, 2)}</button>"
        if kind == "elements":
            inside = f'<section class="{r.choice(["comments", "reader-comments", "comment-list", "replies"])}"><h3>{words(1, 2)}</h3>{comments}</section>' if r.random() < 0.4 else ""
            around = [f"<nav>{menu('li')}</nav>", f"<header>{r.choice([words(1, 4), prose()])}</header>"]
            around += [named(r.choice(["ad", "advert", "sponsor-box", "cookie-notice", "newsletter", "share"]), r.choice([ad, notice]))] * r.randint(0, 1)
            around += [r.choice([f"<p>{prose()}</p>", f"<div><p>{prose()}</p><p>{line(1, 6)}</p></div>", f"<div>{menu('div')}</div>", f"<div>{line(1, 8)}</div>"])] * r.randint(0, 1)
            after = [r.choice([f"<p>{prose()}</p>", f"<p>{line(1, 6)}</p>", f"<div><h3>{words(1, 3)}</h3><p>{prose()}</p></div>", f"<div>{menu('p')}</div>"]), f"<aside>{menu('li')}{r.choice(['', prose()])}</aside>", f"<form>{form}</form>", f"<footer>© {r.choice([words(1, 3), prose()])}</footer>"]
            among = [f"<form><p>{words(1, 4)}</p><input>{form}</form>", f"<aside>{r.choice([f'<p>{prose()}</p>', menu('li')])}</aside>", named("social-share", words(1, 3)), named("ad", ad), f"<nav>{menu('li')}</nav>", f"<footer>{line(2, 8)}</footer>"]
            for x in r.sample(among, r.randint(0, 3)):
                body.insert(r.randint(1, len(body)), x)
            page = "".join(r.sample(around, r.randint(1, len(around)))) + f"<article>{''.join(body)}{inside}</article>" + "".join(r.sample(after, r.randint(1, 3)))
            if r.random() < 0.3:
                page = page.replace("<article>", "<main>").replace("</article>", "</main>")
        elif kind == "names":
            around = [named("main-menu nav", menu("div")), named("site-banner", words(1, 5)), named("cookie-bar", notice), named("ad", ad)]
            after = [named("sidebar", menu("li") + f"<p>{prose()}</p>"), named("comments", comments), named("related", menu("p")), named("page-footer footer", prose())]
            page = "".join(r.sample(around, r.randint(1, 4))) + f'<div class="{r.choice(["content", "post", "story", "text"])}">{"".join(body)}</div>' + "".join(r.sample(after, r.randint(1, 4)))
        else:
            page = f"<div>{menu(r.choice(['li', 'div', 'p']))}</div><div><div>{''.join(body)}</div></div><div>{menu(r.choice(['li', 'p']))}</div><div>{words(1, 4)}</div>"
        out.append((f"<html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>", kept))
    return out


def _truth(found: list[Block], kept: list[str]) -> list[bool]:
    want, at, out = list(kept), 0, []
    for b in found:
        hit = at < len(want) and b.text == want[at]
        at += hit
        out.append(hit)
    return out


@lru_cache(1)
def fitted(pages: int = PAGES, rounds: int = 40) -> Model:
    """The classifier by Newton steps with a slight pull to 0, then the strengths that mislabel the fewest blocks (the least in all, of equals)."""
    every = [(found, _truth(found, kept)) for page, kept in marked_pages(pages) for found in (blocks(page),)]
    x, y = np.concatenate([features(f) for f, _ in every]), np.concatenate([t for _, t in every]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(curve, x.T @ (p - y) + 0.05 * w)
    tried = []
    for strengths in [(a, b, c) for a in NEXT_EDGES for b in PARENT_EDGES for c in GRAND_EDGES]:
        model = Model(w, strengths)
        tried.append((sum(g != t for f, truth in every for g, t in zip(model.labels(f), truth, strict=True)), sum(strengths), strengths))
    return Model(w, min(tried)[2])


def main_text(page: str | None, model: Model | None = None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    kept = (model or fitted()).labels(found)
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` with html replaced by text, and n_chars."""
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    model = fitted()

    def run(batches):
        for part in common.chunks(batches, "html"):
            got = [main_text(x, model) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in keep], pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], [*keep, "text", "n_chars"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in keep]
    return pages.select(*keep, "html").mapInArrow(common.tidy(run), ", ".join([*fields, "text string, n_chars long"]))


def report(pages: DataFrame) -> DataFrame:
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.col("n_chars"))
