"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is parsed into leaf blocks: stretches of text between block-level tags, with their
ancestors. Features are the tags and class words of the ancestors and properties of the
text; the field has two labels, article and rest, whose sequence Viterbi decoding finds.

Training pages are labelled: a bounded sample of the table (``max_pages``), in which the
blocks of an article or main element are the article. As tables may know one layout only,
their blocks are also laid out anew in other ways (by tags or class words only, with
notices, forms, sidebars, related links and reader comments), with the labels they have.

The time that a page takes is in proportion to its length, however broken its markup is.

Defined results: null and empty html, and pages without an article, give the empty text;
rows are kept one for one, null ids and repeated rows included; a head ends, without its end
tag, at the first text or element that it can't hold; broken markup is read as far as it goes; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose begin and end bound a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul label".split()
)
#: Elements whose content is no text of a page.
SKIPPED = frozenset("head script style noscript template iframe svg math object canvas select option textarea button audio video title".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
#: Class words that say what a container holds.
WORDS = {
    "ad": "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion dfp adsense".split(),
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager skip".split(),
    "foot": "footer foot copyright legal colophon imprint".split(),
    "head": "header masthead topbar logo hero branding".split(),
    "side": "sidebar side aside widget related recommended trending popular tags tagcloud rail more".split(),
    "notice": "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription alert paywall signup login".split(),
    "comment": "comment comments reply replies disqus respond responses discussion feedback commentlist reader".split(),
    "share": "share sharing social follow facebook twitter print".split(),
    "content": "content article post entry story main body text page prose articlebody".split(),
    "hidden": "hidden invisible sr offscreen".split(),
}
_GROUP = {w: g for g, ws in WORDS.items() for w in ws}
_TAGS = ("article", "main", "nav", "footer", "header", "aside", "form", "section", "ul", "ol", "table", "figure", "blockquote", "dl", "dialog", "details", "label", "pre")
_LEAVES = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "div", "body", "dd", "dt", "blockquote", "pre", "article", "section", "label", "legend", "figcaption")
NAMES = tuple(
    ["bias"] + [f"in:{t}" for t in _TAGS] + [f"leaf:{t}" for t in _LEAVES] + [f"class:{g}" for g in WORDS] + [f"near:{g}" for g in WORDS]
    + [f"words:{k}" for k in range(7)] + [f"links:{k}" for k in range(4)] + ["sentence", "copyright", "upper", "digits", "hidden", "first", "last", "deep"]
)
INDEX = {n: k for k, n in enumerate(NAMES)}
#: Elements that a head may hold; any other one ends it, as does text.
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_TELLING = frozenset("class id role itemprop style hidden aria-hidden".split())
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    features: list[int]


def _said(attributes: str) -> tuple[frozenset[str], bool]:
    """(what the class words say, whether it is hidden)."""
    if not attributes.strip():
        return frozenset(), False
    said, hidden = set(), False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name not in _TELLING:
            continue
        if name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name != "aria-hidden":
            said |= {_GROUP[w] for w in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w in _GROUP}
    return frozenset(said), hidden


def tokens(page: str) -> Iterator[tuple[str, bool, str, int]]:
    """(tag in lower case or empty for text, whether it ends an element, attributes or text, place behind it); the caller may send a place to go on from.

    Each character is looked at a bounded number of times: no tag is sought behind the last
    ``>``, and once a quote within a tag has turned out to have no end, tags end at the next ``>``.
    """
    at, n, last, quotes = 0, len(page), page.rfind(">"), True
    while at < n:
        begin = page.find("<", at) if at < last else -1
        if begin != at:
            begin = n if begin < 0 else begin
            yield "", False, page[at:begin], begin
            at = begin
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page[at + 1] in "!?":
            at = page.index(">", at) + 1
            continue
        m = _TAG.match(page, at) if quotes else None
        if m:
            closes, name, attributes, at = m[1], m[2], m[3], m.end()
        else:
            m = _NAME.match(page, at)
            if not m:
                yield "", False, "<", at + 1
                at += 1
                continue
            quotes = False
            end = page.index(">", m.end())
            closes, name, attributes, at = m[1], m[2], page[m.end() : end], end + 1
        at = (yield name.lower(), bool(closes), attributes, at) or at


@dataclass(frozen=True)
class Above:
    """What the open elements say: the innermost one's tag, all tags, class words of all and of the last two, whether one is hidden, how many there are."""

    tag: str
    tags: frozenset[str]
    said: frozenset[str]
    near: tuple[frozenset[str], frozenset[str]]
    hidden: bool
    deep: int

    def with_element(self, tag: str, said: frozenset[str], hidden: bool) -> Above:
        tags = self.tags if tag in self.tags else self.tags | {tag}
        return Above(tag, tags, self.said if said <= self.said else self.said | said, (self.near[1], said), self.hidden or hidden, self.deep + 1)


_NONE = Above("body", frozenset(), frozenset(), (frozenset(), frozenset()), False, 0)


class _Open(list):
    """Open elements, with how many there are of each tag, so that an end without a begin costs nothing."""

    def __init__(self) -> None:
        self.count: Counter[str] = Counter()

    def add(self, tag: str, what) -> None:
        self.append((tag, what))
        self.count[tag] += 1

    def close(self, tag: str) -> None:
        """Closes the innermost element of this tag and all within it."""
        if self.count[tag]:
            gone = ""
            while gone != tag:
                gone = self.pop()[0]
                self.count[gone] -= 1


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    found: list[tuple[str, Above, int, int]] = []
    stack, skip = _Open(), _Open()
    parts: list[str] = []
    linked = in_link = 0
    page = page or ""

    def flush():
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = " ".join(entities.unescape(raw).split())
            if text:
                found.append((text, stack[-1][1] if stack else _NONE, linked, len(raw)))
            parts, linked = [], 0

    stream, go_on = tokens(page), None
    while True:
        try:
            tag, closes, said, at = stream.send(go_on)
        except StopIteration:
            break
        go_on = None
        if not tag:
            if skip and skip[-1][0] == "head" and not said.isspace():
                skip.close("head")
            if not skip:
                parts.append(said)
                if in_link:
                    linked += len(said)
            continue
        if closes:
            if skip.count[tag]:
                skip.close(tag)
            elif skip:
                continue
            elif tag in BLOCKS:
                flush()
                stack.close(tag)
            elif tag == "a":
                in_link = 0
            continue
        empty = said.endswith("/")
        if tag in _RAW and not empty:  # nothing inside is markup
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            go_on = end.end() if end else len(page)
            continue
        if tag == "body":
            while skip:
                skip.close(skip[-1][0])
        if skip and skip[-1][0] == "head" and tag not in _HEAD:
            skip.close("head")
        if skip:
            if tag in SKIPPED and not empty:
                skip.add(tag, None)
            continue
        if tag in SKIPPED:
            if not empty:
                skip.add(tag, None)
        elif tag in BLOCKS:
            flush()
            while stack and stack[-1][0] == "p":
                stack.close("p")  # a paragraph ends where a block begins
            if tag in ("li", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == tag:
                stack.close(tag)
            if tag == "body":
                in_link = 0
            if tag != "hr" and not empty:
                stack.add(tag, (stack[-1][1] if stack else _NONE).with_element(tag, *_said(said)))
        elif tag == "a":
            in_link = 1
        elif tag in ("br", "img", "wbr"):
            parts.append(" ")
    flush()
    return [Block(text, _features(text, above, linked, size, k, len(found))) for k, (text, above, linked, size) in enumerate(found)]


def _features(text: str, above: Above, linked: int, size: int, k: int, n: int) -> list[int]:
    on = {"bias", f"leaf:{above.tag}", *(f"in:{t}" for t in above.tags), *(f"class:{g}" for g in above.said), *(f"near:{g}" for said in above.near for g in said)}
    if above.hidden:
        on.add("hidden")
    words = text.count(" ") + 1
    on.add(f"words:{min(6, words.bit_length() - 1)}")
    share = linked / max(size, 1)
    on.add(f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.9 else 3}")
    if text[-1] in ".!?\"”»…":
        on.add("sentence")
    if "©" in text or "(c)" in text.lower():
        on.add("copyright")
    if text.isupper():
        on.add("upper")
    if 2 * sum(map(str.isdigit, text)) > len(text):
        on.add("digits")
    if k == 0:
        on.add("first")
    if k == n - 1:
        on.add("last")
    if above.deep > 6:
        on.add("deep")
    return [INDEX[x] for x in on if x in INDEX]


@dataclass(frozen=True)
class Model:
    """Weights of the article label (the rest has none) and a transition score for each pair of labels."""

    weights: tuple[float, ...]
    steps: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, found: list[Block]) -> list[int]:
        """Viterbi: the best sequence of labels."""
        if not found:
            return []
        (s00, s01), (s10, s11) = self.steps
        w = self.weights
        a, b = 0.0, sum([w[f] for f in found[0].features])
        back: list[tuple[int, int]] = []
        for block in found[1:]:
            e = sum([w[f] for f in block.features])
            from0, from1 = (0, 1)[b + s10 > a + s00], (0, 1)[b + s11 > a + s01]
            back.append((from0, from1))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + e
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = 250, rate: float = 0.15, ridge: float = 1e-4) -> Model:
    """Maximum likelihood by forward-backward over padded sequences, with Adam."""
    pages = [p for p in pages if p[0]]
    n, longest = len(pages), max(len(b) for b, _ in pages)
    x = np.zeros((n, longest, len(NAMES)), np.float32)
    y = np.zeros((n, longest), int)
    there = np.zeros((n, longest), bool)
    for i, (found, labels) in enumerate(pages):
        for k, block in enumerate(found):
            x[i, k, block.features] = 1
        y[i, : len(labels)], there[i, : len(labels)] = labels, True
    flat = x.reshape(-1, len(NAMES))
    total = there.sum()
    theta = np.zeros(len(NAMES) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, s = theta[: len(NAMES)], theta[len(NAMES) :].reshape(2, 2)
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, longest)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = e[:, 0]
        for k in range(1, longest):
            new = e[:, k] + np.logaddexp(ahead[:, k - 1, :1] + s[0], ahead[:, k - 1, 1:] + s[1])
            ahead[:, k] = np.where(there[:, k, None], new, ahead[:, k - 1])
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        after = np.zeros((n, longest, 2))
        for k in range(longest - 2, -1, -1):
            to = e[:, k + 1] + after[:, k + 1]
            new = np.logaddexp(s[:, 0] + to[:, :1], s[:, 1] + to[:, 1:])
            after[:, k] = np.where(there[:, k + 1, None], new, 0)
        p = np.exp(ahead + after - z[:, None, None])[:, :, 1] * there
        gradient = np.zeros_like(theta)
        gradient[: len(NAMES)] = flat.T @ ((y - p) * there).astype(np.float32).reshape(-1)
        pair = there[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                q = np.exp(np.minimum(ahead[:, :-1, i] + s[i, j] + e[:, 1:, j] + after[:, 1:, j] - z[:, None], 0)) * pair
                gradient[len(NAMES) + 2 * i + j] = (((y[:, :-1] == i) & (y[:, 1:] == j) & pair) - q).sum()
        gradient = gradient / total - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = theta[len(NAMES) :].reshape(2, 2)
    return Model(tuple(map(float, theta[: len(NAMES)])), tuple(tuple(map(float, r)) for r in s))


def own_labels(page: str) -> tuple[list[Block], list[int]] | None:
    """Blocks of a page that marks its article by tags; None if it doesn't."""
    found = blocks(page)
    article = INDEX["in:article"] if any(INDEX["in:article"] in b.features for b in found) else INDEX["in:main"]
    rest = {INDEX[f"in:{t}"] for t in ("nav", "footer", "aside", "form", "dialog")} | {INDEX[f"class:{g}"] for g in ("ad", "nav", "side", "notice", "comment", "share", "hidden")} | {INDEX["hidden"]}
    labels = [int(article in b.features and not rest & set(b.features)) for b in found]
    return (found, labels) if any(labels) else None


#: Text for layouts where a table has no page to learn from.
_FILLER = (
    "The committee met on Tuesday and agreed on the plan for the coming year, which it will publish soon.",
    "Nobody had expected the bridge to open before spring, but the work went faster than planned.",
    "A second report is due in the autumn.",
    "Those who live near the river have seen the water rise again, and they ask what is to be done.",
)


def laid_out(article: list[str], other: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page of another layout around the given article, with its labels."""
    out: list[str] = []
    texts: list[tuple[str, int]] = []

    def put(tag: str, text: str, label: int, attributes: str = "") -> str:
        texts.append((text, label))
        return f"<{tag}{attributes}>{entities.escape(text, quote=False)}</{tag}>"

    few = lambda a, b: [" ".join(rng.choice(other).split()[: rng.randint(1, 4)]) or "x" for _ in range(rng.randint(a, b))]
    line = lambda: rng.choice(other)
    cls = lambda group: f' {rng.choice(["class", "id"])}="{rng.choice(["", "c-", "site-", "js-"])}{rng.choice(WORDS[group])}"'

    def box(tag: str, group: str, inner) -> None:
        semantic = rng.random() < 0.5
        name = tag if semantic else "div"
        out.append(f"<{name}{'' if semantic and rng.random() < 0.6 else cls(group)}>")
        inner()
        out.append(f"</{name}>")

    def links():
        out.append("<ul>")
        for t in few(3, 8):
            texts.append((t, 0))
            out.append(f'<li><a href="/x">{entities.escape(t, quote=False)}</a></li>')
        out.append("</ul>")

    def said(group: str, label: int, a: int, b: int, tags=("p", "div", "p")):
        for _ in range(rng.randint(a, b)):
            out.append(put(rng.choice(tags), line(), label))

    def comments():
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "li", "article"])
            out.append(f"<{tag}{rng.choice(['', cls('comment')])}>")
            out.append(put("h4", few(1, 1)[0], 0))
            for _ in range(rng.randint(1, 2)):
                out.append(put("p", rng.choice(article + other), 0))
            out.append(f"</{tag}>")

    def form():
        out.append("<form>")
        out.append(put("label", few(1, 1)[0], 0))
        out.append(put("p", line(), 0))
        out.append("<input name=q><button>OK</button></form>")

    if rng.random() < 0.7:
        box("header", "head", lambda: (out.append(put("div", few(1, 1)[0], 0)), links() if rng.random() < 0.5 else None))
    if rng.random() < 0.8:
        box("nav", "nav", links)
    if rng.random() < 0.4:
        box("div", "notice", lambda: said("notice", 0, 1, 2))
    if rng.random() < 0.5:
        out.append(f"<div{cls('ad')}>")
        said("ad", 0, 1, 2)
        out.append("</div>")
    side_first = rng.random() < 0.3

    def side():
        box("aside", "side", lambda: (said("side", 0, 0, 2), links()))

    if side_first:
        side()
    kind = rng.random()
    opened = ("<article>", "</article>") if kind < 0.35 else ("<main>", "</main>") if kind < 0.5 else ("<main><article>", "</article></main>") if kind < 0.6 else (f"<div{cls('content')}>", "</div>")
    out.append(opened[0])
    inner_class = rng.random() < 0.3
    if inner_class:
        out.append(f"<div{cls('content')}>")
    out.append(put(rng.choice(["h1", "h1", "h2"]), " ".join(article[0].split()[:8]), 1))
    for k, t in enumerate(article):
        tag = rng.choice(["p"] * 12 + ["li", "blockquote", "h2", "h3", "div", "pre"])
        if tag in ("h2", "h3"):
            out.append(put(tag, " ".join(t.split()[:6]), 1))
            tag = "p"
        out.append("<ul>" + put(tag, t, 1) + "</ul>" if tag == "li" else put(tag, t, 1))
        if rng.random() < 0.06:
            out.append(f"<div{cls('ad')}>")
            said("ad", 0, 1, 1)
            out.append("</div>")
    if inner_class:
        out.append("</div>")
    if rng.random() < 0.25:
        out.append(f"<div{cls('share')}>")
        links()
        out.append("</div>")
    if rng.random() < 0.2:
        box("section", "comment", comments)
    out.append(opened[1])
    if rng.random() < 0.4:
        out.append(f"<{(t := rng.choice(['section', 'div']))}{cls('comment')}>")
        comments()
        out.append(f"</{t}>")
    if rng.random() < 0.3:
        form()
    if not side_first and rng.random() < 0.5:
        side()
    if rng.random() < 0.9:
        box("footer", "foot", lambda: (out.append(put("p", rng.choice(["© 2024 ", "", "Copyright "]) + line(), 0)), links() if rng.random() < 0.4 else None))
    found = blocks("<html><body>" + "".join(out) + "</body></html>")
    # each text became one block, in order
    assert [b.text for b in found] == [" ".join(t.split()) for t, _ in texts]
    return found, [label for _, label in texts]


def train(sample: list[str], seed: int = 7, layouts: int = 500, article_blocks: int = 12, other_texts: int = 5000, together: int = 80) -> Model:
    """Fits on the labelled pages of the sample and on new layouts of their blocks.

    The sample's pages count whole; a sequence of more than ``together`` blocks is fitted in
    several parts. Only the new layouts are bounded: in number, and each takes at most
    ``article_blocks`` blocks, chosen anew over the whole length of an article, and the
    texts around it from ``other_texts`` of all others.
    """
    rng = random.Random(seed)
    own = [p for p in map(own_labels, sample) if p]
    articles = [[b.text for b, y in zip(*p) if y] for p in own] or [list(_FILLER)]
    others = [b.text for p in own for b, y in zip(*p) if not y] or list(_FILLER)
    others = rng.sample(others, other_texts) if len(others) > other_texts else others
    some = lambda a: [a[i] for i in sorted(rng.sample(range(len(a)), min(article_blocks, len(a))))]
    made = []
    for k in range(layouts):
        pool = others + some(rng.choice(articles)) if len(others) < 50 or rng.random() < 0.5 else others
        made.append(laid_out(some(articles[k % len(articles)]), pool, rng))
    return fit([(found[k : k + together], labels[k : k + together]) for found, labels in own + made for k in range(0, len(found), together)])


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, model.decode(found)) if y)


def _extract(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k in range(0, len(pdf), 500):
            part = pdf.iloc[k : k + 500]
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": [main_text(h, model) for h in part["html"]]})


def sample_pages(pages: DataFrame, max_pages: int) -> list[str]:
    """At most ``max_pages`` pages, by a hash of their ids.

    The hashes are chosen first, so that tasks send ``max_pages`` numbers and not as many pages.
    """
    hashed = pages.filter(F.col("html").isNotNull()).select(F.xxhash64("page_id", "url").alias("h"), "html")
    chosen = hashed.select("h").distinct().orderBy("h").limit(max_pages)
    rows = hashed.join(F.broadcast(chosen), "h").orderBy("h", F.length("html")).limit(max_pages).select("html").collect()
    return [r[0] for r in rows]


def extract(pages: DataFrame, model: Model | None = None, max_pages: int = 300) -> DataFrame:
    """(page_id, url, text) for each row of pages."""
    model = model or train(sample_pages(pages, max_pages))
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(partial(_extract, model=model), f"page_id {kind}, url string, text string")
