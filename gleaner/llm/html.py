"""Main text of web pages: boosted trees over DOM nodes, decoded as a hierarchy.

A page is parsed into its block-level elements. Each gets features of its subtree
(text, link and tag density), attribute tokens, depth and siblings; boosted trees
give the log-odds that it belongs to the main text. Decoding picks the likeliest
labelling in which every path from the root lies first outside, then inside, then,
for good, outside the main text again; so no descendant contradicts its ancestors.

The trees are trained here, on pages of a generator that varies layouts, class
names and sloppy markup. Nothing is learned from the pages that are extracted.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import table
from .boosting import Boosted
from .common import lean

TRAIN_PAGES = 600
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul textarea label".split())
CLOSES_P = BLOCK - frozenset("html body button label textarea legend".split()) | {"hr"}
#: What may stand in a head; any other tag, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes script style template head html".split())
#: An opened tag ends the nearest open one of these kinds, the outer kind first, up to the tag's own container.
CELLS, ROWS, BODIES = frozenset(("td", "th")), frozenset(("tr",)), frozenset(("tbody", "thead", "tfoot"))
IMPLIED = {
    **{t: ((frozenset(ends.split()),), frozenset(within.split())) for t, ends, within in (("li", "li", "ul ol menu dir td th table"), ("dt", "dt dd", "dl td th table"), ("dd", "dt dd", "dl td th table"))},
    **{t: ((CELLS,), frozenset(("tr", "table"))) for t in CELLS},
    "tr": ((ROWS, CELLS), BODIES | {"table"}),
    **{t: ((BODIES, ROWS, CELLS), frozenset(("table",))) for t in BODIES},
}
#: An end tag closes nothing beyond these; those of a table's parts, nothing beyond the table.
TABLE_PARTS = CELLS | ROWS | BODIES | {"table"}
FENCE, TABLE_FENCE = CELLS | {"table"}, frozenset(("table",))
#: A quote opens a value only behind an equals sign.
VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?=[^a-zA-Z])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{VALUE})?)?)*+)>?", re.S)
ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?)?")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
#: Groups of attribute tokens, each one feature of a node.
GROUPS = [
    "nav menu navbar navigation topnav", "header masthead topbar banner hero logo brand", "footer foot bottom colophon", "sidebar aside side rail widget", "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp",
    "comment comments discussion disqus reply replies respond thread", "form login signin signup subscribe newsletter search register", "cookie cookies consent notice alert gdpr warning message modal popup overlay toast", "share social sharing follow twitter facebook",
    "related recommended more trending popular similar", "breadcrumb breadcrumbs pagination pager paging toc", "article post entry story news", "content main body text prose copy maincontent", "author byline date meta tags tag category", "hidden hide invisible sr", "copyright legal terms privacy",
]
GROUP_OF = {w: i for i, g in enumerate(GROUPS) for w in g.split()}
BAD, GOOD = (1 << 11) - 1 | 1 << 14 | 1 << 15, 1 << 11 | 1 << 12
TAGS = ["p", "h1 h2 h3 h4 h5 h6", "li dd dt", "ul ol dl menu", "div center", "section", "article", "main", "nav", "aside", "header", "footer", "form fieldset button label textarea legend", "table tbody thead tr td th", "blockquote pre", "figure figcaption", "body html", "details dialog address summary"]
TAG_OF = {t: i for i, g in enumerate(TAGS) for t in g.split()}
TAG_BAD = {"nav", "aside", "header", "footer", "form", "dialog", "button", "fieldset"}
INPUTS = frozenset(("input", "select", "textarea", "button"))


class Node:
    __slots__ = ("tag", "up", "depth", "tokens", "above", "in_bad", "in_good", "index", "kids", "text", "links", "nodes", "paras", "items", "inputs", "own", "own_links", "marks", "begin", "label")

    def __init__(self, tag: str, up: int, depth: int):
        self.tag, self.up, self.depth = tag, up, depth
        self.tokens = self.above = self.in_bad = self.in_good = self.index = self.kids = 0
        self.text = self.links = self.nodes = self.paras = self.items = self.inputs = self.own = self.own_links = self.marks = self.begin = 0
        self.label = 0


def _read_attributes(raw: str) -> tuple[int, int | None, bool]:
    """(groups of tokens as bits, training label, hidden) of a start tag's attributes."""
    bits, label, hidden, seen = 0, None, False, set()
    for m in ATTR.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in seen:  # of equal names the first counts
            continue
        seen.add(name)
        if name == "data-main":
            label = int(value or 0)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
        elif name in ("class", "id", "role"):
            for w in SPLIT.findall(value):
                if (g := GROUP_OF.get(w.lower())) is not None:
                    bits |= 1 << g
    return bits, label, hidden


_short_attributes = functools.lru_cache(maxsize=20_000)(_read_attributes)


def _attributes(raw: str) -> tuple[int, int | None, bool]:
    return _short_attributes(raw) if len(raw) < 200 else _read_attributes(raw)


class Stack:
    """The open tags. A tag is (name, number of its nearest block's node).

    Blocks have frames of their own, and each frame counts the other tags that are
    open in it, so no search walks over tags that it doesn't close; a search among
    frames that fails is remembered in those it passed.
    """

    def __init__(self):
        self.tags: list[tuple[str, int]] = [("body", 0)]
        self.frames: list[tuple[int, str, set]] = [(0, "body", set())]
        self.counts: list[dict[str, int]] = [{}]

    def push(self, tag: str, node: int) -> None:
        if tag in BLOCK:
            self.frames.append((len(self.tags), tag, set()))
            self.counts.append({})
        else:
            self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        self.tags.append((tag, node))

    def pop(self) -> str:
        tag = self.tags.pop()[0]
        if tag in BLOCK:
            self.frames.pop()
            self.counts.pop()
        else:
            self.counts[-1][tag] -= 1
        return tag

    def nearest(self, tags: frozenset, fence: frozenset) -> int | None:
        """Place of the nearest open block of these tags, none beyond a fence."""
        key = (tags, fence)
        for k in range(len(self.frames) - 1, 0, -1):
            at, tag, failed = self.frames[k]
            if tag in tags:
                return at
            if tag in fence or key in failed:
                break
        else:
            k = 0
        for f in self.frames[k + 1 :]:
            f[2].add(key)
        return None

    def inline(self, tag: str) -> int | None:
        """Place of the nearest open tag that is no block, none beyond the nearest block."""
        if not self.counts[-1].get(tag):
            return None
        k = len(self.tags) - 1
        while self.tags[k][0] != tag:
            k -= 1
        return k


ONE = {t: frozenset((t,)) for t in BLOCK}


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes in document order, text blocks as (owner node, text)); time grows with the page's length."""
    root = Node("body", -1, 0)
    nodes, blocks = [root], []
    stack = Stack()
    open_ = stack.tags
    buffer: list[str] = []
    hide = links = 0
    size = 0
    head = None  # its place in the stack

    def flush() -> None:
        nonlocal size
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                blocks.append((open_[-1][1], text))
                size += len(text)

    def words(raw: str) -> None:
        if head is not None and len(open_) - 1 == head and not raw.isspace():
            close(head)
        if hide or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        buffer.append(text)
        n = len(text.strip())
        if n:
            node = nodes[open_[-1][1]]
            node.own += n
            node.marks += text.count(".") + text.count(",")
            if links:
                node.own_links += n

    def close(depth: int) -> None:
        nonlocal hide, links, head
        while len(open_) > depth:
            tag = open_[-1][0]
            if tag in BLOCK:
                flush()
            stack.pop()
            if tag in HIDDEN or tag == "!hidden":
                hide -= 1
            elif tag == "a":
                links -= 1
        if head is not None and len(open_) <= head:
            head = None

    pos, end = 0, len(page)
    search = TOKEN.search
    while pos < end:
        m = search(page, pos)
        if m is None:
            words(page[pos:])
            break
        if m.start() > pos:
            words(page[pos : m.start()])
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1] and tag != "br":
            at = stack.nearest(ONE[tag], TABLE_FENCE if tag in TABLE_PARTS else FENCE) if tag in BLOCK else stack.inline(tag)
            if at is not None:
                close(at)
            elif tag == "p":
                flush()
            continue
        if head is not None and len(open_) - 1 == head and tag not in IN_HEAD:
            close(head)
        if tag in ("html", "body"):
            root.tokens |= _attributes(m[3])[0]
            continue
        if tag in CLOSES_P and stack.frames[-1][1] == "p":
            close(stack.frames[-1][0])
        if tag in IMPLIED:
            kinds, within = IMPLIED[tag]
            for kind in kinds:
                if (at := stack.nearest(kind, within)) is not None:
                    close(at)
                    break
        top = nodes[open_[-1][1]]
        if tag in VOID:
            if tag == "input":
                top.inputs += 1
            elif tag == "hr":
                flush()
            elif tag == "br" and not hide:
                buffer.append(" ")
            continue
        if tag in INPUTS:
            top.inputs += 1
        if tag in RAW:
            if tag == "textarea":
                top.inputs += 1
            found = RAW_END[tag].search(page, pos)
            pos = page.find(">", found.end()) if found else -1
            pos = end if pos < 0 else pos + 1
            continue
        if tag in HIDDEN:
            if tag == "head":
                if head is not None or len(nodes) > 1:
                    continue
                head = len(open_)
            stack.push(tag, open_[-1][1])
            hide += 1
            continue
        if tag == "a":
            links += 1
        top.nodes += 1
        if tag not in BLOCK:
            stack.push(tag, open_[-1][1])
            continue
        flush()
        bits, label, hidden = _attributes(m[3])
        node = Node(tag, open_[-1][1], top.depth + 1)
        node.tokens, node.above = bits, top.above | top.tokens
        node.in_bad = top.in_bad + (top.tag in TAG_BAD)
        node.in_good = top.in_good + (top.tag in ("article", "main"))
        node.label = top.label if label is None else label
        node.index, node.begin = top.kids, size
        top.kids += 1
        stack.push(tag, len(nodes))
        nodes.append(node)
        if hidden:
            stack.push("!hidden", len(nodes) - 1)
            hide += 1
    close(1)
    flush()
    for n in nodes:
        n.text, n.links = n.own, n.own_links
    for n in reversed(nodes[1:]):
        up = nodes[n.up]
        up.text += n.text
        up.links += n.links
        up.nodes += n.nodes
        up.inputs += n.inputs
        up.marks += n.marks
        up.paras += n.paras + (n.tag == "p")
        up.items += n.items + (n.tag == "li")
    return nodes, blocks


def features(nodes: list[Node]) -> list[list[float]]:
    """One row of numbers per node."""
    total = nodes[0].text or 1
    kin: dict[int, list[float]] = {}
    for n in nodes[1:]:
        k = kin.setdefault(n.up, [0, 0, 0, 0])
        k[0] += 1
        k[1] += n.text
        k[2] += n.links
        k[3] = max(k[3], n.text)
    out = []
    log = math.log1p
    for n in nodes:
        t = n.text or 1
        k = kin.get(n.up) or (1, n.text, n.links, n.text)
        row = [0.0] * (len(TAGS) + len(GROUPS))
        row[TAG_OF.get(n.tag, 4)] = 1.0
        bits = n.tokens
        while bits:
            low = bits & -bits
            row[len(TAGS) + low.bit_length() - 1] = 1.0
            bits ^= low
        row += [
            n.depth, n.in_bad, n.in_good, (n.above & BAD).bit_count(), (n.above & GOOD).bit_count(), log(n.text), n.links / t, n.text / (n.nodes + 1), log(n.paras), log(n.items), n.inputs, n.marks / t, n.text / total, n.begin / total, log(n.own), n.own_links / (n.own or 1), n.index / k[0], k[0], log(k[1] / k[0]), k[2] / (k[1] or 1), n.text / (k[3] or 1),
        ]
        out.append(row)
    return out


def decode(nodes: list[Node], odds: list[float]) -> list[bool]:
    """Whether each node is inside, in the likeliest labelling that leaves the main text at most once on a path."""
    n = len(nodes)
    yes = [-math.log1p(math.exp(-o)) if o > -30 else o for o in odds]
    no = [-math.log1p(math.exp(o)) if o < 30 else -o for o in odds]
    before, inside, after = no[:], yes[:], no[:]
    for i in range(n - 1, 0, -1):
        up = nodes[i].up
        before[up] += max(before[i], inside[i])
        inside[up] += max(inside[i], after[i])
        after[up] += after[i]
    state = [0] * n
    state[0] = 1 if inside[0] > before[0] else 0
    for i in range(1, n):
        s = state[nodes[i].up]
        if s == 0:
            state[i] = 1 if inside[i] > before[i] else 0
        elif s == 1:
            state[i] = 1 if inside[i] >= after[i] else 2
        else:
            state[i] = 2
    return [s == 1 for s in state]


class Pages:
    """A generator of labelled pages; data-main marks what is main text, and what inside it isn't."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def some(self, lo: int, hi: int) -> str:
        r = self.rng
        parts = ["an", "er", "th", "ion", "le", "ou", "st", "de", "ch", "ung", "é", "ó", "que", "ing"]
        words = ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        for i in range(0, len(words), r.randint(6, 14)):
            words[i] = words[i].capitalize()
            if i:
                words[i - 1] += r.choice([".", ",", "."])
        return " ".join(words) + r.choice([".", ".", ""]) if r.random() < 0.9 else "%%% ".join(words)

    def link(self, lo=1, hi=4) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{self.some(lo, hi)}</a>'

    def box(self, names: str, body: str, tags: str = "div", bare: float = 0.2, main: int | None = None) -> str:
        r = self.rng
        tag = r.choice(tags.split())
        name = r.choice(names.split())
        attr = "" if r.random() < bare else r.choice([f' class="{name}"', f' id="{name}"', f' class="{name}-box c{r.randint(1, 9)}"', f' class="site-{name}"'])
        return f"<{tag}{attr}{'' if main is None else f' data-main="{main}"'}>{body}</{tag}>"

    def menu(self, tags="nav div") -> str:
        items = "".join(f"<li>{self.link(1, 2)}</li>" for _ in range(self.rng.randint(3, 9)))
        return self.box("nav menu navbar topnav", f"<ul>{items}</ul>", tags)

    def junk(self, kind: str, bare: float) -> str:
        r, some, link = self.rng, self.some, self.link
        if kind == "header":
            return self.box("header masthead topbar logo", f"{r.choice(['<h1>', '<h2>', '<p>'])}{some(1, 4)}" + f"<p>{some(2, 8)}</p>", "header div", bare)
        if kind == "footer":
            return self.box("footer bottom copyright", r.choice([f"&copy; 2024 &middot; {some(3, 20)}", f"<p>&copy; {some(2, 12)}</p><ul>" + "".join(f"<li>{link()}</li>" for _ in range(4)) + "</ul>"]), "footer footer div", bare)
        if kind == "side":
            return self.box("sidebar aside widget rail", f"<h3>{some(1, 3)}</h3>" + "".join(r.choice([f"<p>{link(2, 6)}</p>", f"<p>{some(4, 14)} {link()}</p>", f"<ul><li>{link(2, 6)}</li><li>{link(2, 6)}</li></ul>"]) for _ in range(r.randint(1, 4))), "aside aside div section", bare)
        if kind == "ad":
            return self.box("ad advert sponsor promo ads", r.choice([some(2, 12), f"<p>{some(4, 20)}</p>{link()}", f'<a href="//x.example">{some(3, 9)}</a>']), "div div aside", bare / 2)
        if kind == "notice":
            return self.box("cookie notice alert consent", f"<p>{some(8, 30)}</p><button>{some(1, 2)}</button>", "div div section dialog", bare / 2)
        if kind == "form":
            return self.box("newsletter subscribe login search", f'<form action="/go"><p>{some(3, 14)}</p><label>{some(1, 2)}</label><input name="q"><button>{some(1, 2)}</button></form>', "div section", 0.5)
        if kind == "comments":
            each = "".join(self.box("comment reply", f"<p>{some(1, 3)}</p><p>{some(8, 50)}</p>" + (link() if r.random() < 0.5 else ""), "div li article", 0.1) for _ in range(r.randint(1, 6)))
            return self.box("comments discussion disqus respond", f"<h3>{some(1, 3)}</h3>{each}", "section div", bare / 4)
        if kind == "related":
            return self.box("related recommended trending popular", f"<h3>{some(1, 3)}</h3><ul>" + "".join(f"<li>{link(3, 9)}</li>" for _ in range(r.randint(2, 6))) + "</ul>", "div section aside", bare)
        if kind == "share":
            return self.box("share social follow", "".join(link(1, 1) for _ in range(3)), "div ul", bare)
        return self.box("breadcrumb pagination pager", " &gt; ".join(link(1, 2) for _ in range(3)), "div nav", bare)

    def article(self) -> str:
        r, some = self.rng, self.some
        out = [f"<h1>{some(2, 12)}</h1>"] if r.random() < 0.85 else []
        sloppy = r.random() < 0.3
        if r.random() < 0.2:  # a stub: all else on the page may be longer
            return "".join(out) + f"<p>{'<b>' if sloppy else ''}{some(1, 9)}{'<br>' if sloppy else '</p>'}"
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.72:
                body = some(*r.choice([(1, 6), (15, 60), (40, 140), (30, 90)]))
                if r.random() < 0.2:
                    body = f"<b>{body}</b>" if not sloppy else f"<b>{body}<br>"
                if r.random() < 0.15:
                    body += f" {self.link()} {some(3, 12)}"
                out.append(f"<p>{body}" + ("" if sloppy and r.random() < 0.5 else "</p>"))
            elif x < 0.78:
                out.append(f"<h2>{some(2, 7)}</h2>")
            elif x < 0.84:
                out.append("<ul>" + "".join(f"<li>{some(3, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.88:
                out.append(f"<blockquote>{some(8, 40)}</blockquote>")
            elif x < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.94:
                out.append(f"<div>{some(10, 60)}</div>")
            elif x < 0.96:
                out.append(f'<figure><img src="a.png"><figcaption>{some(3, 12)}</figcaption></figure>')
            else:
                junk = self.junk(r.choice(["ad", "share", "form", "related", "notice"]), 0.05)
                out.append(re.sub(r"^<(\w+)", r'<\1 data-main="0"', junk))
        return "".join(out)

    def page(self) -> str:
        r = self.rng
        bare = r.choice([0.05, 0.2, 0.5])
        kinds = [k for k in ("header", "ad", "notice", "crumbs", "ad") if r.random() < 0.4]
        top = "".join([self.menu() if r.random() < 0.85 else "", *(self.junk(k, bare) for k in kinds)])
        tail = [self.junk(k, bare) for k in ("share", "comments", "related", "side", "form", "ad") if r.random() < 0.35]
        if r.random() < 0.9:
            tail.append(self.junk("footer", bare))
        body = self.article()
        style = r.random()
        if style < 0.45:
            core = f'<article data-main="1">{body}</article>'
        elif style < 0.6:
            core = f'<main data-main="1">{body}</main>'
        elif style < 0.9:
            core = self.box("content main post entry article story text", body, "div div section", 0.25, 1)
        else:
            core = re.sub(r"<(p|h1|h2|ul|div|table|blockquote|figure)>", r'<\1 data-main="1">', body)
        left = self.junk("side", bare) if r.random() < 0.25 else ""
        inner = top + left + core + "".join(tail)
        if r.random() < 0.35:
            inner = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.some(2, 8)}</title><style>p{{}}</style></head><body>{inner}" + ("</body></html>" if r.random() < 0.9 else "")


@functools.cache
def trained(pages: int = TRAIN_PAGES, seed: int = 11) -> Boosted:
    made = Pages(seed)
    rows, labels = [], []
    for _ in range(pages):
        nodes, _ = parse(made.page())
        rows += features(nodes)
        labels += [n.label for n in nodes]
    return Boosted().fit(np.array(rows), np.array(labels, float))


def main_texts(pages: list[str], model: Boosted) -> list[str]:
    parsed = [parse(p) for p in pages]
    rows = [f for nodes, _ in parsed for f in features(nodes)]
    odds = model.predict(np.array(rows, float)).tolist() if rows else []
    out, at = [], 0
    for nodes, blocks in parsed:
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(text for owner, text in blocks if kept[owner]))
    return out


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """pages' columns and main_text; page texts come from the whole html.

    Null and empty html, and pages without any main text, give an empty string.
    Repeated rows give equal texts; a column named main_text is replaced.
    """
    pages = pages.drop("main_text")
    held = pages.sparkSession.sparkContext.broadcast(model or trained())
    kept = pages.schema

    def run(batches):
        for b in batches:
            texts = [x or "" for x in b["html"].to_pylist()]
            out = []
            for lo in range(0, len(texts), 256):
                out += main_texts(texts[lo : lo + 256], held.value)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept.names), pa.array(out, pa.string())], [*kept.names, "main_text"])

    return pages.mapInArrow(lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", main_text string")


def op3(spark, sf_dir):
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
