"""Main text of web pages by wrappers inferred per host.

The pages of a host are aligned one after the other into a union-free regular expression over their block elements: where
two differ, an element becomes optional, neighbours of one shape become a repeated group, and a text that isn't the same on
all pages becomes a slot (Crescenzi, Mecca and Merialdo 2001, on the tree of blocks). In the wrapper the region with the
article's slots is chosen once for the host; pages are then read through it in one pass. Partial wrappers of bounded groups of
pages merge in a tree, so that no task holds all pages of a host.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, stored, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
CLASS = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BREAK = {"br", "hr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
ASIDE = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "template", "svg", "math", "canvas", "object", "dialog", "menu", "audio", "video", "fieldset", "datalist"}
ASIDE_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|banners?|side-?bar\w*|menus?|nav\w*|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscri\w*|signup|login|search|"
    r"shar(?:e|ing)|social|related|recommend\w*|promo\w*|sponsor\w*|comments?|commentlist|disqus|repl(?:y|ies)|respond|widgets?|toolbar|paginat\w*|pager|skip|complementary|navigation|contentinfo)(?:$|[\s_-])",
    re.I,
)
COMMENTS = re.compile(r"comment|disqus|repl(?:y|ies)|respond", re.I)
MAIN_WORD = re.compile(r"(?:^|[\s_-])(?:article(?:body)?|post|entry|story|content|main|body|text)(?:$|[\s_-])", re.I)
#: a start of the first closes the second, up to the third
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
#: Up to so many pairs of places two sequences are aligned by their longest common subsequence.
LCS_CELLS = 250_000
#: A text that every one of at least so many pages has in the same place is the host's, not the article's.
CONSTANT_PAGES = 8


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """('open', label, aside), ('close', '', False) and ('text', block, False) of a page, every opened block closed again.
    Inline elements and comments vanish; scripts, styles and the like are skipped."""
    stack: list[tuple[str, str, bool]] = []  # tag, label, aside
    parts: list[str] = []
    out: list[tuple[str, str, bool]] = []

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(("text", text, False))

    def pop_to(n: int) -> None:
        while len(stack) > n:
            stack.pop()
            out.append(("close", "", False))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in INLINE:
            continue
        flush()
        yield from out
        out.clear()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
            continue
        if name in BREAK or name in VOID:
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        marks = " ".join(x[2] or x[3] or x[4] or "" for x in CLASS.finditer(attributes)) if attributes else ""
        aside = name in ASIDE or bool(marks and ASIDE_WORD.search(marks)) and name not in ("html", "body", "article", "main")
        if name == "article" and marks and COMMENTS.search(marks):
            aside = True
        if stack:
            if name not in ("head", "meta", "link", "title", "base") and any(s[0] == "head" for s in stack):
                pop_to(next(k for k, s in enumerate(stack) if s[0] == "head"))
            if stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            if name in CLOSES:
                ends, limits = CLOSES[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in limits:
                        break
                    if stack[k][0] in ends:
                        pop_to(k)
                        break
            if name in ("article", "main") and not aside:
                # a menu or advert that was never closed doesn't hold the article
                k = next((k for k, s in enumerate(stack) if s[2] and not COMMENTS.search(s[1])), None)
                if k is not None:
                    pop_to(k)
        label = f"{name}.{'.'.join(sorted(set(marks.lower().split())))}" if marks else name
        stack.append((name, label, aside))
        out.append(("open", label, aside))
    flush()
    pop_to(0)
    yield from out


@dataclass
class Node:
    """An element of a wrapper: how often it may occur ('1', '?', '+', '*'), and what it holds. A text (label '#') has its
    value (a hash of it, however long) if that is the same wherever it was seen, else it is a slot. pages counts the pages, chars their text in it."""

    label: str
    often: str = "1"
    children: list[Node] = field(default_factory=list)
    value: str | None = None
    chars: int = 0
    pages: int = 1
    aside: bool = False

    def dump(self) -> list:
        """The nodes in document order, each with the number of its children; flat, as pages may be nested to any depth."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            out.append([x.label, x.often, len(x.children), x.value, x.chars, x.pages, int(x.aside)])
            todo += reversed(x.children)
        return out

    @classmethod
    def load(cls, rows: list) -> Node:
        done: list[Node] = []
        for label, often, n, value, chars, pages, aside in reversed(rows):
            children = [done.pop() for _ in range(n)]
            done.append(cls(label, often, children, value, chars, pages, bool(aside)))
        return done[0]


def often(a: str, b: str) -> str:
    many, none = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return ("*" if none else "+") if many else ("?" if none else "1")


def _whole(step: Generator) -> Any:
    """The result of a step that yields the steps it needs: recursion to any depth on a stack of its own."""
    stack, value = [step], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as e:
            stack.pop()
            value = e.value
        else:
            stack.append(inner)
            value = None
    return value


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """The wrapper of both, which have one label."""
    return _whole(_merge(a, b, same_page))


def _merge(a: Node, b: Node, same_page: bool) -> Generator:
    value = a.value if a.value == b.value else None
    pages = a.pages if same_page else a.pages + b.pages
    children = (yield _align(a.children, b.children, same_page)) if a.children or b.children else []
    return Node(a.label, often(a.often, b.often), children, value, a.chars + b.chars, pages, a.aside and b.aside)


def _align(a: list[Node], b: list[Node], same_page: bool) -> Generator:
    """Aligns two sequences by their longest common subsequence of labels, or long ones mismatch by mismatch; what only one has
    becomes optional."""
    out: list[Node] = []
    if [x.label for x in a] == [x.label for x in b]:
        for x, y in zip(a, b, strict=True):
            out.append((yield _merge(x, y, same_page)))
        return out
    n, m = len(a), len(b)
    if n * m > LCS_CELLS:
        for i, j in _steps([x.label for x in a], [x.label for x in b]):
            if i is not None and j is not None:
                out.append((yield _merge(a[i], b[j], same_page)))
            else:
                one = a[i] if j is None else b[j]
                one.often = often(one.often, "?")
                out.append(one)
        return (yield _fold(out, True))
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].label == b[j].label else max(best[i + 1][j], best[i][j + 1])
    i, j = 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i].label == b[j].label:
            out.append((yield _merge(a[i], b[j], same_page)))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            a[i].often = often(a[i].often, "?")
            out.append(a[i])
            i += 1
        else:
            b[j].often = often(b[j].often, "?")
            out.append(b[j])
            j += 1
    return (yield _fold(out, True))


def _steps(a: list[str], b: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """An alignment of two long sequences, as pairs of places. At a mismatch the side whose label comes up again sooner on the
    other one is what the other goes on to; what lies before it is skipped. No table of all pairs is made."""
    at_a, at_b = defaultdict(list), defaultdict(list)
    for places, labels in ((at_a, a), (at_b, b)):
        for k, label in enumerate(labels):
            places[label].append(k)

    def after(places: list[int], k: int) -> int | None:
        p = bisect_left(places, k)
        return places[p] if p < len(places) else None

    i, j = 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
            continue
        in_b, in_a = after(at_b[a[i]], j), after(at_a[b[j]], i)
        if in_b is None or in_a is not None and in_a - i < in_b - j:
            yield i, None
            i += 1
        else:
            yield None, j
            j += 1
    for k in range(i, len(a)):
        yield k, None
    for k in range(j, len(b)):
        yield None, k


def alike(a: Node, b: Node) -> bool:
    """Whether neighbours may be one repeated group: they have one label, and where that says nothing (a plain div or section)
    hold the same kinds of blocks. A menu, an article and a footer in plain blocks stay apart."""
    return a.label == b.label and (a.label not in ("div", "section") or {c.label for c in a.children} == {c.label for c in b.children})


def fold(items: list[Node], same_page: bool = True) -> list[Node]:
    """Neighbours of one label, or of two or three labels in turn, become one repeated group."""
    return _whole(_fold(items, same_page))


def _fold(items: list[Node], same_page: bool) -> Generator:
    for period in (1, 2, 3):
        i = 0
        while i + 2 * period <= len(items):
            if all(alike(items[i + k], items[i + period + k]) for k in range(period)):
                for k in range(period):
                    one, two = items[i + k], items[i + period + k]
                    joined = yield _merge(one, two, same_page)
                    joined.often = "*" if one.often in "?*" and two.often in "?*" else "+"
                    items[i + k] = joined
                del items[i + period : i + 2 * period]
            else:
                i += 1
    return items


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def page_tree(page: str) -> Node:
    """A page as a wrapper of itself."""
    root = Node("")
    stack = [root]
    for kind, what, aside in events(page):
        if kind == "open":
            child = Node(what, aside=aside)
            stack[-1].children.append(child)
            stack.append(child)
        elif kind == "close":
            done = stack.pop()
            done.children = fold(done.children)
            done.chars = sum(c.chars for c in done.children)
        else:
            stack[-1].children.append(Node("#", value=digest(what), chars=len(what)))
    root.children = fold(root.children)
    return root


@dataclass
class Region:
    """Where the article is: for each step down its label, which of the wrapper's blocks of that label it is, what kinds of
    blocks it holds, and what the others hold; texts in it that are the host's, by place and hash; and labels that look like
    an aside's but hold the article."""

    path: list[tuple[str, int, list[str], list[list[str]]]]
    constant: set[tuple[int, str]] = field(default_factory=set)
    kept: set[str] = field(default_factory=set)

    def dump(self) -> str:
        return json.dumps([self.path, sorted(self.constant), sorted(self.kept)])

    @classmethod
    def load(cls, text: str) -> Region:
        path, constant, kept = json.loads(text)
        return cls([tuple(p) for p in path], {(k, v) for k, v in constant}, set(kept))


def place(above: int, label: str) -> int:
    """A number for the labels on the way down to a block."""
    return zlib.crc32(label.encode("utf-8", "surrogatepass"), above)


def named_aside(node: Node) -> bool:
    """Whether a block counts as an aside only for its names, which may be wrong; comments are believed."""
    return node.aside and node.label.partition(".")[0] not in ASIDE and not COMMENTS.search(node.label)


#: A block named like an aside that has this share of the text outside of real ones holds the article.
MOST = 0.6


def misnamed(wrapper: Node) -> set[str]:
    """Labels of the blocks that are named like asides, but hold most of what the host's pages say."""
    total, named, todo = 0, [], [wrapper]
    while todo:
        node = todo.pop()
        for c in node.children:
            if c.label == "#":
                total += c.chars
            elif not c.aside or named_aside(c):
                if c.aside:
                    named.append(c)
                todo.append(c)
    return {c.label for c in named if c.chars and c.chars >= MOST * total}


def region(wrapper: Node) -> Region:
    """The article's region in a wrapper."""
    kept = misnamed(wrapper)
    best: tuple[int, int, tuple, Node] | None = None
    todo: list[tuple[Node, tuple]] = [(wrapper, ())]  # a path is (path above, parent, node)
    while todo:
        node, path = todo.pop()
        for c in node.children:
            if c.aside and c.label not in kept or c.label == "#":
                continue
            name, _, marks = c.label.partition(".")
            rank = 3 if name == "article" else 2 if name == "main" else 1 if marks and MAIN_WORD.search(marks.replace(".", " ")) else 0
            if rank and c.chars and (best is None or (rank > 1, c.chars if rank < 2 else 0, rank, c.chars) > (best[0] > 1, best[1] if best[0] < 2 else 0, best[0], best[1])):
                best = (rank, c.chars, (path, node, c), c)
            todo.append((c, (path, node, c)))
    if best is None:
        order = [wrapper]
        for node in order:
            order += node.children
        said: dict[int, int] = {}  # characters of slots; what all pages say tells nothing
        for node in reversed(order):
            said[id(node)] = (0 if node.value is not None and node.pages >= CONSTANT_PAGES else node.chars) if node.label == "#" else sum(said[id(c)] for c in node.children)
        node, path = wrapper, ()
        while True:
            # where one block has most of the slots' text, the article is in it
            inner = [c for c in node.children if c.label != "#" and (not c.aside or c.label in kept)]
            total = sum(said[id(c)] for c in node.children if not c.aside or c.label in kept)
            chosen = max(inner, key=lambda c: said[id(c)], default=None)
            if chosen is None or said[id(chosen)] < 0.7 * total or chosen.often in "+*" or all(c.label == "#" for c in chosen.children):
                break
            node, path = chosen, (path, node, chosen)
        best = (0, node.chars, path, node)
    constant, slots, todo2 = set(), 0, [(best[3], 0)]
    while todo2:
        node, at = todo2.pop()
        for c in node.children:
            if c.label != "#":
                todo2.append((c, place(at, c.label)))
            elif c.value is not None and c.pages >= CONSTANT_PAGES and c.pages >= 0.9 * best[3].pages:
                constant.add((at, c.value))
            else:
                slots += c.chars
    steps, up = [], best[2]
    while up:
        up, parent, node = up
        same = [c for c in parent.children if c.label == node.label]
        at = next(i for i, c in enumerate(same) if c is node)
        steps.append((node.label, at, sorted({c.label for c in node.children}), [sorted({c.label for c in x.children}) for x in same if x is not node]))
    return Region(steps[::-1], constant if slots else set(), kept)


@dataclass
class Block:
    """A block of a page, or a text in one (label '#')."""

    label: str
    aside: bool = False
    children: list[Block] = field(default_factory=list)
    text: str = ""


def blocks_of(page: str) -> Block:
    root = Block("")
    stack = [root]
    for kind, what, aside in events(page):
        if kind == "open":
            stack[-1].children.append(Block(what, aside))
            stack.append(stack[-1].children[-1])
        elif kind == "close":
            stack.pop()
        else:
            stack[-1].children.append(Block("#", text=what))
    return root


def _meant(found: list[Block], at: int, own: list[str], others: list[list[str]]) -> list[Block]:
    """Of a page's blocks of one label those that the wrapper means: by what they hold; else by their place, if there are as
    many as in the wrapper; else the one with the most text."""
    if len(found) < 2 or not others:
        return found

    def like(c: Block, kinds: list[str]) -> float:
        x, y = {b.label for b in c.children}, set(kinds)
        return len(x & y) / max(len(x | y), 1)

    sure = [c for c in found if like(c, own) > max(like(c, o) for o in others)]
    if sure:
        return sure
    if len(found) == 1 + len(others):
        return [found[at]]

    def size(c: Block) -> int:
        n, todo = 0, [c]
        while todo:
            x = todo.pop()
            n += len(x.text)
            todo += x.children
        return n

    return [max(found, key=size)]


def extract(page: str, chosen: Region | None) -> str:
    """Text of the blocks of a page in the wrapper's region, but those in asides and the host's own; where the page has no such
    region, in that of its own wrapper."""
    return _extract(blocks_of(page), page, chosen)


def _extract(root: Block, page: str, chosen: Region | None) -> str:
    own = chosen is None
    if own:
        chosen = region(page_tree(page))
    at = [root]
    for label, number, holds, others in chosen.path:
        at = [c for node in at for c in _meant([c for c in node.children if c.label == label and (not c.aside or label in chosen.kept)], number, holds, others)]
    if not at:
        return "" if own else _extract(root, page, None)
    out: list[str] = []
    todo = [(node, 0) for node in reversed(at)]
    while todo:
        node, key = todo.pop()
        if node.label == "#":
            if (key, digest(node.text)) not in chosen.constant:
                out.append(node.text)
            continue
        for c in reversed(node.children):
            # inside the article a header is the article's own
            if not c.aside or c.label in chosen.kept or c.label.startswith("header"):
                todo.append((c, key if c.label == "#" else place(key, c.label)))
    return " ".join(out)


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, group_pages: int = 256, fan_in: int = 32) -> DataFrame:
    """(host, wrapper json, n_pages), from all pages. The pages of a host that come by in one task are aligned one after the
    other; then fan_in partial wrappers at a time are merged, as often as the largest host needs if each of its tasks has
    group_pages of its pages."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("n"))
    most = hosts.agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // group_pages))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pages of one host that come by in one task are aligned at once, a bounded number of hosts at a time
        own: dict[str, tuple[Node, int]] = {}
        size = 0

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([json.dumps(w.dump()) for w, _ in own.values()], pa.string()), pa.array([n for _, n in own.values()], pa.int64())], names=["host", "wrapper", "n_pages"])

        for b in batches:
            for host, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                tree = page_tree(page.as_py() or "")
                if host in own:
                    own[host] = (merge(own[host][0], tree), own[host][1] + 1)
                else:
                    own[host] = (tree, 1)
                size += 1
                if size >= 20_000:
                    yield give()
                    own.clear()
                    size = 0
        yield give()

    def combine(t: pa.Table) -> pa.Table:
        joined, n = None, 0
        for w, k in sorted(zip(t.column("wrapper").to_pylist(), t.column("n_pages").to_pylist(), strict=True)):
            w = Node.load(json.loads(w))
            joined, n = w if joined is None else merge(joined, w), n + k
        return pa.table([[t.column("host")[0].as_py()], [json.dumps(joined.dump())], [n]], schema=pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("n_pages", pa.int64())]))

    out = pages.select("host", "html").mapInArrow(partial, "host string, wrapper string, n_pages long")
    while parts > fan_in:
        parts = -(-parts // fan_in)
        out = out.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(parts))).groupBy("host", "part").applyInArrow(combine, "host string, wrapper string, n_pages long")
    return out.groupBy("host").applyInArrow(combine, "host string, wrapper string, n_pages long")


#: Regions up to this many bytes together are broadcast; more are joined by host, hot hosts' pages in salted parts.
BROADCAST_BYTES = 32 << 20


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null or blank html gives an empty text. Pages without a host in their url (or a null url) share the host ''. Rows that
    repeat are returned as often; whole pages are read, however long."""
    p = columns(pages, page_id="long", url="string", html="string").withColumn("host", host_of(F.col("url")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [region(Node.load(json.loads(w))) for w in b.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([f.dump() for f in found], pa.string()), b.column("n_pages")], names=["host", "region", "n_pages"])

    regions = stored(infer_wrappers(p).mapInArrow(choose, "host string, region string, n_pages long"), "regions")
    size = regions.agg(F.sum(F.octet_length("region") + F.octet_length("host") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        joined = p.join(F.broadcast(regions.select("host", "region")), "host", "left")
    else:
        salts = regions.select("host", "region", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_pages") / 10_000))).alias("salt"))
        counted = p.join(regions.select("host", (F.floor(F.col("n_pages") / 10_000) + 1).alias("salts")).hint("shuffle_hash"), "host", "left")
        joined = counted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.col("salts"))).join(salts, ["host", "salt"], "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str | None, Region | None] = {}
        for b in batches:
            texts = []
            for page, chosen in zip(b.column("html"), b.column("region").to_pylist(), strict=True):
                if chosen not in cache:
                    if len(cache) > 10_000:
                        cache.clear()
                    cache[chosen] = Region.load(chosen) if chosen else None
                texts.append(extract(page.as_py() or "", cache[chosen]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "region").mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
