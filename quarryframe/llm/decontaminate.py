"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to k edits, k a share of its length. Cut into k + 1 pieces, at least one of them
then occurs unchanged. All pieces of all items are looked for in one pass (Aho-Corasick); a hit is verified bottom-up with
Myers' bit-parallel distance: spans of two pieces must match with one edit at most, spans of p pieces with p - 1, up to the
whole item with k, so that a chance hit costs a few steps only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table

#: An automaton holds items of about this many characters together (some 100 bytes each); more items take several passes.
BLOCK_CHARS = 4_000_000
ERROR_RATE = 0.1
MATCHES = "doc_id long, item_id long, distance int, budget int"
MATCHES_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32())])


def normalise(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def myers(pattern_bits: dict[str, int], m: int, text: str) -> int:
    """The least edit distance between a pattern of m characters and any substring of text (Myers 1999). pattern_bits has
    for each character the positions in the pattern that hold it."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now, best = full, 0, m, m
    get = pattern_bits.get
    for c in text:
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
            if now < best:
                best = now
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
    return best


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


class Items:
    """The automaton of the pieces of some items, and the spans above each piece."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        by_text: dict[str, list[int]] = defaultdict(list)
        for item_id, text in items:
            if t := normalise(text):
                by_text[t].append(item_id)
        self.texts, self.ids = list(by_text), list(by_text.values())
        self.budget = [int(rate * len(t)) for t in self.texts]
        at: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        #: of item i: piece boundaries; of (i, piece): the spans (from, to) of pieces around it, smallest first
        self.cuts: list[list[int]] = []
        self.above: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        self._bits: dict[tuple[int, int, int], dict[str, int]] = {}
        for i, t in enumerate(self.texts):
            p = self.budget[i] + 1
            cuts = [len(t) * j // p for j in range(p + 1)]
            self.cuts.append(cuts)
            for j in range(p):
                at[t[cuts[j] : cuts[j + 1]]].append((i, j, cuts[j]))
            self._spans(i, 0, p)
        self.automaton = ahocorasick.Automaton()
        for piece, uses in at.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def _spans(self, i: int, a: int, b: int) -> None:
        if b - a == 1:
            return
        mid = (a + b) // 2
        self._spans(i, a, mid)
        self._spans(i, mid, b)
        for j in range(a, b):
            self.above[i, j].append((a, b))

    def span_distance(self, i: int, a: int, b: int, text: str, start: int) -> int:
        """Least distance of pieces a to b of item i near the place where the item would start at `start` of text."""
        cuts, slack = self.cuts[i], b - a - 1
        lo, hi = cuts[a], cuts[b]
        if (key := (i, a, b)) not in self._bits:
            self._bits[key] = bits(self.texts[i][lo:hi])
        return myers(self._bits[key], hi - lo, text[max(0, start + lo - slack) : start + hi + slack])

    def matches(self, text: str | None) -> dict[int, int]:
        """For each item (by its index) within its budget anywhere in text: the least distance found."""
        found: dict[int, int] = {}
        t = normalise(text)
        if self.empty or not t:
            return found
        tried: set[tuple[int, int, int, int]] = set()
        for end, (size, uses) in self.automaton.iter(t):
            for i, j, offset in uses:
                if found.get(i) == 0:
                    continue
                start = end + 1 - size - offset
                distance = 0
                for a, b in self.above[i, j] if (i, j) in self.above else ():
                    if (key := (i, a, b, start)) in tried:
                        distance = -1
                        break
                    tried.add(key)
                    distance = self.span_distance(i, a, b, t, start)
                    if distance > b - a - 1:
                        distance = -1
                        break
                if distance >= 0 and distance < found.get(i, 1 << 30):
                    found[i] = distance
        return found


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in lists of about block_chars characters."""
    items = columns(benchmark, item_id="long", text="string").filter(F.length(F.trim("text")) > 0).distinct()
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        yield [(r.item_id, r.text) for r in items.filter(F.col("block") == k).select("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget: each pair of a document and a test item that occurs in it within its budget of
    floor(rate * length) edits, with the least distance found. Case and the kind of white space don't count.

    Whole texts are searched. Null and blank documents and items match nothing; rows that repeat give one row; null
    doc_ids are reported as null. Items that are more than block_chars together are searched for in several passes of
    bounded size."""
    d = columns(docs, doc_id="long", text="string")
    out = None
    for some in item_blocks(benchmark, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(some)
        one = d.mapInArrow(_searcher(sent, rate), MATCHES)
        out = one if out is None else out.unionAll(one)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.first("budget").alias("budget"))


def _searcher(sent, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, rate)
        for b in batches:
            rows = []
            ids = b.column("doc_id")
            for n, text in enumerate(b.column("text")):
                for i, distance in items.matches(text.as_py()).items():
                    rows += [(ids[n].as_py(), item_id, distance, items.budget[i]) for item_id in items.ids[i]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], MATCHES_ARROW.field(k).type) for k in range(4)], schema=MATCHES_ARROW)

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs, with all columns, without the rows that hold a test item: one pass for each block of items, no shuffle."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")

    def filterer(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, rate)
            for b in batches:
                yield b.filter(pa.array([not items.matches(t.as_py()) for t in b.column(at)], pa.bool_()))

        return run

    for some in item_blocks(benchmark, block_chars):
        safe = safe.mapInArrow(filterer(docs.sparkSession.sparkContext.broadcast(some)), safe.schema)
    return safe.toDF(*names)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
