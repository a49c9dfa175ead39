"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits (ASCII punctuation separates, A-Z is lower-cased). Documents and
benchmark items join on shared ``MIN_TILE``-word seeds, found by Karp-Rabin hashes of every window. In the words
that lie under a pair's seeds the longest match of equal words is marked, then again the longest among what stays
unmarked, until none of ``MIN_TILE`` words is left (ties: the first place in the document, then in the item). The
share of an item's words under tiles is its coverage, whatever order the passages stand in. A document is
contaminated by an item at a coverage of ``COVERAGE`` or more.

Scale: documents never shuffle. Benchmark items go to the tasks in blocks of at most ``BLOCK_WORDS`` words
(or one item); each block is one pass over the documents, its rows are written and its broadcast is released before the
next, so driver and executors hold one block whatever the benchmark's size. Seeds are never listed in pairs: matches
are followed along all diagonals at once, item word by item word, in memory proportional to the document, so a long
repetitive text costs time (its words by the item's for each distinct tile length) but not memory.

Defined cases: null and empty texts match nothing; items under ``MIN_TILE`` words match where their whole
word sequence occurs; rows that repeat give repeated rows, repeated item texts match each; a null doc_id or
item_id keeps its row; empty tables give no rows; other columns are ignored. ``clean`` judges each row by its own text,
whatever its doc_id. Hash hits only select places; words are compared as bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelink.llm.common import as_bytes, dropped, texts, written

MIN_TILE = 5
COVERAGE = 0.5
BLOCK_WORDS = 500_000
KEPT = 64
SCHEMA = "doc_id long, item_id long, n_words long, n_covered long, n_tiles long"

_BASE = np.uint64(0x100000001B3)
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 mixed bits for each word."""
    n = len(words)
    low = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    high = np.fromiter(map(zlib.adler32, words), np.uint64, n)
    mixed = (low << np.uint64(32) ^ high) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ mixed >> np.uint64(29)


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    rolled = np.zeros(n, np.uint64)
    for i in range(size):
        rolled = rolled * _BASE + codes[i : i + n]
    return rolled


def longest(doc: np.ndarray, item: np.ndarray, size: int) -> tuple[int, list[tuple[int, int]], bool]:
    """The greatest length (at least ``size``) at which unmarked words agree, its places (document, item) in order, and whether these are all.

    Marked words are negative, differently so in both. Of each item word at most ``KEPT`` places are held, so places
    beyond the last held one of a cut row are left for another call.
    """
    best, ends = size, []
    order = np.argsort(doc, kind="stable")
    sorted_doc = doc[order]
    lengths, last = np.zeros(len(doc) + 1, np.int32), np.zeros(0, np.int64)  # of the match that ends before a place
    for i, word in enumerate(item):
        at = order[np.searchsorted(sorted_doc, word) : np.searchsorted(sorted_doc, word, side="right")]
        now = lengths[at] + 1
        lengths[last + 1] = 0
        lengths[at + 1] = now
        last = at
        top = int(now.max(initial=0))
        if top >= best:
            if top > best:
                best, ends = top, []
            ends.append((i, (at[now == top] + 1)[: KEPT + 1].copy()))
    cut = [int(at[KEPT - 1]) for _, at in ends if len(at) > KEPT]
    limit = min(cut, default=len(doc))
    places = sorted((int(d) - best, i + 1 - best) for i, at in ends for d in at[:KEPT] if d <= limit)
    return best, places, not cut


def tiles(doc: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word number sequences: tiles (document, item, length), longest first."""
    doc, item = doc.copy(), item.copy()
    doc[doc < 0], item[item < 0] = -1, -2
    found: list[tuple[int, int, int]] = []
    while True:
        length, places, _ = longest(doc, item, size)
        if not places:
            return found
        for d, i in places:
            if (doc[d : d + length] >= 0).all() and (item[i : i + length] >= 0).all():
                found.append((d, i, length))
                doc[d : d + length], item[i : i + length] = -1, -2


class Items:
    """Seed index of a block of benchmark items."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        self.rows = [(item_id, words_of(text)) for item_id, text in rows]
        self.sizes = sorted({min(MIN_TILE, len(words)) for _, words in self.rows if words})
        self.numbers: dict[bytes, int] = {}  # the items' words
        self.items = [np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int32) for _, words in self.rows]
        self.index: dict[int, dict[int, dict[int, int]]] = {s: defaultdict(lambda: defaultdict(int)) for s in self.sizes}
        for k, (_, words) in enumerate(self.rows):
            if size := min(MIN_TILE, len(words)):
                for h in window_hashes(word_hashes(words), size).tolist():
                    self.index[size][h][k] += 1  # how many windows of the item carry the seed
        self.keys = {s: np.array(sorted(x), np.uint64) for s, x in self.index.items()}
        self.light = {}
        for s, keys in self.keys.items():  # a bit for each 20-bit prefix, to pass over most windows
            self.light[s] = np.zeros(1 << 20, bool)
            self.light[s][(keys >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, text: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(item position, its words, covered words, tiles) for each item of enough coverage."""
        words = words_of(text)
        codes = word_hashes(words)
        for size in self.sizes:
            grams = window_hashes(codes, size)
            at = np.flatnonzero(self.light[size][(grams >> np.uint64(44)).astype(np.int64)])
            keys = self.keys[size]
            at = at[keys[np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)] == grams[at]]
            met = defaultdict(list)
            for h in set(grams[at].tolist()):
                for k in self.index[size][h]:
                    met[k].append(h)
            for k, seeds in met.items():
                item, n = self.items[k], len(self.items[k])
                if size * sum(self.index[size][h][k] for h in seeds) < COVERAGE * n:  # tiles lie under seeds
                    continue
                own = at[np.isin(grams[at], np.array(seeds, np.uint64))]
                found = tiles(self._under(words, own, size), item, size)
                if (covered := sum(x[2] for x in found)) >= COVERAGE * n:
                    yield k, n, covered, len(found)

    def _under(self, words: list[bytes], at: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the words under the windows at ``at``, with -1 between separate stretches and for words of no item."""
        begins = np.append(True, np.diff(at) > size)
        firsts, lasts = at[begins], at[np.append(begins[1:], True)] + size
        number, out = self.numbers.get, []
        for a, b in zip(firsts.tolist(), lasts.tolist()):
            out += [number(w, -1) for w in words[a:b]]
            out.append(-1)
        return np.array(out, np.int32)


_ITEMS: dict[str, Items] = {}


def _items(name: str, rows: list[tuple[int | None, bytes]]) -> Items:
    """The index of a block, built once in a worker; the one before goes."""
    if name not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[name] = Items(rows)
    return _ITEMS[name]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    block, size = [], 0
    for row in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        block.append((row.item_id, row.text.encode()))
        size += len(block[-1][1]) // 4
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _pass(docs: DataFrame, block: list[tuple[int | None, bytes]], work: Callable[[Items, pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """The rows of one pass over ``docs`` with a block of items, written; the block's broadcast is released."""
    shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(name, shared.value)
        for b in batches:
            yield work(items, b)

    rows = written(docs.mapInArrow(run, schema))
    shared.destroy()
    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_tiles, coverage) for each contaminated document and item."""
    names = ["doc_id", "item_id", "n_words", "n_covered", "n_tiles"]

    def found(items: Items, b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(d, items.rows[k][0], n, c, t) for d, text in zip(b.column("doc_id").to_pylist(), as_bytes(b, "text")) for k, n, c, t in items.matches(text)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5)], names)

    parts = [_pass(texts(docs), block, found, SCHEMA) for block in _blocks(benchmark)]
    rows = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], SCHEMA)
    return rows.withColumn("coverage", F.col("n_covered") / F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that some item contaminates: one narrow pass for each block of items, no shuffle."""

    def rest(items: Items, b: pa.RecordBatch) -> pa.RecordBatch:
        whole = pa.compute.fill_null(b.column("text"), "").cast(pa.binary()).to_pylist()
        return b.filter(pa.array([next(items.matches(t), None) is None for t in whole], pa.bool_()))

    before = None
    for block in _blocks(benchmark):
        docs = _pass(docs, block, rest, docs.schema)
        if before is not None:
            dropped(before)
        before = docs
    return docs
