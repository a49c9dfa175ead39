"""Phrase collocation mining: bounded-depth suffix automata per shard, counts reduced globally, subsumption along links.

Texts, with A-Z lower-cased, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. A task gathers the pieces of one language into shards of
about ``SHARD`` words and builds the generalised suffix automaton of each, bounded in depth, from its suffix-link tree: the nodes of depth k are the classes of
positions whose last k words agree, found by refining the classes of depth k - 1 by one more word to the left; a class's size is its endpos count, its
class of depth k - 1 is where its link leads, and nodes of one endpos set are one state. The substrings of the states, with their endpos counts, are
summed over all shards.

Exact pruning: a phrase found ``least`` times has words and pairs found as often. Three passes count words, pairs of frequent words, and longer phrases of
frequent pairs. A pass knows the frequent ones by a bitmap of ``2**BITS`` bits (8 MB, whatever the corpus), built by Spark's bitmap aggregates; bits that
collide let more phrases through to the exact counts and never lose one.

Subsumption: a candidate's link leads to it without its first word, its transition came from it without its last; any longer phrase that holds a
phrase is reached by such steps over phrases at least as frequent as it, so each candidate only looks at those one word longer.

Scale: counts combine on the map side; a hot word is one row a shard. Parts of candidates join their counts by ``keyed_join``; the first
``top`` of each language are cut in every partition before they meet (row_number with a limit). A task holds at most ``HELD`` words of all languages, or one text.

Defined cases: a null text has no piece; a null language is ``und``; rows that repeat count as often; a text of any length is read whole; scores that tie
fall to the more frequent phrase, then to the least in byte order; a language without candidates has no rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelink.llm.common import as_bytes, dropped, keyed_join, written

SHARD, HELD = 1 << 18, 1 << 19
READ, SENT = 64, 1 << 14  # rows at a time, in and out
BITS = 26
DEPTH = 4
_BREAK = b"\xff"  # a byte that UTF-8 never has
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)
_SEED = 42  # of Spark's xxhash64


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, with ``_BREAK`` between pieces."""
    return text.lower().translate(_PIECES).replace(_BREAK, b" \xff ").split()  # bytes.lower and bytes.split know ASCII only


@dataclass
class Automaton:
    """States by number; 0 is the root. A state's substrings end at ``at``; they have up to ``longest`` words, and more than the state at its ``link``."""

    at: np.ndarray
    longest: np.ndarray
    link: np.ndarray
    endpos: np.ndarray

    def ends(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the distinct substrings of k words end for the first time, and their endpos counts."""
        holds = (self.longest >= k) & (self.longest[self.link] < k)
        return self.at[holds], self.endpos[holds]


def automaton(ids: np.ndarray, depth: int, passes=None) -> Automaton:
    """The suffix automaton of the pieces in ``ids`` (0 between pieces), of substrings up to ``depth`` words.

    ``passes(ends, k)`` tells which of the substrings of k words that end at ``ends`` are followed any further; those left out get no state.
    """
    ends = np.flatnonzero(ids)
    node = np.zeros(len(ids), np.int64)  # of each position, its node at the depth reached
    size, at, length, up = [np.array([len(ends)])], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    made = 1
    for k in range(1, depth + 1):
        ends = ends[ends >= k - 1]
        ends = ends[ids[ends - k + 1] > 0]
        if passes is not None:
            ends = ends[passes(ends, k)]
        wide = node[ends] * (int(ids.max(initial=0)) + 1) + ids[ends - k + 1]
        _, first, inverse, count = np.unique(wide, return_index=True, return_inverse=True, return_counts=True)
        size.append(count), at.append(ends[first]), length.append(np.full(len(count), k)), up.append(node[ends[first]])
        node = np.zeros(len(ids), np.int64)
        node[ends] = made + inverse
        made += len(count)
    size, at, length, up = map(np.concatenate, (size, at, length, up))
    # a node whose endpos set is that of its child one word longer is the same state
    child = np.arange(1, made)[size[1:] == size[up[1:]]]
    child = child[up[child] > 0]
    top = np.arange(made)
    top[up[child]] = child
    for _ in range(depth):
        top = top[top]
    states = np.flatnonzero(top == np.arange(made))
    number = np.zeros(made, np.int64)
    number[states] = np.arange(len(states))
    bottom = up[states]
    for _ in range(depth):  # from a state's longest substring down to the first one of another state
        same = top[bottom] == states
        same[0] = False
        bottom = np.where(same, up[bottom], bottom)
    return Automaton(at[states], length[states], number[bottom], size[states])


def word_hashes(vocabulary: list[bytes], lang: bytes) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang, _SEED)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))


def _turn(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(1)) | (h >> np.uint64(63))


class Shard:
    """Words of one language, numbered from 1 in the order they appear."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[_BREAK]  # number 0
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, text: bytes) -> int:
        """Takes a text in; gives its number of words, breaks included."""
        found = tokens(text)
        self.parts += [np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found)), np.zeros(1, np.int64)]
        self.words += len(found)
        return len(found)

    def counts(self, lang: str, depth: int, known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """(lang, k, phrase, f) of the substrings that this pass counts; ``known``: the bitmap of what the last pass found frequent."""
        ids, vocabulary = np.concatenate(self.parts), list(self.numbers)
        passes, shortest = None, depth
        if depth > 1:
            hashes = word_hashes(vocabulary, lang.encode())
            has = lambda h: (known[(h >> np.uint64(64 - BITS + 3)).astype(np.int64)] >> ((h >> np.uint64(64 - BITS)) & np.uint64(7)).astype(np.uint8)) & 1 == 1
            if depth == 2:
                frequent = has(hashes)
                passes = lambda ends, k: frequent[ids[ends - k + 1]]
            else:
                shortest = 3
                pairs = has(_turn(hashes[ids[:-1]]) ^ hashes[ids[1:]])
                passes = lambda ends, k: pairs[ends - k + 1] if k > 1 else np.full(len(ends), True)
        states = automaton(ids, depth, passes)
        table = pa.array(vocabulary, pa.binary())
        for k in range(shortest, depth + 1):
            at, endpos = states.ends(k)
            for i in range(0, len(at), SENT):
                here, f = at[i : i + SENT], endpos[i : i + SENT]
                cells = [table.take(pa.array(ids[here - k + 1 + j])) for j in range(k)]
                phrase = pc.binary_join_element_wise(*cells, pa.scalar(b" ", pa.binary())) if k > 1 else cells[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(np.full(len(f), k, np.int32)), phrase.cast(pa.string()), pa.array(f)], ["lang", "k", "phrase", "f"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Language and text of each row, a few rows of a batch at a time as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, READ):
            part = b.slice(i, READ)
            yield from zip(part.column("lang").to_pylist(), as_bytes(part, "text"))


def _counted(depth: int, known=None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, np.uint8) if known is not None else None
        shards: dict[str, Shard] = {}
        held = 0
        for lang, text in _rows(batches):
            shard = shards.setdefault(lang, Shard())
            held += shard.add(text)
            full = lang if shard.words >= SHARD else max(shards, key=lambda x: shards[x].words) if held >= HELD else None
            if full is not None:
                held -= shards[full].words
                yield from shards.pop(full).counts(full, depth, bits)
                pa.default_memory_pool().release_unused()
        for lang, shard in shards.items():
            yield from shard.counts(lang, depth, bits)

    return count


def bitmap(phrases: DataFrame) -> bytes:
    """``2**BITS`` bits, set at the hashes of the phrases (of one or two words): at most 2**(BITS - 15) rows of 4 KB reach the driver."""
    words = F.split("phrase", " ")
    hashes = F.transform(words, lambda w: F.xxhash64("lang", w))
    turned = F.shiftleft(hashes[0], 1).bitwiseOR(F.shiftrightunsigned(hashes[0], 63))
    full = F.when(F.size("h") == 1, F.col("h")[0]).otherwise(F.col("turned").bitwiseXOR(F.get("h", F.lit(1))))
    place = phrases.select(hashes.alias("h"), turned.alias("turned")).select(F.shiftrightunsigned(full, 64 - BITS).alias("v"))
    rows = place.groupBy(F.expr("v div 32768").alias("b")).agg(F.bitmap_construct_agg(F.expr("v % 32768")).alias("m")).collect()
    out = bytearray(1 << (BITS - 3))
    for r in rows:
        out[r.b * 4096 : r.b * 4096 + len(r.m)] = r.m
    return bytes(out)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Texts go to Python ``rows`` at a time, on both sides of the pipe, while the plans inside run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def phrase_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of one to four words found at least ``least`` times, and (lang, n), both written."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    context, schema = docs.sparkSession.sparkContext, "lang string, k int, phrase string, f long"
    total = lambda rows: rows.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    words = written(total(texts.mapInArrow(_counted(1), schema)))
    n = written(words.groupBy("lang").agg(F.sum("f").alias("n")))
    found = [written(words.where(F.col("f") >= least))]
    dropped(words)
    for depth in (2, DEPTH):
        known = context.broadcast(bitmap(found[-1]))
        found.append(written(total(texts.mapInArrow(_counted(depth, known), schema)).where(F.col("f") >= least)))
        known.destroy()
    phrases = written(found[0].unionByName(found[1]).unionByName(found[2]))
    dropped(*found)
    return phrases, n


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of the candidates: phrases of two words or more, by their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = phrases.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    joined = lambda x: F.array_join(x, " ")
    sides = cuts.select("lang", "phrase", "k", "a", "cut", F.explode(F.array(F.struct(F.lit("l").alias("side"), joined(F.slice("w", 1, F.col("cut"))).alias("part")), F.struct(F.lit("r").alias("side"), joined(F.slice("w", F.col("cut") + 1, F.col("k"))).alias("part")))).alias("x"))
    sides = written(sides.select("lang", "phrase", "k", "a", "cut", "x.side", "x.part"))
    asked = sides.groupBy("lang", "part").agg(F.count("*").alias("_rows"))
    known = written(asked.join(phrases.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]))
    pairs = keyed_join(sides, known, ["lang", "part"]).groupBy("lang", "phrase", "k", "a", "cut").agg(F.sum(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.sum(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    score = F.expr("cast((cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r) as long)")
    lowest = pairs.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    out = written(lowest.select("lang", "phrase", "k", "a", "c.l", "c.r", "c.score"))
    dropped(sides, known)
    return out


def subsumed(candidates: DataFrame, share: int) -> DataFrame:
    """(lang, phrase) of the candidates that lie in a longer one with at least ``share`` percent of their count."""
    words, k = F.split("phrase", " "), F.col("k")
    links = F.array(F.array_join(F.slice(words, 2, k - 1), " "), F.array_join(F.slice(words, 1, k - 1), " "))
    held = candidates.where("k > 2").select("lang", F.explode(links).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(held, ["lang", "phrase"]).where(100 * F.col("longer") >= share * F.col("a")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), the first ``top`` of each language (None: all)."""
    with small_batches(docs.sparkSession):
        phrases, n = phrase_counts(docs, least)
    candidates = scored(phrases)
    left = candidates.join(subsumed(candidates, share), ["lang", "phrase"], "left_anti")
    line = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(line))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    sizes = n.select("lang", "n")  # languages: a row each; Spark broadcasts it only below its threshold
    out = written(ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    dropped(phrases, n, candidates)
    return out
