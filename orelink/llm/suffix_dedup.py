"""Repeated passages across documents by sparse suffix arrays.

Words are runs outside ``[\\x20\\x09-\\x0D]``. A suffix is retained at the positions whose ``GRAM``-word hash is
the least of ``WINDOW`` neighbouring ones; any ``PASSAGE`` words hold such a position, chosen by content
alone, so two documents that share a passage retain the same place in it. Retained suffixes whose gram
occurs in one document only are let go; the rest are sorted by the words that follow, neighbours are
compared, and a match is extended to the right and left. Matches of ``PASSAGE`` words or more with another
document are kept, and overlapping ones of a document merge into spans.

A neighbour in this order shares most words to the right, but another suffix may share fewer to the right and more
to the left. So a suffix is settled only if its matches reach as far as LEFT and RIGHT words or its text go, or if
its gram has two members and they met. Any other sends its gram to a second step: every member of that gram
hashes the windows of ``PASSAGE`` words whose least gram it is, and windows found in two documents are matches.
Grams of the second step are told by a bitmap of fixed size; a gram that shares a bit with one of them hashes its windows too, which finds true matches again.
This also covers the first and last suffix of each sorted partition and neighbours in one document. Hence:
the spans cover exactly the words that lie in passages of ``PASSAGE`` words that another document has as well.

A match longer than LEFT and RIGHT words is not followed beyond them: every ``PASSAGE`` words of a passage hold a retained
position of their own, whose spans overlap and merge, so passages of any length are covered whole. Words are
compared by 31 bits of a hash each, 50 of them in a row at least; windows of the second step by 64 bits.

Scale: about 2 / (WINDOW + 1) of the positions are rows of 20 bytes; only the retained ones that occur in two
documents carry their surrounding words. Texts shuffle once, by document. The sort is by range over (gram, leading words,
document, position), so a passage in a third of all documents spreads over tasks; the words around a position are dealt out once, for that sort; grams and windows of more than a
thousandth of the rows are joined by broadcast (``common.keyed_join``). Only the result's table stays.

Defined cases: null and empty texts, and texts under ``PASSAGE`` words, have no spans; rows that share a
doc_id are one document (repeats among them do not count), each with its own spans, equal rows give one
set; null doc_ids count as one document; ties, passages found at several places or in several documents, are all
covered; an empty table has no spans; a text of any length is read whole; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelink.llm.common import as_bytes, dropped, keyed_join, texts, written

PASSAGE = 50
GRAM = 25
WINDOW = PASSAGE - GRAM + 1
LEFT, RIGHT = PASSAGE - GRAM, PASSAGE
WIDTH = LEFT + RIGHT
BITS = 26  # of the bitmap of grams, 8 MB

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_BASE = np.uint64(_BASE)
_NULL_ID = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _codes(text: bytes) -> np.ndarray:
    words = text.split()
    low, high = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)), np.fromiter(map(zlib.adler32, words), np.uint64, len(words))
    return _mixed(low << np.uint64(32) ^ high)


def _rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` codes, from prefix sums of a polynomial modulo 2^64."""
    n = len(codes)
    if n < size:
        return np.zeros(0, np.uint64)
    powers = np.ones(n, np.uint64)
    powers[1:] = _INVERSE
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64, out=sums[1:])
    powers[1:] = _BASE
    return _mixed((sums[size:] - sums[:-size]) * np.cumprod(powers, dtype=np.uint64)[: n - size + 1])


def _minimisers(grams: np.ndarray) -> np.ndarray:
    """For each window of ``PASSAGE`` words the position of its least gram, the first of equal ones."""
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return np.concatenate([views[i : i + 4096].argmin(axis=1) + np.arange(i, min(i + 4096, len(views))) for i in range(0, len(views), 4096)])


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Retained positions and their gram hashes."""
    grams = _rolled(codes, GRAM)
    at = np.unique(_minimisers(grams))
    return at, grams[at]


def _retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_anchors(_codes(t)) for t in as_bytes(b, "text")]
        rows = np.repeat(np.arange(b.num_rows), [len(x[0]) for x in found])
        at = np.concatenate([x[0] for x in found] or [np.zeros(0, np.int64)]).astype(np.int32)
        grams = np.concatenate([x[1] for x in found] or [np.zeros(0, np.uint64)]).view(np.int64)
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([pa.array(grams), b.column("doc_id").take(take), b.column("body").take(take), pa.array(at)], ["gram", "doc_id", "body", "pos"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around each position: RIGHT from it on, then LEFT before it from right to left; 0 beyond the text."""
    offsets = np.concatenate([np.arange(RIGHT), -1 - np.arange(LEFT)])
    for b in batches:
        for doc_id, body, text, places in zip(b.column("doc_id"), b.column("body"), as_bytes(b, "text"), b.column("places").to_pylist()):
            codes = _codes(text)
            at = np.array(places, np.int64)
            where = at[:, None] + offsets
            inside = (where >= 0) & (where < len(codes))
            short = (codes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            words = np.where(inside, short[np.where(inside, where, 0)], np.uint32(0)).astype(">u4")
            grams = _rolled(codes, GRAM)
            chosen, starts = _minimisers(grams), at[:, None] - np.arange(WINDOW)
            whole = (starts >= 0) & (starts < len(chosen))
            own = (whole & (chosen[np.where(whole, starts, 0)] == at[:, None])) @ (1 << np.arange(WINDOW))  # bit j: the position is the least of the window that starts j words before
            n = len(at)
            around = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * WIDTH * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(words))])
            yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), around, pa.array([doc_id.as_py()] * n, pa.int64()), pa.array([body.as_py()] * n, pa.int64()), pa.array(at.astype(np.int32)), pa.array(own.astype(np.int32))], ["gram", "around", "doc_id", "body", "pos", "own"])


_AROUND = "gram long, around binary, doc_id long, body long, pos int, own int"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint32).reshape(-1, WIDTH)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading columns in which rows agree, within the text."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare sorted neighbours; a row for each suffix: its span (first, last), its gram unless the span is maximal, and whether it met a neighbour of its gram."""
    held = None  # the last row so far: gram, around, doc, body, pos, first, last, met

    def settled(gram, around, doc, body, pos, first, last, met):
        done = (pos - first == (around[:, RIGHT:] != 0).sum(axis=1)) & (last - pos == (around[:, :RIGHT] != 0).sum(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, mask=doc == _NULL_ID), pa.array(body), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(gram, mask=done & (last - first >= PASSAGE)), pa.array(met)],
            ["doc_id", "body", "first", "last", "gram", "met"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        gram, around = b.column("gram").to_numpy(), _matrix(b.column("around"))
        doc, body = b.column("doc_id").fill_null(_NULL_ID).to_numpy(), b.column("body").to_numpy()
        pos = b.column("pos").to_numpy().astype(np.int64)
        first, last, met = pos.copy(), pos.copy(), np.zeros(len(pos), bool)
        if held is not None:
            gram, around, doc, body, pos, first, last, met = (np.concatenate([h, x]) for h, x in zip(held, (gram, around, doc, body, pos, first, last, met)))
        right, left = _shared(around[:-1, :RIGHT], around[1:, :RIGHT]), _shared(around[:-1, RIGHT:], around[1:, RIGHT:])
        same = gram[:-1] == gram[1:]
        match = same & (doc[:-1] != doc[1:]) & (right + left >= PASSAGE)
        for rows in (slice(None, -1), slice(1, None)):
            first[rows] = np.where(match, np.minimum(first[rows], pos[rows] - left), first[rows])
            last[rows] = np.where(match, np.maximum(last[rows], pos[rows] + right), last[rows])
            met[rows] |= same
        yield settled(*(x[:-1] for x in (gram, around, doc, body, pos, first, last, met)))
        held = tuple(x[-1:] for x in (gram, around, doc, body, pos, first, last, met))
    if held is not None:
        yield settled(*held)


def gram_bits(grams: DataFrame) -> np.ndarray:
    """``2**BITS`` bits, set at the leading bits of the grams: at most 2**(BITS - 15) rows of 4 KB reach the driver."""
    place = grams.select(F.shiftrightunsigned("gram", 64 - BITS).alias("v")).groupBy(F.expr("v div 32768").alias("b"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in place.agg(F.bitmap_construct_agg(F.expr("v % 32768")).alias("m")).collect():
        out[r.b * 4096 : r.b * 4096 + len(r.m)] = np.frombuffer(r.m, np.uint8)
    return out


def _has(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = grams.view(np.uint64) >> np.uint64(64 - BITS)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _windows(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of PASSAGE words whose least gram is a position's, for the grams of ``bits``: every window comes from one position, the same one in every document."""
    for b in batches:
        b = b.filter(pa.array(_has(bits, b.column("gram").to_numpy())))
        words = _matrix(b.column("around"))
        line = np.concatenate([words[:, : RIGHT - 1 : -1], words[:, :RIGHT]], axis=1).astype(np.uint64)  # left to right, LEFT words before the position
        own = b.column("own").to_numpy()
        for j in range(WINDOW):  # the window starts j words before the position
            at, ok = LEFT - j, np.flatnonzero(own >> j & 1)
            h, held = np.zeros(len(ok), np.uint64), line[ok, at : at + PASSAGE]
            for i in range(PASSAGE):
                h = _mixed(h * _BASE + held[:, i])
            take = pa.array(ok)
            start = pa.array((b.column("pos").to_numpy()[ok] - j).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("doc_id").take(take), b.column("body").take(take), start], ["h", "doc_id", "body", "first"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last, n_words): spans of words, ``last`` exclusive, that repeat in other documents."""
    full = texts(docs).withColumn("body", F.xxhash64("text"))
    held = written(full.mapInArrow(_retain, "gram long, doc_id long, body long, pos int"))
    other = F.coalesce(F.min("doc_id") != F.max("doc_id"), F.lit(False)) | ((F.count("doc_id") > 0) & (F.count("doc_id") < F.count("*")))
    grams = written(held.groupBy("gram").agg(other.alias("two"), F.count("*").alias("_rows")).where("two").select("gram", "_rows"))

    kept = keyed_join(held, grams, ["gram"]).select("doc_id", "body", "pos")
    lists = kept.groupBy("doc_id", "body").agg(F.collect_set("pos").alias("places")).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "places")
    joined = full.join(lists, full["doc_id"].eqNullSafe(lists["_id"]) & (full["body"] == lists["_body"]))
    rows = written(joined.select("doc_id", "body", "text", "places").mapInArrow(_around, _AROUND))  # the only shuffle of text; the range sample reads it too
    dropped(held)
    near = F.substring("around", 1, 16)  # the leading words, in the order of all of them
    dealt = rows.repartitionByRange("gram", near, "doc_id", "body", "pos").sortWithinPartitions("gram", "around", "doc_id", "body", "pos")
    compared = written(dealt.mapInArrow(_neighbours, "doc_id long, body long, first int, last int, gram long, met boolean"))
    unsettled = compared.where("gram is not null").groupBy("gram").agg(F.min("met").alias("met")).join(grams, "gram").where("_rows > 2 or not met")
    bits = docs.sparkSession.sparkContext.broadcast(gram_bits(unsettled))
    hashed = lambda batches: _windows(batches, bits.value)
    windows = written(rows.mapInArrow(hashed, "h long, doc_id long, body long, first int"))
    bits.destroy()
    dropped(rows, grams)
    twice = written(windows.groupBy("h").agg(other.alias("two"), F.count("*").alias("_rows")).where("two").select("h", "_rows"))
    more = keyed_join(windows, twice, ["h"]).select("doc_id", "body", "first", (F.col("first") + PASSAGE).alias("last"))
    spans = written(_merged(compared.where(F.col("last") - F.col("first") >= PASSAGE).select("doc_id", "body", "first", "last").unionByName(more)))
    dropped(compared, windows, twice)
    return spans


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document joined."""
    line = Window.partitionBy("doc_id", "body").orderBy("first", "last")
    before = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.distinct().withColumn("new", F.coalesce((F.col("first") > before).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "body", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.select("doc_id", "first", "last", (F.col("last") - F.col("first")).alias("n_words"))
