"""Quality rules: structural base rules and a hashed n-gram log-likelihood ratio.

Words are runs outside ``[\\x20\\x09-\\x0D]``. A document fails the base rules below ``MIN_WORDS`` words or
when words in 8-word windows that occur twice or more make up over ``REPEAT_PERCENT`` % of its words.
Otherwise its byte 4-grams, hashed to ``BUCKETS`` buckets, are scored with the mean log ratio of two
smoothed multinomials: a trusted target (all documents labelled good) against the raw corpus (every document). A score under ``THRESHOLD``
rejects; the threshold is a constant, so each verdict depends on the text and the two tables alone.

Scale: one pass counts (bucket sums, at most ``BUCKETS`` rows for each task, summed with map-side combine),
one pass scores with a table of fixed size. Neither shuffles text, unless the ids of good documents are sparse (``_marked``).

Defined cases: a null text has no words and fails; texts under four bytes score 0; very long texts are read whole, in
chunks; a score equal to the threshold keeps; a null doc_id keeps its row; repeated rows get equal rows and each counts in
the corpus; without any label or any text every score is 0; an empty table gives no rows; other columns stay as they are, but for those named like a result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orelink.llm.common import as_bytes, texts

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
BUCKETS = 1 << 14
GRAM = 4
SMOOTHING = 20.0
THRESHOLD = -0.25
BITMAPS = 8192  # of 4 KB, or 32,768 ids, each
SYMBOLS = b"#*$%&|<>"
_CHUNK = 1 << 20

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_STARTS = np.array([b & 0xC0 != 0x80 for b in range(256)])  # the first byte of a code point
_STARTS[[0x20, *range(0x09, 0x0E)]] = False


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur at least twice."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    rolled = np.zeros(n - WINDOW + 1, np.uint64)
    for i in range(WINDOW):  # a polynomial over 64-bit word hashes
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + (ids[i : n - WINDOW + 1 + i] ^ (ids[i : n - WINDOW + 1 + i] >> np.uint64(29)))
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(rolled), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    edges[: len(twice)] += twice
    edges[WINDOW : WINDOW + len(twice)] -= twice
    return int((np.cumsum(edges)[:n] > 0).sum())


def base_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    codes = np.frombuffer(text, np.uint8)
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return len(words), int(_STARTS[codes].sum()), int(_IS_SYMBOL[codes].sum()), again, repeated_words(words)


def gram_buckets(text: bytes) -> Iterator[np.ndarray]:
    """Hash buckets of a text's byte 4-grams, in chunks of bounded size."""
    codes = np.frombuffer(text, np.uint8)
    for at in range(0, len(codes) - GRAM + 1, _CHUNK):
        part = codes[at : at + _CHUNK + GRAM - 1].astype(np.uint32)
        gram = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
        yield (gram * np.uint32(2654435761)) >> np.uint32(18)


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``trusted``: whether ``ids`` has the doc_id.

    Dense ids make bitmaps of a bit each, which are broadcast, so that texts stay where they are; ids that spread over more than
    ``BITMAPS`` bitmaps are joined instead, which shuffles the texts.
    """
    bucket, bit = F.bitmap_bucket_number("doc_id").alias("_bucket"), F.bitmap_bit_position("doc_id")
    bitmaps = ids.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    if ids.select(bucket).distinct().limit(BITMAPS + 1).count() > BITMAPS:
        return docs.join(ids.select("doc_id", F.lit(True).alias("trusted")), "doc_id", "left")
    byte = F.conv(F.hex(F.substr("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
    found = docs.withColumn("_bucket", F.bitmap_bucket_number("doc_id")).join(F.broadcast(bitmaps), "_bucket", "left")
    return found.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("trusted"))


def gram_counts(docs: DataFrame, target: DataFrame | set[int]) -> np.ndarray:
    """Bucket counts of the raw corpus and, in the second row, of the documents in ``target`` (doc_id, each once, or a small set of ids)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for trusted, text in zip(b.column("trusted").to_pylist(), as_bytes(b, "text")):
                for grams in gram_buckets(text):
                    got = np.bincount(grams, minlength=BUCKETS)
                    sums[0] += got
                    if trusted:
                        sums[1] += got
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0, at]), pa.array(sums[1, at])], ["bucket", "raw", "trusted"])

    if isinstance(target, DataFrame):
        marked = _marked(docs.select("doc_id", "text"), target)
    else:
        marked = docs.select("doc_id", "text").withColumn("trusted", F.col("doc_id").isin(*target))
    rows = texts(marked, "trusted").mapInArrow(count, "bucket int, raw long, trusted long")
    found = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    sums = np.zeros((2, BUCKETS))
    sums[:, found["bucket"].to_numpy(np.int64)] = found[["raw", "trusted"]].to_numpy(float).T
    return sums


def log_ratio(sums: np.ndarray) -> np.ndarray:
    """log(target / raw) for each bucket; the target is smoothed towards the raw corpus."""
    raw, trusted = sums
    share = (raw + 1) / (raw + 1).sum()
    if not trusted.sum():
        return np.zeros(BUCKETS, np.float32)
    smooth = SMOOTHING * BUCKETS
    return np.log((trusted + smooth * share) / (trusted.sum() + smooth) / share).astype(np.float32)


def llr_score(text: bytes, weights: np.ndarray) -> float:
    total = n = 0
    for grams in gram_buckets(text):
        total, n = total + float(weights[grams].sum(dtype=np.float64)), n + len(grams)
    return total / n if n else 0.0


def target_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids of all documents labelled good, each once."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def judge_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (at least doc_id and text) plus the base figures, llr, base_failed and kept."""
    weights = log_ratio(gram_counts(docs, target_ids(labels)))
    figures = SCHEMA.removeprefix("doc_id long, ")
    names = [c.split()[0] for c in figures.split(", ")]
    docs = docs.drop(*names, "base_failed", "kept")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = pa.compute.fill_null(b.column("text"), "").cast(pa.binary()).to_pylist()
            rows = [(*base_figures(t), llr_score(t, weights)) for t in whole]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 6, [pa.int64()] * 5 + [pa.float64()])]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *names])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    kind = T.StructType([*docs.schema.fields, *T._parse_datatype_string(figures).fields])
    return docs.mapInArrow(score, kind).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= THRESHOLD))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base figures, llr, base_failed and kept."""
    return judge_texts(docs.select("doc_id", "text"), labels).drop("text")
