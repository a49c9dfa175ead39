"""Line dedup with built-in columns only; keep bitmaps per document instead of text.

A text splits at ``\\n``; a line's key is the line trimmed of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.
Keys (of at least ``min_chars`` code points) found in at least ``min_docs`` documents are frequent.
All lines of a frequent key go, or with ``keep_first`` all but the first by document and position.

Plan: key hashes are range-partitioned by (hash, document) and sorted by (hash, document, position), so one
streaming pass over each partition yields a row for each key and document with its ordered positions. The range
includes the document, so a line that a third of all documents share spreads over many tasks; documents
per key are then counted with map-side partial sums. Only positions travel from there on. The result is a
run-length compressed keep bitmap: lengths of alternating runs of kept and dropped lines, kept first.

Keys that hold more than a thousandth of the rows are joined by broadcast (``common.keyed_join``).

Defined cases: a null or empty text is one empty line; empty keys are never frequent; rows of a null doc_id count
as no document, but lose frequent lines; rows that share a doc_id count as one document and each keeps its own
bitmap (rows of equal text have equal bitmaps); a text of any length is one row, a line of any length one key; with
``keep_first`` the first line is that of the smallest doc_id, then position; an empty table gives none; other columns
stay as they are, but for those named as in ``OWN``, which are replaced. Keys are compared by 128 hash bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelink.llm.common import BLANKS, dropped, keyed_join, lower_ascii, texts, written


OWN = ("n_lines", "n_dropped", "runs", "kept", "_text", "_lines", "_id", "_body", "_n", "_runs")


def split_lines(text):
    return F.split(text, "\n", -1)


def line_key(line):
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _positions(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, body, at): the positions of each key in each document, in order."""
    body = texts(docs).select("doc_id", F.xxhash64("text").alias("body"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = body.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= max(1, min_chars))
    hashed = written(keyed.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc_id", "body", "pos"))  # the range sample reads it too
    ranged = hashed.repartitionByRange("h1", "h2", "doc_id", "body").sortWithinPartitions("h1", "h2", "doc_id", "body", "pos")
    lines = written(ranged.groupBy("h1", "h2", "doc_id", "body").agg(F.sort_array(F.collect_set("pos")).alias("at")))  # a repeated row repeats its positions
    dropped(hashed)
    return lines


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, body, n_dropped, runs) for the documents that lose a line; ``body`` is xxhash64 of the text."""
    lines = _positions(docs, min_chars)
    per_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
    held = per_doc.groupBy("h1", "h2").agg(F.count("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.sum("n").alias("_rows"))
    frequent = written(held.where(F.col("n_docs") >= min_docs).drop("n_docs"))
    hit = keyed_join(lines, frequent, ["h1", "h2"])
    if keep_first:
        rest = F.when(F.col("doc_id").eqNullSafe(F.col("first_doc")), F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0)))).otherwise(F.col("at"))
        hit = hit.withColumn("at", rest).where(F.size("at") > 0)
    marks = hit.groupBy("doc_id", "body").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))
    at = F.col("at")
    edges = marks.select(
        "doc_id", "body", F.size("at").cast("long").alias("n_dropped"),
        F.filter(at, lambda p, i: (i == 0) | (p != F.get(at, i - 1) + 1)).alias("starts"),
        F.filter(at, lambda p, i: (i == F.size(at) - 1) | (p != F.get(at, i + 1) - 1)).alias("ends"),
    )
    ends = F.col("ends")
    runs = F.flatten(F.transform("starts", lambda s, i: F.array(s - F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1), F.get(ends, i) - s + 1)))
    bitmaps = written(edges.select("doc_id", "body", "n_dropped", runs.alias("runs")))
    dropped(lines, frequent)
    return bitmaps


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` plus n_lines, n_dropped, runs and ``kept``, the text that stays."""
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), F.col("n_dropped").alias("_n"), F.col("runs").alias("_runs"))
    docs = docs.drop(*OWN)
    full = docs.select(*docs.columns, F.coalesce("text", F.lit("")).alias("_text"))
    full = full.join(marks, full["doc_id"].eqNullSafe(marks["_id"]) & (F.xxhash64("_text") == marks["_body"]), "left")
    full = full.withColumn("_lines", split_lines(F.col("_text")))
    flags = F.flatten(F.transform("_runs", lambda n, i: F.array_repeat(i % 2 == 0, n)))
    pairs = F.arrays_zip(F.col("_lines").alias("line"), flags.alias("keep"))  # flags end with the last dropped line; null: kept
    kept = F.when(F.col("_runs").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(F.filter(pairs, lambda x: F.coalesce(x["keep"], F.lit(True))), lambda x: x["line"]), "\n"))
    return full.select(
        *docs.columns, F.size("_lines").cast("long").alias("n_lines"), F.coalesce("_n", F.lit(0).cast("long")).alias("n_dropped"),
        F.coalesce("_runs", F.array().cast("array<int>")).alias("runs"), kept.alias("kept"),
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` plus n_lines, n_dropped, runs and kept."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, keep_first))
