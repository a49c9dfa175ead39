"""Text feeds of any size: one file over many tasks, records numbered in file order, long records reported.

A file is read as lines, split over tasks wherever Spark splits it. A line begins a record where the quotes ahead of it in the file are even in
number; that follows from the quotes of the splits before and the lines before. Every split is summed once (lines, records, quotes, bytes); the running totals over a
file's splits tell each where it stands. Lines of a split that holds no blank line, no open quote and no long line are records as they are and stay in
their task; the lines of other splits meet by split, which is as large as a split at most, and the few records of several lines by record.

Numbers count the records that are not blank, the header being 1, as a reader of the whole file would. A record of more than ``RECORD_MAX`` characters
has no cells but an error, and no more of it than that is held; the other records are read. A quote that is never closed makes the rest of its file such a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD_MAX = 65536
_SPLIT = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = F.regexp_replace("value", "\r$", "")
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path, lineSep="\n").select(*where, F.monotonically_increasing_id().alias("at"), text.alias("line"))
    return lines.withColumns({"quotes": F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit(""))), "size": F.length("line").cast("long") + 1, "blank": F.trim("line") == ""})


def _splits(lines: DataFrame, most: int) -> DataFrame:
    """A row a split: whether it is plain, where its lines begin, whether a quote is open before it, and the records ahead of it."""
    odd = F.col("quotes") % 2 == 1
    sums = lines.groupBy(*_SPLIT).agg(
        F.min("at").alias("first"), F.count("*").alias("n"), F.sum("quotes").alias("quotes"), (~F.bool_or(odd | F.col("blank") | (F.col("size") > most))).alias("plain"),
    )
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    return sums.withColumn("open", F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) % 2 == 1).withColumn("plain", F.col("plain") & ~F.col("open"))


def records(spark: SparkSession, path: str, most: int = RECORD_MAX) -> DataFrame:
    """(file, row_number, record, error): every record of the files that is not blank; ``error`` is record_too_long, with a null record, or null."""
    lines = _lines(spark, path)
    splits = _splits(lines, most)
    told = lines.join(splits.select(*_SPLIT, "first", "plain", "open"), _SPLIT)
    # lines of mixed splits: what is open before each, within its split
    before = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mixed = told.where("not plain").withColumn("inside", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) + F.col("open").cast("long")) % 2 == 1)
    begins = ~F.col("inside") & ~F.col("blank")
    mixed = mixed.withColumns({"begins": begins, "lost": ~F.col("inside") & F.col("blank")}).withColumns({"nth": F.count_if("begins").over(upto), "bytes": F.sum("size").over(upto)})
    # running totals over the splits of a file: records, and bytes since the last record began
    counted = mixed.groupBy(*_SPLIT).agg(F.count_if("begins").alias("began"), F.sum("size").alias("size"), F.max(F.when(F.col("begins") | F.col("lost"), F.col("bytes") - F.col("size"))).alias("last"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    plain = splits.where("plain").select(*_SPLIT, F.col("n").alias("began"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("last"))
    offsets = counted.unionByName(plain).withColumns({"records": F.coalesce(F.sum("began").over(ahead), F.lit(0)), "ahead": F.coalesce(F.sum("size").over(ahead), F.lit(0))})
    offsets = offsets.withColumn("from", F.coalesce(F.max(F.col("ahead") + F.col("last")).over(ahead), F.lit(0))).select(*_SPLIT, "records", "ahead", "from")
    alone = told.where("plain").join(offsets, _SPLIT).select("file", (F.col("records") + F.col("at") - F.col("first") + 1).alias("row_number"), F.col("line").alias("record"), F.lit(None).cast("string").alias("error"))
    # a record's lines: as many characters as are allowed, and one more to tell that there are more
    place = mixed.where("not lost").join(offsets, _SPLIT)
    began = F.max(F.when(F.col("begins"), F.col("ahead") + F.col("bytes") - F.col("size"))).over(upto)
    place = place.withColumns({"row_number": F.col("records") + F.col("nth"), "start": F.greatest("from", F.coalesce(began, F.col("from")))})
    skip = F.col("ahead") + F.col("bytes") - F.col("size") - F.col("start")
    held = place.withColumn("skip", skip).where(F.col("skip") <= most)
    cut = F.col("skip") + F.length("line") > most
    single = F.col("begins") & (F.col("quotes") % 2 == 0)
    flat = held.where(single).select("file", "row_number", F.when(~cut, F.col("line")).alias("record"), F.when(cut, "record_too_long").alias("error"))
    many = held.where(~single).groupBy("file", "row_number").agg(F.bool_or(cut | (F.col("skip") == most)).alias("long"), F.array_sort(F.collect_list(F.struct("skip", F.substring(F.col("line"), 1, most).alias("line")))).alias("parts"))
    joined = many.select("file", "row_number", F.when(~F.col("long"), F.array_join(F.transform("parts", lambda p: p["line"]), "\n")).alias("record"), F.when(F.col("long"), "record_too_long").alias("error"))
    return alone.unionByName(flat).unionByName(joined)


def _cells(record, columns: list[str], most: int):
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "maxCharsPerColumn": str(most)}
    return F.from_csv(record, ", ".join(f"`{c}` string" for c in columns), options)


def header(found: DataFrame, most: int = RECORD_MAX) -> list[str]:
    """The names in the first record of the files; files of different headers are an error."""
    heads = [r["record"] for r in found.where("row_number = 1").select("record").distinct().limit(2).collect()]
    if len(heads) != 1 or heads[0] is None:
        raise ValueError("the files have no header" if not heads else "the files' headers differ or are too long")
    text = heads[0].lstrip("﻿")
    spark = found.sparkSession
    cells = spark.createDataFrame([(text,)], "r string").select(_cells(F.col("r"), [f"c{i}" for i in range(text.count(",") + 1)], most).alias("c")).first()["c"]
    names = [(x or "").strip() for x in cells]
    while names and not names[-1] and text.count('"'):  # commas inside quotes
        names.pop()
    return [n or f"_{i}" for i, n in enumerate(names, 1)]


def read_feed(spark: SparkSession, path: str, most: int = RECORD_MAX) -> DataFrame:
    """Cells of every record as trimmed strings (null where empty), with file, row_number (the header is 1) and error."""
    found = records(spark, path, most)
    names = header(found, most)
    return found.where("row_number > 1").select("file", "row_number", "error", _cells(F.col("record"), names, most).alias("c")).select("file", "row_number", "error", "c.*")
