"""Imports as jobs: rows staged in chunks, loaded by a stream that can stop, fail and go on, and counted chunk by chunk.

``stage`` writes checked rows to ``<folder>/staged``, one file for a chunk or some, and settles there which row of a key is its first in the file, so the result does not
hang on the order in which chunks are loaded. ``run`` is a Structured Streaming query over these files (``availableNow``): its checkpoint knows which
files are done, and each batch replaces its own partitions of the store and of the ledger, so a chunk that is loaded twice, after a failure or by a new
checkpoint, changes nothing. Keys that other runs have stored are duplicates; what this run has stored is not held against it.

Store: ``<store>/run=<id>/chunk=<n>``, rows with their key (n: the first chunk of a file). Ledger: ``<folder>/ledger/chunk=<n>``, one row a chunk: its number, rows, imported, duplicate, error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_ROWS = 1_000_000
FILE_ROWS = 100_000
OUTCOMES = ("imported", "duplicate", "error")


def loadable_key(checked: DataFrame, *parts: Column) -> DataFrame:
    """Adds ``key`` to validated rows: the parts, trimmed, in upper case, as one text; null where a row has another error than being a duplicate. Empty rows are left out."""
    fit = F.forall(F.filter("problems", lambda p: p["severity"] == "ERROR"), lambda p: p["rule"].startswith("duplicate_in_"))
    return checked.where("not is_empty").withColumn("key", F.when(fit, F.to_json(F.array(*[F.upper(F.trim(F.coalesce(p, F.lit("")))) for p in parts]))))


def stage(rows: DataFrame, folder: str, chunk_rows: int = CHUNK_ROWS, file_chunks: int = 1) -> None:
    """rows: row_number (from 1), key (null: an error) and any other columns. A chunk is ``chunk_rows`` row numbers, a file ``file_chunks`` of them: small chunks share files, so that files and folders do not grow in number with them."""
    firsts = rows.where("key is not null").groupBy("key").agg(F.min("row_number").alias("_first"))
    told = rows.join(firsts, "key", "left").withColumns({"is_first": F.coalesce(F.col("row_number") == F.col("_first"), F.lit(False)), "number": F.floor((F.col("row_number") - 1) / chunk_rows).cast("long")})
    told = told.withColumn("chunk", F.col("number") - F.pmod("number", F.lit(file_chunks).cast("long")))
    told.drop("_first").repartition("chunk").write.partitionBy("chunk").parquet(f"{folder}/staged")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def stored_keys(spark: SparkSession, store: str, run_id: str) -> DataFrame:
    """Keys that other runs have stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(folder)] if files.exists(folder) else []
    others = [str(p) for p in found if p.getName().startswith("run=") and p.getName() != f"run={run_id}"]  # a folder for each run; this run's chunks are not listed
    return spark.read.schema("key string").option("basePath", store).parquet(*others).select("key").distinct() if others else spark.createDataFrame([], "key string")


def decided(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Staged rows with their outcome."""
    known = rows.join(keys.withColumn("_known", F.lit(True)).hint("merge"), "key", "left")  # the store's keys grow, so no batch sends them through the driver
    return known.withColumn("outcome", F.when(F.col("key").isNull(), "error").when(F.col("_known").isNotNull() | ~F.col("is_first"), "duplicate").otherwise("imported")).drop("_known")


def load(rows: DataFrame, folder: str, store: str, run_id: str) -> None:
    """Loads staged rows of whole chunks, in place of what the same chunks loaded before. The ledger comes last: a chunk without its row is not done."""
    spark = rows.sparkSession
    done = decided(rows, stored_keys(spark, store, run_id))
    columns = [c for c in done.columns if c not in ("is_first", "outcome", "chunk", "number")]
    replace = lambda df, path: df.repartition("chunk").write.partitionBy("chunk").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    replace(done.where("outcome = 'imported'").select(*columns, "chunk"), f"{store}/run={run_id}")
    counts = done.groupBy("chunk", "number").agg(F.count("*").alias("rows"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    replace(counts, f"{folder}/ledger")


def run(spark: SparkSession, folder: str, store: str, run_id: str, at_once: int = 8, before: Callable[[DataFrame, int], None] | None = None) -> None:
    """Loads the files of chunks that this job's checkpoint does not know as done, ``at_once`` of them a batch. ``before`` sees each batch first; what it raises ends the run there."""

    def batch(rows: DataFrame, number: int) -> None:
        if before:
            before(rows, number)
        load(rows, folder, store, run_id)

    schema = spark.read.parquet(f"{folder}/staged").schema
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(f"{folder}/staged")
    query = chunks.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk, rows, imported, duplicate, error) of the chunks that are done."""
    if not _exists(spark, f"{folder}/ledger"):
        return spark.createDataFrame([], "rows long, imported long, duplicate long, error long, chunk long")
    kept = spark.read.schema("number long, rows long, imported long, duplicate long, error long").parquet(f"{folder}/ledger")
    return kept.select("rows", *OUTCOMES, F.col("number").alias("chunk"))


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """One row: chunks staged and done, rows staged, processed, imported, duplicate and error, and the state: STAGED, RUNNING or COMPLETED."""
    staged = spark.read.parquet(f"{folder}/staged").groupBy("number").agg(F.count("*").alias("n")).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("staged_rows"))
    done = ledger(spark, folder).agg(F.count("*").alias("done"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", *OUTCOMES)])
    state = F.when(F.col("done") == F.col("chunks"), "COMPLETED").when(F.col("done") > 0, "RUNNING").otherwise("STAGED")
    return staged.crossJoin(done).withColumn("state", state).withColumnRenamed("rows", "processed_rows")  # one row each
