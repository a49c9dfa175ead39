"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words and trims lines, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Only a local session without one (tests) gets a folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="orelink-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read many times, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/orelink-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._orelink_path = path
    return again


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._orelink_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


HOT_SHARE = 1000


def keyed_join(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``keys``, one row a key, whose column ``_rows`` counts the key's rows; it is not kept.

    Keys of more than a ``HOT_SHARE``-th of these rows are fewer than ``HOT_SHARE`` in number: they are broadcast, and their
    rows stay where they are. So no key of ``keys`` holds more than that share in the shuffle.
    """
    total = keys.agg(F.sum("_rows").alias("n")).first()["n"] or 0
    is_hot = F.col("_rows") * HOT_SHARE > total
    hot = keys.where(is_hot).drop("_rows")
    marked = rows.join(F.broadcast(hot.select(*on, F.lit(True).alias("_hot"))), on, "left")
    rest = marked.where("_hot is null").drop("_hot").join(keys.where(~is_hot).drop("_rows"), on, how)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns alone; a null text counts as empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes, without making Python strings of it."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def crc_fold(column, parts: int):
    """crc32 of an id, as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(parts))
