"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir``; a local session without one gets a folder of its own, a cluster has none."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        return None
    key = spark.sparkContext.applicationId
    if key not in _OWN_DIRS:
        _OWN_DIRS[key] = tempfile.mkdtemp(prefix="orelink-mart-")
        atexit.register(shutil.rmtree, _OWN_DIRS[key], True)
    return _OWN_DIRS[key]


def written_once(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder, so that what reads them twice reads the same; without such a folder the rows themselves."""
    spark = rows.sparkSession
    if not (folder := shared_dir(spark)):
        return rows
    path = f"{folder.rstrip('/')}/orelink-rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
