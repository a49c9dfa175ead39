"""Roll-ups of the record table: additive measures by month, and exact distinct counts by bitmaps.

Two tables hold a row for each combination that occurs, partitioned by month: ``cells`` (month, organization, cmi, unit, currency, status) and
``pairs`` (month, supplier, organization, cmi, currency, status). Every measure adds up: counts and cents by sums, dates by least and
greatest, days by a mask of the month's days. Coarser roll-ups follow from these; distinct suppliers and organizations are bitmaps
of 32,768 numbers a bucket, which combine by OR, so no view expands its rows for a distinct count. They are built from distinct values,
each bucket in one place, so that rows of two numbers are shuffled and not a bitmap of 4 KB for every task and group.

A month that changes is rolled up again from its own records (``refresh``); the others keep their files. Dates that cut a month take
that month from the records and the whole months from the cells (``between``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = ("month", "org_id", "cmi", "uom", "currency", "status")
PAIRS = ("month", "supplier_id", "org_id", "cmi", "currency", "status")
MEASURES = ("records", "priced", "qty_cents", "spend_cents", "first_date", "last_date", "days")


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def measured(rows: DataFrame) -> DataFrame:
    """Records as rows of one record each, with a month; rows that are rolled up already stay."""
    if "records" in rows.columns:
        return rows
    date = F.col("purchase_date")
    one = {"month": month(date), "records": F.lit(1).cast("long"), "priced": F.col("unit_price").isNotNull().cast("long"), "first_date": date, "last_date": date, "days": F.expr("shiftleft(1, dayofmonth(purchase_date) - 1)")}
    return rows.withColumns(one)


def rolled(rows: DataFrame, *keys: str) -> DataFrame:
    """All measures by ``keys``. ``days`` is the mask of days within a month, so it is of use where month is a key."""
    sums = [F.sum(c).alias(c) for c in MEASURES[:4]]
    return measured(rows).groupBy(*keys).agg(*sums, F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.bit_or("days").alias("days"))


def bits(rows: DataFrame, number: str, *keys: str) -> DataFrame:
    """(keys, bucket, bits): the distinct values of an integer column as bitmaps."""
    values = rows.where(F.col(number).isNotNull()).select(*keys, F.col(number).alias("_number")).distinct()
    placed = values.select(*keys, F.bitmap_bucket_number("_number").alias("bucket"), F.bitmap_bit_position("_number").alias("_bit")).repartition(*keys, "bucket")
    return placed.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def merged(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """Bitmaps by fewer keys."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct(bitmaps: DataFrame, name: str, *keys: str) -> DataFrame:
    """How many values the bitmaps hold by ``keys``."""
    return merged(bitmaps, *keys).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def summary(cells: DataFrame, suppliers: DataFrame, *keys: str) -> DataFrame:
    """Records, parties, pricing and the first and last date for each key; ``suppliers``: bitmaps by the keys or more."""
    parties = distinct(bits(cells, "org_id", *keys), "organizations", *keys)
    out = rolled(cells, *keys).join(parties, list(keys), "left").join(distinct(suppliers, "suppliers", *keys), list(keys), "left")
    return out.select(*keys, "records", "organizations", "suppliers", "priced", (F.col("records") - F.col("priced")).alias("unpriced"), "first_date", "last_date")


def evidence(cells: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Per cmi: organizations, suppliers, records and dates. A cmi's dates are the days of its months."""
    linked = cells.where("cmi is not null")
    days = linked.groupBy("cmi", "month").agg(F.bit_or("days").alias("days"), F.sum("records").alias("records"))
    sums = days.groupBy("cmi").agg(F.sum("records").alias("records"), F.sum(F.bit_count("days").cast("long")).alias("dates"))
    out = sums.join(distinct(bits(linked, "org_id", "cmi"), "organizations", "cmi"), "cmi")
    return out.join(distinct(suppliers, "suppliers", "cmi"), "cmi").select("cmi", "organizations", "suppliers", "records", "dates")


def supplier_list(suppliers: DataFrame, totals: DataFrame, cmis: DataFrame, search: str | None = None, **activity) -> DataFrame:
    """All suppliers that fit ``search`` with what they did within ``activity`` (organization, currency).

    ``totals``: measures by supplier, organization and currency; ``cmis``: their distinct cmis.
    """
    if search:
        suppliers = suppliers.where(F.lower("supplier").contains(search.lower()))
    within = reduce(lambda test, by: test & F.col(by[0]).eqNullSafe(F.lit(by[1])), activity.items(), F.lit(True))
    counted = totals.where(within).groupBy("supplier_id").agg(F.sum("records").alias("records"), F.countDistinct("org_id").alias("organizations"), F.max("last_date").alias("last_date"))
    held = cmis.where(within).select("supplier_id", "cmi").distinct().groupBy("supplier_id").agg(F.count("*").alias("cmis"))
    out = suppliers.join(counted, "supplier_id", "left").join(held, "supplier_id", "left")
    return out.fillna(0, ["records", "organizations", "cmis"]).select(*suppliers.columns, "records", "organizations", "cmis", "last_date")


def between(records: DataFrame, cells: DataFrame, since: str, until: str) -> DataFrame:
    """Cells of the records from ``since`` to ``until`` (dates, both within): whole months from ``cells``, months that the dates cut from ``records``."""
    first, last = F.lit(since).cast("date"), F.lit(until).cast("date")
    lo, hi = month(F.when(F.dayofmonth(first) > 1, F.add_months(first, 1)).otherwise(first)), month(F.when(last < F.last_day(last), F.add_months(last, -1)).otherwise(last))
    kept = cells.where((F.col("month") >= lo) & (F.col("month") <= hi))
    date = F.col("purchase_date")
    cut = records.where((date >= first) & (date <= last) & ~((month(date) >= lo) & (month(date) <= hi)))
    return kept.select(*CELLS, *MEASURES).unionByName(rolled(cut, *CELLS).select(*CELLS, *MEASURES))


def store(rows: DataFrame, path: str, keys: tuple[str, ...], months: list[str] | None = None) -> None:
    """Writes the roll-up of ``rows`` by ``keys`` as a table partitioned by month; with ``months``, those months alone are replaced, even by nothing.

    Rows are balanced by size, not by month: a month that is far larger than the others has several files.
    """
    wanted = measured(rows) if months is None else measured(rows).where(F.col("month").isin(months))
    out = rolled(wanted, *keys).select(*keys, *MEASURES).hint("rebalance", "month")
    if months is None:
        out.write.partitionBy("month").mode("overwrite").parquet(path)
        return
    out.write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    spark = rows.sparkSession
    left = {r["month"] for r in wanted.select("month").distinct().collect()}  # at most the months asked for
    for gone in set(months) - left:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/month={gone}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def refresh(records: DataFrame, folder: str, months: list[str]) -> None:
    """Rolls the named months up again, in the stored cells and pairs; files of other months stay as they are."""
    store(records, f"{folder}/cells", CELLS, months)
    store(records, f"{folder}/pairs", PAIRS, months)


def stored(spark, path: str, keys: tuple[str, ...], records: DataFrame) -> DataFrame:
    """A roll-up that ``store`` wrote; ``records`` gives the types."""
    return spark.read.schema(rolled(records, *keys).select(*keys, *MEASURES).schema).parquet(path).select(*keys, *MEASURES)
