"""Roll-ups against plain aggregation of the records."""

import os

from pyspark.sql import functions as F

from orelink.operators import procurement as P
from orelink.operators import rollup as R
from test_procurement import records


def rows(df):
    names = sorted(df.columns)
    return sorted(map(repr, df.select(*names).collect()))


def test_rolled_views_equal_those_of_records(spark):
    base = records(spark).withColumn("status", F.lit("OPEN"))
    cells, suppliers = R.rolled(base, *R.CELLS), R.bits(base, "supplier_id", "org_id", "cmi")
    assert rows(P.totals(cells, "org_id")) == rows(P.totals(base, "org_id"))
    assert rows(P.monthly(cells, "cmi")) == rows(P.monthly(base, "cmi"))
    assert rows(P.coverage(cells, suppliers)) == rows(P.coverage(base))
    assert rows(R.summary(cells.where("cmi is not null"), suppliers, "cmi")) == rows(P.summary(base.where("cmi is not null"), "cmi"))
    assert rows(R.evidence(cells, suppliers.where("cmi is not null"))) == rows(P.opportunity_evidence(base))


def test_bitmaps_count_over_buckets(spark):
    numbers = spark.createDataFrame([(1, n) for n in (0, 1, 32767, 32768, 32769, 70000)] + [(2, 1), (2, 1), (2, 5), (3, None)], "k int, n long")
    held = R.bits(numbers, "n", "k")
    assert {r.k: r.found for r in R.distinct(held, "found", "k").collect()} == {1: 6, 2: 2}
    assert R.distinct(held, "found").collect()[0].found == 7


def test_refresh_replaces_the_named_months_only(spark, tmp_path):
    base = records(spark).withColumn("status", F.lit("OPEN"))
    for name, keys in (("cells", R.CELLS), ("pairs", R.PAIRS)):
        R.store(base, f"{tmp_path}/{name}", keys)
    january = sorted(os.listdir(tmp_path / "cells/month=2024-01"))
    changed = base.unionByName(base.where("po = 5").withColumn("po", F.lit(9).cast("long")))
    R.refresh(changed, str(tmp_path), ["2024-04"])
    for name, keys in (("cells", R.CELLS), ("pairs", R.PAIRS)):
        assert rows(R.stored(spark, f"{tmp_path}/{name}", keys, base)) == rows(R.rolled(changed, *keys).select(*keys, *R.MEASURES))
    R.refresh(changed, str(tmp_path), ["2024-04"])  # twice changes nothing
    assert rows(R.stored(spark, f"{tmp_path}/cells", R.CELLS, base)) == rows(R.rolled(changed, *R.CELLS).select(*R.CELLS, *R.MEASURES))
    assert sorted(os.listdir(tmp_path / "cells/month=2024-01")) == january
    R.refresh(changed.where("month(purchase_date) = 1"), str(tmp_path), ["2024-04"])  # a month without records any more
    assert {r.month for r in R.stored(spark, f"{tmp_path}/cells", R.CELLS, base).select("month").collect()} == {"2024-01"}


def test_dates_that_cut_months(spark):
    base = records(spark).withColumn("status", F.lit("OPEN"))
    cells = R.rolled(base, *R.CELLS)
    for since, until in (("2024-01-01", "2024-04-30"), ("2024-01-04", "2024-04-03"), ("2024-01-03", "2024-01-03"), ("2024-02-10", "2024-02-12"), ("2024-01-01", "2024-01-31"), ("2023-12-31", "2024-04-02")):
        want = base.where(F.col("purchase_date").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
        assert rows(P.totals(R.between(base, cells, since, until), "org_id")) == rows(P.totals(want, "org_id"))
