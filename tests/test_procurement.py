"""Totals on records of several units and currencies."""

import datetime

from orelink.operators import procurement as P

SCHEMA = "org_id int, supplier_id long, material_id long, cmi string, category string, po long, purchase_date date, uom string, currency string, unit_price decimal(18,2), qty_cents long, spend_cents long"


def records(spark):
    day = lambda y, m: datetime.date(y, m, 3)
    rows = [
        (1, 7, 1, "C", "x", 1, day(2024, 1), "KG", "USD", 2, 150, 300), (1, 7, 1, "C", "x", 2, day(2024, 1), "EA", "INR", 5, 1200, 6000), (2, 7, 2, "C", "x", 3, day(2024, 1), "KG", None, None, 50, None),
        (2, 8, 2, "C", "x", 4, day(2024, 4), "EA", "USD", 1, 205, 205), (2, 8, 3, None, "x", 5, day(2024, 4), "bX9", "INR", 1, 100, 100),
    ]
    return spark.createDataFrame([(*r[:9], None if r[9] is None else __import__("decimal").Decimal(r[9]), *r[10:]) for r in rows], SCHEMA)


def test_units_and_currencies_stay_apart(spark):
    rows = records(spark)
    got = {r.org_id: r for r in P.totals(rows, "org_id").collect()}
    assert (got[1].quantity_by_uom, got[1].spend_by_currency) == ("EA=12; KG=1.50", "INR=60; USD=3")
    assert (got[2].quantity_by_uom, got[2].spend_by_currency) == ("EA=2.05; KG=0.50; bX9=1", "INR=1; USD=2.05")
    assert (got[2].records, got[2].linked, got[2].priced, got[2].unpriced) == (3, 2, 2, 1)


def test_months_are_filled_and_cut_not_dropped(spark):
    rows = records(spark).where("cmi is not null")
    full = [(r.month, r.records, r.quantity_by_uom, r.spend_by_currency) for r in P.monthly_filled(rows, "cmi").orderBy("month").collect()]
    assert full == [("2024-01", 3, "EA=12; KG=2", "INR=60; USD=3"), ("2024-02", 0, "", ""), ("2024-03", 0, "", ""), ("2024-04", 1, "EA=2.05", "USD=2.05")]
    assert P.monthly_filled(rows, "cmi", most=None).count() == 4
    assert [r.month for r in P.monthly_filled(rows, "cmi", most=2).orderBy("month").collect()] == ["2024-01", "2024-02"]


def test_coverage_of_an_empty_table(spark):
    got = {r.scope: r for r in P.coverage(records(spark)).collect()}
    assert got["all"].linked_bp == 8000 and got["linked"].quantity_by_uom == "EA=14.05; KG=2" and got["unlinked"].spend_by_currency == "INR=1"
    none = P.coverage(records(spark).limit(0)).collect()
    assert len(none) == 3 and all(r.records == 0 and r.linked_bp is None and r.quantity_by_uom == "" for r in none)


def test_unharmonized_lists_at_most_twenty(spark):
    rows = records(spark).where("org_id = 2 and po = 5")
    from pyspark.sql import functions as F

    many = rows.crossJoin(spark.range(30).select(F.col("id").alias("n"))).withColumn("material_id", F.col("n") + 100).drop("n")
    out = P.unharmonized(records(spark).unionByName(many)).collect()
    assert [(r.org_id, r.records, r.materials) for r in out] == [(2, 31, 31)] and out[0].material_ids == ",".join(map(str, [3, *range(100, 119)]))
