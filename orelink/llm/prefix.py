"""Running totals over a whole table in sorted order, with no task that holds a whole key.

Rows are sorted by range, so a key of any size spreads over many partitions. Totals run within a partition; what earlier
partitions hold of a key is added. Only the first key of a partition can have rows in an earlier one, so the carried
totals are fewer than the partitions: that is the bound of their broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelink.llm.common import dropped, written


def running(rows: DataFrame, order: list[str], sums: dict[str, str] | None = None, xors: dict[str, str] | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` plus running totals (own row included) by ``order`` within ``key``.

    ``sums`` and ``xors`` map new columns to long columns. ``rows`` is a written table (the range sample reads it too); rows that
    tie in ``order`` come in any order. The result is a written table.
    """
    made = {n: (F.sum(c), F.sum) for n, c in (sums or {}).items()} | {n: (F.bit_xor(c), F.bit_xor) for n, c in (xors or {}).items()}
    ranged = written(rows.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part", *key).agg(*[total.alias(n) for n, (total, _) in made.items()])
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # without a key: a row for each partition
    first = next(iter(made))
    carried = parts.select("_part", *key, *[again(n).over(before).alias(f"_before_{n}") for n, (_, again) in made.items()]).where(f"_before_{first} is not null")
    line = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranged.select("*", *[total.over(line).alias(f"_in_{n}") for n, (total, _) in made.items()])
    both = within.join(F.broadcast(carried), ["_part", *key], "left")
    had = lambda n: F.coalesce(f"_before_{n}", F.lit(0).cast("long"))
    totals = [(F.col(f"_in_{n}") + had(n) if n in (sums or {}) else F.col(f"_in_{n}").bitwiseXOR(had(n))).alias(n) for n in made]
    out = written(both.select(*rows.columns, *totals))
    dropped(ranged)
    return out
