"""Substring search by a table of trigrams.

Each row's texts give their distinct three-character pieces, in lower case; ``postings`` holds (gram, id) in the order of the gram, so a filter on a gram
reads the few row groups that hold it. A query looks at the rarest of its own grams only: every row that holds the query holds that gram, so what the postings
name is a superset, and the texts of these rows decide. Queries under three characters have no gram and are looked for in every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3


def _grams(text: Column) -> Column:
    """Distinct pieces of ``SIZE`` characters; none of a shorter text."""
    n = F.length(text) - SIZE + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(SIZE))))).otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(gram, id) of every text column, each once a row, sorted by gram within ranges; a gram in very many rows spreads over several ranges. ``key`` names each row once."""
    texts = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in columns])
    spread = rows.select(F.col(key).alias("id"), *columns).repartition(rows.sparkSession.sparkContext.defaultParallelism, "id")  # a table of short texts may be one file
    found = spread.select("id", F.explode(F.array_distinct(F.flatten(F.transform(texts, _grams)))).alias("gram"))
    return found.select("gram", "id").repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")


def frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("gram").agg(F.count("*").alias("n"))


def _holds(columns: tuple[str, ...], query: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(query), F.lit(False)) for c in columns])


def rarest(query: str, counts: DataFrame) -> str | None:
    """The gram of the query that the fewest rows hold; '' if one of its grams is in no row, None if it has none."""
    wanted = {query.lower()[i : i + SIZE] for i in range(len(query) - SIZE + 1)}
    if not wanted:
        return None
    found = {r["gram"]: r["n"] for r in counts.where(F.col("gram").isin(sorted(wanted))).collect()}  # a row for each gram of one query
    return min(found, key=lambda g: (found[g], g)) if len(found) == len(wanted) else ""


def search(rows: DataFrame, posted: DataFrame, counts: DataFrame, query: str, key: str, *columns: str) -> DataFrame:
    """The rows of which a column holds the query, without regard to case."""
    gram = rarest(query, counts)
    if gram is None:
        return rows.where(_holds(columns, F.lit(query.lower())))
    ids = posted.where(F.col("gram") == gram).select(F.col("id").alias(key))  # '' is no gram: no row
    return rows.join(ids, key, "left_semi").where(_holds(columns, F.lit(query.lower())))


def searches(rows: DataFrame, posted: DataFrame, counts: DataFrame, queries: DataFrame, key: str, *columns: str) -> DataFrame:
    """queries: (query), each once, of three characters or more. (query, id) of every row that holds one."""
    asked = queries.select("query", F.explode(_grams(F.lower("query"))).alias("gram"))
    picked = asked.join(counts, "gram", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    near = picked.where("least.n > 0").select("query", F.col("least.gram").alias("gram")).join(posted, "gram").select("query", F.col("id").alias(key))
    return near.join(rows, key).where(_holds(columns, F.lower("query"))).select("query", key)
