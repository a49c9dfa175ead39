"""All registered queries of the reference operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orelink.plans import analytics, governance, imports, kernels, matching, review

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return analytics.QUERIES | governance.QUERIES | matching.QUERIES | kernels.QUERIES | imports.QUERIES | review.QUERIES


def oracle_sql() -> dict[str, str]:
    return analytics.ORACLES | governance.ORACLES | matching.ORACLES | kernels.ORACLES | imports.ORACLES | review.ORACLES
