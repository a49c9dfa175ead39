"""Pair counting against counting pairs."""

import itertools

from orelink.operators import evaluation as E


def test_clusters_and_decisions_count_like_pairs(spark):
    groups = [("g", 1), ("g", 2), ("g", 3), ("h", 4), ("h", 5), ("k", 9)]
    clusters = {1: "x", 2: "x", 3: "y", 4: "y", 5: "x"}
    labelled, found = spark.createDataFrame(groups, "group_id string, member long"), spark.createDataFrame([(c, m) for m, c in clusters.items()], "cluster string, member long")
    row = E.clustered(labelled, found).collect()[0]
    pairs = [(a[0] == b[0], clusters[a[1]] == clusters[b[1]]) for a, b in itertools.combinations([x for x in groups if x[1] in clusters], 2)]
    assert (row.tp, row.fp, row.tn, row.fn) == tuple(pairs.count(x) for x in ((True, True), (False, True), (False, False), (True, False)))
    assert row.skipped == 1 and row.evaluated == len(pairs)
    decided = spark.createDataFrame([(1, 2, "HIGH_CONFIDENCE_MATCH"), (1, 3, "NEEDS_TECHNICAL_REVIEW"), (3, 4, "HIGH_CONFIDENCE_MATCH"), (1, 9, "HIGH_CONFIDENCE_MATCH")], "a long, b long, state string")
    records = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "member long")
    row = E.evaluated(labelled, spark.createDataFrame([(4, 3), (2, 4), (2, 7)], "a long, b long"), decided, records).collect()[0]
    assert (row.evaluated, row.positives, row.negatives, row.tp, row.fp, row.tn, row.fn) == (5, 3, 2, 1, 1, 1, 2)
    assert (row.review_rate, row.unsafe_matches, row.conflicts_caught, row.skipped) == (0.2, 1, 1, 2) and (row.precision, round(row.recall, 4), row.f1) == (0.5, 0.3333, 0.4)


def test_nothing_labelled(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    row = E.evaluated(none("group_id string, member long"), none("a long, b long"), none("a long, b long, state string"), none("member long")).collect()[0]
    assert (row.evaluated, row.tp, row.precision, row.recall, row.f1, row.review_rate, row.skipped) == (0, 0, 0, 0, 0, 0, 0)
    assert E.clustered(none("group_id string, member long"), none("cluster string, member long")).collect()[0].tn == 0
