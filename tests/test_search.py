"""Trigram search against the scan."""

import random

from orelink.operators import search as S


def test_search_equals_a_scan(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abAB é-") for _ in range(rng.randrange(0, 12))) if i % 9 else None, "hot text" if i % 3 else "Cold") for i in range(120)]
    table = spark.createDataFrame(rows, "id long, a string, b string")
    posted = S.postings(table, "id", "a", "b")
    counts = S.frequencies(posted)
    texts = ["ab", "aba", "HOT", "cold", "é-a", "t t", "zzz", "hot zzz", "", "hot text"]
    holds = lambda q: {i for i, a, b in rows if q.lower() in (a or "").lower() or q.lower() in b.lower()}
    for q in texts:
        assert {r.id for r in S.search(table, posted, counts, q, "id", "a", "b").collect()} == holds(q), q
    long = [q for q in texts if len(q) >= 3]
    got = S.searches(table, posted, counts, spark.createDataFrame([(q,) for q in long], "query string"), "id", "a", "b").collect()
    assert {(r.query, r.id) for r in got} == {(q, i) for q in long for i in holds(q)} and len(got) == len(set(got))


def test_postings_are_spread_and_need_no_distinct(spark):
    posted = S.postings(spark.createDataFrame([(1, "aaaa", "AAAb"), (2, "aab", None)], "id long, a string, b string").coalesce(1), "id", "a", "b")
    assert sorted(map(tuple, posted.collect())) == [("aaa", 1), ("aab", 1), ("aab", 2)]
    plan = posted._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 2
