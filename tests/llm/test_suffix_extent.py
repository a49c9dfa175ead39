"""Repeated passages of which sorted neighbours see a part only."""

import collections
import random

from orelink.llm import suffix_dedup


def crossed(seed):
    """Four texts: A and C share [p-5, p+50), B and D another, A and B [p-25, p+30); p is the one place retained there."""
    rng = random.Random(seed)
    words = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    while True:
        left, core, tails = words(20), words(35), (words(20), words(20))
        rows = [words(40) + (left if k < 2 else words(20)) + core + tails[k % 2] + words(40) for k in range(4)]
        if all([x for x in suffix_dedup._anchors(suffix_dedup._codes(" ".join(r).encode()))[0] if 40 <= x <= 70] == [65] for r in rows[:2]):
            return rows


def test_every_repeated_word_is_covered(spark):
    texts = dict(enumerate(r for seed in range(12) for r in crossed(seed)))
    rng = random.Random(99)
    base = [f"u{i}" for i in range(200)]
    for k in range(12):
        a = rng.randrange(100)
        texts[100 + k] = [f"z{rng.randrange(10**9)}" for _ in range(30)] * (k % 2) + base[a : a + rng.randrange(50, 100)] + [f"z{rng.randrange(10**9)}" for _ in range(30)]
    where, covered = collections.defaultdict(set), collections.defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                covered[i].update(range(k, k + 50))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found = collections.defaultdict(set)
            for r in suffix_dedup.repeated_spans(docs).collect():
                found[r.doc_id].update(range(r.first, r.last))
            assert found == covered
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
