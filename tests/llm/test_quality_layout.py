"""The PU fit does not hang on how documents are partitioned, and its sums are those of plain numpy."""

import random

import numpy as np
from pyspark.sql import functions as F

from orelink.llm import quality_pu


def corpus(spark):
    rng = random.Random(8)
    good, junk = ["alpha", "beta", "gamma", "delta"], ["win", "$$$", "click", "!!!"]
    rows = [(i, " ".join(rng.choice(junk if i % 5 == 0 else good) for _ in range(rng.randrange(5, 40))) if i % 31 else None) for i in range(300)] + [(None, "alpha win"), (7, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 300, 2)], "doc_id long, quality int")


def test_scores_do_not_hang_on_the_layout(spark):
    docs, labels = corpus(spark)
    found = []
    for n in (1, 4, 40):
        here = docs.repartition(n)
        net = quality_pu.fitted(here, labels, F.lit(True))
        found.append({(r.doc_id, round(r.score, 6)) for r in quality_pu.score(here, net).collect()})
    assert found[0] == found[1] == found[2]


def test_sums_over_all_documents(spark):
    docs, _ = corpus(spark)
    rows = [((r.text or "").encode(), r.half) for r in docs.withColumn("half", F.expr(quality_pu.HALF)).collect()]
    x = np.stack([quality_pu.vector(t) for t, _ in rows])
    net, other = quality_pu.Net(), quality_pu.Net(11)
    sums, loss, n = quality_pu.unlabelled_sums(docs.repartition(5), net)
    z = net.logits(x)
    want = net.gradient(x, 1 / (1 + np.exp(-z)))
    assert n == len(rows) and np.isclose(loss, np.logaddexp(0, z).sum()) and all(np.allclose(a, b) for a, b in zip(sums, want))
    unseen = np.where(np.array([h for _, h in rows]) == 0, other.logits(x), net.logits(x))
    assert (quality_pu.score_counts(docs.repartition(3), [net, other]) == np.bincount(quality_pu.bins_of(unseen), minlength=quality_pu.BINS)).all()
