"""Quality scores by positive-unlabelled learning in numpy.

A small network (hashed byte 3-gram shares and a few shape figures, one hidden layer) minimises the non-negative
unbiased risk ``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` with the logistic loss:
where the bracket turns negative, the step goes against it. Trusted positives are documents labelled good in the
training fold, at most ``positives`` of them, least id hash first; no other label is read. Unlabelled is every document.

Fitting: first nets are fitted in the driver on the vectors of the positives and of ``first_unlabelled`` documents, least id hash first. The class
prior is estimated over all documents: they fall into two halves by a hash of their id, a scout net is fitted on the sample of each half, and every
document and positive is scored by the scout that has not seen its half. For each score the share of documents that reach it, divided by
the share of positives that do, is at least the prior; the least such bound, with its sampling error, gives the estimate. A net fitted with this
prior then takes ``STEPS`` steps of the whole risk: tasks sum the gradient of the unlabelled part over every document, the driver adds that of the
positives and decides, on these whole sums, whether the negative part is below 0. So the unlabelled risk is that of the whole corpus, whatever the
partitioning (sums of floats aside).

Scale: the sample bounds fix the driver's work, and it holds vectors, not texts; a task adds one row for each score bin or parameter of a net of
fixed size, summed with ``groupBy``; tasks get the net alone. Fitting reads the texts 1 + ``STEPS`` times, scoring once.

Defined cases: null and empty texts get the score of no figures; very long texts are read whole, in chunks; a null doc_id keeps its row
and counts as unlabelled, but is not in the first sample; rows that share a sampled doc_id are one row there, that of the least text;
without positives or documents every score is 0; repeated rows get equal scores; empty tables give no rows; other columns are
ignored. Labels, lang, source and doc_id are not inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelink.llm.common import as_bytes, texts

POSITIVES = 3000
FIRST_UNLABELLED = 6000
BUCKETS = 1 << 10
FIGURES = 8
HIDDEN = 16
EPOCHS = 12
BATCH = 128
RATE = 0.005
CUT = 0.7
STEPS = 3
BINS, REACH = 4096, 24.0  # of the histogram of logits, from -REACH to REACH
_CHUNK = 1 << 20

_KIND = np.full(256, 5, np.int64)  # 0 lower case, 1 upper case, 2 digit, 3 white space, 4 other ASCII, 5 beyond ASCII
_KIND[:128] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3


def vector(text: bytes) -> np.ndarray:
    """Square roots of hashed 3-gram shares, then shape figures."""
    out = np.zeros(BUCKETS + FIGURES, np.float32)
    codes = np.frombuffer(text, np.uint8)
    for at in range(0, len(codes) - 2, _CHUNK):
        part = codes[at : at + _CHUNK + 2].astype(np.uint32)
        gram = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        out[:BUCKETS] += np.bincount(gram * np.uint32(2654435761) >> np.uint32(22), minlength=BUCKETS)
    out[:BUCKETS] = np.sqrt(out[:BUCKETS] / max(1, len(codes) - 2))
    kinds = np.bincount(_KIND[codes], minlength=6) / max(1, len(codes))
    words = text.split()
    again = 1 - len(set(words)) / len(words) if words else 0
    pairs = sum(map(bytes.__eq__, words, words[1:])) / len(words) if words else 0
    out[BUCKETS:] = [*kinds[[1, 2, 3, 4]] * 3, again * again, 3 * pairs, min(len(words), 200) / 200, 1 / (1 + len(words))]
    return out


class Net:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = BUCKETS + FIGURES
        self.params = [rng.normal(0, 0.3, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]

    def hidden(self, x):
        return np.maximum(x @ self.params[0] + self.params[1], 0)

    def logits(self, x):
        return self.hidden(x) @ self.params[2] + self.params[3]

    def gradient(self, x, slope):
        """Of sum(slope * logit)."""
        h = self.hidden(x)
        back = slope[:, None] * self.params[2] * (h > 0)
        return [x.T @ back, back.sum(axis=0), h.T @ slope, np.array([slope.sum()])]

    def risk(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
        """The two parts of the risk: of the positives, and of the negatives (which may come out below 0)."""
        zp, zu = self.logits(positive), self.logits(unlabelled)
        return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

    def slopes(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> list[np.ndarray]:
        """Gradient of the risk, or where the negative part is below 0 the direction that raises it."""
        zp, zu = self.logits(positive), self.logits(unlabelled)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        n, m = len(positive), len(unlabelled)
        if np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():
            return [a + b for a, b in zip(self.gradient(positive, prior * (sp - 1) / n - prior * sp / n), self.gradient(unlabelled, su / m))]
        return [-(a + b) for a, b in zip(self.gradient(positive, -prior * sp / n), self.gradient(unlabelled, su / m))]

    def stepped(self, slopes: list[np.ndarray], first: list[np.ndarray], second: list[np.ndarray], step: int, rate: float) -> "Net":
        """The net after one Adam step; ``first`` and ``second``, the moments so far, go on."""
        out = Net()
        for k, (w, g, m, v) in enumerate(zip(self.params, slopes, first, second)):
            g = g + 1e-4 * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            out.params[k] = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return out

    def steps(self, batches: Iterable[tuple[np.ndarray, np.ndarray]], prior: float, rate: float) -> None:
        """Adam steps over (positive, unlabelled) batches."""
        first, second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        for step, (p, u) in enumerate(batches, 1):
            self.params = self.stepped(self.slopes(p, u, prior), first, second, step, rate).params

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)

        def batches():
            for _ in range(EPOCHS):
                order = rng.permutation(len(unlabelled))
                for at in range(0, len(order), BATCH):
                    yield positive[rng.integers(0, len(positive), BATCH)], unlabelled[order[at : at + BATCH]]

        self.steps(batches(), prior, RATE)


def bins_of(logits: np.ndarray) -> np.ndarray:
    return np.clip((logits + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from the logits of both: the least upper bound over all cuts."""
    return binned_prior(positive, np.bincount(bins_of(unlabelled), minlength=BINS))


def binned_prior(positive: np.ndarray, counts: np.ndarray) -> float:
    """``class_prior`` from the histogram of the unlabelled.

    Where positives of a share q_p and unlabelled of a share q_u reach a cut, the prior is q_u / q_p at most; the sampling error
    of the two shares is added to find the cut, not to the estimate.
    """
    n_p, n_u = len(positive), counts.sum()
    q_p, q_u = (x[::-1].cumsum()[::-1] / n for x, n in ((np.bincount(bins_of(positive), minlength=BINS), n_p), (counts, n_u)))
    slack = np.sqrt(np.log(40) / (2 * n_u)) + np.sqrt(np.log(40) / (2 * n_p))
    bound = np.where(q_p > 0, (q_u + slack) / np.maximum(q_p, 1e-12), np.inf)
    k = int(np.argmin(bound))
    return float(np.clip(q_u[k] / q_p[k], 0.01, 0.99))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cells = [vector(t).tobytes() for t in as_bytes(b, "text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("positive"), b.column("half"), pa.array(cells, pa.binary())], ["doc_id", "positive", "half", "cells"])


HALF = "pmod(xxhash64(doc_id, 'half'), 2)"


def samples(docs: DataFrame, labels: DataFrame, allowed: Column, positives: int = POSITIVES, first_unlabelled: int = FIRST_UNLABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors and halves of the positives, then of the first unlabelled documents. ``allowed`` limits the labels that are read."""
    known = labels.where(allowed & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id", F.lit(1).alias("positive"))
    web = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit("web")), "doc_id").limit(first_unlabelled).select("doc_id", F.lit(0).alias("positive"))
    ids = good.unionByName(web.distinct())
    found = texts(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text")).withColumn("half", F.expr(HALF))  # a row an id
    rows = sorted(found.mapInArrow(_vectors, "doc_id long, positive int, half long, cells binary").collect(), key=lambda r: r.doc_id)
    out = []
    for kind in (1, 0):
        mine = [r for r in rows if r.positive == kind]
        out += [np.stack([np.frombuffer(r.cells, np.float32) for r in mine]) if mine else np.zeros((0, BUCKETS + FIGURES), np.float32), np.array([r.half for r in mine], np.int64)]
    return tuple(out)


def _stacked(batch: pa.RecordBatch, most: int = 512) -> Iterator[np.ndarray]:
    rows = as_bytes(batch, "text")
    for at in range(0, len(rows), most):
        yield np.stack([vector(t) for t in rows[at : at + most]])


def score_counts(docs: DataFrame, scouts: list[Net]) -> np.ndarray:
    """How many documents fall into each bin of logits, each scored by the scout of the other half."""
    shared = docs.sparkSession.sparkContext.broadcast([s.params for s in scouts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets, counts = [], np.zeros(BINS, np.int64)
        for params in shared.value:
            nets.append(Net())
            nets[-1].params = params
        for b in batches:
            halves, at = b.column("half").to_numpy(), 0
            for x in _stacked(b):
                here = halves[at : at + len(x)]
                counts += np.bincount(bins_of(np.where(here == 0, nets[1].logits(x), nets[0].logits(x))), minlength=BINS)
                at += len(x)
        k = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(counts[k])], ["k", "n"])

    rows = texts(docs).select("text", F.expr(HALF).alias("half")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # BINS rows at most
    shared.destroy()
    out = np.zeros(BINS, np.int64)
    for r in rows:
        out[r.k] = r.n
    return out


def scouts_of(positive: np.ndarray, halves: np.ndarray, unlabelled: np.ndarray, others: np.ndarray) -> list[Net]:
    """A net fitted on each half; a half without samples takes all of them."""
    made = []
    for h in (0, 1):
        p, u = positive[halves == h], unlabelled[others == h]
        made.append(Net())
        made[-1].fit(p if len(p) else positive, u if len(u) else unlabelled, 0.5)
    return made


def unlabelled_sums(docs: DataFrame, net: Net) -> tuple[list[np.ndarray], float, int]:
    """Over all documents: the summed gradient of their negative losses, the summed losses, and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(net.params)
    sizes = [p.size for p in net.params]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, loss, seen = Net(), np.zeros(sum(sizes)), 0.0, 0
        own.params = shared.value
        for b in batches:
            for x in _stacked(b):
                z = own.logits(x)
                total += np.concatenate([g.reshape(-1) for g in own.gradient(x, 1 / (1 + np.exp(-z)))])
                loss, seen = loss + float(np.logaddexp(0, z).sum()), seen + len(z)
        flat = np.concatenate([total, [loss, seen]])
        for at in range(0, len(flat) if seen else 0, 4096):
            part = flat[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part)], ["k", "x"])

    rows = texts(docs).select("text").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toPandas()  # a row a parameter
    shared.destroy()
    flat = rows.sort_values("k")["x"].to_numpy() if len(rows) else np.zeros(sum(sizes) + 2)
    cuts = np.cumsum([0, *sizes])
    return [flat[a:b].reshape(p.shape) for a, b, p in zip(cuts, cuts[1:], net.params)], float(flat[-2]), int(flat[-1])


def refined(docs: DataFrame, net: Net, positive: np.ndarray, prior: float, steps: int = STEPS) -> Net:
    """``net`` after some steps of the risk over all documents."""
    first, second = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params]
    for step in range(1, steps + 1):
        sums, loss, n = unlabelled_sums(docs, net)
        if not n:
            return net
        zp = net.logits(positive)
        sp, m = 1 / (1 + np.exp(-zp)), len(positive)
        above = loss / n >= prior * np.logaddexp(0, zp).mean()
        own = net.gradient(positive, (prior * (sp - 1) - prior * sp if above else -prior * sp) / m)
        slopes = [(a + b / n) * (1 if above else -1) for a, b in zip(own, sums)]
        net = net.stepped(slopes, first, second, step, RATE)
    return net


def fitted(docs: DataFrame, labels: DataFrame, allowed: Column, positives: int = POSITIVES, first_unlabelled: int = FIRST_UNLABELLED) -> Net | None:
    """The whole fit: sample, scouts, prior over all documents, first net and the steps over all documents."""
    positive, halves, web, others = samples(docs, labels, allowed, positives, first_unlabelled)
    if not len(positive) or not len(web):
        return None
    scouts = scouts_of(positive, halves, web, others)
    unseen = np.where(halves == 0, scouts[1].logits(positive), scouts[0].logits(positive))
    prior = binned_prior(unseen, score_counts(docs, scouts))
    net = Net()
    net.fit(positive, web, prior)
    return refined(docs, net, positive, prior)


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """(doc_id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, scores = as_bytes(b, "text"), np.zeros(b.num_rows)
            if shared.value is not None:
                for at in range(0, len(rows), 512):
                    x = np.stack([vector(t) for t in rows[at : at + 512]])
                    scores[at : at + 512] = 1 / (1 + np.exp(-shared.value.logits(x)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")
