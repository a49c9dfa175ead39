"""Toxicity scores from a convolutional text classifier trained in numpy.

A word is the sum of rows of a hashed embedding table: one for the word and one for each of its beginnings of
``STEMS`` bytes that more bytes follow. Filters of several widths slide over the words, each keeps its largest response in a text, and a
logistic layer turns these maxima into a score. Training (Adam, batches of whole texts) runs in the driver on at most
``SAMPLE`` labelled documents of each class, least id hash first, with one fifth held back to calibrate: the
scores' offset, so that 0.7 splits the classes best, and a threshold for each language.

Scale: the sample bound fixes the driver's work; scoring is one narrow pass with a model of fixed size over
whole texts, long ones in overlapping segments whose maxima combine.

Defined cases: null and empty texts get the score of no words; texts of fewer words than a filter is wide are padded with empty words;
very long texts are read whole, in overlapping segments; a null doc_id keeps its row and is never in the sample; rows that share a
sampled doc_id are one row there, that of the least text; languages without calibration (or null) use the common threshold; a score equal to
a threshold reaches it; without labels of both classes all scores are 0; repeated rows get equal scores; empty tables give no rows;
other columns are ignored. Labels, lang, source and doc_id
are not inputs of a score; lang selects the threshold of ``flagged`` alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelink.llm.common import as_bytes, texts

SAMPLE = 3000
BUCKETS = 1 << 18
DIM = 6
WIDTHS = (1, 2, 3)
FILTERS = 8
STEMS = (4, 5, 6, 7)
ROWS = 1 + len(STEMS)
EPOCHS = 6
BATCH = 32
RATE = 0.01
CUT = 0.7
SEGMENT = 200_000

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table_rows(words: list[bytes]) -> np.ndarray:
    """The table rows of each word, of the word and of its beginnings; -1 for none. Shape (words, ROWS)."""
    rows = np.full((len(words), ROWS), -1, np.int32)
    if words:
        rows[:, 0] = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) >> np.uint32(14)
        for k, n in enumerate(STEMS, 1):
            stems = np.fromiter((zlib.crc32(w[:n]) if len(w) > n else 0 for w in words), np.uint32, len(words))
            rows[:, k] = np.where(stems, (stems * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(14), -1)
    return rows


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class Words:
    """Numbers for the distinct words of some texts."""

    def __init__(self):
        self.number: dict[bytes, int] = {b"": 0}

    def __call__(self, text: bytes) -> np.ndarray:
        number, words = self.number, words_of(text)
        return np.fromiter([number.setdefault(w, len(number)) for w in words], np.int32, len(words))

    def rows(self) -> np.ndarray:
        rows = table_rows(list(self.number))
        rows[0] = -1  # the empty word
        return rows


def _packed(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch in one array, each document followed by max(WIDTHS) empty words (0), and the starts."""
    gap = np.zeros(max(WIDTHS), np.int32)
    starts = np.cumsum([0] + [len(d) + len(gap) for d in docs[:-1]])
    return np.concatenate([x for d in docs for x in (d, gap)]), starts


class Net:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        self.table[-1] = 0  # the empty word
        self.filters = [rng.normal(0, 0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.offset = np.float32(0)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return sum(self.table[rows[:, k]] for k in range(ROWS))

    def maxima(self, docs: list[np.ndarray], vectors, want_where: bool = False):
        """Largest response of each filter in each document: (documents, filters); with its position.

        ``vectors`` turns word numbers into word vectors.
        """
        ids, starts = _packed(docs)
        words = vectors(ids)
        best, where = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            reply = sum(words[k : len(words) - max(WIDTHS) + 1 + k] @ f[k * DIM : (k + 1) * DIM] for k in range(w)) + b
            edges = np.zeros(len(reply) + 1, np.int32)  # windows lie inside their text, padded to the largest width
            edges[starts] += 1
            edges[np.minimum(starts + np.maximum([len(d) for d in docs], max(WIDTHS)) - w + 1, len(reply))] -= 1
            reply[np.cumsum(edges[:-1]) == 0] = -np.inf
            top = np.maximum.reduceat(reply, starts, axis=0)
            best.append(top)
            if want_where:
                ends = np.append(starts[1:], len(reply))
                where.append(np.stack([s + reply[s:e].argmax(axis=0) for s, e in zip(starts, ends)]))
        return np.maximum(np.concatenate(best, axis=1), 0), where, ids, words

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.offset

    def fit(self, docs: list[np.ndarray], rows_of: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        """Train on documents of word numbers; ``rows_of`` has the table rows of each number."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, *self.bias, self.out]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        squares, step = np.zeros(BUCKETS + 1, np.float32), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for at in range(0, len(docs), BATCH):
                rows = order[at : at + BATCH]
                pooled, where, ids, words = self.maxima([docs[r] for r in rows], lambda x: self.vectors(rows_of[x]), True)
                error = 1 / (1 + np.exp(-self.logits(pooled))) - labels[rows]
                grad_pool = (error[:, None] * self.out) * (pooled > 0) / len(rows)
                grads_f, grads_b = [], []
                touched, moved = [], []
                for i, w in enumerate(WIDTHS):
                    g = grad_pool[:, i * FILTERS : (i + 1) * FILTERS]
                    gf = np.zeros_like(self.filters[i])
                    for k in range(w):
                        spots = where[i] + k  # (documents, filters)
                        part = slice(k * DIM, (k + 1) * DIM)
                        gf[part] = np.einsum("df,dfe->ef", g, words[spots])
                        touched.append(rows_of[ids[spots].reshape(-1)])
                        moved.append((g[:, :, None] * self.filters[i][part].T[None]).reshape(-1, DIM))
                    grads_f.append(gf)
                    grads_b.append(g.sum(axis=0))
                grads = [*grads_f, *grads_b, pooled.T @ error / len(rows)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                self.offset -= np.float32(RATE * 3 * error.mean())
                spots, slope = np.concatenate(touched), np.concatenate(moved)
                for side in range(ROWS):
                    rows_, back = np.unique(spots[:, side], return_inverse=True)
                    g = np.zeros((len(rows_), DIM), np.float32)
                    np.add.at(g, back, slope)
                    squares[rows_] += (g * g).mean(axis=1)
                    self.table[rows_] -= (5 * RATE) * g / (np.sqrt(squares[rows_]) + 1e-6)[:, None]
                self.table[-1] = 0

    def pooled(self, texts_: list[bytes]) -> np.ndarray:
        """Maxima of whole texts, in segments of bounded size."""
        out = np.zeros((len(texts_), len(WIDTHS) * FILTERS), np.float32)
        rows, parts, size, words = [], [], 0, Words()

        def flush():
            table = self.vectors(words.rows())
            np.maximum.at(out, rows, self.maxima(parts, table.__getitem__)[0])

        for i, t in enumerate(texts_):
            ids = words(t)
            for at in range(0, max(1, len(ids)), SEGMENT - max(WIDTHS)):
                rows.append(i)
                parts.append(ids[at : at + SEGMENT])
                size += len(parts[-1])
                if size >= SEGMENT:
                    flush()
                    rows, parts, size = [], [], 0
            if not parts:
                words = Words()
        if parts:
            flush()
        return out


class Classifier:
    """A net, the shift of its logits and the score thresholds by language."""

    def __init__(self, net: Net | None, shift: float = 0.0, by_lang: dict[str, float] | None = None):
        self.net, self.shift, self.by_lang = net, shift, by_lang or {}

    def scores(self, texts_: list[bytes]) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(texts_))
        return 1 / (1 + np.exp(-(self.net.logits(self.net.pooled(texts_)).astype(np.float64) + self.shift)))


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit between two values that gives the best F1, in the middle of the widest such gap."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    top = f1 >= f1.max() - 1e-12
    k = np.flatnonzero(top)
    nxt = np.append(logits[order][1:], logits[order][-1] - 2)
    k = k[np.argmax(logits[order][k] - nxt[k])]
    return float((logits[order][k] + nxt[k]) / 2)


def train(rows: list[tuple[bytes, int, str | None]]) -> Classifier:
    """Fit and calibrate on (text, label, lang)."""
    labels = np.array([r[1] for r in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        return Classifier(None)
    held = np.array([zlib.crc32(r[0]) % 5 == 0 for r in rows])
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    fit = np.flatnonzero(~held)
    # classes weigh alike: the rarer one repeats
    small = fit[labels[fit] == (labels[fit].mean() < 0.5)]
    times = max(1, (len(fit) - len(small)) // len(small))
    fit = np.concatenate([fit, *[small] * (times - 1)])
    net = Net()
    words = Words()
    docs = [words(r[0]) for r in rows]
    net.fit([docs[i] for i in fit], words.rows(), labels[fit])
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    logits, truth = net.logits(net.pooled([rows[i][0] for i in check])), labels[check]
    at_cut = np.log(CUT / (1 - CUT))
    shift = at_cut - best_cut(logits, truth)
    by_lang = {}
    for lang in {rows[i][2] for i in check} - {None}:
        own = np.array([rows[i][2] == lang for i in check])
        if truth[own].sum() >= 5 and (1 - truth[own]).sum() >= 5:
            by_lang[lang] = float(1 / (1 + np.exp(-(best_cut(logits[own], truth[own]) + shift))))
    return Classifier(net, shift, by_lang)


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, size: int = SAMPLE) -> list[tuple[bytes, int, str | None]]:
    """At most ``size`` labelled documents of each class, least id hash first."""
    known = labels.where(allowed & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    found = texts(docs, "lang").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "lang", "label")  # 2 * size ids at most
    found = found.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "label")).alias("r")).select("doc_id", "r.*")
    rows = sorted(found.collect(), key=lambda r: r.doc_id)
    return [(r.text.encode(), int(r.label), r.lang) for r in rows]


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score, flagged): ``flagged`` holds the language's threshold against the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = m.scores(as_bytes(b, "text"))
            cuts = np.array([m.by_lang.get(x, CUT) for x in b.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores), pa.array(scores >= cuts)], ["doc_id", "score", "flagged"])

    return texts(docs, "lang").mapInArrow(run, "doc_id long, score double, flagged boolean")
