"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.textbytes import LOWER_VALUE, Spans, column_bytes, runs, slices, word_bounds

_CLASS = np.full(256, 9, dtype=np.int64)  # 9: other ASCII
for _c, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:?", b"!", b"#*$%&", b"|<>{}[]\\^~=_", (), range(128, 256))):
    _CLASS[list(_bytes)] = _c
CLASSES = 11
FEATURES = CLASSES + 12


def repeats(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many keys of each row repeat an earlier one of it."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    same = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    return np.bincount(r[1:][same], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) numbers of whole texts: shares of byte classes, word shapes, repetition, length."""
    out = np.zeros((len(offsets) - 1, FEATURES))
    for i, j in runs(offsets):
        d, off, n = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], j - i
        if not len(d):
            continue
        row = np.repeat(np.arange(n), np.diff(off))
        shares = np.bincount(row * CLASSES + _CLASS[d], minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(np.diff(off), 1)[:, None]
        s, e, of = word_bounds(d, off)
        words = np.bincount(of, minlength=n)
        per = lambda x: np.bincount(of, weights=x, minlength=n) / np.maximum(words, 1)  # noqa: E731,B023
        x = np.zeros((n, FEATURES - CLASSES))
        x[:, 0] = np.log1p(words)
        if len(s):
            h = Spans(d, LOWER_VALUE).hash(s, e)
            size, last, head = e - s, _CLASS[d[e - 1]], _CLASS[d[s]]
            x[:, 1], x[:, 2] = per(size), np.sqrt(np.maximum(per(size.astype(float) ** 2) - per(size) ** 2, 0))
            x[:, 3], x[:, 4] = per((last >= 6) & (last <= 7)), per((size == 1) & (_CLASS[d[s]] == 8))
            x[:, 5] = per((head == 1) & (size > 1) & (_CLASS[d[np.minimum(s + 1, len(d) - 1)]] == 1))
            x[:, 6] = repeats(of, h, n) / np.maximum(words, 1)
            pair = of[1:] == of[:-1]
            x[:, 7] = np.bincount(of[1:][pair & (h[1:] == h[:-1])], minlength=n) / np.maximum(words, 1)
            x[:, 8] = repeats(of[1:][pair], (h[1:] * np.uint64(3) + h[:-1])[pair], n) / np.maximum(words, 1)
            x[:, 9] = per(last == 5)
            x[:, 10] = per((head == 2) | (last == 2))
            x[:, 11] = shares[:, 4] * np.diff(off) / np.maximum(words, 1)
        out[i:j] = np.concatenate((shares, x), axis=1)
    return out


class Net:
    """One hidden layer of tanh units over standardised features."""

    def __init__(self, hidden: int = 16, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.w = [rng.normal(0, 0.3, (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
        self.mean, self.scale, self.slope, self.shift = np.zeros(FEATURES), np.ones(FEATURES), 1.0, 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))

    def risk(self, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
        """The two terms of the unbiased risk for the sigmoid loss, prior * R+(positive) and R-(unlabelled) - prior * R-(positive), and
        the gradient of their sum, or, where the second is below zero, of its negative, which takes the net back from positives it has learned
        by heart: no risk is negative."""
        x, n = np.concatenate((p, u)), len(p)
        a = np.tanh(x @ self.w[0] + self.w[1])
        g = a @ self.w[2] + self.w[3][0]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # loss of calling it negative; 1 - s that of calling it positive
        plus, minus = prior * (1 - s[:n]).mean(), s[n:].mean() - prior * s[:n].mean()
        slope = s * (1 - s)
        if minus >= 0:
            d = np.concatenate((-2 * prior * slope[:n] / n, slope[n:] / len(u)))
        else:
            d = np.concatenate((prior * slope[:n] / n, -slope[n:] / len(u)))
        da = (d[:, None] * self.w[2]) * (1 - a * a)
        return float(plus), float(minus), [x.T @ da, da.sum(axis=0), a.T @ d, np.array([d.sum()])]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, batch: int = 512, rate: float = 0.01, decay: float = 1e-3) -> None:
        """Minimises prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) by seeded steps, with weight decay."""
        both = np.concatenate((positive, unlabelled))
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        norm = lambda x: np.clip((x - self.mean) / self.scale, -6, 6)
        p_all, u_all = norm(positive), norm(unlabelled)
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for t in range(1, steps + 1):
            p, u = p_all[self.rng.integers(0, len(p_all), batch)], u_all[self.rng.integers(0, len(u_all), batch)]
            _, _, grads = self.risk(p, u, prior)
            grads[0], grads[2] = grads[0] + decay * self.w[0], grads[2] + decay * self.w[2]
            for k, grad in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> None:
        """Logistic scaling of the net's output g without negatives: Newton steps on the unbiased logistic risk
        mean over unlabelled of log(1 + exp(a g + b)) - prior * mean over positives of (a g + b), which is convex. At its least the
        mean score of unlabelled text is the prior. The order of scores stays as the net has it."""
        p, u = self.raw(positive), self.raw(unlabelled)
        a, b = 1.0, 0.0
        for _ in range(60):
            s = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
            w = s * (1 - s) + 1e-9
            grad = np.array([(s * u).mean() - prior * p.mean() + 1e-3 * a, s.mean() - prior])
            hess = np.array([[(w * u * u).mean() + 1e-3, (w * u).mean()], [(w * u).mean(), w.mean() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.slope, self.shift = (max(a, 0.1), b) if a > 0 else (1.0, 0.0)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among the unlabelled, from outputs of any net that neither was used to fit.

    Above every threshold stand at least prior * (share of positives above it) of the unlabelled; the estimate is the ratio
    of the two shares at the threshold where, with an allowance for chance, that bound is least.
    """
    cuts = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    chance = math.sqrt(math.log(4 / confidence) / 2) * (1 / math.sqrt(len(positive)) + 1 / math.sqrt(len(unlabelled)))
    best = int(np.argmin((above_u + chance) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def held_out(fold: int = 5) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % fold == 0


def sample_features(docs: DataFrame, ids: DataFrame) -> dict[int, np.ndarray]:
    """Features of the sampled documents, gathered to the driver; `ids` is bounded by the sample's limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(*column_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").mapInArrow(run, "doc_id bigint, x array<double>")
    t = rows.toArrow()
    return dict(zip(t.column("doc_id").to_pylist(), map(np.array, t.column("x").to_pylist()), strict=True))


def train(docs: DataFrame, labels: DataFrame, most: int = 8000) -> Net:
    """Fits the net on at most `most` trusted positives and `most` unlabelled documents, those of least seeded hash.

    Only rows outside the held-out fold count. Trusted positives are labelled rows with quality 1; of the others nothing is learned, but a
    document that has contrary labels is not trusted. The unlabelled text is a sample of all documents, whatever their label. The class prior
    is estimated from the two samples alone (a first net on one half, estimate_prior on the other), and so is the scale of the scores. Without
    positives or unlabelled text the net scores every text 0.5.

    Repeated rows of one doc_id count once, by any of their texts. Rows without a doc_id are scored but not learned. Null and empty texts are
    texts whose features are 0. Ties of the hash go by doc_id. Columns other than doc_id, text and quality are ignored, whatever their names. Very long texts
    are measured whole.
    """
    known = docs.select("doc_id").where("doc_id is not null").where(~held_out()).distinct()
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out())
    trusted = marked.where("quality = 1").select("doc_id").orderBy(F.xxhash64(F.lit(31), "doc_id"), "doc_id").limit(most).collect()
    web = known.orderBy(F.xxhash64(F.lit(37), "doc_id"), "doc_id").limit(most).collect()
    trusted, web = [r[0] for r in trusted], [r[0] for r in web]
    net = Net()
    x = sample_features(docs, docs.sparkSession.createDataFrame([(i,) for i in {*trusted, *web}], "doc_id bigint")) if trusted and web else {}
    positive, unlabelled = (np.array([x[i] for i in ids if i in x]) for ids in (trusted, web))
    if len(positive) < 2 or len(unlabelled) < 2:
        net.w[2] *= 0
        return net
    first = Net(seed=6)
    first.fit(positive[::2], unlabelled[::2], 0.5)
    prior = estimate_prior(first.raw(positive[1::2]), first.raw(unlabelled[1::2]))
    net.fit(positive, unlabelled, prior)
    net.calibrate(positive, unlabelled, prior)
    return net


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score) of every whole text, null and empty ones included (all features 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.score(features(*column_bytes(b.column(1)))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double")


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents, all their columns, that score `threshold` or more."""
    net, names = train(docs, labels), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(net.score(features(*column_bytes(b.column(at)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_positive_unlabelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: every document scored by the net of train()."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
