"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.llm.textbytes import column_bytes

SPAN = 64
HIDDEN = 8
PAD = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


class Gru:
    """One direction: arrays have units first, windows last. Gates stand in the order update, reset, candidate."""

    def __init__(self, rng: np.random.Generator) -> None:
        f = lambda *s, k: rng.normal(0, k, s).astype(np.float32)
        self.e, self.u, self.b = f(3 * HIDDEN, 256, k=0.4), f(3 * HIDDEN, HIDDEN, k=HIDDEN**-0.5), np.zeros((HIDDEN, 1), dtype=np.float32)

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, HIDDEN, windows) for bytes (steps, windows)."""
        steps, n = x.shape
        out = np.empty((steps, HIDDEN, n), dtype=np.float32)
        h = np.zeros((HIDDEN, n), dtype=np.float32)
        k = 2 * HIDDEN
        a, g = np.empty((3 * HIDDEN, n), dtype=np.float32), np.empty((3 * HIDDEN, n), dtype=np.float32)
        for t in range(steps):
            np.take(self.e, x[t], axis=1, out=a, mode="clip")
            np.matmul(self.u, h, out=g)
            a[:k] += g[:k]
            zr = _sigmoid(a[:k])
            c = g[k:]
            c += self.b
            hc = c.copy() if keep is not None else None
            c *= zr[HIDDEN:]
            c += a[k:]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((zr.copy(), c.copy(), hc, h))
            new = out[t]
            np.subtract(h, c, out=new)
            new *= zr[:HIDDEN]
            new += c
            h = new
        return out

    def backward(self, x: np.ndarray, keep: list, dout: np.ndarray) -> list[np.ndarray]:
        """Gradients of e, u and b by backpropagation through time."""
        steps, n = x.shape
        de, du, db = np.zeros_like(self.e), np.zeros_like(self.u), np.zeros_like(self.b)
        gates = np.empty((3 * HIDDEN, steps, n), dtype=np.float32)
        dh = np.zeros((HIDDEN, n), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            zr, c, hc, h = keep[t]
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            dh = dh + dout[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            back = np.concatenate((dz, dr, dc * r))
            du += back @ h.T
            db += (dc * r).sum(axis=1, keepdims=True)
            gates[:, t] = np.concatenate((dz, dr, dc))
            dh = dh * z + self.u.T @ back
        flat = x.ravel()
        for k in range(3 * HIDDEN):
            de[k] = np.bincount(flat, weights=gates[k].ravel(), minlength=256)
        return [de, du, db]


class Tagger:
    """Both directions and a softmax over languages at every position."""

    def __init__(self, languages: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.fore, self.back = languages, Gru(rng), Gru(rng)
        self.v, self.c = rng.normal(0, 0.3, (len(languages), 2 * HIDDEN)).astype(np.float32), np.zeros((len(languages), 1), dtype=np.float32)

    def logits(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        f = self.fore.forward(x, keep and keep[0])
        b = self.back.forward(x[::-1], keep and keep[1])[::-1]
        h = np.concatenate((f, b), axis=1)
        return np.matmul(self.v, h) + self.c, h

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over the labels of all positions that are not padding."""
        keep: tuple[list, list] = ([], [])
        o, h = self.logits(x, keep)
        p = np.exp(o - o.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        real = (x != PAD)[:, None, :]
        d = p
        d[:, y, np.arange(len(y))] -= 1
        d *= real / np.float32(max(1, real.sum()))
        dv, dc = np.einsum("tln,thn->lh", d, h, optimize=True), d.sum(axis=(0, 2))[:, None]
        dh = np.matmul(self.v.T, d)
        return [*self.fore.backward(x, keep[0], dh[:, :HIDDEN]), *self.back.backward(x[::-1], keep[1], dh[::-1, HIDDEN:]), dv, dc]

    def fit(self, windows: np.ndarray, y: np.ndarray, steps: int = 260, batch: int = 256, rate: float = 0.02, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        params = [self.fore.e, self.fore.u, self.fore.b, self.back.e, self.back.u, self.back.b, self.v, self.c]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(y), batch)
            grads = self.step(np.ascontiguousarray(windows[pick].T), y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * (1 - t / (steps + 1))
            for k, g in enumerate(grads):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                params[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def pooled(self, data: np.ndarray, offsets: np.ndarray, windows_at_once: int = 4096) -> np.ndarray:
        """(documents, languages): softmax of the mean log-probability over every byte of each document."""
        n, k = len(offsets) - 1, len(self.languages)
        total = np.zeros((n, k))
        lengths = np.diff(offsets)
        count = -(-lengths // SPAN)
        row = np.repeat(np.arange(n), count)
        start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * SPAN
        size = np.minimum(offsets[row + 1] - start, SPAN) if len(row) else np.zeros(0, dtype=np.int64)
        for i in range(0, len(row), windows_at_once):
            r, s, z = row[i : i + windows_at_once], start[i : i + windows_at_once], size[i : i + windows_at_once]
            place = np.arange(SPAN)[:, None]
            real = place < z
            x = np.where(real, _LOWER[data[np.minimum(s + place, len(data) - 1)]], PAD)
            o, _ = self.logits(x)
            o -= o.max(axis=1, keepdims=True)
            lse = np.log(np.exp(o).sum(axis=1, keepdims=True))
            o -= lse
            o *= real[:, None, :]
            per = o.sum(axis=0)
            for j in range(k):
                total[:, j] += np.bincount(r, weights=per[j], minlength=n)
        mean = total / np.maximum(lengths, 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def held_out(fold: int = 4, at: int = 2) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % fold == at


def train(docs: DataFrame, per_language: int = 400, windows: int = 24, most_documents: int = 25_600, most_windows: int = 60_000) -> Tagger | None:
    """Fits a tagger on the `per_language` documents of least seeded hash of each language outside the held-out fold.

    The training sample is bounded, and only it: `most_documents` texts in all, so with many languages each has fewer than
    `per_language`, but every language is learned (over most_documents / 4 of them raise an error); of each text `windows` windows of SPAN
    bytes at places spread over the whole of it; of all windows `most_windows`, drawn with the same chance for each language. Documents
    without text or lang are not learned. Rows that repeat a doc_id are one place in the sample and all of them are learned; other columns
    are ignored. None if there is nothing to learn from.
    """
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(~held_out())
    n = known.agg(F.count_distinct("lang")).first()[0]
    if n > most_documents // 4:
        raise ValueError(f"{n} languages are more than a sample of {most_documents} documents can teach")
    per_language = min(per_language, most_documents // max(n, 1))
    ids = known.select("doc_id", "lang", F.xxhash64(F.lit(41), "doc_id").alias("_h")).distinct()
    for key in (["lang", F.pmod("_h", F.lit(64))], ["lang"]):  # within slices first, so no task sees a whole language
        ids = ids.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy("_h", "doc_id"))).where(F.col("_r") <= per_language).drop("_r")
    ids = ids.select("doc_id").distinct()
    length = F.length("text")
    step = F.greatest(F.lit(1), F.floor(length / windows)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring("text", i.cast("int") * step + 1, F.lit(SPAN)))
    rows = known.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang", F.array_distinct(F.filter(cuts, lambda c: F.length(c) > 0)).alias("cuts")).orderBy("doc_id", "lang").collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    xs, ys = [], []
    for r in rows:
        for c in r["cuts"]:
            b = np.frombuffer(c.encode()[:SPAN], dtype=np.uint8)
            if len(b):
                w = np.full(SPAN, PAD, dtype=np.uint8)
                w[: len(b)] = _LOWER[b]
                xs.append(w)
                ys.append(languages.index(r["lang"]))
    if not xs:
        return None
    x, y = np.array(xs), np.array(ys)
    rng = np.random.default_rng(13)
    share = np.bincount(y, minlength=len(languages))
    pick = rng.choice(len(y), size=min(len(y), most_windows), p=(1 / share[y]) / (1 / share[y]).sum())
    tagger = Tagger(languages)
    tagger.fit(x[pick], y[pick])
    return tagger


def identify(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """(doc_id, lang_pred, score): the language of greatest pooled probability over all bytes of the whole text.

    Every text is cut into windows of SPAN bytes, all of which are read in both directions; each position is labelled and the
    log-probabilities are averaged over the document. `und` with score 0 goes to null texts, texts without a letter and all texts
    if nothing was learned. Equal probabilities go to the first language by name. Repeated rows get the same prediction each; columns
    other than doc_id and text are ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = column_bytes(b.column(1))
            n = len(offsets) - 1
            letters = np.concatenate(([0], np.cumsum(LETTER[data])))
            has = letters[offsets[1:]] > letters[offsets[:-1]]
            wide = np.flatnonzero(~has & (np.diff(offsets) > 0))
            for i in wide:  # letters beyond ASCII
                has[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "ignore"))
            if tagger is None or not n:
                names, score = ["und"] * n, np.zeros(n)
            else:
                p = tagger.pooled(data, offsets)
                best = p.argmax(axis=1)
                names = [tagger.languages[k] if ok else "und" for k, ok in zip(best, has, strict=True)]
                score = np.where(has, p[np.arange(n), best], 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op7_byte_gru(docs: DataFrame) -> DataFrame:
    """The contract's columns: every document identified by the tagger of train()."""
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
