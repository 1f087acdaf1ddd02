"""N-best segmentation over a piece lattice: forward Viterbi scores guide a backward A* search exactly."""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.textbytes import column_bytes, runs

SPACE = "▁"
LONG = 40
CACHED = 250_000


class Pieces:
    """Pieces and scores of a SentencePiece model with byte fallback and no other normalisation than the space mark."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], prefix: bool) -> None:
        self.pieces, self.byte_ids, self.prefix = pieces, byte_ids, prefix
        self.text = {i: p for p, (i, _) in pieces.items()}
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.longest = max(map(len, pieces))
        #: A character without a piece costs ten less than the worst ordinary piece, however many bytes it takes.
        self.unknown = min(s for _, s in pieces.values() if s > -1e8) - 10.0
        self.local = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.lines = not any("\n" in p for p in pieces)
        code = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(code)
        self.codes = code[order]
        self.ids = np.array([i for i, _ in pieces.values()], dtype=np.int64)[order]
        self.scores = np.array([s for _, s in pieces.values()])[order]
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.codes >> np.uint64(44)).astype(np.int64)] = True
        if len(np.unique(self.codes)) != len(self.codes):
            raise ValueError("two pieces share a hash")

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
        return h

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Reads a model file on the driver; what executors need is its vocabulary, which goes with the tasks."""
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not m.trainer_spec.byte_fallback:
            raise ValueError("only models without normalisation and with byte fallback are read")
        usual = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        return cls(usual, [i for i, p in enumerate(m.pieces) if p.type == 6], spec.add_dummy_prefix)

    def ending(self, s: str, b: int) -> Iterator[tuple[int, int, float]]:
        """(start, id, score) of the pieces that end at b, longest first; id -1 is a character as bytes."""
        for a in range(max(0, b - self.longest), b):
            found = self.pieces.get(s[a:b])
            if found:
                yield (a, *found)
            elif a == b - 1:
                yield a, -1, self.unknown

    def forward(self, s: str) -> list[float]:
        """The best score of a way from the start to each place."""
        alpha = [0.0] + [-math.inf] * len(s)
        for a in range(len(s)):
            here = alpha[a]
            for b in range(a + 1, min(len(s), a + self.longest) + 1):
                found = self.pieces.get(s[a:b])
                if found:
                    alpha[b] = max(alpha[b], here + found[1])
                elif b == a + 1:
                    alpha[b] = max(alpha[b], here + self.unknown)
        return alpha

    def spell(self, s: str, path: tuple | None) -> np.ndarray:
        """Ids of a path of (start, id, rest)."""
        out = array("i")
        while path is not None:
            a, i, path = path
            if i >= 0:
                out.append(i)
            else:
                out.extend([self.byte_ids[x] for x in s[a].encode()])
        return np.array(out, dtype=np.int32)

    def spelled(self, ids: list[int]) -> str:
        """The marked text of some ids; runs of byte ids are UTF-8."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.text[i] for i in ids])
        parts: list[str] = []
        for byte, run in itertools.groupby(ids, key=lambda i: i in self.byte_of):
            run = list(run)
            parts.append(bytes(self.byte_of[i] for i in run).decode("utf-8", "replace") if byte else "".join(self.text[i] for i in run))
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        """The text of some ids, without the space that stands before every text."""
        text = self.spelled(ids).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def n_best(pieces: Pieces, s: str, n: int) -> list[tuple[float, np.ndarray]]:
    """The n best segmentations of a string, best first, as (score, ids).

    Forward scores alpha are the best way from the start to each place, so that score so far + alpha is exactly what a
    partial path from the end can still reach. Partial paths stand for disjoint sets of segmentations, so n of them at
    most can matter: the search keeps the n with the highest values and extends the first. Of equal values the one nearest to the start
    comes first, then the one met first, where longer last pieces are met before shorter ones; this is the order of
    segmentations of equal score, too. Pieces are looked up where a path needs them: memory is a number for each
    character and a step for each piece of a kept path, whatever the text.
    """
    alpha = pieces.forward(s)
    # value, place, order, score so far, path as (start, id, rest of the path to the end)
    frontier: list[tuple] = [(-alpha[-1], len(s), 0, 0.0, None)]
    found: list[tuple[float, np.ndarray]] = []
    tick = 1
    while frontier and len(found) < n:
        _, at, _, done, path = frontier.pop(0)
        if at == 0:
            found.append((done, pieces.spell(s, path)))
            continue
        room = n - len(found)
        for a, i, w in pieces.ending(s, at):
            value = -(done + w + alpha[a])
            if len(frontier) == room:
                if (value, a, tick) >= frontier[-1][:3]:
                    continue
                frontier.pop()
            bisect.insort(frontier, (value, a, tick, done + w, (a, i, path)))
            tick += 1
    return found


class Encoder:
    """Encodes whole texts. Between two segments no piece can stand, so the best of a text are the sums of theirs."""

    def __init__(self, pieces: Pieces, n: int) -> None:
        self.p, self.n = pieces, n
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.kept: list[np.ndarray] = [np.zeros(0, dtype=np.int32)]
        self.lengths: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        self.score: list[np.ndarray] = [np.zeros(0)]
        self.gap: list[np.ndarray] = [np.zeros(0)]
        self.same: list[np.ndarray] = [np.zeros(0, dtype=bool)]
        self.listed: dict[str, list[tuple[float, np.ndarray]]] = {}

    def segments(self, text: str) -> list[str]:
        """Keys of the parts of a marked text that no piece can cross: a part begins with the space marks before a word, of
        which the key leaves out the first, or, if no piece holds a line break, with a line break, which the key keeps."""
        if not text:
            return []
        if not (self.p.local and self.p.prefix):
            return ["\0" + (SPACE if self.p.prefix else "") + text.replace(" ", SPACE)]
        plain = SPACE not in text and "  " not in text and " \n" not in text and text[0] not in " \n" and text[-1] != " "
        if plain and "\0" not in text:
            return (text.replace("\n", " \n") if self.p.lines else text).split(" ")
        marked = SPACE + text.replace(" ", SPACE)
        if not self.p.lines:
            return ["\0" + x for x in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", marked)]
        return ["\0" + x for x in re.findall(f"\n[^{SPACE}\n]*|{SPACE}*[^{SPACE}\n]+|{SPACE}+(?=\n|$)", marked)]

    def string(self, key: str) -> str:
        """The part of the marked text that a key stands for."""
        return key[1:] if key[:1] == "\0" else key if self.p.lines and key[:1] == "\n" else SPACE + key

    def learn(self, segments: list[str]) -> None:
        """Finds best path, score and distance to the second best of segments not seen yet, many of a length at once."""
        by: dict[int, list[str]] = {}
        for key in segments:
            size = len(self.string(key))
            by.setdefault(size if size <= LONG else 0, []).append(key)
        for size, group in by.items():
            for i in range(0, len(group), 2048):
                part = [self.string(key) for key in group[i : i + 2048]]
                ids, lengths, score, gap = self._many(part, size) if size else self._long(group[i : i + 2048])
                at, flat, ends = len(self.index), ids.tolist(), np.cumsum(lengths).tolist()
                # a part reads back if its pieces, the space mark being a space, spell it
                same = [self.p.spelled(flat[b - n : b]) == x for x, n, b in zip(part, lengths.tolist(), ends, strict=True)]
                self.same.append(np.array(same))
                self.index.update(zip(group[i : i + 2048], range(at, at + len(part)), strict=True))
                for store, x in ((self.kept, ids), (self.lengths, lengths), (self.score, score), (self.gap, gap)):
                    store.append(x)

    def _long(self, keys: list[str]) -> tuple:
        best = [n_best(self.p, self.string(key), max(self.n, 2)) for key in keys]
        self.listed.update((key, b[: self.n]) for key, b in zip(keys, best, strict=True))
        ids = np.concatenate([b[0][1] for b in best])
        return ids, np.array([len(b[0][1]) for b in best]), np.array([b[0][0] for b in best]), np.array([b[0][0] - b[1][0] if len(b) > 1 else np.inf for b in best])

    def _many(self, part: list[str], size: int) -> tuple:
        p, n = self.p, len(part)
        code = np.array(part, dtype=f"<U{size}").view(np.uint32).reshape(n, size).astype(np.uint64)
        most = min(p.longest, size)
        edge = np.full((size, most, n), -np.inf)
        ids = np.full((size, most, n), -1, dtype=np.int32)
        for a in range(size):
            h = np.zeros(n, dtype=np.uint64)
            for m in range(min(most, size - a)):
                h = h * np.uint64(0x9E3779B97F4A7C15) + code[:, a + m] + np.uint64(1)
                if m == 0:
                    edge[a, 0] = p.unknown
                maybe = np.flatnonzero(p.seen[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(p.codes, h[maybe]), len(p.codes) - 1)
                hit = p.codes[at] == h[maybe]
                at, maybe = at[hit], maybe[hit]
                edge[a, m, maybe] = p.scores[at]
                ids[a, m, maybe] = p.ids[at]
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0
        by = np.zeros((size + 1, n), dtype=np.int64)
        for b in range(1, size + 1):
            for m in range(min(most, b) - 1, -1, -1):  # of equal scores the longest last piece
                x = alpha[b - m - 1] + edge[b - m - 1, m]
                better = x > alpha[b]
                alpha[b] = np.where(better, x, alpha[b])
                by[b] = np.where(better, m, by[b])
        beta = np.full((size + 1, n), -np.inf)
        beta[size] = 0
        for a in range(size - 1, -1, -1):
            for m in range(min(most, size - a)):
                beta[a] = np.maximum(beta[a], edge[a, m] + beta[a + m + 1])
        col = np.arange(n)
        pos = np.full(n, size)
        rows = []
        total = np.full((size, most, n), -np.inf)
        for a in range(size):
            for m in range(min(most, size - a)):
                total[a, m] = alpha[a] + edge[a, m] + beta[a + m + 1]
        while (pos > 0).any():
            live = pos > 0
            m = by[pos, col]
            a = np.where(live, pos - m - 1, 0)
            rows.append((np.where(live, ids[a, m, col], -2), np.where(live, a, -1)))
            total[a[live], m[live], col[live]] = -np.inf  # the second best leaves the best path somewhere
            pos = np.where(live, a, 0)
        second = total.reshape(-1, n).max(axis=0)
        best = alpha[size]
        gap = np.where(np.isfinite(second), np.maximum(best - second, 0.0), np.inf)
        out = np.array([r for r, _ in rows[::-1]]).T
        starts = np.array([a for _, a in rows[::-1]]).T
        unknown = (out == -1).any(axis=1)
        lengths = (out >= 0).sum(axis=1)
        if not unknown.any():
            return out[out >= 0].astype(np.int32), lengths, best, gap
        flat: list[np.ndarray] = []
        for i in range(n):
            if unknown[i]:
                path = None
                for x, a in zip(out[i][::-1].tolist(), starts[i][::-1].tolist(), strict=True):
                    path = path if x == -2 else (a, x, path)
                flat.append(p.spell(part[i], path))
                lengths[i] = len(flat[-1])
            else:
                flat.append(out[i][out[i] >= 0].astype(np.int32))
        return np.concatenate(flat), lengths, best, gap

    def encode(self, texts: list[str]) -> Iterator[tuple]:
        """For each text (ids, scores of the n best, counts of their pieces, crc32 of their ids as little-endian int32, whether it reads back)."""
        for ways, scores, same in self.readings(texts):
            yield ways[0], scores, [len(w) for w in ways], [zlib.crc32(np.ascontiguousarray(w, dtype="<i4")) for w in ways], same

    def readings(self, texts: list[str]) -> Iterator[tuple]:
        """For each text (ids of each of the n best, their scores, whether it reads back)."""
        if len(self.index) > CACHED or sum(map(len, self.kept)) > 16 * CACHED:
            self._clear()
        cut = [self.segments(t) for t in texts]
        every = list(itertools.chain.from_iterable(cut))
        where = np.fromiter(map(self.index.get, every, itertools.repeat(-1)), dtype=np.int64, count=len(every))
        missing = np.flatnonzero(where < 0)
        if len(missing):
            self.learn(sorted({every[k] for k in missing}))
            where[missing] = [self.index[every[k]] for k in missing]
        self.kept, self.lengths, self.score, self.gap, self.same = ([np.concatenate(x)] for x in (self.kept, self.lengths, self.score, self.gap, self.same))
        pool, lengths, score, gap = self.kept[0], self.lengths[0], self.score[0], self.gap[0]
        starts, begin = np.cumsum(lengths) - lengths, 0
        for text, segs in zip(texts, cut, strict=True):
            if not segs:
                yield [np.zeros(0, dtype=np.int32)], [0.0], True
                continue
            at = where[begin : begin + len(segs)]
            begin += len(segs)
            size = lengths[at]
            ends = np.cumsum(size)
            ids = pool[np.repeat(starts[at] - ends + size, size) + np.arange(ends[-1])]
            same = bool(self.same[0][at].all()) and SPACE not in text
            best = float(score[at].sum())
            # only the n - 1 segments nearest to another reading can change in the n best
            near = np.argsort(gap[at], kind="stable")[: self.n - 1] if len(at) <= 64 else self._nearest(gap[at])
            ways: list[tuple[float, tuple]] = [(0.0, ())]
            for k in near:
                if not np.isfinite(gap[at[k]]):
                    break
                s = segs[k]
                if s not in self.listed:
                    self.listed[s] = n_best(self.p, self.string(s), self.n)
                own = self.listed[s]
                ways = heapq.nsmallest(self.n, ((d + own[0][0] - w, (*c, (int(k), r)) if r else c) for d, c in ways for r, (w, _) in enumerate(own)), key=lambda x: x[0])
            scores, wholes = [], []
            for d, changes in ways:
                parts, last = [], 0
                for k, r in sorted(changes):
                    parts += [ids[last : ends[k] - size[k]], self.listed[segs[k]][r][1]]
                    last = ends[k]
                wholes.append(np.concatenate((*parts, ids[last:])) if parts else ids)
                scores.append(best - d)
            yield wholes, scores, same

    def _nearest(self, gap: np.ndarray) -> np.ndarray:
        some = np.argpartition(gap, self.n - 1)[: self.n - 1]
        return some[np.argsort(gap[some], kind="stable")]


def encode(docs: DataFrame, model: str, n: int = 4, at_once: int = 4 << 20, every: bool = False) -> DataFrame:
    """doc_id, ids of the best segmentation, scores, piece counts and crc32 of the n best, and whether decoding gives the text; with `every` also nbest, the ids of
    each of the n best, best first.

    Whole texts are encoded, about `at_once` bytes of them at a time (a longer one by itself), which bounds memory and changes no result.
    Null and empty texts have no ids, one segmentation of score 0 and no pieces, and decode to the
    empty text. Texts with fewer than n segmentations list those there are. Segmentations of equal score
    come in the order that n_best states for a part; of changes to several parts of a text that cost the same, those to parts nearer to a second reading, then
    earlier parts, come first. Unbroken runs of any length are searched in memory in proportion to their length. A text that holds the space mark itself decodes to a space there, and says so. Other columns
    and clashing names are ignored; rows that repeat are encoded each for itself.
    """
    pieces = Pieces.load(model)

    def lists(flat: list[np.ndarray]) -> pa.ListArray:
        ends = np.concatenate(([0], np.cumsum([len(x) for x in flat]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *flat])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, n)
        for b in batches:
            _, offsets = column_bytes(b.column(1))
            for i, j in runs(offsets, at_once):
                part = b.slice(i, j - i)
                texts = [t or "" for t in part.column(1).to_pylist()]
                best, scores, counts, sums, same, ways = [], [], [], [], [], []
                for w, x, ok in encoder.readings(texts):
                    best.append(w[0])
                    scores.append(x)
                    counts.append([len(y) for y in w])
                    sums.append([zlib.crc32(np.ascontiguousarray(y, dtype="<i4")) for y in w])
                    same.append(ok)
                    ways.append(w if every else ())
                columns = [part.column(0), lists(best), pa.array(scores, pa.list_(pa.float64())), pa.array(counts, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.int64())), pa.array(same)]
                names = ["doc_id", "ids", "scores", "pieces", "crcs", "round_trip"]
                if every:
                    ends = np.concatenate(([0], np.cumsum([len(w) for w in ways]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), lists([y for w in ways for y in w])))
                    names.append("nbest")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", nbest array<array<int>>" if every else ""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, ids array<int>, scores array<double>, pieces array<bigint>, crcs array<bigint>, round_trip boolean" + more)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""
    pieces = Pieces.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id bigint, text string")


def op3_nbest(docs: DataFrame, model: str) -> DataFrame:
    """Every document with the ids of its best segmentation, and the ids (nbest) and digests of each of its four best."""
    return encode(docs, model, 4, every=True)
