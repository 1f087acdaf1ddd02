"""Vector code compression: one codebook for each part of the vectors, learned by Lloyd's rounds in which kd-trees assign whole subtrees at once.

Components are whole numbers, so sums and distances are exact and no result depends on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import cut, within_bound

LEAF = 32
FAR = 2.0**60


class Tree:
    """A kd-tree over points, split at the middle of the widest side of each box. Nodes of a level are consecutive runs of one order of the points;
    each keeps its box, the sum of its points and their number."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        n, d = points.shape
        self.depth = max(0, (n // leaf).bit_length() - 1) if n else 0
        self.order, ends = np.arange(n), np.array([0, n])
        self.ends = [ends]
        for _ in range(self.depth):
            size = np.diff(ends)
            node = np.repeat(np.arange(len(size)), size)
            p = points[self.order]
            spread = np.maximum.reduceat(p, ends[:-1]) - np.minimum.reduceat(p, ends[:-1])
            self.order = self.order[np.lexsort((p[np.arange(n), spread.argmax(axis=1)[node]], node))]
            ends = np.insert(ends, np.arange(1, len(ends)), ends[:-1] + size // 2)
            self.ends.append(ends)
        self.points = points[self.order]
        if not n:
            return
        at = ends[:-1]
        self.low, self.high = [np.minimum.reduceat(self.points, at)], [np.maximum.reduceat(self.points, at)]
        self.sums = [np.add.reduceat(self.points, at)]
        for _ in range(self.depth):  # upwards, from pairs of children
            self.low.insert(0, np.minimum(self.low[0][::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][::2], self.high[0][1::2]))
            self.sums.insert(0, self.sums[0][::2] + self.sums[0][1::2])

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each point (ties to the lower index), and count and sum of the points of each entry.

        From the root down a node has the entries that may be nearest to some of its points. The one nearest to the box's middle rules out every
        entry that is farther from the whole box; where it is left alone, it takes the subtree with its cached sum.
        """
        k, (n, d) = len(entries), self.points.shape
        counts, sums, chosen = np.zeros(k, dtype=np.int64), np.zeros((k, d), dtype=np.int64), np.zeros(n, dtype=np.int64)
        if not n:
            return chosen, counts, sums
        index = np.arange(k)
        nodes, may = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        for level in range(self.depth + 1):
            low, high = self.low[level][nodes], self.high[level][nodes]
            middle = ((low + high)[:, None] - 2 * entries) ** 2
            best = np.where(may, middle.sum(axis=2), np.iinfo(np.int64).max).argmin(axis=1)
            lead = entries[best][:, None]
            corner = np.where(entries > lead, high[:, None], low[:, None])  # of the box, the farthest towards the other entry
            own, other = ((corner - lead) ** 2).sum(axis=2), ((corner - entries) ** 2).sum(axis=2)
            may &= ~((own < other) | ((own == other) & (best[:, None] < index)))
            alone = may.sum(axis=1) == 1
            ends = self.ends[level]
            start, end = ends[nodes], ends[nodes + 1]
            np.add.at(sums, best[alone], self.sums[level][nodes[alone]])
            np.add.at(counts, best[alone], (end - start)[alone])
            for a, b, e in zip(start[alone].tolist(), end[alone].tolist(), best[alone].tolist(), strict=True):
                chosen[a:b] = e
            nodes, may, start, end = nodes[~alone], may[~alone], start[~alone], end[~alone]
            if level < self.depth:
                nodes, may = (2 * nodes[:, None] + [0, 1]).reshape(-1), np.repeat(may, 2, axis=0)
        for i in range(0, len(nodes), 256):  # leaves that stay undecided: point by point, among what is left
            size = (end - start)[i : i + 256]
            at = np.concatenate([np.arange(a, b) for a, b in zip(start[i : i + 256].tolist(), end[i : i + 256].tolist(), strict=True)])
            x = self.points[at].astype(np.float64)  # whole numbers below 2**53, so exact
            far = (x**2).sum(axis=1)[:, None] - 2 * x @ entries.T.astype(np.float64) + (entries.astype(np.float64) ** 2).sum(axis=1)
            e = np.where(np.repeat(may[i : i + 256], size, axis=0), far, FAR).argmin(axis=1)
            chosen[at] = e
            counts += np.bincount(e, minlength=k)
            np.add.at(sums, e, self.points[at])
        back = np.empty(n, dtype=np.int64)
        back[self.order] = chosen
        return back, counts, sums


def finite(embedding: Column) -> Column:
    """False for null vectors and those with null or non-finite components."""
    return F.coalesce(embedding.isNotNull() & ~F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def whole_numbers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; an error where sums of squares might not be exact."""
    x = np.floor(np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim) * scale)
    if len(x) and np.abs(x).max() >= 2**24:
        raise ValueError(f"components of {2**24 // scale} and more are beyond what distances are exact for")
    return x.astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of several batches together, `rows` at most."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        for i in range(0, b.num_rows, rows):
            held.append(b.slice(i, rows))
            if sum(x.num_rows for x in held) >= rows:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, block: int = 1 << 15) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) for each row with a usable vector, and the codebooks (part, entry, component).

    Every task cuts its rows into blocks of `block` and builds a kd-tree for each part of a block. A round sends the driver the count and sum of
    each entry, summed up by Spark: parts * entries rows. The codebooks go back with the next round's tasks. A vector is usable if it is finite and
    as long as the one of the smallest vec_id whose length `parts` divides; others are dropped. `entries` is 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits")
    size = F.size("embedding")
    whole = vectors.select("vec_id", "label", "embedding").where(finite(F.col("embedding")) & (size > 0) & (size % parts == 0))
    order = [F.asc_nulls_last("vec_id"), "embedding"]
    first = whole.orderBy(*order).select(size).limit(1).collect()
    dim = first[0][0] if first else parts
    whole, d = whole.where(size == dim), dim // parts
    if 4 * d * 2**48 >= 2**53:
        raise ValueError("parts of more than seven components are beyond what distances are exact for")
    start = pa.array([r[0] for r in whole.orderBy(*order).select("embedding").limit(entries).collect()], pa.list_(pa.float64()))
    books = np.ascontiguousarray(whole_numbers(start, dim, scale).reshape(-1, parts, d).swapaxes(0, 1))

    def trees(b: pa.RecordBatch) -> Iterator[Tree]:
        x = whole_numbers(b.column("embedding"), dim, scale)
        for p in range(parts):
            yield Tree(np.ascontiguousarray(x[:, p * d : (p + 1) * d]))

    def totals(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for b in blocks(batches, block):
            for p, tree in enumerate(trees(b)):
                _, n, s = tree.assign(books[p])
                count[p] += n
                total[p] += s
        used = np.argwhere(count)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(used[:, 0], pa.int32()), "entry": pa.array(used[:, 1], pa.int32()), "n": pa.array(count[count > 0]), "s": pa.array(list(total[count > 0]), pa.list_(pa.int64()))}
        )

    def codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, block):
            code, error = np.zeros((b.num_rows, parts), dtype=np.uint8), np.zeros(b.num_rows, dtype=np.int64)
            for p, tree in enumerate(trees(b)):
                at, _, _ = tree.assign(books[p])
                code[:, p] = at
                error[tree.order] += ((tree.points - books[p][at[tree.order]]) ** 2).sum(axis=1)
            digits = code.tobytes().hex()
            text = pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), text, pa.array(error)], ["vec_id", "label", "code", "error"])

    for _ in range(rounds if len(start) else 0):
        found = whole.select("embedding").mapInArrow(lambda batches, books=books: totals(batches, books), "part int, entry int, n long, s array<long>")
        sums = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(d)])
        books = books.copy()
        for r in sums.collect():
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
    kinds = dict(zip(vectors.schema.names, vectors.schema.fields, strict=True))
    ids = f"vec_id {kinds['vec_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}"
    return whole.mapInArrow(lambda batches: codes(batches, books), f"{ids}, code string, error long"), books


def op13_filtering_lloyd(vectors: DataFrame) -> DataFrame:
    """The contract's columns. Dropped are rows whose vector is null, empty or holds null or non-finite components, and rows that cannot be cut like the others (another
    length). Fewer than 64 rows give as many entries. Null ids come last in the order of ids, equal ids by their vectors; repeated rows are coded each for
    itself. An empty table gives an empty result. Only vec_id, embedding and label are read. Components of 65536 and more raise an error."""
    coded, books = compress(vectors)
    coded = cut(coded)
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    told = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    out = coded.join(within_bound(by_label), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))
