"""Exact neighbours by cosine through pivots: the angle between vectors is a metric, so blocks that are far from each other as seen from any pivot need
not be compared."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.operators.iterate import cut

#: Angles are compared with this much to spare, for they come from rounded cosines.
SLACK = 1e-6
BINS = 1024


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim) if len(flat) else np.zeros((0, dim))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 where a vector is zero."""
    n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
    return np.divide(x @ y.T, n, out=np.zeros((len(x), len(y))), where=n > 0)


def spread_out(sample: np.ndarray, most: int) -> np.ndarray:
    """Of a sample, `most` directions that lie far from each other: each next one is the farthest from those before it."""
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    if not len(sample):
        return sample
    chosen, near = [0], cosines(sample, sample[:1])[:, 0]
    while len(chosen) < most and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, cosines(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


class Index:
    """Vectors (id, e) in blocks around pivots.

    A vector belongs to the pivot of the smallest angle; what belongs to a pivot is cut into rings by that angle, so that a block has about
    `block_rows` rows. Of each block the least and greatest angle to every pivot are known: if two blocks' ranges of angles to some pivot are
    apart by more than r, all their vectors are. Pivots come from a sample of `sample` vectors; they decide what is compared, not what is found.
    Zero vectors are in blocks of their own, which are near to everything. A table within one block needs no pivots. Rows without an id or a vector and
    vectors of another length than the sample's first are left out.
    """

    def __init__(self, vectors: DataFrame, block_rows: int = 2048, sample: int = 4096, like: Index | None = None) -> None:
        d = vectors.select("id", F.col("embedding").cast("array<double>").alias("e")).where("id is not null and embedding is not null")
        if like is None:
            some = d.orderBy(F.xxhash64("id"), "id").limit(sample).select("e").collect()
            self.dim = max((len(r.e) for r in some), default=1)
            x = np.array([r.e for r in some if len(r.e) == self.dim], dtype=float).reshape(-1, self.dim)
            rows = len(some) if len(some) < sample else d.count()
            self.single = rows <= block_rows
            self.pivots = spread_out(x[:sample], 1 if self.single else min(128, max(8, 4 * math.isqrt(rows // block_rows + 1))))
            if not len(self.pivots):  # zero vectors alone
                self.pivots = np.eye(1, self.dim)
        else:
            self.dim, self.pivots, self.single = like.dim, like.pivots, like.single and vectors.limit(block_rows + 1).count() <= block_rows
        d = d.where(F.size("e") == self.dim)
        if self.single:
            self.placed = d.withColumns({"cell": F.lit(0), "block": F.lit(0).cast("long")})
            return
        placed = cut(self._measured(d))
        # fine bins of the angle, then rings of whole bins; a bin that is too full is dealt into several blocks by a hash
        bins = placed.groupBy("cell", "bin").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("cell").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("ring", F.floor(before / block_rows))
        rings = bins.groupBy("cell", "ring").agg(F.ceil(F.sum("n") / (2.0 * block_rows)).alias("parts"))
        bins = bins.join(rings, ["cell", "ring"]).select("cell", "bin", "ring", "parts")  # BINS a pivot at most
        placed = placed.join(F.broadcast(bins), ["cell", "bin"])
        block = (F.col("cell") + 1) * F.lit(2**40) + F.col("ring") * F.lit(2**20) + F.pmod(F.xxhash64("id"), F.col("parts"))
        self.placed = cut(placed.select("id", "e", "cell", block.alias("block"), "angles"))
        ends = [f(F.col("angles")[i]) for i in range(len(self.pivots)) for f in (F.min, F.max)]
        g = self.placed.groupBy("cell", "block").agg(F.array(*ends[::2]).alias("low"), F.array(*ends[1::2]).alias("high"))
        self.blocks = cut(g)
        self.placed = self.placed.drop("angles")

    def _measured(self, d: DataFrame) -> DataFrame:
        """Adds the nearest pivot, a bin of its angle, and the angles to all pivots; for zero vectors no pivot (-1) and no angles, which rule out nothing."""
        pivots, dim = self.pivots, self.dim

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("e"), dim)
                angles = np.arccos(np.clip(cosines(x, pivots), -1, 1)).astype(np.float64)
                cell = angles.argmin(axis=1).astype(np.int32)
                bins = np.minimum(angles[np.arange(len(x)), cell] / math.pi * BINS, BINS - 1).astype(np.int32)
                zero = np.linalg.norm(x, axis=1) == 0
                cell[zero], bins[zero] = -1, 0
                angles[zero] = np.nan
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("e"), pa.array(cell), pa.array(bins), pa.FixedSizeListArray.from_arrays(pa.array(angles.reshape(-1)), len(pivots)).cast(pa.list_(pa.float64()))], ["id", "e", "cell", "bin", "angles"]
                )

        ids = d.schema["id"].dataType.simpleString()
        return d.mapInArrow(measure, f"id {ids}, e array<double>, cell int, bin int, angles array<double>")

    def cells(self) -> DataFrame:
        """Each pivot's ranges over all of its blocks: as many rows as there are pivots."""
        n = len(self.pivots)
        return self.blocks.groupBy("cell").agg(F.array(*[F.min(F.col("low")[i]) for i in range(n)]).alias("low"), F.array(*[F.max(F.col("high")[i]) for i in range(n)]).alias("high"))


def nearest_of(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, k: int, rows: int = 256, cols: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, sim): of each row of x (ids a) the k nearest rows of y (ids b, ascending) with another id, by cosine to nine places, then by id.

    Products in single precision tell what may be among them, with a margin over their rounding; only these few are worked out in double precision. A row that
    has k at a cosine of 1 is done, since later ids are no better.
    """
    lengths = [np.linalg.norm(z, axis=1) for z in (x, y)]
    with np.errstate(invalid="ignore", over="ignore"):
        unit = [np.where(np.isfinite(z).all(axis=1)[:, None], np.divide(z, n[:, None], out=np.zeros_like(z), where=n[:, None] > 0), np.nan).astype(np.float32) for z, n in zip((x, y), lengths, strict=True)]
    margin = np.float32((x.shape[1] + 16) * 2.4e-7)
    parts: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in range(0, len(a), rows):
        q = unit[0][i : i + rows]
        low = np.full(len(q), -np.inf, dtype=np.float32)
        row, col, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, len(b), cols):
            s = q @ unit[1][j : j + cols].T
            if not j and s.shape[1] > k + 1:  # one of the k + 1 best may be the row itself
                kth = -np.partition(-s, k, axis=1)[:, k]
                low = np.where(np.isnan(kth), low, kth - 2 * margin)
            r, c = np.nonzero(s >= low[:, None])
            for h in range(0, len(r), 65_536):
                rr, cc = r[h : h + 65_536], c[h : h + 65_536] + j
                other = a[i + rr] != b[cc]
                rr, cc = rr[other], cc[other]
                n = lengths[0][i + rr] * lengths[1][cc]
                exact = np.divide(np.einsum("ij,ij->i", x[i + rr], y[cc]), n, out=np.zeros(len(rr)), where=n > 0)
                row, col, sim = np.concatenate((row, rr)), np.concatenate((col, cc)), np.concatenate((sim, exact))
                order = np.lexsort((col, -np.floor(sim * 1e9 + 0.5), row))
                row, col, sim = row[order], col[order], sim[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place < k
                row, col, sim, place = row[keep], col[keep], sim[keep], place[keep]
                last = place == k - 1
                low[row[last]] = np.where(np.floor(sim[last] * 1e9 + 0.5) >= 1e9, np.inf, sim[last] - margin)
        parts.append((a[i + row], b[col], sim))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def tile_rows(rows: int) -> int:
    """Rows of a block: a sixteenth of the table, so that a row is sent to about as many tiles whatever the table's size, up to what a task holds with ease."""
    return min(65_536, max(2048, -(-rows // 16)))


def apart(a: str, b: str) -> Column:
    """The angle that two blocks, or cells, are at least apart; ranges that are not known (NaN) keep nothing apart."""
    gap = F.transform(F.arrays_zip(F.col(f"{a}.low").alias("a"), F.col(f"{a}.high").alias("b"), F.col(f"{b}.low").alias("c"), F.col(f"{b}.high").alias("d")), lambda z: F.greatest(z["c"] - z["b"], z["a"] - z["d"], F.lit(0.0)))
    gap = F.array_max(F.transform(gap, lambda g: F.when(F.isnan(g) | g.isNull(), 0.0).otherwise(g)))
    return F.coalesce(gap, F.lit(0.0))


def block_pairs(left: Index, right: Index, reach: DataFrame | float) -> DataFrame:
    """(qb, ib): blocks of `left` and of `right` that are not known to be farther apart than `reach`, a number or (block, reach) for those of `left`.

    Pairs of cells are settled first, of which there are as many as pivots squared at most; blocks meet within the pairs of cells that are left.
    """
    limit = reach if isinstance(reach, DataFrame) else None
    q = left.blocks if limit is None else left.blocks.join(limit, "block")
    q = q.withColumn("reach", F.lit(float(reach))) if limit is None else q
    widest = q.groupBy("cell").agg(F.max("reach").alias("reach"))
    a = left.cells().join(widest, "cell").alias("a")
    near = a.join(F.broadcast(right.cells()).alias("b"), apart("a", "b") <= F.col("a.reach") + SLACK).select(F.col("a.cell").alias("qc"), F.col("b.cell").alias("ic"))
    x = q.alias("x").join(F.broadcast(near), F.col("x.cell") == F.col("qc"))
    return x.join(right.blocks.alias("y"), F.col("ic") == F.col("y.cell")).where(apart("x", "y") <= F.col("x.reach") + SLACK).select(F.col("x.block").alias("qb"), F.col("y.block").alias("ib"))


def met(left: Index, right: Index, pairs: DataFrame | None, kernel, schema: str) -> DataFrame:  # noqa: ANN001
    """`kernel` over the rows of every pair of blocks (id, e); None stands for the single blocks of two small tables."""
    side = lambda index, mine, other: index.placed.join(F.broadcast(pairs), F.col("block") == F.col(mine)).select("id", "e", "qb", "ib")
    if pairs is None:
        whole = lambda index: index.placed.select("id", "e", F.lit(0).alias("qb"), F.lit(0).alias("ib"))
        q, i = whole(left), whole(right)
    else:
        q, i = side(left, "qb", "ib"), side(right, "ib", "qb")
    i = i.toDF("id", "e", "qb", "ib")  # columns of their own, where both sides come from one table
    return q.groupBy("qb", "ib").cogroup(i.groupBy("qb", "ib")).applyInArrow(kernel, schema)


def nearest(queries: DataFrame | None, vectors: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """(query, item, sim): for each query (id, embedding), or without queries for each vector, its k nearest vectors but itself, by cosine to nine
    places, then by id; and some more that are not among them.

    First every block of queries meets the blocks that may be nearest; the k-th best that its rows find there bounds how far away their neighbours can
    be, and only blocks within that bound are met then.
    """
    block_rows = block_rows or tile_rows(vectors.count())
    index = Index(vectors, block_rows)
    own = index if queries is None else Index(queries, block_rows, like=index)
    dim = index.dim

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query", pa.int64()), ("item", pa.int64()), ("sim", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return pa.table({c: [] for c in out.names}, schema=out)
        right = right.sort_by("id")
        a, b = left.column("id").to_numpy(), right.column("id").to_numpy()
        found = nearest_of(a, matrix(left.column("e"), dim), b, matrix(right.column("e"), dim), k)
        return pa.table(list(found), schema=out)

    schema = "query bigint, item bigint, sim double"
    if index.single and own.single:
        return met(own, index, None, kernel, schema)
    if own.single or index.single:  # one side is one block: it meets all of the other
        every = own.placed.select(F.col("block").alias("qb")).distinct().join(index.placed.select(F.col("block").alias("ib")).distinct())
        return met(own, index, cut(every), kernel, schema)
    near = block_pairs(own, index, math.pi / 2).alias("p")
    close = near.join(own.blocks.alias("x"), F.col("qb") == F.col("x.block")).join(index.blocks.alias("y"), F.col("ib") == F.col("y.block"))
    middle = F.aggregate(F.arrays_zip(F.col("x.low").alias("a"), F.col("x.high").alias("b"), F.col("y.low").alias("c"), F.col("y.high").alias("d")), F.lit(0.0), lambda t, z: t + F.coalesce(F.nanvl(F.abs(z["a"] + z["b"] - z["c"] - z["d"]), F.lit(0.0)), F.lit(0.0)))
    first = close.select("qb", "ib", F.row_number().over(W.partitionBy("qb").orderBy(apart("x", "y"), middle, "ib")).alias("r")).where("r <= 2").select("qb", "ib")
    first = cut(first)
    found = cut(met(own, index, first, kernel, schema))
    worst = found.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim")))).where(F.col("r") == k).select("query", F.acos(F.greatest(F.least(F.col("sim") - 2e-9, F.lit(1.0)), F.lit(-1.0))).alias("reach"))
    reach = own.placed.join(worst, F.col("id") == F.col("query"), "left").groupBy("block").agg(F.max(F.coalesce("reach", F.lit(math.pi))).alias("reach"))
    rest = cut(block_pairs(own, index, reach).join(first, ["qb", "ib"], "left_anti"))
    return found.union(met(own, index, rest, kernel, schema))


def within(vectors: DataFrame, floor: float, block_rows: int | None = None) -> DataFrame:
    """(a, b, sim) of all pairs a < b of vectors (id, embedding) whose cosine, to nine places, is `floor` (over 0) or more, however many a vector has.

    Equal vectors are one class under their smallest id, whose members are paired with that id alone; pairs between classes are pairs of their
    smallest ids. So what is linked stays linked, and a copy costs one row.
    """
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda t, v: t + v * v))
    d = vectors.select("id", F.col("embedding").cast("array<double>").alias("e")).where("id is not null and e is not null")
    same = d.groupBy("e").agg(F.min("id").alias("lead"))
    copies = d.join(same, "e").where(norm > 0).where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    block_rows = block_rows or tile_rows(vectors.count())
    index = Index(same.select(F.col("lead").alias("id"), F.col("e").alias("embedding")), block_rows)
    dim, least = index.dim, math.floor(floor * 1e9 + 0.5)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])
        a, b = left.column("id").to_numpy(), right.column("id").to_numpy()
        x, y = matrix(left.column("e"), dim), matrix(right.column("e"), dim)
        parts = []
        step = max(1, min(512, (1 << 20) // max(1, len(b))))
        for i in range(0, len(a), step):
            s = cosines(x[i : i + step], y)
            r, c = np.nonzero((np.floor(s * 1e9 + 0.5) >= least) & (a[i : i + step, None] < b[None]))
            parts.append((a[i : i + step][r], b[c], s[r, c]))
        whole = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [[], [], []]
        return pa.table(whole, schema=out)

    pairs = None if index.single else cut(block_pairs(index, index, math.acos(max(-1.0, min(1.0, floor - 2e-9)))))
    links = met(index, index, pairs, kernel, "a bigint, b bigint, sim double")
    return links.union(copies)
