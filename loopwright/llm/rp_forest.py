"""Embedding near-duplicates: dense groups exactly, by distance bounds to their centres, the rest by a forest of random-projection trees with spill."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import components, cut

LEAF = 384
#: So many neighbours within one leaf make a vector the middle of a dense group.
DENSE = LEAF // 8
BINS = 32


class Forest:
    """Trees of random splits. All nodes of a level of a tree share a random direction; a node's threshold is the median of
    the sampled vectors in it, and vectors within `spill` node spreads of the threshold go down both sides.

    The sample that fixes thresholds is bounded (`most` vectors); below the depth it can resolve, nodes inherit the
    threshold and spread of their last resolved ancestor's level average, so any number of rows can be split further.
    """

    def __init__(self, sample: np.ndarray, rows: int, trees: int, spill: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.trees, self.spill, dim = trees, spill, sample.shape[1] if len(sample) else 1
        grow = min(1.5, 1 + 0.8 * spill)  # a node's two sides hold that many times its rows, as those near the threshold go both ways
        self.depth = math.ceil(math.log(rows / LEAF) / math.log(2 / grow)) if rows > LEAF else 0
        self.directions = rng.normal(size=(trees, self.depth, dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True) + 1e-300
        self.nodes: list[list[dict[int, tuple[float, float]]]] = []
        self.level: list[list[tuple[float, float]]] = []
        for t in range(trees):
            path = np.zeros(len(sample), dtype=np.int64)
            levels, means = [], []
            for d in range(self.depth):
                x = sample @ self.directions[t, d]
                found: dict[int, tuple[float, float]] = {}
                order = np.argsort(path, kind="stable")
                ids, first = np.unique(path[order], return_index=True)
                for node, own in zip(ids.tolist(), np.split(order, first[1:]), strict=True):
                    if len(own) >= 24:
                        found[node] = (float(np.median(x[own])), float(x[own].std()))
                rest = (float(np.median(x)) if len(x) else 0.0, float(np.mean([s for _, s in found.values()])) if found else float(x.std()) if len(x) else 0.0)
                means.append(rest)
                levels.append(found)
                cutoff = np.array([found.get(p, rest)[0] for p in path.tolist()])
                path = path * 2 + (x > cutoff)
            self.nodes.append(levels)
            self.level.append(means)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree, leaf) for every leaf that a row reaches."""
        rows, trees, leaves = [], [], []
        for t in range(self.trees):
            row, path = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
            for d in range(self.depth):
                p = (x @ self.directions[t, d])[row]
                found, rest = self.nodes[t][d], self.level[t][d]
                ids, inverse = np.unique(path, return_inverse=True)
                at = np.array([found.get(i, rest) for i in ids.tolist()]).reshape(-1, 2)[inverse]
                off = p - at[:, 0]
                right, both = off > 0, np.abs(off) < self.spill * at[:, 1]
                row, path, right = np.concatenate((row, row[both])), np.concatenate((path, path[both])), np.concatenate((right, ~right[both]))
                path = path * 2 + right
            rows.append(row)
            trees.append(np.full(len(row), t))
            leaves.append(path)
        return np.concatenate(rows), np.concatenate(trees), np.concatenate(leaves)


def shared_bits(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """(n, words) bit sets of the codes of each row; codes that one row alone has are left out."""
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    new = np.concatenate(([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
    ids = np.cumsum(new) - 1
    many = np.bincount(ids)[ids] > 1 if len(ids) else np.zeros(0, bool)
    _, ids = np.unique(ids[many], return_inverse=True)
    bits = np.zeros((n, (int(ids.max()) >> 6) + 1 if len(ids) else 1), dtype=np.uint64)
    np.bitwise_or.at(bits, (row[many], ids >> 6), np.uint64(1) << (ids & 63).astype(np.uint64))
    return bits


def usable(embedding: F.Column) -> F.Column:
    """False for null and zero vectors and those with null or non-finite components."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda v: v != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim) if len(flat) else np.zeros((0, dim))


def near_vectors(rows: DataFrame, least: float = 0.9, trees: int = 14, spill: float = 0.12, most: int = 16_384, block: int = 512, seed: int = 71, chunk: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) with links between vectors whose cosine, in double precision, is `least` or more.

    Equal vectors are one class under their smallest vec_id, with a count, so copies cost a row. Medians cut a dense group
    like any other rows, and a forest loses its links; so classes near the centre of a dense group are compared exactly with all
    that may link with them (see _cells). The other classes go down a forest built on a sample of `most` classes; in each leaf all are compared, block by block, and a pair that shares
    several leaves counts in the first of these alone. A leaf returns, for each class, how many vectors it links with
    and an edge to the earliest in a spanning forest of the leaf, so results stay linear in the leaf. Links of which one end is
    near a dense centre are all found; recall of the others is that of the forest (tests measure both against brute force). Precision is exact.

    Null, zero or non-finite vectors link with nothing. Vectors of another length than the most frequent one are
    compared only with equal lengths, each length in a forest of its own, so a table should have few lengths. Repeated rows are links of each other; a cosine
    at the limit links. Columns other than vec_id and embedding are ignored, whatever their names. Empty tables give empty results.
    """
    spark = rows.sparkSession
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("ok", usable(F.col("embedding")))
    e = F.col("embedding") if dict(rows.dtypes)["embedding"] == "array<float>" else F.transform("embedding", lambda x: x.cast("double"))
    v = v.withColumn("e", F.when(F.col("ok"), e))  # floats travel as they are and are widened where they are compared
    classes = cut(v.where("ok").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("e")))
    counts: DataFrame | None = None
    edges: DataFrame | None = None
    for dim, n in classes.groupBy("dim").count().orderBy("dim").collect():
        own = classes.where(F.col("dim") == dim).select("rep", "copies", "e")
        def grown(rows: DataFrame, n: int, trees: int, spill: float) -> Forest:
            x = matrix(rows.orderBy(F.xxhash64(F.lit(seed), "rep"), "rep").limit(most).select("e").toArrow().column("e"), dim)
            return Forest(x / np.linalg.norm(x, axis=1, keepdims=True), n, trees, spill, seed)

        found = []
        centres = _centres(own, grown(own, n, 1, 0.0), dim, least) if n > LEAF else np.zeros((0, dim))
        if len(centres):
            own, c, e = _cells(own, centres, dim, least, block, chunk)
            found.append((c, e))
            n = own.count()
        if n:
            found.append(_links(own, grown(own, n, trees, spill), dim, least, block))
        for c, e in found:
            counts, edges = (c, e) if counts is None else (counts.union(c), edges.union(e))
    if counts is None:
        counts, edges = spark.createDataFrame([], "rep bigint, links bigint"), spark.createDataFrame([], "a bigint, b bigint")
    comp = cut(components(edges))
    linked = counts.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("e", "rep", "copies").join(linked, "rep", "left").join(comp, F.col("rep") == F.col("id"), "left")
    named = named.select(F.col("e").alias("e2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = v.select("vec_id", "e").join(named, F.col("e") == F.col("e2"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _centres(own: DataFrame, tree: Forest, dim: int, least: float) -> np.ndarray:
    """Unit centres of dense groups: in each leaf of one tree without spill the means of rows with many neighbours there, those near each other merged."""

    def place(batches):  # noqa: ANN001, ANN202
        for b in batches:
            x = matrix(b.column(2), dim)
            if len(x):
                _, _, leaf = tree.leaves(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column(0), b.column(2)], names=["leaf", "rep", "e"])

    def find(key: tuple, t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("rep").to_numpy(), kind="stable")[:: -(-t.num_rows // 4096)]))
        x = matrix(t.column("e"), dim)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= least
        count = near.sum(axis=1)
        means, sizes = [], []
        while len(count) and count.max() > DENSE:
            own = near[np.argmax(count)].copy()
            means.append(x[own].mean(axis=0).tolist())
            sizes.append(int(own.sum()))
            near[:, own] = False
            near[own] = False
            count = near.sum(axis=1)
        return pa.table({"mean": pa.array(means, pa.list_(pa.float64())), "size": pa.array(sizes, pa.int64())})

    leaves = own.select("rep", "copies", "e").mapInArrow(place, f"leaf bigint, rep bigint, e {dict(own.dtypes)['e']}")
    t = leaves.groupBy("leaf").applyInArrow(find, "mean array<double>, size bigint").orderBy(F.desc("size"), "mean").toArrow()
    c, size = matrix(t.column("mean"), dim), t.column("size").to_numpy()
    unit = c / np.linalg.norm(c, axis=1, keepdims=True)
    centres, left = [], np.arange(len(c))
    while len(left):
        near = unit[left] @ unit[left[0]] >= math.cos(math.acos(least) * 0.4)
        mean = (c[left[near]] * size[left[near], None]).sum(axis=0)
        centres.append(mean / np.linalg.norm(mean))
        left = left[~near]
    return np.array(centres).reshape(-1, dim)


def _cells(own: DataFrame, centres: np.ndarray, dim: int, least: float, block: int, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classes near no centre, and counts and edges of all links of the others.

    A class within the limit's angle of a centre is a member of the nearest one's cell; what links with a member is within twice
    that angle of its centre and visits the cell, unless its own cell comes first. A cell is cut by angle into chunks of about `chunk`
    rows. By the triangle inequality, two chunks whose angles add up to the limit or less are linked throughout and two
    further apart than it not at all; only the rest are compared, chunk against chunk.
    """
    spark = own.sparkSession
    limit, eps = math.acos(least), 1e-6
    kind = dict(own.dtypes)["e"]

    def place(batches):  # noqa: ANN001, ANN202
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                b = whole.slice(first, 1000)
                x = matrix(b.column(2), dim)
                angle = np.arccos(np.clip(x / np.linalg.norm(x, axis=1, keepdims=True) @ centres.T, -1, 1))
                home = np.argmin(angle, axis=1)
                home[angle[np.arange(len(x)), home] > limit] = len(centres)  # none
                row, cell = np.nonzero((angle <= 2 * limit + eps) & (np.arange(len(centres)) <= home[:, None]))
                alone = np.flatnonzero(home == len(centres))
                role = np.concatenate((cell != home[row], np.zeros(len(alone), bool))).astype(np.int32)
                at = np.concatenate(((angle[row, cell] / limit * BINS).astype(np.int32), np.zeros(len(alone), np.int32)))
                cell, take = np.concatenate((cell, np.full(len(alone), -1))).astype(np.int32), pa.array(np.concatenate((row, alone)))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(role), pa.array(at), *[b.column(i).take(take) for i in range(3)]], names=["cell", "role", "bin", "rep", "copies", "e"])

    dealt = cut(own.select("rep", "copies", "e").mapInArrow(place, f"cell int, role int, bin int, rep bigint, copies bigint, e {kind}"))
    sizes = dealt.where("cell >= 0").groupBy("cell", "role", "bin").count().orderBy("cell", "role", "bin").collect()
    bins, chunks, last, held = [], [], None, 0  # chunks: cell, role, least and greatest angle
    for cell, role, at, n in sizes:
        lo, hi = at * limit / BINS, (at + 1) * limit / BINS
        if last == (cell, role) and held + n <= chunk:
            chunks[-1][3], held, parts = hi, held + n, 1
            bins.append((cell, role, at, len(chunks) - 1, 1))
        else:
            parts = -(-n // chunk)
            bins.append((cell, role, at, len(chunks), parts))
            chunks += [[cell, role, lo, hi] for _ in range(parts)]
            last, held = (cell, role), n if parts == 1 else chunk
    table = spark.createDataFrame(bins, "cell int, role int, bin int, base bigint, parts bigint")
    rows = dealt.join(F.broadcast(table), ["cell", "role", "bin"]).select((F.col("base") + F.pmod(F.xxhash64("rep"), "parts")).alias("chunk"), "rep", "copies", "e")
    known = {r.chunk: (r.s, r.m) for r in rows.groupBy("chunk").agg(F.sum("copies").alias("s"), F.min("rep").alias("m")).collect()}
    by_cell: dict[int, list[int]] = {}
    for i in sorted(known):
        by_cell.setdefault(chunks[i][0], []).append(i)
    add, own_too, to, tiles, n_tiles, joints = dict.fromkeys(known, 0), set(), {}, {i: [] for i in known}, 0, []
    for ids in by_cell.values():
        for i in (i for i in ids if chunks[i][1] == 0):
            for j in (j for j in ids if j >= i):
                (_, _, lo, hi), (_, _, lo2, hi2) = chunks[i], chunks[j]
                if hi + hi2 <= limit - eps:
                    add[i] += known[j][0]
                    to.setdefault(i, known[j][1])
                    if i == j:
                        own_too.add(i)
                    else:
                        add[j] += known[i][0]
                        to.setdefault(j, known[i][1])
                        joints.append((known[i][1], known[j][1]))
                elif max(lo - hi2, lo2 - hi) <= limit + eps:
                    tiles[i].append((n_tiles, 0))
                    if i != j:
                        tiles[j].append((n_tiles, 1))
                    n_tiles += 1
    plan = spark.createDataFrame([(i, add[i], i in own_too, to.get(i), tiles[i]) for i in known], "chunk bigint, add bigint, own boolean, to bigint, tiles array<struct<tile: bigint, side: int>>")
    rows = rows.join(F.broadcast(plan), "chunk")

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort((t.column("rep").to_numpy(), t.column("side").to_numpy()))))
        rep, copies, side = (t.column(c).to_numpy() for c in ("rep", "copies", "side"))
        x = matrix(t.column("e"), dim)
        norm, n, m = np.linalg.norm(x, axis=1), len(rep), int((side == 0).sum())
        links, root = np.zeros(n, dtype=np.int64), np.arange(n)
        start, stop = (0, n) if m == n else (m, n)  # a chunk with itself, or the first with the second
        for i in range(0, m, block):
            for j in range(start, stop, block):
                a, b = slice(i, min(i + block, m)), slice(j, min(j + block, stop))
                near = (x[a] @ x[b].T) / (norm[a, None] * norm[None, b]) >= least
                if m == n:
                    near &= np.arange(a.start, a.stop)[:, None] != np.arange(b.start, b.stop)
                links[a] += near @ copies[b]
                if m < n:
                    links[b] += copies[a] @ near
                hit = np.flatnonzero(near.any(axis=0))
                if not len(hit):
                    continue
                # roots of the block's rows after its links: rows and columns that meet take the least of their roots until none changes
                while True:
                    low = np.where(near[:, hit], root[a][:, None], n).min(axis=0)
                    low = np.minimum(low, root[b][hit])
                    up = np.minimum(np.where(near[:, hit], low[None, :], n).min(axis=1), root[a])
                    p, q = np.concatenate((root[a], root[b][hit])), np.concatenate((up, low))
                    worse = p > q
                    if not worse.any():
                        break
                    new = np.arange(n)
                    np.minimum.at(new, p[worse], q[worse])
                    while (new[new] != new).any():
                        new = new[new]
                    root = new[root]
        touched, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
        return pa.table({"rep": np.concatenate((rep[touched], rep[moved])), "links": np.concatenate((links[touched], np.zeros(len(moved), np.int64))), "other": pa.array([None] * len(touched) + rep[root[moved]].tolist(), pa.int64())})

    tiled = rows.select(F.explode("tiles").alias("t"), "rep", "copies", "e").select("t.tile", "t.side", "rep", "copies", "e")
    found = tiled.groupBy("tile").applyInArrow(compare, "rep bigint, links bigint, other bigint")
    proven = rows.where("add > 0").select("rep", (F.col("add") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("links"), F.lit(None).cast("long").alias("other"))
    joined = rows.where("`to` is not null").select("rep", F.lit(0).cast("long").alias("links"), F.col("to").alias("other"))
    found = cut(found.union(proven).union(joined).union(spark.createDataFrame([(a, 0, b) for a, b in joints], "rep bigint, links bigint, other bigint")))
    alone = dealt.where("cell = -1").select("rep", "copies", "e")
    return alone, found.where("other is null").select("rep", "links"), found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))


def _links(own: DataFrame, forest: Forest, dim: int, least: float, block: int) -> tuple[DataFrame, DataFrame]:
    def place(batches):  # noqa: ANN001, ANN202
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):  # a row becomes several, so few at a time
                b = whole.slice(first, 1000)
                x = matrix(b.column(2), dim)
                row, tree, leaf = forest.leaves(x / np.linalg.norm(x, axis=1, keepdims=True))
                order = np.lexsort((leaf, tree, row))
                row, code = row[order], tree[order] * np.int64(1 << 48) + leaf[order]
                # with each leaf go the row's leaves that come before it, in earlier trees and in this one
                at = np.searchsorted(row, row)
                before = np.arange(len(row)) - at
                ends = np.concatenate(([0], np.cumsum(before)))
                pick = np.repeat(at - ends[:-1], before) + np.arange(ends[-1])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(code), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(code[pick]))], names=["leaf", "rep", "copies", "e", "earlier"])

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("rep").to_numpy(), kind="stable")))
        rep, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        x = matrix(t.column("e"), dim)
        norm = np.linalg.norm(x, axis=1)
        n = len(rep)
        links, root = np.zeros(n, dtype=np.int64), np.arange(n)
        lists = t.column("earlier").combine_chunks()
        met = shared_bits(np.repeat(np.arange(n), np.asarray(lists.value_lengths())), np.asarray(lists.flatten()), n)
        for i in range(0, n, block):
            for j in range(i, n, block):
                cos = (x[i : i + block] @ x[j : j + block].T) / (norm[i : i + block, None] * norm[None, j : j + block])
                a, b = np.nonzero(cos >= least)
                a, b = a[a + i < b + j] + i, b[a + i < b + j] + j
                for part in range(0, len(a), 16_384):
                    p, q = a[part : part + 16_384], b[part : part + 16_384]
                    new = ~(met[p] & met[q]).any(axis=1)  # else the pair counts where it met first
                    p, q = p[new], q[new]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    while (root[p] != root[q]).any():  # both ends take the lower root, and so do those that had the higher
                        low = np.arange(n)
                        np.minimum.at(low, np.maximum(root[p], root[q]), np.minimum(root[p], root[q]))
                        while (low[low] != low).any():
                            low = low[low]
                        root = low[root]
        touched, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
        return pa.table({"rep": np.concatenate((rep[touched], rep[moved])), "links": np.concatenate((links[touched], np.zeros(len(moved), dtype=np.int64))), "other": pa.array([None] * len(touched) + rep[root[moved]].tolist(), pa.int64())})

    placed = own.mapInArrow(place, f"leaf bigint, rep bigint, copies bigint, e {dict(own.dtypes)['e']}, earlier array<bigint>")
    found = cut(placed.groupBy("leaf").applyInArrow(compare, "rep bigint, links bigint, other bigint"))
    return found.where("other is null").select("rep", "links"), found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))


def op5_projection_forest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns from near_vectors at cosine 0.9."""
    return near_vectors(embeddings)
