"""Near-duplicate detection by b-bit MinHash: low bits of the minima packed into words, compared by bit counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import components, cut
from loopwright.llm.textbytes import column_bytes, mix, shingles, slices

MINIMA, BITS, BANDS = 128, 2, 32
LANES = [f"s{i}" for i in range(MINIMA * BITS // 64)]
_RNG = np.random.default_rng(411)
FACTORS = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _RNG.integers(0, 2**64, MINIMA, dtype=np.uint64)


def minima(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """(n, MINIMA) minima of the permuted hashes of each row's set; rows without a set keep the largest value."""
    out = np.full((n, MINIMA), np.iinfo(np.uint64).max, dtype=np.uint64)
    if not len(rows):
        return out
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    ids, step = rows[starts], 1 << 14
    ends = np.append(starts[1:], len(rows))
    i = 0
    while i < len(starts):  # some rows at a time, so that their hashes stay in the cache
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        h, at = hashes[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
        for k in range(MINIMA):
            out[ids[i:j], k] = np.minimum.reduceat(h * FACTORS[k] + ADDENDS[k], at)
        i = j
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """Packs the low BITS bits of (n, MINIMA) minima into (n, lanes) signed words."""
    bits = (mix(low) & np.uint64((1 << BITS) - 1)).reshape(len(low), len(LANES), -1)
    shifts = np.arange(bits.shape[2], dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(bits << shifts, axis=2).view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, k1, k2, packed lanes and band keys; (n, k1, k2) identifies a shingle set by 128 bits of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, offsets = column_bytes(b.column(1))
            n = len(offsets) - 1
            rows, hashes = shingles(data, offsets, k)
            count = np.bincount(rows, minlength=n)
            at = np.concatenate(([0], np.cumsum(count)))
            total = lambda x: (c := np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64))))[at[1:]] - c[at[:-1]]  # noqa: E731,B023
            low = minima(rows, hashes, n)
            keys = np.zeros((n, BANDS), dtype=np.uint64)
            for x in range(MINIMA // BANDS):
                keys = mix(keys + low[:, x::MINIMA // BANDS] * np.uint64(2 * x + 3))
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            lanes = pack(low)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(count), pa.array(total(hashes).view(np.int64)), pa.array(total(mix(hashes)).view(np.int64)), *[pa.array(np.ascontiguousarray(lanes[:, i])) for i in range(len(LANES))], bands],
                names=["doc_id", "n", "k1", "k2", *LANES, "bands"],
            )

    schema = "doc_id bigint, n bigint, k1 bigint, k2 bigint, " + ", ".join(f"{x} bigint" for x in LANES) + ", bands array<bigint>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: the share of equal values less that of chance collisions."""
    spread = int("01" * 32, 2)  # the low bit of every two-bit value
    differ = F.lit(0)
    for x in LANES:
        y = F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))
        differ = differ + F.bit_count(y.bitwiseOR(F.shiftrightunsigned(y, 1)).bitwiseAND(F.lit(spread).cast("long")))
    chance = 1 / 2**BITS
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, hashes): the distinct shingles of each text as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, offsets = column_bytes(b.column(1))
            rows, hashes = shingles(data, offsets, k)
            at = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(offsets) - 1))))
            lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id bigint, hashes array<bigint>")


class Sets:
    """Shingle sets of some rows, renumbered so that the members of one can be marked in an array."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        lists = column.combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.size = np.asarray(lists.value_lengths()).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        names, self.ids = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        self.mark = np.zeros(len(names), dtype=bool)

    def linked(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of `others` whose sets are near enough to the set of row i."""
        own = self.ids[self.at[i] : self.at[i + 1]]
        self.mark[own] = True
        size = self.size[others]
        ends = np.cumsum(size)
        members = self.ids[np.repeat(self.at[others] - ends + size, size) + np.arange(ends[-1])]
        both = np.add.reduceat(self.mark[members], ends - size, dtype=np.int64)
        self.mark[own] = False
        return others[100 * both >= percent * (self.size[i] + size - both)]


def alike(i: int, others: np.ndarray, lanes: np.ndarray, n: np.ndarray, percent: int, floor: float) -> np.ndarray:
    """Those of `others` whose packed signatures and set sizes allow a link with row i."""
    x = lanes[others] ^ lanes[i]
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(int("01" * 32, 2))).sum(axis=1)
    chance = 1 / 2**BITS
    near = ((1 - differ / MINIMA) - chance) / (1 - chance) >= floor
    return others[near & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]


def _tile(t: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
    """A tile's rows, its first chunk ahead, with their packed signatures and the number of rows in the first chunk."""
    side, rep = t.column("side").to_numpy(), t.column("rep").to_numpy()
    t = t.take(pa.array(np.lexsort((t.column("n").to_numpy(), rep, side))))
    lanes = np.stack([t.column(x).to_numpy() for x in LANES], axis=1).view(np.uint64)
    return t, lanes, int((side == 0).sum())


def _tiles(cells: DataFrame, least: float, rows: int, weight: int) -> DataFrame:
    """The rows of `cells` (hub, main, rep, n ...) with tile and side: every two rows of a cell that stand in different
    chunks of like set sizes, or in one, meet in one tile, but for two rows that are both in the cell's main component.

    A cell is cut into chunks of about `rows` rows and `weight` shingles, so no tile grows with a cell.
    """
    base = max(math.log(1 / least), 1e-3) * (1 + 1e-9) if 0 < least < 1 else 1e-3
    cells = cells.withColumn("level", F.floor(F.log("n") / base))
    kind = ["hub", "main", "level"]
    chunks = cells.groupBy(*kind).agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum("n") / weight)).cast("int").alias("parts"))
    chunks = cut(chunks)
    each = chunks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.withColumn("chunk", F.struct("main", "level", "part"))
    x, y = each.where("not main").alias("x"), each.alias("y")
    order = F.col("y.main") | (F.col("x.chunk") <= F.col("y.chunk"))
    near = F.abs(F.col("x.level") - F.col("y.level")) <= 1
    pairs = x.join(y, (F.col("x.hub") == F.col("y.hub")) & order & near)
    ends = F.array(F.struct(F.col("x.chunk").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("y.chunk").alias("chunk"), F.lit(1).alias("side")))
    ends = F.when(F.col("x.chunk") == F.col("y.chunk"), F.slice(ends, 1, 1)).otherwise(ends)
    tile = F.xxhash64(F.col("x.hub"), F.col("x.chunk"), F.col("y.chunk"))
    dealt = pairs.select(F.col("x.hub").alias("hub"), tile.alias("tile"), F.explode(ends).alias("e")).select("hub", "tile", "e.chunk.*", "e.side")
    cells = cells.join(chunks, kind).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    return cells.join(dealt, [*kind, "part"]).select("tile", "side", *[c for c in cells.columns if c not in (*kind, "part", "parts")])


def hub_links(stars: DataFrame, sets: DataFrame, percent: int, weight: int) -> DataFrame:
    """(a, b): the stars (hub, rep, n) whose full sets are near enough; a hub's are dealt to groups of about `weight` shingles."""
    parts = stars.groupBy("hub").agg(F.ceil(F.sum("n") / weight).cast("int").alias("parts"))
    rows = stars.join(parts, "hub").select("hub", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), "rep")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("rep"))
    met = rows.union(hubs).join(sets, F.col("rep") == F.col("id")).select("hub", "part", "rep", "hashes")

    def compare(t: pa.Table) -> pa.Table:
        hub, rep = t.column("hub")[0].as_py(), t.column("rep").to_numpy()
        s = Sets(t.column("hashes"))
        others, found = np.flatnonzero(rep != hub), []
        for i in np.flatnonzero(rep == hub) if len(others) else ():
            found.append(rep[s.linked(i, others, percent)])
        b = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return pa.table({"a": np.full(len(b), hub, dtype=np.int64), "b": b})

    return met.groupBy("hub", "part").applyInArrow(compare, "a bigint, b bigint")


def tile_links(tiles: DataFrame, sets: DataFrame, percent: int, floor: float) -> DataFrame:
    """(a, b): links that join different components c within each tile, one for each two components that meet there.

    First packed signatures tell which rows of a tile may link with any other at all; only their sets travel to the tile, where
    each row is held against those rows of other components that its signature allows.
    """
    lanes = ", ".join(f"{x} bigint" for x in LANES)

    def across(root: np.ndarray, i: int, first: int) -> np.ndarray:
        others = np.arange(i + 1 if first == len(root) else first, len(root))
        return others[root[others] != root[i]]

    def choose(t: pa.Table) -> pa.Table:
        t, sig, first = _tile(t)
        n, c = t.column("n").to_numpy(), t.column("c").to_numpy()
        some = np.zeros(len(n), dtype=bool)
        for i in range(first):
            near = alike(i, across(c, i, first), sig, n, percent, floor)
            some[near] = True
            some[i] |= len(near) > 0
        return t.filter(pa.array(some))

    def compare(t: pa.Table) -> pa.Table:
        t, sig, first = _tile(t)
        rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
        _, root = np.unique(t.column("c").to_numpy(), return_inverse=True)
        s, a, b = Sets(t.column("hashes")), [], []
        for i in range(first):
            near = alike(i, across(root, i, first), sig, n, percent, floor)
            if not len(near):
                continue
            hit = s.linked(i, near, percent)
            for r, j in zip(*np.unique(root[hit], return_index=True), strict=True):
                a.append(rep[i])
                b.append(rep[hit[j]])
                root[root == r] = root[i]
        return pa.table({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    may = cut(tiles.groupBy("tile").applyInArrow(choose, f"tile bigint, side int, rep bigint, c bigint, n bigint, {lanes}"))
    met = may.join(sets, F.col("rep") == F.col("id")).select("tile", "side", "rep", "c", F.size("hashes").cast("long").alias("n"), *LANES, "hashes")
    return met.groupBy("tile").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, slack: float = 0.22, rows: int = 4096, weight: int = 1 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for texts linked at 100 * |A & B| >= percent * |A | B|.

    Equal shingle sets become one class under their smallest doc_id, so exact copies cost one row. Classes meet if
    they share one of 32 bands of four minima (a pair at 0.8 misses all with probability 5e-8). Each bucket's hub is the
    class with the most neighbours over all its bands, and a hub's cell is what shares a bucket of its with it. Whatever the packed
    estimate, within `slack` (five standard deviations: one pair in ten million at 0.8 falls below), lets be a link is confirmed on full sets:
    first each cell against its hub, which is linear; after these links, what stands outside a cell's main component
    against the cell's other components, in tiles of bounded size. Links within a component that is known already are not looked for. Only the
    distinct texts that lie around a hub but do not link with it cost more than linear work. Component ids come from star contraction.

    Null and empty texts and texts of white space have no shingles and link with nothing. Of rows that repeat a doc_id with
    different texts each is compared; what links with any text of a class's smallest doc_id is in that class's component. Rows without a doc_id take
    the component of their class if it has an id, else null, and are not kept for it. Very long texts are compared whole. Ties
    do not occur: ids are the smallest. An empty table gives an empty result; other columns are ignored.
    """
    key = ["n", "k1", "k2"]
    floor, least = percent / 100 - slack, percent / 100
    d = cut(signatures(docs, k))
    grouped = d.where("n > 0").groupBy(*key)
    classes = cut(grouped.agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in (*LANES, "bands")]).where("rep is not null"))
    sig = classes.select("rep", "n", *LANES)
    banded = classes.select("rep", F.explode("bands").alias("key"))
    members = cut(banded.join(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "key"))
    degree = members.groupBy("rep").agg(F.sum("m").alias("degree"))
    hubs = members.join(degree, "rep").groupBy("key").agg((-F.max(F.struct("degree", (-F.col("rep")).alias("r")))["r"]).alias("hub"))
    stars = cut(members.select("key", "rep").join(hubs, "key").where("rep <> hub").select("hub", "rep").distinct())
    # the sets of all that met
    ids = stars.select(F.explode(F.array("hub", "rep")).alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    texts = texts.groupBy("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("l")).agg(F.first("text").alias("text"))
    sets = cut(shingle_sets(texts, k))
    # each cell against its hub
    x, y = sig.alias("x"), sig.alias("y")
    ratio = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    held = stars.join(x, F.col("hub") == F.col("x.rep")).join(y, stars["rep"] == F.col("y.rep")).where((estimate("x", "y") >= floor) & ratio)
    known = cut(hub_links(held.select("hub", stars["rep"], F.col("y.n").alias("n")), sets, percent, weight))
    comp = cut(components(known))
    # what is left within cells; a hub itself has met all of its cell
    at = stars.join(comp, F.col("rep") == F.col("id"), "left").select("hub", "rep", F.coalesce("component", "rep").alias("c"))
    parts = at.groupBy("hub", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("hub")
    main = parts.agg(F.max(F.struct("m", (-F.col("c")).alias("c"))).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = at.join(main.select("hub", (-F.col("top.c")).alias("top")), "hub").join(sig, "rep")
    mixed = mixed.select("hub", (F.col("c") == F.col("top")).alias("main"), "rep", "c", "n", *LANES)
    more = cut(tile_links(_tiles(mixed, least, rows, weight), sets, percent, floor))
    comp = cut(components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)))
    named = classes.select(*key, "rep").join(comp, F.col("rep") == F.col("id"), "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    out = d.select("doc_id", *key).join(named, key, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_bbit_minhash(docs: DataFrame) -> DataFrame:
    """near_duplicates on two-word shingles, as the contract has it."""
    return near_duplicates(docs, k=2, percent=80)
