"""Pairs of similar sets, exactly: filters that need a few bytes of a set come before the sets themselves are sent."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.operators.iterate import cut

#: Bits of the shortest sketch.
BITS = 256


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of how many elements (by hash) fall on each bit, one bit or more for an element: two sketches differ in no more bits than their sets in elements."""
    bits = BITS << max(0, math.ceil(math.log2(max(1, len(hashes)) / BITS)))
    return np.packbits((np.bincount(hashes & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes) as they would be with `width` bytes."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_differ(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """In how many elements sets of n and m elements with a Jaccard of `least` may differ."""
    return (n + m) * ((1 - least) / (1 + least)) + 1e-6


def candidates(prefix: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: ids that share an element of their prefixes (id, n, p, t, s0 to s3: size, place and hash of an element, the folded sketch), if sizes, what stands behind
    the element and the sketches leave a Jaccard of `least` open.

    Rows travel once, to the task of their element, and meet there in the order of their sizes, so each stops at the first that is too large for it.
    """
    kind, share = prefix.schema["id"].dataType.simpleString(), least / (1 + least)

    def of(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, n, p, t = rows[:4]
        s = np.stack(rows[4:], axis=1).view(np.uint64)  # bits of signed numbers are counted without their sign
        i, k = np.arange(len(t)), 0
        while len(i):
            k += 1
            i = i[i + k < len(t)]
            i = i[(t[i + k] == t[i]) & (n[i] >= least * n[i + k] - 1e-9)]
            j = i + k
            fit = np.minimum(n[i] - p[i], n[j] - p[j]) >= share * (n[i] + n[j]) - 1e-9
            x, y = i[fit], j[fit]
            near = (np.bitwise_count(s[x] ^ s[y]).sum(axis=1) <= may_differ(n[x], n[y], least)) & (ids[x] != ids[y])
            x, y = ids[x[near]], ids[y[near]]
            if len(x):
                yield np.where(x < y, x, y), np.where(x < y, y, x)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(c) for c in zip(*made, strict=True))
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, id_type)], ["a", "b"])

        held, id_type = None, None  # rows of the last element so far; the next batch may go on with it
        for batch in batches:
            if not batch.num_rows:
                continue
            id_type = batch.schema.field("id").type
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            end = int(np.searchsorted(rows[3], rows[3][-1]))
            held = [c[end:] for c in rows]
            for pair in of([c[:end] for c in rows]):
                made.append(pair)
                if sum(len(x) for x, _ in made) >= 65_536:
                    yield out()
            if len(made) > 1000:
                yield out()
        if held is not None:
            for pair in of(held):
                made.append(pair)
                if sum(len(x) for x, _ in made[-1:]) >= 65_536 or len(made) > 1000:
                    yield out()
        if made:
            yield out()

    rows = prefix.select("id", F.col("n").cast("long"), F.col("p").cast("long"), "t", "s0", "s1", "s2", "s3")
    return rows.repartition("t").sortWithinPartitions("t", "n").mapInArrow(meet, f"a {kind}, b {kind}").distinct()


def sketched(pairs: DataFrame, sets: DataFrame, least: float, tile_bytes: int = 1 << 26, tile_pairs: int = 500_000) -> DataFrame:
    """Those of the pairs (a, b) whose whole sketches, sets (id, n, sketch), leave a Jaccard of `least` open.

    Sketches are dealt to groups, and each is sent to the tiles of its group with every other, however many pairs it is in.
    """
    total = sets.agg(F.sum(F.length("sketch"))).first()[0] or 0
    groups = max(4, -(-total // tile_bytes))
    pieces = max(1, -(-pairs.count() // (tile_pairs * (groups * (groups + 1) // 2))))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    tile = lambda g, h, piece: [F.least(g, h).alias("g"), F.greatest(g, h).alias("h"), piece.alias("piece")]
    left = pairs.select(*tile(group("a"), group("b"), F.pmod(F.xxhash64("a", "b"), F.lit(pieces))), "a", "b")
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    right = sets.select("id", "n", "sketch", each(groups).alias("other")).select("id", "n", "sketch", "other", each(pieces).alias("part"))
    right = right.select(*tile(group("id"), F.col("other"), F.col("part")), "id", "n", "sketch")
    kind = pairs.schema["a"].dataType.simpleString()

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        import pandas as pd

        own = right.column("sketch").to_pylist()
        n, wide = right.column("n").to_numpy().astype(np.int64), np.array([len(x) for x in own], np.int64)
        place, held = np.zeros(len(own), np.int64), {}
        for w in np.unique(wide):
            at = np.flatnonzero(wide == w)
            place[at], held[w] = np.arange(len(at)), np.frombuffer(b"".join(own[i] for i in at), np.uint8).reshape(-1, w)
        found = pd.DataFrame({"id": right.column("id").to_pandas(), "i": np.arange(len(own))})
        met = pd.DataFrame({"a": left.column("a").to_pandas(), "b": left.column("b").to_pandas()})
        met = met.merge(found.rename(columns={"id": "a", "i": "x"}), on="a").merge(found.rename(columns={"id": "b", "i": "y"}), on="b")
        x, y = met["x"].to_numpy(np.int64), met["y"].to_numpy(np.int64)
        near = np.zeros(len(met), bool)
        for w in held:
            for v in held:
                at = np.flatnonzero((wide[x] == w) & (wide[y] == v))
                step = max(1, (1 << 23) // int(max(w, v)))
                for i in range(0, len(at), step):
                    k = at[i : i + step]
                    s = folded(held[w][place[x[k]]], min(w, v)) ^ folded(held[v][place[y[k]]], min(w, v))
                    near[k] = np.bitwise_count(s).sum(axis=1, dtype=np.int64) <= may_differ(n[x[k]], n[y[k]], least)
        met = met[near].drop_duplicates(["a", "b"])
        return pa.table({c: pa.array(met[c], left.schema.field(c).type) for c in ("a", "b")})

    by = ["g", "h", "piece"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(kernel, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, least: float, chunk: int = 1 << 20, task: int = 1 << 20) -> DataFrame:
    """(a, b, sim) of the pairs (a, b) whose sets (id, set) have a Jaccard of `least` or more; sizes (id, n) says how many elements they have.

    A pair is worked out where the smallest partner of its a is at home, so a set is sent once to all pairs around it and not once for each. What is at home in one place in chunks of
    `chunk` elements meets by pairs of chunks, and tasks get about `task` elements.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    home = pairs.select(F.col("a").alias("id"), F.col("b").alias("o")).union(pairs.select("b", "a")).groupBy("id").agg(F.least("id", F.min("o")).alias("home"))
    at = cut(pairs.join(home, F.col("a") == F.col("id")).select("a", "b", "home"))
    members = at.select("home", F.col("a").alias("id")).union(at.select("home", "b")).distinct().join(sizes.groupBy("id").agg(F.max("n").alias("n")), "id")
    chunks = cut(members.groupBy("home").agg(F.ceil(F.sum("n") / chunk).alias("k")))
    of = lambda c: F.pmod(F.xxhash64(c), F.col("k"))
    at = at.join(chunks, "home").select("a", "b", "home", F.least(of("a"), of("b")).alias("g"), F.greatest(of("a"), of("b")).alias("h"))
    keyed = at.select("home", "g", "h", F.col("a").alias("id")).union(at.select("home", "g", "h", "b")).distinct()
    total = keyed.join(sizes, "id").agg(F.sum("n")).first()[0] or 0
    tasks = max(8, -(-total // task))
    part = F.pmod(F.xxhash64("home", "g", "h"), F.lit(tasks)).alias("part")
    left = at.select(part, "a", "b")
    right = keyed.select(part, "id").distinct().join(sets, "id").select("part", "id", "set")

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict = {}
        own = right.column("set").combine_chunks()
        own = own if isinstance(own, pa.ListArray) else pa.concat_arrays(own.chunks) if own.num_chunks else pa.array([], pa.list_(pa.string()))
        codes = own.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))) if len(own) else [0]
        for i, x in enumerate(right.column("id").to_pylist()):
            rows.setdefault(x, []).append(codes[ends[i] : ends[i + 1]])
        mark = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool)
        out: list[tuple] = []
        last, order = None, sorted(zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True))
        for a, b in order:
            for x in rows.get(a, ()):
                if last is not x:
                    mark[:] = False
                    mark[x], last = True, x
                for y in rows.get(b, ()):
                    both = int(mark[y].sum())
                    sim = both / (len(x) + len(y) - both)
                    if sim >= least:
                        out.append((a, b, sim))
        a, b, sim = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, left.schema.field("a").type), "b": pa.array(b, left.schema.field("b").type), "sim": pa.array(sim, pa.float64())})

    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(kernel, f"a {kind}, b {kind}, sim double")
