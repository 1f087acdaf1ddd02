"""Source divergence audit: which terms set a source apart within its language, and how far its sources lie from each other.

Document frequencies are first counted in a count-min sketch, which is merged over all tasks and never underestimates. Terms that the sketch
rules out are discarded before anything is shuffled; the survivors are counted exactly, and groups are compared over the cells that hold a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.llm.common import cut, within_bound
from loopwright.llm.textbytes import Spans, column_bytes, mix, runs, slices, word_bounds

#: Terms are runs of A-Z, a-z and everything beyond ASCII; no byte of a longer UTF-8 sequence is below 0x80, so bytes settle it.
GAP = np.ones(256, dtype=bool)
GAP[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Rows of the sketch, the largest count a cell can hold, and cells that travel together.
DEPTH, FULL, CHUNK = 4, 3, 1 << 16
SCALE = 1_000_000_000


class Sketch:
    """Count-min counters of two bits, which stop at three: `estimate` is never under the true count, as far as three."""

    def __init__(self, bits: int, cells: np.ndarray | None = None) -> None:
        self.bits = bits
        self.cells = np.zeros((DEPTH, 1 << bits), dtype=np.uint8) if cells is None else cells

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        return [(mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64)) >> np.uint64(64 - self.bits)).astype(np.int64) for r in range(DEPTH)]

    def add(self, hashes: np.ndarray, times: np.ndarray) -> None:
        for r, place in enumerate(self.places(hashes)):
            at, own = np.unique(place, return_inverse=True)
            total = np.bincount(own, np.minimum(times, FULL), len(at))
            self.cells[r, at] = np.minimum(self.cells[r, at] + total, FULL)

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([self.cells[r, place] for r, place in enumerate(self.places(hashes))])


class Packed(Sketch):
    """The same, read from the packed bytes as they were sent."""

    def __init__(self, bits: int, data: bytes) -> None:
        super().__init__(bits, np.frombuffer(data, dtype=np.uint8).reshape(DEPTH, -1))

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([self.cells[r, place >> 2] >> (2 * (place & 3)).astype(np.uint8) & 3 for r, place in enumerate(self.places(hashes))])


def pack(cells: np.ndarray) -> bytes:
    c = cells.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).astype(np.uint8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    return np.stack([b >> s & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1)


def document_terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """For some megabytes of whole texts at a time: row, term and count of each distinct term of a document, and the terms by number."""
    data, offsets = column_bytes(texts)
    for i, j in runs(offsets, 1 << 21):
        d, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, row = word_bounds(d, off, GAP)
        if not len(start):
            continue
        ends = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        found = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(LOWER[d[~GAP[d]]])).dictionary_encode()
        k = len(found.dictionary)
        pair, count = np.unique(row * k + np.asarray(found.indices), return_counts=True)
        yield pair // k + i, pair % k, count, found.dictionary


def hashes(terms: pa.Array) -> np.ndarray:
    data, offsets = column_bytes(terms)
    return Spans(data).hash(offsets[:-1], offsets[1:])


def _names(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    found = column.dictionary_encode()
    return np.asarray(found.indices).astype(np.int64), found.dictionary.to_pylist()


def _by_language(batch: pa.RecordBatch, lang: np.ndarray, langs: list[str]) -> Iterator[tuple]:
    """document_terms, and for each its distinct (language, term) pairs: their hashes, how many documents hold them, and which pair each row is."""
    own = np.array([xxhash.xxh64_intdigest(x) for x in langs], dtype=np.uint64)
    for row, term, count, terms in document_terms(batch.column("text")):
        pair, place, docs = np.unique(lang[row] * len(terms) + term, return_inverse=True, return_counts=True)
        yield row, term, count, terms, mix(hashes(terms)[pair % len(terms)] + own[pair // len(terms)]), place, docs


def sketch_frequencies(docs: DataFrame, bits: int) -> Sketch:
    """The merged sketch of how many documents of its language hold each term. It has a fixed size: DEPTH rows of 2**bits cells."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, salt = Sketch(bits), 0
        for b in slices(batches):
            lang, langs = _names(b.column("lang"))
            for *_, h, _, n in _by_language(b, lang, langs):
                mine.add(h, n)
                salt = int(h[0] & np.uint64(31))
        parts = mine.cells.reshape(-1, min(CHUNK, 1 << bits))
        for i in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "salt": pa.array([salt], pa.int32()), "cells": pa.array([pack(parts[i])], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column("chunk").to_pylist(), b.column("cells"), strict=True):
                c = unpack(data.as_buffer())
                total[i] = np.minimum(total[i] + c, FULL) if i in total else c
        for i, c in total.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "salt": pa.array([0], pa.int32()), "cells": pa.array([pack(c)], pa.binary())})

    shape = "chunk int, salt int, cells binary"
    merged = docs.select("lang", "text").mapInArrow(fill, shape).repartition("chunk", "salt").mapInArrow(add, shape).repartition("chunk").mapInArrow(add, shape)
    sketch = Sketch(bits)
    parts = sketch.cells.reshape(-1, min(CHUNK, 1 << bits))
    for r in merged.collect():  # at most DEPTH * 2**bits / 4 bytes
        parts[r["chunk"]] = unpack(r["cells"])
    return sketch


def surviving_counts(docs: DataFrame, sketch: Sketch, least: int) -> DataFrame:
    """(lang, source, term, n, docs): exact occurrences and documents of every term whose estimate is `least` or more."""
    bits, sent = sketch.bits, docs.sparkSession.sparkContext.broadcast(pack(sketch.cells.reshape(-1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Packed(bits, sent.value)
        for b in slices(batches):
            (lang, langs), (source, sources) = _names(b.column("lang")), _names(b.column("source"))
            for row, term, n, terms, h, place, _ in _by_language(b, lang, langs):
                stay = (known.estimate(h) >= least)[place]
                row, term, n = row[stay], term[stay], n[stay]
                cell, own, held = np.unique((lang[row] * len(sources) + source[row]) * len(terms) + term, return_inverse=True, return_counts=True)
                group = cell // len(terms)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array(langs, pa.string()).take(pa.array(group // len(sources))),
                        "source": pa.array(sources, pa.string()).take(pa.array(group % len(sources))),
                        "term": pc.take(terms, pa.array(cell % len(terms))),
                        "n": pa.array(np.bincount(own, n, len(cell)).astype(np.int64)),
                        "docs": pa.array(held.astype(np.int64)),
                    }
                )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same counts, added up over a hundred thousand rows before they leave Python."""
        held: list[pa.RecordBatch] = []

        def total() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            yield from t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"]).to_batches(1 << 16)

        for b in count(batches):
            held.append(b)
            if sum(x.num_rows for x in held) >= 100_000:
                yield from total()
                held.clear()
        if held:
            yield from total()

    found = docs.mapInArrow(summed, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)) by long division in base 1000, which no count below 9e15 overflows."""
    c, d = count + 1, total + terms
    whole, rest = F.call_function("div", c, d), c % d
    for _ in range(3):
        whole, rest = whole * 1000 + F.call_function("div", rest * 1000, d), rest * 1000 % d
    return whole + 1


def gain(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = 3, top: int = 200, most_bits: int = 24) -> DataFrame:
    """(lang, source, part, item, value, rank) over (lang, source, text) rows without nulls; see op11_source_audit for the two parts.

    The sketch has 16 cells a document in each row, 2**16 at least and 2**`most_bits` at most: 16 MB as it is sent, whatever the data. Beyond that more
    terms pass it and are shuffled; results stay exact. Sums over all kept terms are taken over the cells with a count alone: a term that a
    group lacks has the group's share of a zero, so terms in one of two groups are summed by count, and only terms in both meet.
    """
    rows = docs.count()
    sketch = sketch_frequencies(docs, min(max(math.ceil(math.log2(16 * rows + 1)), 16), most_bits))
    counts = surviving_counts(docs, sketch, least)
    over = W.partitionBy("lang", "term")  # as many rows as the language has sources
    cells = counts.withColumns({"df": F.sum("docs").over(over), "all": F.sum("n").over(over)}).where(F.col("df") >= least)
    cells = cut(cells.select("lang", "source", "term", "n", "all"))
    langs = cells.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("lang_n"))
    groups = docs.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_n"])
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))))
    near = within_bound(groups)
    cells = cells.join(near, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))

    q = share(F.col("all"), F.col("lang_n"), F.col("v"))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = cells.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gain(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    other = (a("lang") == b("lang")) & (a("source") != b("source"))
    ends = [a("lang").alias("lang"), a("source").alias("source"), b("source").alias("item")]
    back = [a("lang").alias("lang"), b("source").alias("source"), a("source").alias("item")]
    base = groups.alias("a").join(near.alias("b"), other).select(*ends, F.coalesce(a("v") * gain(a("p0"), b("p0")), F.lit(0)).alias("value"))
    alone = cells.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k")).alias("a").join(near.alias("b"), other)
    left = alone.select(*ends, (a("k") * (gain(a("p"), b("p0")) - gain(a("p0"), b("p0")))).alias("value"))
    right = alone.select(*back, (a("k") * (gain(b("p0"), a("p")) - gain(b("p0"), a("p0")))).alias("value"))
    both = cells.alias("a").join(cells.alias("b"), other & (a("term") == b("term")))
    both = both.select(*ends, (gain(a("p"), b("p")) - gain(a("p"), b("p0")) - gain(a("p0"), b("p")) + gain(a("p0"), b("p0"))).alias("value"))
    pairs = base.union(left).union(right).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.union(terms)


def op11_source_audit(docs: DataFrame) -> DataFrame:
    """The contract's rows: for each (lang, source) group the other sources of its language by summed divergence, and its 200 terms of the largest gain.

    Every row counts as a document, repeated rows and texts too. Null and empty texts have no terms but make their group occur; null lang and source
    are ''. Texts of any length are read whole. Equal values are ordered by item. A group without a second source has no pair rows; an
    empty table gives an empty result. Columns other than text, lang and source are not read, so their names are free.
    """
    return audit(docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]))
