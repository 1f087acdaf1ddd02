"""Removal of repeated passages by longest previous factors over a suffix order that is spread by minimisers.

A suffix array of a whole corpus fits no machine, but a passage of `window` bytes only has to meet its equals. Every window
is filed under its minimiser, the smallest-hashed q-gram in it (the leftmost of equals), which equal windows share at the
same distance. The windows of a text that follow each other under one minimiser form a stretch. Stretches that repeat whole
are settled by their hashes; the bytes of those that may repeat in part meet under their minimiser, where windows are
sorted into suffix order and longest previous factors, from previous and next smaller places in that order, tell which
windows stood earlier.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.textbytes import Spans, column_bytes, mix, runs

GRAM = 24
KEYS = np.dtype([("mh", "<u4"), ("kl", "<u2"), ("kr", "<u2"), ("sk", "<u8")])
PART = np.dtype([("mh", "<u8"), ("doc", "<i8"), ("block", "<i8"), ("row", "<i4"), ("start", "<i8"), ("count", "<i4"), ("off", "<i4"), ("size", "<i4")])
CUTS = np.dtype([("row", "<i4"), ("start", "<i8"), ("count", "<i8")])
LAST = np.iinfo(np.int64).max


class Stretches:
    """All stretches of a block of documents, in order of document and place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int) -> None:
        parts = [self._run(data, offsets, i, j, window) for i, j in runs(offsets)]
        names = ("row", "start", "count", "anchor", "mh", "sk", "kl", "kr")
        for x, name in enumerate(names):
            setattr(self, name, np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, dtype=np.int64))

    @staticmethod
    def _run(data: np.ndarray, offsets: np.ndarray, i: int, j: int, window: int) -> tuple:
        d, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n, grams, half = len(d), window - GRAM + 1, (window - GRAM) // 2
        none = np.zeros(0, dtype=np.int64)
        if n < window:
            return (none, none, none, none, *[none.astype(np.uint64)] * 2, *[none.astype(np.uint16)] * 2)
        spans = Spans(d)
        at = np.arange(n - GRAM + 1)
        g = spans.hash(at, at + GRAM)
        low, arg, width = g.copy(), at.astype(np.int64), 1
        while width < grams:  # minima of twice the width each time, then of exactly `grams`
            step = min(width, grams - width)
            m = len(low) - step
            right = low[step:] < low[:m]
            low, arg = np.where(right, low[step:], low[:m]), np.where(right, arg[step:], arg[:m])
            width += step
        ok = np.zeros(n + 1, dtype=np.int64)  # windows that do not leave their document
        lengths = np.diff(off)
        fits = np.flatnonzero(lengths >= window)
        np.add.at(ok, off[fits], 1)
        np.add.at(ok, off[fits] + lengths[fits] - window + 1, -1)
        valid = np.flatnonzero(np.cumsum(ok)[: len(arg)] > 0)
        if not len(valid):
            return (none, none, none, none, *[none.astype(np.uint64)] * 2, *[none.astype(np.uint16)] * 2)
        a = arg[valid]
        new = np.ones(len(valid), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(new)
        start, anchor = valid[first], a[first]
        count = np.diff(np.append(first, len(valid)))
        row = np.searchsorted(off, start, side="right") - 1
        sk = mix(spans.hash(start, start + count - 1 + window) + (anchor - start).astype(np.uint64))
        left, right = anchor - half, anchor + GRAM + half

        def side(lo: np.ndarray, hi: np.ndarray, has: np.ndarray) -> np.ndarray:
            out = np.zeros(len(lo), dtype=np.uint16)
            h = spans.hash(lo[has], hi[has])
            out[has] = (h >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
            return out

        kl = side(left, anchor, left >= off[row])
        kr = side(anchor + GRAM, right, right <= off[row + 1])
        return (row + i, start - off[row], count, anchor - start, g[anchor], sk, kl, kr)

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """The first stretch of each kind, in order of place, and for every stretch which of these is its like."""
        _, first, kind = np.unique(mix(self.mh + mix(self.sk)), return_index=True, return_inverse=True)
        order = np.argsort(first, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return first[order], rank[kind]


def ordered(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """Bytes, offsets, ids and table of a block by id, then text, then what the rows carry."""
    ids = t.column("id").to_numpy()
    if len(np.unique(ids)) == len(ids):
        order = np.argsort(ids, kind="stable")
    else:
        texts = t.column("text").to_pylist()
        more = t.column("carried").to_pylist() if "carried" in t.column_names else texts
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or "", repr(more[i]))), dtype=np.int64)
    t = t.take(pa.array(order)).combine_chunks()
    column = t.column("text").cast(pa.large_string()).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.array([], pa.large_string())
    data, offsets = column_bytes(column)
    return data, offsets, ids[order], t


def suffix_order(data: np.ndarray, at: np.ndarray, kind: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places `at` in suffix order, with the class of each and the bytes, up to `window`, it has in common with the one before it.

    Kinds stand one after the other and have nothing in common; within a kind the order is that of the `window` bytes from each place,
    equal ones in the order given. Bytes are looked at eight at a time; a place that is alone in its class is left where it is.
    """
    order = np.argsort(kind, kind="stable")
    ordered_kind = kind[order]
    first = np.concatenate(([True], ordered_kind[1:] != ordered_kind[:-1])) if len(order) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    common = np.where(first, 0, window).astype(np.int64)
    slot, classes = np.arange(len(order)), group
    words = list(range(0, window - 7, 8))
    if words[-1] + 8 < window:
        words.append(window - 8)
    for w in words:
        many = np.bincount(classes)[classes] > 1 if len(classes) else np.zeros(0, bool)
        slot, classes = slot[many], classes[many]
        if not len(slot):
            break
        here = order[slot]
        word = np.zeros(len(slot), dtype=np.uint64)
        for b in range(8):
            word = (word << np.uint64(8)) | data[at[here] + w + b].astype(np.uint64)
        by = np.lexsort((word, classes))
        order[slot], word = here[by], word[by]  # classes stay where they are
        same = np.concatenate(([False], classes[1:] == classes[:-1]))
        differ = same & np.concatenate(([False], word[1:] != word[:-1]))
        x = word[differ] ^ word[np.flatnonzero(differ) - 1]
        lead = np.zeros(len(x), dtype=np.int64)
        for b in range(1, 8):
            lead += x < np.uint64(1) << np.uint64(8 * b)  # leading bytes that agree
        common[slot[differ]] = w + lead
        classes = np.cumsum(~same | differ) - 1
    return order, group, common


def smaller_before(place: np.ndarray, group: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order the nearest one before it, in its group, that stands earlier in the text (-1 if none), and
    the bytes the two have in common: the least of what neighbours between them have."""
    n = len(place)
    found, shared = np.arange(n) - 1, common.copy()
    todo = np.arange(n)
    while len(todo):
        p = found[todo]
        here = p >= 0
        here[here] &= group[p[here]] == group[todo[here]]
        found[todo[~here]], shared[todo[~here]] = -1, 0
        todo, p = todo[here], p[here]
        high = place[p] >= place[todo]
        todo, p = todo[high], p[high]
        found[todo], shared[todo] = found[p], np.minimum(shared[todo], shared[p])  # all between stand later still
    return found, shared


def longest_previous(place: np.ndarray, group: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors of places in suffix order: the most bytes, up to what `common` counts, that each has in
    common with an earlier place. No other earlier place has more than the nearest smaller ones before and after it."""
    _, back = smaller_before(place, group, common)
    after = np.concatenate((common[1:], [0])) if len(common) else common
    _, fore = smaller_before(place[::-1], group[::-1], after[::-1])
    return np.maximum(back, fore[::-1])


def passage_cuts(
    docs: DataFrame, window: int = 100, block_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20, hot: int = 2048, carry: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Blocks of documents (block, doc_id, id, text, and if asked for the struct `carried`) and the windows to remove (block, blob of CUTS)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks, n_buckets = max(8, -(-total // block_bytes)), max(24, -(-total // bucket_bytes))
    # texts without an id come after all others, in the order of a hash
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST) - F.shiftrightunsigned(F.xxhash64("text"), 2))
    more = [F.struct(*carry).alias("carried")] if carry else []
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own.alias("id"), *more)
    held = held.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"), "doc_id", "id", "text", *["carried"][: len(more)])
    blocks = held.drop("carried")

    def announce(key: tuple, t: pa.Table) -> pa.Table:
        """Of each kind of stretch in the block the first, dealt to buckets by minimiser."""
        data, offsets, ids, _ = ordered(t)
        s = Stretches(data, offsets, window)
        first, _ = s.firsts()
        k = np.zeros(len(first), dtype=KEYS)
        k["mh"], k["kl"], k["kr"], k["sk"] = (s.mh[first] >> np.uint64(32)).astype(np.uint32), s.kl[first], s.kr[first], s.sk[first]
        bucket = (s.mh[first] % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        doc = ids[s.row[first]]
        rows: dict = {"bucket": [], "block": [], "keys": [], "docs": []}
        for b in np.unique(bucket):
            o = order[ends[b] : ends[b + 1]]
            rows["bucket"].append(int(b))
            rows["block"].append(key[0].as_py())
            rows["keys"].append(k[o].tobytes())
            rows["docs"].append(zlib.compress(np.diff(doc[o], prepend=np.int64(0)).tobytes(), 1))
        return pa.table(rows, schema=pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())]))

    def reply(key: tuple, t: pa.Table) -> pa.Table:
        """For each announced stretch: 1 its like stands earlier, 2 it may share a window with another, 4 many may with one under its minimiser."""
        keys = [np.frombuffer(x, dtype=KEYS) for x in t.column("keys").to_pylist()]
        docs_ = [np.cumsum(np.frombuffer(zlib.decompress(x), dtype=np.int64)) for x in t.column("docs").to_pylist()]
        k, doc = np.concatenate(keys), np.concatenate(docs_)
        order = np.lexsort((doc, k["sk"], k["mh"]))
        o = k[order]
        new = np.concatenate(([True], (o["sk"][1:] != o["sk"][:-1]) | (o["mh"][1:] != o["mh"][:-1])))
        flag = np.zeros(len(k), dtype=np.uint8)
        flag[order[~new]] = 1
        lead = order[new]
        crowded = []
        for side in ("kl", "kr"):
            own = lead[k[side][lead] > 0]
            joint = (k["mh"][own].astype(np.uint64) << np.uint64(16)) | k[side][own]
            _, inverse, count = np.unique(joint, return_inverse=True, return_counts=True)
            flag[own[count[inverse] > 1]] |= 2
            crowded.append(k["mh"][own[count[inverse] > hot]])
        # stretches that share windows must go the same way, and any two under a minimiser may
        flag[lead[np.isin(k["mh"][lead], np.concatenate(crowded))]] |= 4
        ends = np.cumsum([len(x) for x in keys])[:-1]
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "flags": pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(flag, ends)], pa.binary())})

    def settle(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        """Windows that are repeats whole, and the bytes of stretches that may repeat in part."""
        data, offsets, ids, _ = ordered(t)
        block = key[0].as_py()
        s = Stretches(data, offsets, window)
        first, kind = s.firsts()
        flag = np.zeros(len(first), dtype=np.uint8)
        bucket = (s.mh[first] % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b, f in zip(replies.column("bucket").to_pylist(), replies.column("flags").to_pylist(), strict=True):
            flag[order[ends[b] : ends[b + 1]]] = np.frombuffer(zlib.decompress(f), dtype=np.uint8)
        gone = np.ones(len(s.row), dtype=bool)
        gone[first] = flag & 1 > 0
        rows: dict = {"key": [], "block": [], "cuts": [], "parts": [], "text": []}

        def emit(to: int, cuts: bytes | None, parts: bytes | None, text: bytes | None) -> None:
            for name, x in zip(rows, (to, block, cuts, parts, text), strict=True):
                rows[name].append(x)

        open_ = first[(flag & 3) == 2]
        many = flag[(flag & 3) == 2] & 4 > 0
        # of crowded stretches each window travels alone, filed by its own hash; the first of equal ones in the block goes
        lone = open_[many]
        w_of = np.repeat(np.arange(len(lone)), s.count[lone])
        w_in = np.arange(len(w_of)) - np.repeat(np.cumsum(s.count[lone]) - s.count[lone], s.count[lone])
        w_row, w_start = s.row[lone[w_of]], s.start[lone[w_of]] + w_in
        digest = [hashlib.blake2b(data[a : a + window], digest_size=16).digest() for a in offsets[w_row] + w_start]
        digest, check = np.frombuffer(b"".join(digest), dtype=np.uint64).reshape(-1, 2).T
        _, lead, like = np.unique(digest, return_index=True, return_inverse=True)
        later = check == check[lead[like]]
        later[lead] = False
        lead = np.flatnonzero(~later)
        c = np.zeros(int(gone.sum()) + int(later.sum()), dtype=CUTS)
        c["row"], c["start"] = np.concatenate((s.row[gone], w_row[later])), np.concatenate((s.start[gone], w_start[later]))
        c["count"] = np.concatenate((s.count[gone], np.ones(int(later.sum()), dtype=np.int64)))
        if len(c):
            emit(-1 - block, joined(np.sort(c, order=("row", "start")), 1).tobytes(), None, None)
        w_of, w_in, digest = w_of[lead], w_in[lead], digest[lead]
        p = np.zeros(int((~many).sum()) + len(w_of), dtype=PART)
        src = np.concatenate((open_[~many], lone[w_of]))
        inner = np.concatenate((np.zeros(int((~many).sum()), dtype=np.int64), w_in))
        p["mh"], p["doc"], p["block"], p["row"] = s.mh[src], ids[s.row[src]], block, s.row[src]
        p["start"], p["off"] = s.start[src] + inner, s.anchor[src] - inner
        p["count"] = np.concatenate((s.count[open_[~many]], np.ones(len(w_of), dtype=np.int64)))
        p["size"] = p["count"] - 1 + window
        lo = offsets[p["row"]] + p["start"]
        to = np.concatenate((p["mh"][: len(p) - len(w_of)], mix(digest)))
        to = (to % np.uint64(n_buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        for o in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else ():
            emit(int(to[o[0]]), None, p[o].tobytes(), b"".join(data[a : a + z].tobytes() for a, z in zip(lo[o], p["size"][o], strict=True)))
        return pa.table(rows, schema=pa.schema([("key", pa.int64()), ("block", pa.int64()), ("cuts", pa.binary()), ("parts", pa.binary()), ("text", pa.binary())]))

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        """Suffix order and longest previous factors of the windows that met under their minimisers."""
        out = pa.schema([("block", pa.int64()), ("cuts", pa.binary())])
        if key[0].as_py() < 0:
            return pa.table({"block": t.column("block"), "cuts": t.column("cuts")}, schema=out)
        parts = np.concatenate([np.frombuffer(x, dtype=PART) for x in t.column("parts").to_pylist()])
        data = np.frombuffer(b"".join(t.column("text").to_pylist()), dtype=np.uint8)
        begin = np.cumsum(parts["size"]) - parts["size"]
        order = np.lexsort((parts["start"], parts["row"], parts["doc"]))
        parts, begin = parts[order], begin[order]
        count = parts["count"].astype(np.int64)
        of = np.repeat(np.arange(len(parts)), count)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        kind = mix(parts["mh"][of] + mix((parts["off"][of] - inner).astype(np.uint64)))
        order, group, common = suffix_order(data, begin[of] + inner, kind, window)
        lpf = longest_previous(order, group, common)  # elements are numbered in order of document and place
        hit = np.sort(order[lpf >= window])
        c = np.zeros(len(hit), dtype=CUTS)
        e = of[hit]
        c["row"], c["start"], c["count"] = parts["row"][e], parts["start"][e] + inner[hit], 1
        block = parts["block"][e]
        by = np.argsort(block, kind="stable")
        ids, starts = np.unique(block[by], return_index=True)
        return pa.table({"block": ids, "cuts": pa.array([joined(np.sort(x, order=("row", "start")), 1).tobytes() for x in np.split(c[by], starts[1:])] if len(ids) else [], pa.binary())}, schema=out)

    said = blocks.groupBy("block").applyInArrow(announce, "bucket bigint, block bigint, keys binary, docs binary")
    replies = said.groupBy("bucket").applyInArrow(reply, "block bigint, bucket bigint, flags binary")
    settled = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(settle, "key bigint, block bigint, cuts binary, parts binary, text binary")
    return held, settled.groupBy("key").applyInArrow(compare, "block bigint, cuts binary")


def joined(c: np.ndarray, near: int) -> np.ndarray:
    """Sorted cuts with those merged that touch or overlap as windows."""
    if not len(c):
        return c
    end = c["start"] + c["count"]
    new = np.concatenate(([True], (c["row"][1:] != c["row"][:-1]) | (c["start"][1:] > end[:-1] + near - 1)))
    first = np.flatnonzero(new)
    out = c[first].copy()
    out["count"] = end[np.append(first[1:], len(c)) - 1] - out["start"]
    return out


def strip_passages(docs: DataFrame, window: int = 100, with_text: bool = False, carry: tuple[str, ...] = (), **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, the text without its repeats and the row's own columns `carry`, in a struct `carried`.

    Every byte goes that a string of `window` bytes covers which also starts earlier: in a document of smaller doc_id or
    further ahead in the same one. The first copy stays. Strings are judged on the input and do not cross documents. Rows
    that share a doc_id are ordered by text, equal ones in any order; rows without a doc_id come last, ordered by a hash of the text (ids from
    3 * 2**61 on would mix with them). Null and empty texts have 0 bytes and the hash of nothing; texts of any length are cut whole. Other columns are
    ignored, whatever their names. Stretches that repeat whole are told by 96 bits of hashes (one pair of 10**28 different ones is taken for equal) and windows of
    crowded stretches within a block by 128 bits; all else is compared byte by byte. A crowd of stretches under one minimiser is split by the hashes of its windows, so no bucket grows with
    the copies of one passage. `text` drops characters that are cut in part as a whole. A table without rows gives none.
    """
    blocks, cuts = passage_cuts(docs, window, carry=carry, **sizes)

    def remove(key: tuple, t: pa.Table, cut: pa.Table) -> pa.Table:
        data, offsets, _, t = ordered(t)
        n = t.num_rows
        c = np.concatenate([np.frombuffer(x, dtype=CUTS) for x in cut.column("cuts").to_pylist()]) if cut.num_rows else np.zeros(0, dtype=CUTS)
        c = np.sort(c, order=("row", "start"))
        lo, hi = c["start"], c["start"] + c["count"] - 1 + window
        top = np.zeros(0, dtype=np.int64)
        if len(c):  # ends so far within the row, by an offset that keeps rows apart
            far = np.int64(len(data) + window + 1)
            top = np.maximum.accumulate(hi + c["row"] * far) - c["row"] * far
        new = np.concatenate(([True], (c["row"][1:] != c["row"][:-1]) | (lo[1:] > top[:-1]))) if len(c) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        row, lo, hi = c["row"][first], lo[first], top[np.append(first[1:], len(c)) - 1] if len(c) else top
        spans = np.bincount(row, minlength=n)
        removed = np.bincount(row, weights=hi - lo, minlength=n).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(spans)))
        sha, texts = [], []
        view = memoryview(np.ascontiguousarray(data))
        for i in range(n):
            a, b = offsets[i], offsets[i + 1]
            h, pieces, p = hashlib.sha256(), [], a
            for x in range(at[i], at[i + 1]):
                pieces.append(view[p : a + lo[x]])
                p = a + hi[x]
            pieces.append(view[p:b])
            for piece in pieces:
                h.update(piece)
            sha.append(h.hexdigest())
            if with_text:
                texts.append("".join(bytes(piece).decode("utf-8", "ignore") for piece in pieces))
        cols = {"doc_id": t.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(cols | ({"text": pa.array(texts, pa.string())} if with_text else {}) | ({"carried": t.column("carried")} if carry else {}))

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text string" * with_text
    if carry:
        schema += f", carried {blocks.schema['carried'].dataType.simpleString()}"
    return blocks.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(remove, schema)


def op4_suffix_lpf(docs: DataFrame) -> DataFrame:
    """The contract's columns from strip_passages with strings of 100 bytes."""
    return strip_passages(docs, 100)
