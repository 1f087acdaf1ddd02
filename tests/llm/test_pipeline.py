"""The pipeline's stages against brute force on the smallest tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from loopwright.llm import apportion

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.cache()
    labels = spark.read.parquet(f"{small}/labels.parquet")
    first = kept["quality"]
    assert first.columns == corpus_pipeline.COLUMNS
    marked = labels.join(first.select("doc_id", F.lit(1).alias("in")), "doc_id", "left").collect()
    good, bad = ([r for r in marked if r.quality == q] for q in (1, 0))
    assert sum(r["in"] is not None for r in good) >= 0.97 * len(good) and sum(r["in"] is None for r in bad) >= 0.8 * len(bad)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {r.doc_id: shingles(r.text) for r in first.collect()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in kept["near_dedup"].collect()) == [i for i in ids if top(i) == i]

    seen, want = set(), {}
    for r in sorted(kept["near_dedup"].collect(), key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        if not b or not all(gone):
            pieces = []
            for part in re.finditer(rb"\x00+|\x01+", bytes(gone)):
                if part[0][0] == 0:
                    pieces.append(b[part.start() : part.end()].decode("utf-8", "ignore"))
            want[r.doc_id] = "".join(pieces)
    rows = kept["passages"].collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want) and all(r.n_chars == len(r.text) for r in rows)
    seen = set(want)
    mixed = kept["mixing"].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in mixed) <= 2 and {r.doc_id for r in mixed} <= seen
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows}
    source, times = {r.doc_id: r.source for r in rows}, {r.doc_id: r["count"] for r in mixed}
    got = {}
    for i, n in times.items():
        got[source[i]] = got.get(source[i], 0) + n * words[i]
    sizes = spark.createDataFrame(list({s: sum(w for i, w in words.items() if source[i] == s) for s in source.values()}.items()), "source string, source_size long")
    for t in apportion.source_targets(sizes).collect():  # whole documents: off by those at the ends of blocks
        assert abs(got.get(t.source, 0) - t.target) <= 0.15 * t.target + 2 * max(words.values())
    assert kept["encoding"].count() == kept["mixing"].count() and kept["encoding"].where("not round_trip").count() == 0


def awkward(spark):
    """Rows without an id from several sources, rows that share an id, null and empty texts, equal rows."""
    text = lambda i, n: " ".join(f"word{i}x{j}" for j in range(n))
    shared = text("shared", 40)
    rows = [(None, text(f"n{i}", 30 + i), f"l{i}", f"src{i}") for i in range(6)]
    rows += [(None, f"{text('m', 20)} {shared}", "en", "src7"), (None, f"{text('m', 20)} {shared}", "fr", "src8")]
    rows += [(5, text("a", 60), "en", "src1"), (5, text("b", 60), "fr", "src2"), (5, f"{shared} {text('c', 60)}", None, None), (6, f"{shared} {text('d', 60)}", "de", "src3")]
    rows += [(7, None, "en", "src1"), (8, "", "es", None), (9, text("e", 50), "en", "src1"), (9, text("e", 50), "en", "src1")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_rows_keep_their_own_language_and_source(spark, small, tmp_path):
    docs = awkward(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    for given in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        whole = sorted((r.lang or "", r.source or "", r.doc_id or 0) for r in docs.collect())
        for stage in (corpus_pipeline.quality, corpus_pipeline.near_dedup):
            out = stage(spark, given, small)
            assert out.columns == corpus_pipeline.COLUMNS
            assert {(r.doc_id, r.text, r.lang, r.source) for r in out.collect()} <= {(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()}
        out = corpus_pipeline.passages(spark, given, small).collect()
        first = {(r.text or "").split(" ")[0]: r for r in docs.collect() if not (r.text or "").startswith("wordshared")}
        for r in out:
            if r.text and r.text.split(" ")[0] in first and not r.text.startswith("wordm"):
                own = first[r.text.split(" ")[0]]
                assert (r.lang, r.source, r.doc_id) == (own.lang, own.source, own.doc_id)
        assert {r.source for r in out if r.doc_id is None} >= {f"src{i}" for i in range(6)}
        assert sorted((r.lang or "", r.source or "") for r in out if r.doc_id == 5) == [("", ""), ("en", "src1"), ("fr", "src2")]
        assert len([r for r in out if r.doc_id == 9]) == 1 and len(out) == len(whole) - 2  # a copy and the second of two equal texts go whole
    mixed = [sorted(corpus_pipeline.mixing(spark, docs.repartition(n), small).collect(), key=repr) for n in (1, 5)]
    assert mixed[0] == mixed[1] and {(r.doc_id, r.text, r.lang, r.source) for r in mixed[0]} <= {(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()}
    by_source = {}
    for r in mixed[0]:
        by_source[r.source] = by_source.get(r.source, 0) + len((r.text or "").split())
    assert len({r.source for r in mixed[0] if r.doc_id is None}) >= 4  # sources of rows without ids are taken each for itself
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    assert all(n <= 2 * sizes[s] for s, n in by_source.items())
    assert corpus_pipeline.encoding(spark, docs, small).count() == docs.count()


def test_stages_of_an_empty_table(spark, small):
    docs = awkward(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0 and (name == "encoding" or out.columns == corpus_pipeline.COLUMNS), name
