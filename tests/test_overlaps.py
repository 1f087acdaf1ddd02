"""Pairs of similar texts: what is sent follows the texts, not the pairs of them."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from loopwright.operators import overlaps as O  # noqa: E741
from loopwright.operators import retrieval as T


@pytest.fixture
def soon():
    began = time.time()
    yield
    assert time.time() - began < 120


def test_similar_texts_are_sent_once(spark, soon):
    """40 texts of 4,000 words, all near each other: two sets for each pair would be 6 million words. And texts that share half their words."""
    rng = random.Random(7)
    words = [f"{rng.getrandbits(48):012x}" for _ in range(4000)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"own{i}x{k}" for k, w in enumerate(words))) for i in range(40)]
    rows += [(1000 + k, " ".join(f"half{k // 2}x{i}" if i % 2 else f"other{k}x{i}" for i in range(600))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sets = {i: set(t.split()) for i, t in rows}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before, key = written(), "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as for tables that are too large to be broadcast
    try:
        _, near = T.lexical_classes(docs, 0.85)
    finally:
        spark.conf.set(key, was)
    sent = written() - before
    want = {p: x for p, x in share.items() if x >= 0.85}
    got = {(r.a, r.b): r.sim for r in near.collect()}
    assert len(want) == 40 * 39 // 2 and set(got) == set(want) and all(abs(got[p] - want[p]) <= 0.0005001 for p in want)
    assert sent < 25e6, sent


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 255, 256, 257, 900, 5000):
        x = rng.integers(-(2**63), 2**63 - 1, n)
        y = np.concatenate((x[: n - n // 9], rng.integers(-(2**63), 2**63 - 1, n // 7)))
        a, b = (np.frombuffer(O.sketch(z), np.uint8)[None] for z in (x, y))
        assert a.shape[1] * 8 >= n
        w = min(a.shape[1], b.shape[1])
        for width in (w, 32):
            differ = np.bitwise_count(O.folded(a, width) ^ O.folded(b, width)).sum()
            assert differ <= len(set(x.tolist()) ^ set(y.tolist()))
    assert O.sketch(x) == O.sketch(x[::-1])


def test_candidates_over_batches(spark, soon):
    """One element in all prefixes, over many batches, with sketches of either sign: every pair of fitting sizes is found, each once."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(i, 10 + i % 3, 0, t, -1 if i % 2 else 0, -1, 5, -(2**63)) for i in range(60) for t in (4, -9)]
        p = spark.createDataFrame(rows, "id long, n int, p int, t long, s0 long, s1 long, s2 long, s3 long")
        got = sorted(tuple(r) for r in O.candidates(p, 0.85).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    fits = lambda a, b: min(10 + a % 3, 10 + b % 3) >= 0.85 * max(10 + a % 3, 10 + b % 3) - 1e-9
    assert got == [(a, b) for a in range(60) for b in range(a + 1, 60) if (a - b) % 2 == 0 and fits(a, b)]


def test_a_set_is_sent_once_to_the_pairs_around_it(spark):
    """What reaches the tasks that work out pairs: before, two sets a pair."""
    n = 60
    rows = [(i, [f"t{k}" for k in range(40)] + [f"own{i}"]) for i in range(n)]
    sets = spark.createDataFrame(rows, "id long, set array<string>")
    sizes = spark.createDataFrame([(i, 41) for i in range(n)], "id long, n int")
    pairs = spark.createDataFrame(list(itertools.combinations(range(n), 2)), "a long, b long")
    was = O.cut
    try:
        counts = []
        O.cut = lambda d: (counts.append((d.columns, (c := was(d)).count())), c)[1]
        got = O.confirmed(pairs, sizes, sets, 0.9)
        assert got.count() == n * (n - 1) // 2
    finally:
        O.cut = was
    homes = dict((tuple(c), k) for c, k in counts)[("home", "k")]
    assert homes == 1
    small = O.confirmed(pairs, sizes, sets, 0.9, chunk=300, task=500)
    assert small.count() == n * (n - 1) // 2 == small.distinct().count()
    assert {round(r.sim, 9) for r in small.collect()} == {round(40 / 42, 9)}
