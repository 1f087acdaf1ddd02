"""Control loops, hooks and report bundles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loopwright.functions import hooks as H
from loopwright.operators import optimize as O
from loopwright.operators import reports as P
from loopwright.streaming import streams as S

NOW = dt.datetime(2024, 3, 1)


def test_hill_climb_keeps_strict_gains_only():
    values = {"aaaaaaaaaa": 0.5, "aaaaaaaaab": 0.5, "aaaaaaaaac": 0.6, "aaaaaaaaad": 0.9}
    plan = iter(["aaaaaaaaab", "aaaaaaaaac", "a" * 40, "aaaaaaaaad"])
    best, log = O.hill_climb("aaaaaaaaaa", values.get, lambda _, i: next(plan), 4)
    assert best == "aaaaaaaaad" and [x.reason for x in log] == ["not better", "better", "too large", "flagged"]


def test_coordinate_search_finds_a_maximum():
    def f(ws):
        return [1 - (w["a"] - 1.5) ** 2 / 10 - (w["b"] - 0.5) ** 2 / 10 for w in ws]

    best, value = O.coordinate_search({"a": 1.0, "b": 1.0}, f)
    assert abs(best["a"] - 1.5) < 0.01 and abs(best["b"] - 0.5) < 0.01 and value > 0.999
    assert O.coordinate_search({"a": 1.0, "b": 1.0}, lambda ws: [0.1] * len(ws))[0] == {"a": 1.0, "b": 1.0}


def test_coordinate_search_takes_each_gain_at_once():
    seen = []

    def f(ws):
        seen.extend(tuple(w.values()) for w in ws)
        return [1.0 + min(w["a"], 1.5) + (w["b"] if w["a"] > 1.2 else -w["b"]) for w in ws]

    best, value = O.coordinate_search({"a": 1.0, "b": 0.1}, f, rounds=2)
    assert seen[:5] == [(1.0, 0.1), (1.25, 0.1), (0.75, 0.1), (1.25, 0.35), (1.25, 0.0)]  # b is tried from where a went
    assert best == {"a": 1.5, "b": 0.6} and abs(value - 3.1) < 1e-9


def test_rubric_faults():
    assert O.rubric_faults([{"name": "a", "weight": 0.5}, {"name": "b", "weight": 0.5}]) == []
    assert len(O.rubric_faults([{"name": "a", "weight": 0.5}, {"name": "a", "weight": 0}])) == 3


def test_hooks_run_in_batches(spark):
    d = spark.createDataFrame([("a b",), (None,), ("a b",)], "t string")
    got = [r.e for r in d.select(H.batched(H.hashed_embedding(8), "array<double>", 2)(F.col("t")).alias("e")).collect()]
    assert got[0] == got[2] and abs(sum(x * x for x in got[0]) - 1) < 1e-9 and got[1] == [0.0] * 8


def test_freshness_boundaries(spark):
    d = spark.createDataFrame([(str(k), NOW - dt.timedelta(days=k)) for k in (2, 3, 7, 8)], "log string, ts timestamp")
    assert {r.log: r.status for r in P.freshness(d, F.lit(NOW)).collect()} == {"2": "GREEN", "3": "YELLOW", "7": "YELLOW", "8": "RED"}


def test_stale_links(spark):
    docs = spark.createDataFrame([(1, "[a](a.md) [b](http://x.y) [c](c.md) [d](d.md)")], "doc_id long, text string")
    files = spark.createDataFrame([("a.md", NOW - dt.timedelta(days=60)), ("c.md", NOW)], "name string, modified timestamp")
    assert {r.link: r.status for r in P.stale_links(docs, files, F.lit(NOW)).collect()} == {"a.md": "stale", "c.md": "fresh", "d.md": "missing"}


def test_worst_status(spark):
    d = spark.createDataFrame([("a", "ok"), ("a", "warn"), ("b", "fail"), ("b", "warn"), ("c", "ok")], "section string, status string")
    assert {r.section: r.status for r in P.worst_status(d).collect()} == {"a": "warn", "b": "fail", "c": "ok"}


def test_stages_are_isolated():
    def fails():
        raise ValueError("no")

    got = S.run_stages([("a", lambda: 1), ("b", fails), ("c", lambda: 2)])
    assert [(n, x, e) for n, x, e in got] == [("a", 1, None), ("b", None, "no"), ("c", 2, None)]
