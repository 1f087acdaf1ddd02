"""Results that depend on an order over all rows, against plain loops."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from loopwright.operators import ordered as O


def plain_labels(nodes, edges, taxonomy=None, rounds=10):
    """One node after the other; labels vote as soon as they are given."""
    domains = {i: [x for x in d if x] if d and d[0] else [] for i, d in nodes}
    near = {}
    for a, b, kind in sorted(edges):
        if kind in O.VOTES:
            near.setdefault(a, []).append((b, O.VOTES[kind]))
            near.setdefault(b, []).append((a, O.VOTES[kind]))
    source = {i: "given" for i, d in domains.items() if d}
    for _ in range(rounds):
        changed = False
        for i in sorted(domains):
            if domains[i]:
                continue
            votes, n = {}, 0
            for j, w in near.get(i, []):
                if domains.get(j):
                    n += 1
                    for d in domains[j]:
                        votes[d] = votes.get(d, 0) + w
            best = sorted([(d, w) for d, w in votes.items() if taxonomy is None or d in taxonomy], key=lambda x: -x[1])
            if n >= 2 and best and best[0][1] >= 2:
                domains[i], source[i], changed = [best[0][0]], "propagation", True
        if not changed:
            break
    return {i: (domains[i][0] if domains[i] else None, source.get(i)) for i in domains}


@pytest.mark.parametrize(("seed", "per_task"), [(1, 50_000), (2, 12), (3, 7)])
def test_labels_are_given_one_after_the_other(spark, seed, per_task):
    rng = random.Random(seed)
    n = 120
    nodes = [(i, rng.choice([["x"], ["y", "z"], ["", "x"], None, [], [], [], []])) for i in range(n)]
    kinds = [*O.VOTES, "same_domain"]
    edges = list({(a, b): (a, b, rng.choice(kinds)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(420)) if a != b}.values())
    edges += [(i, i + 1, "reinforces") for i in range(40, 110) if (i, i + 1) not in {(a, b) for a, b, _ in edges}]  # a chain along the order
    d = spark.createDataFrame(nodes, "id long, domains array<string>")
    e = spark.createDataFrame([(*x, 1.0) for x in edges], "src long, dst long, relationship string, strength double")
    for taxonomy in (None, ["x", "z"]):
        got = {r.id: (r.domain, r.source) for r in O.propagate_labels(d, e, taxonomy, rows_per_task=per_task).collect()}
        want = plain_labels(nodes, edges, taxonomy)
        assert got == want
        assert sum(s == "propagation" for _, s in want.values()) > 10
    assert O.propagate_labels(d.limit(0), e).count() == 0 and O.propagate_labels(d, e.limit(0)).where("source = 'propagation'").count() == 0


def adjusted(rating):
    if rating is None or rating != int(rating) and 1 < rating < 9:
        return 0.0
    return max(-0.15, min(0.15, round((rating - 5) * 0.05, 2)))


@pytest.mark.parametrize("run", [2048, 5])
def test_a_history_moves_edges_in_order(spark, run):
    rng = random.Random(4)
    start = datetime(2026, 1, 1)
    sessions = [(f"s{i:03d}", start + timedelta(minutes=rng.randrange(400)), rng.choice([1.0, 2, 3, 4, 5, 6, 7, 8, 9, 9.5, 10, 7.5, None, 0.0]), rng.sample(range(12), rng.randrange(1, 5))) for i in range(160)]
    edges = [(a, b, rng.choice(["co_occurred"] * 4 + ["sibling"]), rng.choice([0.30000001, 0.1, 2.0, 1.2345678, 2.6])) for a in range(12) for b in range(a + 1, 12, 2)]
    rows = [(s, t, r, x) for s, t, r, rules in sessions for x in rules]
    rows += rows[:7]  # a rule twice in a session counts once
    h = spark.createDataFrame([(s, t, None if r is None else float(r), x) for s, t, r, x in rows], "session_id string, ts timestamp, rating double, rule_id long")
    e = spark.createDataFrame([(*x, "q") for x in edges], "src long, dst long, relationship string, strength double, source string")
    want = {}
    for a, b, kind, s in edges:
        for _, _, rating, rules in sorted(sessions, key=lambda x: (x[1], x[0])):
            by = adjusted(rating)
            if kind == "co_occurred" and by and (a in rules or b in rules):
                new = min(2.0, max(0.1, s * (1 + by)))
                s = s if new == s else math.floor(new * 10_000 + 0.5) / 10_000
        want[a, b] = s
    got = O.edge_history(e, h, run=run).collect()
    assert {(r.src, r.dst): r.strength for r in got} == want and len(got) == len(edges)
    assert O.edge_history(e, h.limit(0)).agg({"strength": "sum"}).first()[0] == pytest.approx(sum(x[3] for x in edges))


def test_runs_of_ratings_are_step_functions():
    rng = random.Random(6)
    for n in (1, 40, 3000):
        codes = bytes(rng.randrange(6) for _ in range(n))
        start, value = O.composed(codes)
        x = np.arange(1000, 20_001) / O.GRID
        y = x.copy()
        for c in codes:
            y = O.step(y, c)
        assert (np.array(value)[np.searchsorted(start, x, "right") - 1] == y).all()
        assert n < 3000 or len(start) < 3000


def test_draws_add_up_in_every_round(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random(300), np.full(500, 0.25)])
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    for per_part in (20_000, 40):
        rows = O.bootstrap_draws(d, "v", 400, 7, per_part).collect()
        assert len(rows) == 400 and {r.n for r in rows} == {800}
        means = np.array([r.total / r.n for r in rows])
        assert abs(means.mean() - x.mean()) < 4 * x.std() / math.sqrt(800 * 400)
        assert 0.85 < means.std() / (x.std() / math.sqrt(800)) < 1.15  # the spread of a draw with return
        assert rows == O.bootstrap_draws(d.repartition(7), "v", 400, 7, per_part).collect() or sorted(rows) == sorted(O.bootstrap_draws(d.repartition(7), "v", 400, 7, per_part).collect())
    ci = O.bootstrap_ci(d, "v", 400).first()
    assert ci.low < ci.mean < ci.high and abs(ci.mean - x.mean()) < 1e-5
    assert tuple(O.bootstrap_ci(d.limit(0), "v").first()) == (0.0, 0.0, 0.0) and tuple(O.bootstrap_ci(d.limit(0).union(spark.createDataFrame([(2.0,)], "v double")), "v").first()) == (2.0, 2.0, 2.0)


def test_values_are_worked_out_once(spark, small):
    from pyspark.sql import functions as F

    source = spark.read.parquet(f"{small}/events.parquet").select(F.col("value").alias("v"))
    text = O.bootstrap_ci(source, "v", 50)._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in text.lower()  # the mean used to read the source anew
