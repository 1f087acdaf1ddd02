"""State that ends: late rows, expiry, time to live, and compaction that is broken off and run again."""

from __future__ import annotations

import math
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loopwright.streaming import state

DAY0 = datetime(2026, 1, 5)  # a Monday
INJ = "rule_id string, session_id string, ts timestamp, rating double"


def run(spark, tmp_path, schema, batches, make, between=0.0):
    """What a stream over the batches, one after the other, writes."""
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        d = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))

        def keep(df, epoch, i=i):
            out.extend((i, r) for r in df.collect())

        q = d.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        time.sleep(between)
    return out


def test_late_ratings_take_their_place_and_rules_expire(spark, tmp_path):
    at = lambda days: DAY0 + timedelta(days=days)
    first = [("a", f"s{i}", at(i / 10), float(1 + i % 10)) for i in range(30)] + [("b", "x", at(0), 9.0), ("a", "none", at(1), None), ("a", "zero", at(1), 0.0)]
    late = [("a", "late", at(1.05), 10.0), ("a", "s3", at(0.3), 4.0), ("a", "old", at(-30), 10.0)]  # accepted, counted already, behind the watermark
    far = [("c", "y", at(40), 5.0)]
    got = run(spark, tmp_path, INJ, [first, late, far, [("a", "back", at(41), 3.0)]], lambda d: state.rule_stats(d, keep=20, life=10, late="7 days"))
    by = lambda batch, rule: [r for i, r in got if i == batch and r.rule_id == rule]

    def decayed(values):
        w = [math.exp(-math.log(2) / 10 * a) for a in range(len(values) - 1, -1, -1)]
        return sum(x * y for x, y in zip(values, w, strict=True)) / sum(w)

    rated = sorted((t, s, r) for k, s, t, r in first if k == "a" and r)
    assert (by(0, "a")[0].n, by(0, "a")[0].last_seen) == (30, at(2.9)) and by(0, "a")[0].decayed == pytest.approx(decayed([r for *_, r in rated[-20:]]))
    rated = sorted([*rated, (at(1.05), "late", 10.0)])
    now = by(1, "a")[0]
    assert (now.n, now.last_seen, now.expired) == (31, at(2.9), False) and now.decayed == pytest.approx(decayed([r for *_, r in rated[-20:]]))
    assert now.high == sum(r >= 7 for *_, r in rated) and now.low == sum(r <= 4 for *_, r in rated)
    ended = {r.rule_id: r for i, r in got if r.expired}
    assert set(ended) == {"a", "b"} and ended["a"].n == 31 and ended["b"].n == 1
    assert [(r.n, r.expired) for r in by(3, "a") if not r.expired] == [(1, False)]  # a rule that comes back starts anew


@pytest.fixture
def only_with_data(spark):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")


def test_contexts_live_for_their_time(spark, tmp_path, only_with_data):
    schema = "session_id string, ts timestamp, kind string, rules array<string>"
    give = [("s", DAY0, "give", ["r1", "r2"]), ("t", DAY0, "ask", None)]
    ask = [("s", DAY0 + timedelta(hours=1), "ask", None)]
    got = run(spark, tmp_path, schema, [give, ask], lambda d: state.session_contexts(d, hours=24))
    assert {(r.session_id, tuple(r.rules) if r.rules is not None else None) for _, r in got} == {("t", None), ("s", ("r1", "r2"))}
    short = tmp_path / "short"
    short.mkdir()
    got = run(spark, short, schema, [give, ask], lambda d: state.session_contexts(d, hours=0.5 / 3600), between=1.0)
    assert {(r.session_id, r.rules) for _, r in got} == {("t", None), ("s", None)}


def events(week, n=5, rating=6.0):
    return [(DAY0 + timedelta(weeks=week, hours=11 * i), rating + i) for i in range(n)]


def test_compaction_is_bounded_and_can_be_run_again(spark, tmp_path):
    c = state.Compactor(spark, str(tmp_path / "digests"), "1 day")
    frame = lambda rows: spark.createDataFrame(rows, "ts timestamp, rating double")
    rows = []
    most = 0
    for i in range(6):  # twelve weeks, two a batch
        batch = events(2 * i) + events(2 * i + 1) + (events(2 * i - 6, 2, 1.0) if i >= 4 else [])  # late ones from long closed weeks
        rows.append(batch)
        c.cycle(frame(batch), i)
        most = max(most, c.state_rows)
    assert most <= 3  # open weeks only, whatever the number of weeks that went by
    weeks = {r.week: (r.n, r.total) for r in c.weekly().collect()}
    assert weeks[DAY0] == (5, 40.0) and all(v == (5, 40.0) for v in weeks.values()) and len(weeks) == 11
    assert c.late().count() == 2 * 2
    months = {r.month: (r.weeks, r.n, r.mean) for r in c.monthly().collect()}
    assert months == {"2026-01": (4, 20, 8.0), "2026-02": (4, 20, 8.0)}
    for i in (5, 3):  # batches that are done are passed over
        c.cycle(frame(rows[i]), i)
    assert {r.week: (r.n, r.total) for r in c.weekly().collect()} == weeks and c.late().count() == 4 and c.monthly().count() == 2


@pytest.mark.parametrize("step", ["_weeks", "_months"])
def test_a_cycle_that_breaks_off_is_finished_by_the_next(spark, tmp_path, monkeypatch, step):
    c = state.Compactor(spark, str(tmp_path / "digests"), "1 day")
    frame = lambda rows: spark.createDataFrame(rows, "ts timestamp, rating double")
    batches = [[e for w in range(a, a + 6) for e in events(w)] for a in (0, 6)]
    c.cycle(frame(batches[0]), 0)
    whole = getattr(c, step)

    def broken() -> None:
        if step == "_months":
            raise RuntimeError("lost")
        whole()
        raise RuntimeError("lost")

    monkeypatch.setattr(c, step, broken)
    with pytest.raises(RuntimeError):
        c.cycle(frame(batches[1]), 1)
    monkeypatch.setattr(c, step, whole)
    c.cycle(frame(batches[1]), 1)
    assert {r.month: (r.weeks, r.n) for r in c.monthly().collect()} == {"2026-01": (4, 20), "2026-02": (4, 20)}
    assert c.late().count() == 0 and c.weekly().agg(F.sum("n")).first()[0] == 5 * c.weekly().count()
