"""The trace store: what readers see, what filters keep from being opened, what a failed or repeated write leaves."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

from loopwright.sources import traces as T


def some(spark, n=40, start=0):
    day = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 7200)
    d = spark.range(start, start + n).select(F.concat(F.lit("t"), "id").alias("id"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"), F.lit("in").alias("input"), F.when(F.col("id") % 10 > 0, "out").alias("output"), day.alias("ts"))
    return d.union(spark.createDataFrame([("none", None, "in", "out", None)] if not start else [], "id string, name string, input string, output string, ts timestamp"))


def test_round_trip_and_filters(spark, tmp_path):
    path = str(tmp_path / "store")
    T.cache(some(spark).repartition(3), path)
    T.cache(some(spark, 5, 40), path)
    whole = T.cached(spark, path)
    assert whole.count() == 45 - 5 + 1 and {r.id for r in whole.where("name is null").collect()} == {"none"}
    since = F.lit("2024-01-03 00:00:00").cast("timestamp")
    got = T.cached(spark, path, ["n1"], since)
    assert {r.id for r in got.collect()} == {f"t{i}" for i in range(24, 45) if i % 3 == 1 and i % 10}
    reader = T.Reader({"path": path})
    left = list(reader.pushFilters([EqualTo(("name",), "n1"), In(("name",), ("n1", "n2")), GreaterThanOrEqual(("ts",), datetime(2024, 1, 3, tzinfo=timezone.utc))]))
    assert len(left) == 1  # names are settled, times are looked at again
    chosen = reader.chosen()
    assert chosen and {e["name"] for e in chosen} == {"n1"} and all(e["last"] >= "2024-01-03" for e in chosen)
    assert len(chosen) < len(T.Store({"path": path}).listed()) / 3
    assert len(reader.partitions()) == 1 and len(T.Reader({"path": path, "splitBytes": "1"}).partitions()) == len(T.Store({"path": path}).listed())


def test_a_write_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "store")
    T.cache(some(spark), path)
    before = T.cached(spark, path).count()
    bad = some(spark, 30, 100).withColumn("output", F.when(F.col("id") == "t129", F.raise_error(F.lit("lost"))).otherwise(F.col("output")))
    with pytest.raises(Exception, match="lost"):
        T.cache(bad.repartition(4), path)
    assert T.cached(spark, path).count() == before and T.Store({"path": path}).versions() == [0]
    os.makedirs(f"{path}/data/2024-01-01", exist_ok=True)
    with open(f"{path}/data/2024-01-01/stray.jsonl", "w") as f:  # what a lost task leaves
        f.write(json.dumps({"id": "x"}))
    assert T.cached(spark, path).count() == before
    T.cache(some(spark, 9, 200), path, "overwrite")
    assert {r.id for r in T.cached(spark, path).collect()} == {f"t{i}" for i in range(201, 209)} and T.cached(spark, str(tmp_path / "nothing")).count() == 0


def test_two_writers_take_two_versions(tmp_path):
    s = T.Store({"path": str(tmp_path / "store")})
    s.fs.create_dir(f"{s.root}/log", recursive=True)
    assert s._create(f"{s.root}/log/{0:020d}.json", b'{"files": [], "replace": false}') and not s._create(f"{s.root}/log/{0:020d}.json", b"{}")
    s.versions = lambda: []  # a writer that looked before the other one's commit
    s.commit([], False)
    assert T.Store({"path": str(tmp_path / "store")}).versions() == [0, 1]


def test_streams_read_what_was_committed_since_and_write_a_batch_once(spark, tmp_path):
    T.register(spark)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    def run(checkpoint):
        d = spark.readStream.format(T.FORMAT).option("path", a).load()
        q = d.writeStream.format(T.FORMAT).option("path", b).option("writer", "copy").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    read = lambda: sorted(r.id for r in spark.read.format(T.FORMAT).option("path", b).load().collect())
    T.cache(some(spark, 6, 300), a)
    run(str(tmp_path / "c1"))
    first = read()
    T.cache(some(spark, 4, 400), a)
    run(str(tmp_path / "c1"))
    assert len(first) == 6 and len(read()) == 10
    run(str(tmp_path / "c1"))
    assert len(read()) == 10
    s = T.Store({"path": b, "writer": "copy"})
    n = len(s.versions())
    T.StreamWriter({"path": b, "writer": "copy"}).commit([T.Written([])], 0)
    assert len(s.versions()) == n


def test_scores_sent_twice_count_once(spark, tmp_path):
    path = str(tmp_path / "scores")
    d = spark.createDataFrame([("a", "tone", 3.0, "x" * 900, datetime(2024, 1, 2)), ("a", "care", 4.0, None, datetime(2024, 1, 1)), ("b", "tone", 2.0, "", datetime(2024, 1, 1))], "trace_id string, dimension string, value double, reasoning string, ts timestamp")
    T.send_scores(d, path)
    T.send_scores(d.where("trace_id = 'a'").withColumn("value", F.lit(5.0)).withColumn("ts", F.lit("2024-02-01").cast("timestamp")), path)
    got = {(r.name, r.value, len(r.comment or "")) for r in T.sent_scores(spark, path).collect()}
    assert got == {("tone", 5.0, 500), ("care", 5.0, 0), ("tone", 2.0, 0)}
    rows = T.score_rows(d).collect()
    assert sorted(r.type for r in rows) == ["score-create"] * 3 + ["trace-create"] * 2 and len({r.id for r in rows}) == 5
    assert [r.ts for r in rows if r.type == "trace-create" and r.ts.day == 1 and r.value is None] == [datetime(2024, 1, 1)] * 2
    left = T.unscored(spark.createDataFrame([("a",), ("c",)], "id string"), T.sent_scores(spark, path))
    assert [r.id for r in left.collect()] == ["c"]


def test_merges_touch_the_buckets_they_must(spark, tmp_path):
    from loopwright.sources.keyed import KeyedTable

    t = KeyedTable(spark, str(tmp_path / "kv"), "id string, v long", buckets=16)
    rows = lambda pairs: spark.createDataFrame(pairs, "id string, v long")
    whole = lambda: {r.id: r.v for r in t.read().collect()}
    assert t.read().count() == 0 and t.merge(rows([]))["version"] == -1
    assert t.merge(rows([(f"k{i}", i) for i in range(100)]))["put"] == 100
    before = t.manifest()["files"]
    done = t.merge(rows([("k1", 1), ("k2", 77), ("k2", 5), ("new", None), (None, 3)]))
    assert (done["put"], done["version"]) == (2, 1) and done["written"] <= 2 and whole() == {f"k{i}": i for i in range(100)} | {"k2": 77, "new": None}
    after = t.manifest()["files"]
    assert sum(after[b] != before.get(b) for b in after) == done["written"]
    assert t.merge(rows([("k1", 1)]), rows([("nobody", 0)]))["version"] == 1  # nothing to do, no version
    t.merge(gone=rows([(f"k{i}", 0) for i in range(100)]))
    assert whole() == {"new": None} and {r.v for r in t.read(0).collect()} == set(range(100))
    assert {r.id for r in t.lookup(rows([("new", 0), ("k3", 0)])).collect()} == {"new"}
    assert t.vacuum(1) == 2 and whole() == {"new": None}
    assert KeyedTable(spark, str(tmp_path / "kv"), "id string, v long", buckets=4).buckets == 16


def test_a_merge_that_fails_before_the_swap_leaves_the_old_state(spark, tmp_path, monkeypatch):
    from loopwright.sources.keyed import KeyedTable

    t = KeyedTable(spark, str(tmp_path / "kv"), "id string, v long", buckets=4)
    rows = lambda pairs: spark.createDataFrame(pairs, "id string, v long")
    t.merge(rows([("a", 1), ("b", 2)]))
    swap = t._swap
    monkeypatch.setattr(t, "_swap", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.merge(rows([("a", 9)]))
    assert {(r.id, r.v) for r in t.read().collect()} == {("a", 1), ("b", 2)}
    monkeypatch.setattr(t, "_swap", swap)
    t.merge(rows([("a", 9)]))
    assert {(r.id, r.v) for r in t.read().collect()} == {("a", 9), ("b", 2)}
    with pytest.raises(RuntimeError, match="another writer"):
        t._swap(1, {})


def test_unchanged_bodies_are_not_embedded_again(spark, tmp_path):
    from loopwright.sources import keyed

    t = keyed.KeyedTable(spark, str(tmp_path / "vectors"), keyed.VECTORS, buckets=4)
    seen = []

    def prefix(d):
        seen.extend(r.id for r in d.collect())
        return d.select("id", F.when(F.col("body") != "bad", F.concat(F.lit("about "), "id")).alias("prefix"))

    embed = lambda d: d.select("id", F.array(F.length("text").cast("double")).alias("vector"))
    files = lambda pairs: spark.createDataFrame(pairs, "id string, body string")
    done = keyed.embed_changed(t, files([("a", "one"), ("b", "two"), ("c", "bad")]), prefix, embed)
    assert (done["put"], done["failed"], done["skipped"]) == (2, 1, 0) and sorted(seen) == ["a", "b", "c"]
    seen.clear()
    done = keyed.embed_changed(t, files([("a", "one"), ("b", "longer"), ("c", "fine")]), prefix, embed)
    assert (done["put"], done["skipped"]) == (2, 1) and sorted(seen) == ["b", "c"]
    assert {r.id: r.vector[0] for r in t.read().collect()} == {"a": 11.0, "b": 14.0, "c": 12.0}
    keyed.embed_changed(t, files([("b", "longer")]), prefix, embed)
    assert {r.id for r in t.read().collect()} == {"b"}


def test_evictions_leave_registry_and_lists(spark, tmp_path):
    from loopwright.sources import keyed

    reg = keyed.KeyedTable(spark, str(tmp_path / "reg"), keyed.RULES, buckets=4)
    lists = keyed.KeyedTable(spark, str(tmp_path / "lists"), "id string, list string, line string", buckets=4)
    rules = spark.createDataFrame([("r1", "deploy it"), ("r2", "x"), ("r3", "y"), ("r4", "z")], "id string, text string")
    keyed.sync_rules(reg, rules, F.when(F.col("text") == "deploy it", F.array(F.lit("deployment"))).otherwise(F.array().cast("array<string>")))
    assert {r.id: r.domains for r in reg.read().collect()} == {"r1": ["deployment"], "r2": ["testing"], "r3": ["testing"], "r4": ["testing"]}
    lists.merge(spark.createDataFrame([("r1", "critical", "- **r1:** deploy it"), ("r2", "learned", "- **r2:** x"), ("r4", "learned", "l4")], "id string, list string, line string"))
    c = spark.createDataFrame([("r1", "critical-stale 9", False), ("r2", "noise", None), ("r3", "avg low", False), ("r4", "stale", True)], "id string, reason string, confirm boolean")
    got = {r.id: (r.outcome, r.trigger) for r in keyed.apply_evictions(reg, lists, c, F.lit("2026-01-05")).collect()}
    assert got == {"r1": ("demoted", "never-helped"), "r2": ("evicted", "high-injection-low-value"), "r3": ("evicted", "low-avg-high-volume"), "r4": ("skipped", None)}
    assert {r.id for r in reg.read().collect()} == {"r4"}
    assert {r.id: (r.list, r.line) for r in lists.read().collect()} == {"r1": ("learned", "- **r1:** deploy it <!-- demoted from Critical on 2026-01-05 -->"), "r4": ("learned", "l4")}


def test_transcripts_of_any_shape(spark):
    from loopwright.sources import transcripts as X

    user = lambda c: json.dumps({"type": "user", "message": {"content": c}, "timestamp": "2026-01-01T00:00:00Z"})
    said = lambda *b: json.dumps({"type": "assistant", "message": {"content": list(b)}})
    text, tool = (lambda t: {"type": "text", "text": t}), (lambda n, **i: {"type": "tool_use", "name": n, "input": i})
    lines = [
        user("no problem, go on"), "{broken", "", said(text("first"), text("second"), tool("Skill", skill="plan")), user("No, not like this"), json.dumps({"type": "last-prompt", "sessionId": "real"}),
        said(tool("Edit", file_path="x"), {"type": "tool_use"}), user([{"type": "image"}, text("fix it M:1 S:2 Q:3")]), said(text(7)), user("undo"), user({"odd": 1}), json.dumps([1, 2]), "null", json.dumps({"type": "user", "content": "  STOP now"}),
        said(tool("Skill", skill="")), user("/rate m:9 s:9  q:10 thanks"), json.dumps({"type": "assistant", "content": "plain"}),
    ]
    d = spark.createDataFrame([("f1", i, x) for i, x in enumerate(lines)] + [("f2", 0, user("wrong")), ("f1", 99, None)], "file string, line long, value string").repartition(3)
    got = X.signals(d, 10)
    assert {(r.session_id, r.line, r.score) for r in got["ratings"].collect()} == {("real", 7, "M:1 S:2 Q:3"), ("real", 15, "m:9 s:9  q:10")}
    assert {(r.line, r.session_id, r.phrase, r.context) for r in got["corrections"].collect()} == {
        (4, "f1", "No, not like this", "second"), (7, "real", "fix it M:1 S:2 Q:3", "second"), (9, "real", "undo", ""), (13, "real", "  STOP now", "")
    }
    assert {r.tool: r.n for r in got["tools"].collect()} == {"Skill": 2, "Edit": 1, "unknown": 1}
    assert [(r.session_id, r.skill) for r in got["skills"].collect()] == [("f1", "plan")] and tuple(got["files"].first()) == (1, 1)
