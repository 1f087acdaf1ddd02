"""Joins whose work must follow the rows: keys that all rows share made them look at every pair, which took minutes at these sizes."""

from __future__ import annotations

import bisect
import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from loopwright.operators import graph as G
from loopwright.operators import learned as L
from loopwright.operators import retrieval as T
from loopwright.operators import rules as R
from loopwright.streaming import streams as S


@pytest.fixture
def soon():
    began = time.time()
    yield
    assert time.time() - began < 60


def test_containing_where_all_texts_begin_alike(spark, soon):
    n = 40_000
    name = F.concat(F.lit("large-ring-"), F.col("id"))
    long = spark.range(n).select(F.col("id").alias("a"), name.alias("x"))
    short = spark.range(n).where("id % 2 = 0").select(F.col("id").alias("b"), name.alias("y")).union(spark.createDataFrame([(-1, ""), (-2, "ring-77"), (-3, "large-ring-with-much-more")], "b long, y string"))
    got = {tuple(r) for r in L.containing(long, short).collect()}
    want = {(i, int(str(i)[:k])) for i in range(n) for k in range(1, len(str(i)) + 1) if int(str(i)[:k]) % 2 == 0 and str(int(str(i)[:k])) == str(i)[:k]} | {(i, -2) for i in range(n) if str(i).startswith("77")}
    assert got == want


def test_nearest_rating_within_one_bucket(spark, soon):
    n, zero, rng = 60_000, dt.datetime(2024, 1, 1), random.Random(3)
    draw = lambda: [rng.randrange(0, 20_000_000) for _ in range(n)]
    asks, given = draw(), draw()
    at = lambda ms: zero + dt.timedelta(milliseconds=ms)
    s = spark.createDataFrame([(i, at(t)) for i, t in enumerate(asks)] + [(-1, at(90_000_000)), (-2, None)], "session_id long, ts timestamp")
    r = spark.createDataFrame([(i, at(t), float(i)) for i, t in enumerate(given)] + [(n, None, 1.0)], "event_id long, ts timestamp, rating double")
    got = {x.session_id: (x.rating, x.seconds) for x in R.nearest_rating(s, r, 6).collect()}
    line = sorted((t, i) for i, t in enumerate(given))
    sec = lambda ms: (1_704_067_200_000_000 + ms * 1000) / 1e6  # noqa: E731  # distances are those of doubles, as in SQL
    for i, t in enumerate(asks):
        k = bisect.bisect_left(line, (t + 1, -1))
        near = line[bisect.bisect_left(line, (line[k - 1][0], -1))] if k else None, line[k] if k < n else None
        d, _, e = min((abs(sec(t) - sec(x[0])), *x) for x in near if x)
        assert got[i] == (float(e), round(d, 3))
    assert set(got) == set(range(n))


def test_interval_join_of_one_key(spark, tmp_path, soon):
    n, first = 60_000, 1_704_067_200
    spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(first) + F.col("id") * 60 + F.col("id") % 7).alias("ts"), F.lit(1).alias("skill")).coalesce(1).write.parquet(f"{tmp_path}/e.parquet")
    e = spark.read.parquet(f"{tmp_path}/e.parquet")
    side = lambda k: S.read_table(spark, str(tmp_path), "e", e.schema).where(F.col("event_id") % 2 == k)
    got = S.to_table(S.interval_join(side(0), side(1), "skill", 30), "append")
    at = lambda i: 60 * i + i % 7
    want = sum(at(i) <= at(j) <= at(i) + 1800 for i in range(0, n, 2) for j in range(i + 1, min(n, i + 35), 2))
    assert got.count() == want == got.distinct().count()


def test_copies_are_one_class(spark, soon):
    """30,000 copies, a near one, and texts of few common words."""
    n = 30_000
    words = lambda k, m: " ".join(f"word{k}x{i}" for i in range(m))
    near = words("a", 39) + " other"
    rows = [(i, words("a", 40)) for i in range(n)] + [(n, near), (n + 1, words("b", 30)), (n + 2, words("b", 30).upper()), (n + 3, words("c", 30)), (n + 4, "short"), (n + 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes, pairs = T.lexical_classes(docs)
    assert {tuple(r) for r in classes.where(f"id >= {n}").collect()} == {(n, n), (n + 1, n + 1), (n + 2, n + 1), (n + 3, n + 3)}
    assert classes.where("lead = 0").count() == n and [tuple(r) for r in pairs.collect()] == [(0, n, 0.951)]
    assert {tuple(r) for r in G.near_duplicate_clusters(pairs, classes).collect()} == {(0, n + 1, 1.0), (n + 1, 2, 1.0)}
    ranked = spark.createDataFrame([(1, 5, 4), (1, n + 4, 1), (2, n, 2), (3, n + 3, 1)], "query_id long, item long, rank int")
    gold = spark.createDataFrame([(1, 7), (1, n), (1, n + 4), (1, n + 5), (2, 0), (3, n + 1)], "query_id long, item long")
    both = pairs.select(F.col("a").alias("item"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    got = R.cluster_recall(ranked, gold, both, classes.withColumnRenamed("id", "item"))
    assert {tuple(r) for r in got.collect()} == {(1, 0.75, 1.0), (2, 1.0, 0.5), (3, 0.0, 0.0)}


def test_pairs_of_copies_over_many_chunks(spark):
    texts = {i: "one two three four five six seven" if i % 3 else "one two three four five six seven eight" for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted(tuple(r) for r in T.lexical_duplicates(docs, 0.8, chunk=4).collect())
    assert got == [(a, b, 1.0 if texts[a] == texts[b] else 0.875) for a in range(60) for b in range(a + 1, 60)]


def test_leaders_meet_rows_of_one_block(spark, soon):
    """12,000 rows that share words with nearly all others: pairs of rows would be 70 million, pairs of a row and a leader are few."""
    rng = random.Random(5)
    common, rare = [f"common{i}" for i in range(12)], [f"rare{i}" for i in range(400)]
    data = [(i, rng.sample(common, rng.randrange(0, 7)) + rng.choices(rare, k=rng.randrange(0, 12))) for i in range(12_000)]
    leaders, want = [], {}
    for i, tokens in data:
        hit = next((x for x, t in leaders if tokens and sum(w in t for w in tokens) / min(len(tokens), len(t)) >= 0.4), None) if tokens else None
        if hit is None and tokens:
            leaders.append((i, tokens))
        want[i] = i if hit is None else hit
    d = spark.createDataFrame([("all", *x) for x in data], "block string, id long, tokens array<string>").withColumn("ordinal", F.col("id"))
    for rows_per_task in (16_384, 500):
        got = {r.id: r.leader for r in G.leader_groups(d, "block", 0.4, False, rows_per_task).collect()}
        assert got == want


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_texts_are_scored_where_they_stand(spark):
    """Scores of all pairs of a text and a query used to be shuffled; only each task's best go to the ranking."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["a", "É", "x_y", "two-parts"]
    texts = [(i, None if i % 50 == 7 else " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(600)] + [(600 + i, texts_of := "w1 W2 w3!") for i in range(30)]
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(40)] + [(40, None), (41, "unknown"), (42, texts_of)]
    docs, queries = spark.createDataFrame(texts, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "query_id long, text string")
    got = T.bm25_search(docs, queries, 15)
    assert plan(got).count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan(got)
    want = T.top_k(T.bm25_scores(docs, queries), 15, "query_id", "doc_id")
    near = lambda d: {(r.query_id, r["rank"], r.doc_id): round(r.score, 8) for r in d.collect()}
    assert near(got) == near(want) and len(near(got)) > 500
    assert [r.doc_id for r in got.where("query_id = 42").orderBy("rank").collect()][:3] == [600, 601, 602]
    assert T.bm25_search(docs.limit(0), queries).count() == 0 == T.bm25_search(docs, queries.limit(0)).count()


def test_domains_of_a_query_need_no_shuffle(spark):
    """All scores of a query with all domains met in the tasks of a few terms; seeds are few, so queries are scored where they stand."""
    from loopwright.operators import context as C

    seeds = spark.createDataFrame([("é", "red blue green"), ("b", "red red tall"), ("a", "red blue green"), ("c", "small"), (None, "tiny"), ("d", None)], "domain string, text string")
    rows = [(1, "red blue"), (2, "tall red red"), (3, "none"), (4, None), (5, "small tall"), (6, "tiny")]
    got = C.detect_domains(spark.createDataFrame(rows, "query_id long, text string"), seeds)
    assert "Exchange" not in plan(got)
    found = {(r.query_id, r["rank"]): (r.domain, r.score) for r in got.collect()}
    want = T.top_k(T.bm25_scores(seeds, spark.createDataFrame(rows, "query_id long, text string"), "domain"), 3, "query_id", "domain").collect()
    best = {r.query_id: r.score for r in want if r["rank"] == 1}
    want = {(r.query_id, r["rank"]): (r.domain, r.score) for r in want if r.score >= 0.3 * best[r.query_id]}
    assert set(found) == set(want) and all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-9 for k in want)
    assert found[1, 1][0] == "a" and found[1, 2][0] == "é" and C.detect_domains(spark.createDataFrame(rows, "query_id long, text string"), seeds.limit(0)).count() == 0


def test_terms_are_mined_once(spark, small):
    from loopwright.plans import q_context

    assert "parquet" not in plan(q_context.pattern_diff(spark, small)).lower()  # each side used to mine them anew, four times in all


def test_pairs_are_dealt_to_tasks_of_a_bounded_size(spark):
    """Pairs used to be summed in as many tasks as there are partitions, however many pairs there were."""
    rng = random.Random(8)
    held = [(i, r, float(1 + i % 10)) for i in range(300) for r in rng.sample(range(150), rng.randrange(0, 7))]
    want, rules = {}, {}
    for i, r, x in held:
        rules.setdefault(i, (x, set()))[1].add(r)
    for x, rs in rules.values():
        for a, b in ((a, b) for a in rs for b in rs if a < b):
            want[a, b] = want.get((a, b), 0) + max(0.3, x / 10)
    pairs = sum(len(rs) * (len(rs) - 1) // 2 for _, rs in rules.values())
    got = G.cooccurrence_edges(spark.createDataFrame(held, "session_id long, rule_id long, rating double"), spark.range(150), k=10_000, heavy=5, pairs_per_task=40)
    assert "hashpartitioning(src#" in plan(got) and f", {1 + pairs // 40}), REPARTITION_BY_NUM" in plan(got)
    found = {(r.src, r.dst): r.strength for r in got.collect()}
    assert set(found) == set(want) and all(abs(found[p] - w / len(rules)) < 1e-8 for p, w in want.items())
