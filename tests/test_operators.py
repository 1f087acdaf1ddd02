"""Operators on hand-made rows, with hand-computed results."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from loopwright.operators import conversation as V
from loopwright.operators import graph as G
from loopwright.operators import retrieval as T
from loopwright.operators import rules as R
from loopwright.operators import signals as S
from loopwright.operators.iterate import components
from loopwright.sources import logs as L

DAY = dt.datetime(2024, 1, 1)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bm25_counts_repeated_query_terms_twice(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "alpha alpha"), (3, "nothing")], "query_id long, text string")
    got = {r.query_id: r.score for r in T.bm25_search(docs, q, 5).collect()}
    assert set(got) == {1, 2} and math.isclose(got[2], 2 * got[1])


def test_rrf_sums_reciprocal_ranks(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, item long, rank long")
    b = spark.createDataFrame([(1, 11, 1)], "query_id long, item long, rank long")
    got = {r["item"]: r.score for r in T.rrf({"x": a, "y": b}, {"x": 2.0, "y": 1.0}).collect()}
    assert math.isclose(got[10], 2 / 61) and math.isclose(got[11], 2 / 62 + 1 / 61)


def test_diversity_caps_domains(spark):
    d = spark.createDataFrame([(1, i, "a" if i < 5 else "b", 10.0 - i) for i in range(6)], "query_id long, item long, domain string, score double")
    assert rows(T.diversity_topk(d, 4), "item") == [(0,), (1,), (5,)]


def test_sections_and_learned_rules(spark):
    d = spark.createDataFrame([(1, "pre\n## One\na\nb\n## Two\n")], "doc_id long, text string")
    assert rows(T.sections(d), "section", "heading", "start", "n_lines", "body") == [(0, "One", 2, 3, "a\nb"), (1, "Two", 5, 2, "")]
    d = spark.createDataFrame([(1, "- **r1 (from s 2024-01-02):** do\n  more\n- **r2:** x")], "doc_id long, text string")
    assert rows(T.learned_rules(d).fillna(""), "rule_id", "source", "dated", "text") == [("r1", "s", "2024-01-02", "do more"), ("r2", "", "", "x")]


def test_lexical_duplicates_match_brute_force(spark):
    import itertools
    import random

    rng = random.Random(2)
    words = [f"word{i}" for i in range(30)]
    texts = [" ".join(rng.sample(words, rng.randint(6, 9))) for _ in range(60)]
    texts += [t + " extra" for t in texts[:10]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(t.split()) for t in texts]
    want = sorted((i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)
    assert rows(T.lexical_duplicates(d, 0.8), "a", "b") == want


def turns(spark, *xs):
    return spark.createDataFrame([(1, i, r, t, len(t)) for i, (r, t) in enumerate(xs)], "session_id long, seq long, role string, text string, char_count int")


def test_session_score(spark):
    t = turns(spark, ("user", "please build the new parser module now"), ("assistant", "x" * 300), ("user", "no that is bad"), ("assistant", "ok"), ("user", "please build the new parser module again"), ("assistant", "ok"), ("user", "perfect"))
    f = V.turn_features(t)
    got = V.session_score(f, V.uninterrupted_runs(f)).first()
    assert (got.corrections, got.reprompts, got.approvals) == (1, 0, 1)
    assert got.score == 5.6 and got.confidence == 0.5  # 6 - .5 - .3 + .4


def test_runs_end_with_corrections(spark):
    t = turns(spark, *[("assistant", "a")] * 5, ("user", "wrong"), *[("assistant", "a")] * 5, ("user", "go on"), *[("assistant", "a")] * 4)
    assert V.uninterrupted_runs(V.turn_features(t)).first().runs == 1


def test_assertions_need_evidence(spark):
    d = spark.createDataFrame([(1, "You can't run here locally. Fine words follow today. That is all there is."), (2, "You can't run here locally. The output shows a failure. Done with it all.")], "message_id long, text string")
    assert rows(V.assertion_audit(d), "message_id", "has_evidence") == [(1, False)]


def test_task_prefers_an_issue(spark):
    t = turns(spark, ("user", "hello"), ("assistant", "running gh issue view 42"), ("user", "fix the parser in the ship module so that it builds again"))
    assert V.extract_task(t).first().task == "#42"


def test_rule_stats_decay(spark):
    d = spark.createDataFrame([(1, i, DAY + dt.timedelta(days=i), float(i % 10 + 1)) for i in range(25)] + [(1, 99, DAY, 0.0)], "rule_id long, session_id long, ts timestamp, rating double")
    got = R.rule_stats(d).first()
    last = [float(i % 10 + 1) for i in range(5, 25)]
    w = [2 ** (-(19 - k) / 10) for k in range(20)]
    assert got.n == 25 and math.isclose(got.decayed, sum(a * b for a, b in zip(last, w, strict=True)) / sum(w), abs_tol=1e-6)


def test_eviction_boundaries(spark):
    d = spark.createDataFrame([("a", 150, 3.9, 1, 1), ("b", 51, 3.9, 1, 1), ("c", 50, 3.9, 1, 1), ("d", 5, 9.0, 0, 0), ("e", 4, 1.0, 0, 4), ("f", 10, 9.0, 2, 5), ("g", 10, 9.0, 2, 4)], "rule_id string, n long, decayed double, high long, low long")
    assert rows(R.auto_evict(d), "rule_id", "trigger") == [("a", "high-injection-low-value"), ("b", "low-avg-high-volume"), ("d", "never-helped"), ("f", "net-negative-roi")]


def test_budget_boundaries(spark):
    d = spark.createDataFrame([("a", 15), ("b", 16), ("c", 20), ("d", 21), ("e", 999)], "tier string, n long")
    got = dict(rows(R.budget_status(d, {"a": 20, "b": 20, "c": 20, "d": 20, "e": None}), "tier", "status"))
    assert got == {"a": "ok", "b": "warning", "c": "warning", "d": "over", "e": "unbounded"}


def test_recall_at_five(spark):
    ranked = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("xayb z".replace(" ", ""))], "query_id long, item string, rank long")
    gold = spark.createDataFrame([(1, x) for x in "abc"], "query_id long, item string")
    got = R.retrieval_quality(ranked, gold).first()
    assert got.recall_5 == 0.666667 and got.precision_5 == 0.4 and got.rr == 0.5


def test_regression_watermark_can_fall():
    assert R.regression_gate(0.70, 0.74) == (True, 0.70)
    assert R.regression_gate(0.69, 0.74) == (False, 0.74)


def test_conversion_claims_once(spark):
    at = lambda m: DAY + dt.timedelta(minutes=m)
    s = spark.createDataFrame([("k", "s1", at(0), 1), ("k", "s2", at(1), 2)], "skill string, session_id string, ts timestamp, event_id long")
    v = spark.createDataFrame([("k", "s2", at(30), 3)], "skill string, session_id string, ts timestamp, event_id long")
    got = S.skill_conversion(s, v).first()
    assert (got.suggested, got.converted) == (2, 1)


def test_components_and_labels(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (7, 7)], "a long, b long")
    assert rows(components(e), "id", "component") == [(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10)]
    n = spark.createDataFrame([(1, ["x"]), (2, ["x"]), (3, [None]), (4, ["y"]), (5, [None])], "id long, domains array<string>")
    g = spark.createDataFrame([(1, 3, "reinforces", 1.0), (2, 3, "reinforces", 1.0), (3, 5, "reinforces", 1.0), (4, 5, "same_domain", 1.0)], "src long, dst long, relationship string, strength double")
    assert dict(rows(G.propagate_labels(n, g), "id", "domain"))[3] == "x"


def test_leader_groups_grow(spark):
    d = spark.createDataFrame([("b", 1, 1, ["a", "b"]), ("b", 2, 2, ["b", "c"]), ("b", 3, 3, ["c", "d"]), ("b", 4, 4, ["z"])], "block string, ordinal long, id long, tokens array<string>")
    assert rows(G.leader_groups(d, "block", 0.25, True), "leader", "id") == [(1, 1), (1, 2), (1, 3), (4, 4)]


def test_logs(spark, tmp_path):
    (tmp_path / "corrections.jsonl").write_text('{"id":"1","rating":2}\nnot json\n\n{"id":"2","rating":3}\n')
    from pyspark.sql import types as K

    schema = K.StructType([K.StructField("id", K.StringType()), K.StructField("rating", K.DoubleType())])
    assert rows(L.read_log(spark, str(tmp_path), "corrections", schema), "id") == [("1",), ("2",)]
    assert L.read_log(spark, str(tmp_path), "absent", schema).count() == 0
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one.md").write_text("---\nname: a: b\ntype: x\n---\nBody")
    (tmp_path / "r" / "README.md").write_text("no")
    got = L.read_rules(spark, str(tmp_path / "r")).first()
    assert got.id == "one" and got.front == {"name": "a: b", "type": "x"} and got.body == "Body"


def test_transcripts(spark):
    d = spark.createDataFrame(
        [("s", 1, '{"type":"user","message":{"content":"hi"}}'), ("s", 2, '{"type":"assistant","message":{"content":[{"type":"text","text":"a"},{"type":"text","text":"b"},{"type":"tool_use","name":"Edit","input":{"file_path":"/p/x.py"}}]}}'), ("s", 3, "broken")],
        "session_id string, line long, value string",
    )
    assert rows(L.parse_transcript(d), "line", "role", "text") == [(1, "user", "hi"), (2, "assistant", "a b")]
    assert rows(L.tool_blocks(d, "/p/"), "path", "tool", "line") == [("x.py", "Edit", 2)]


def test_audit_round_trip(spark):
    d = spark.createDataFrame([("s", 0, "r1", True), ("s", 1, "r2", False)], "session_id string, place int, rule_id string, relevant boolean")
    assert rows(L.parse_audit(L.audit_markdown(d)), "place", "rule_id", "relevant") == [(0, "r1", True), (1, "r2", False)]


def test_nearest_rating_prefers_the_earlier(spark):
    at = lambda h: DAY + dt.timedelta(hours=h)
    s = spark.createDataFrame([("s", at(24)), ("t", at(100))], "session_id string, ts timestamp")
    r = spark.createDataFrame([(1, at(22), 3.0), (2, at(26), 9.0)], "event_id long, ts timestamp, rating double")
    assert rows(R.nearest_rating(s, r), "session_id", "rating") == [("s", 3.0)]


def test_matching_corrections_by_stem(spark):
    r = spark.createDataFrame([("r", "verify deployment always")], "rule_id string, text string")
    c = spark.createDataFrame([(1, DAY, "you must deploy verified code"), (2, DAY, "nothing alike")], "correction_id long, ts timestamp, text string")
    assert R.matching_corrections(r, c).count() == 1
    assert R.effectiveness(spark.createDataFrame([("r", DAY + dt.timedelta(days=1))], "rule_id string, promoted_at timestamp"), R.matching_corrections(r, c)).select(F.col("effective")).first()[0]


def test_matching_in_time_is_the_greedy_one(spark):
    import random

    from loopwright.operators import gold

    rng = random.Random(3)
    stamp = lambda t: f"2024-01-{1 + t // 86_400:02d} {t % 86_400 // 3600:02d}:{t % 3600 // 60:02d}:{t % 60:02d}"
    for _ in range(4):
        e = [(f"e{i:03d}", rng.randrange(0, 20 * 86_400, 600)) for i in range(70)]
        s = [(f"s{i:03d}", rng.randrange(0, 20 * 86_400, 600)) for i in range(60)]
        free, want = sorted((t, i) for i, t in s), {}
        for t, i in sorted((t, i) for i, t in e):
            best = min(free, key=lambda x: (abs(x[0] - t), x[0], x[1]), default=None)
            if best and abs(best[0] - t) < 7200:
                want[i] = (best[1], float(abs(best[0] - t)))
                free.remove(best)
        side = lambda rows, key: spark.createDataFrame([(i, stamp(t)) for i, t in rows], f"{key} string, ts string").withColumn("ts", F.to_timestamp("ts"))
        got = {r.entry_id: (r.session_id, r.seconds) for r in gold.match_in_time(side(e, "entry_id"), side(s, "session_id")).collect()}
        assert got == want


def test_places_in_groups_come_without_a_window_over_them(spark):
    from loopwright.operators.iterate import ranked

    d = spark.createDataFrame([(None if i % 5 == 0 else f"g{i % 3}", (i * 7919) % 1000) for i in range(300)], "g string, v long")
    got = {(r.g, r.v): r.r for r in ranked(d, "g", "v").collect()}
    for g in {x for x, _ in got}:
        assert [got[k] for k in sorted(k for k in got if k[0] == g)] == list(range(1, 1 + sum(k[0] == g for k in got)))


def test_lists_longer_than_the_hits_are_filled_with_the_first_rules(spark):
    from loopwright.operators import retrieval as T

    rules = spark.createDataFrame([(i, "common words" if i % 4 else f"rare{i} thing") for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "rare8 rare16"), (2, "nothing known"), (3, "common")], "query_id long, text string")
    got = {}
    for r in T.bm25_filter(rules, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score > 0))
    assert got[1] == [(8, True), (16, True), (0, False), (1, False), (2, False)]
    assert got[2] == [(i, False) for i in range(5)] and [i for i, _ in got[3]] == [1, 2, 3, 5, 6]


def test_skill_conversion_in_stretches_matches_one_pass_over_all_events(spark):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(5)
    start = datetime(2026, 1, 1)
    row = lambda i: (i, start + timedelta(minutes=rng.choice((0, 0, 300, 1000)) + rng.randrange(0, 121)), rng.randrange(4), f"s{rng.randrange(2)}")
    sugg, used = [row(i) for i in range(80)], [row(i) for i in range(100, 170)]
    names = ["event_id", "ts", "session_id", "skill"]
    got = {r.skill: (r.suggested, r.converted) for r in S.skill_conversion(spark.createDataFrame(sugg, names), spark.createDataFrame(used, names)).collect()}
    want = {}
    for skill in ("s0", "s1"):
        free = sorted((x for x in used if x[3] == skill), key=lambda x: (x[1], x[0]))
        mine, done = sorted((x for x in sugg if x[3] == skill), key=lambda x: (x[1], x[0])), 0
        for s in mine:
            near = [x for x in free if timedelta(0) <= x[1] - s[1] <= timedelta(minutes=30)]
            if near:
                free.remove(next((x for x in near if x[2] == s[2]), near[0]))
                done += 1
        want[skill] = (len(mine), done)
    assert got == want


def test_dense_claims_in_many_blocks_match_one_pass(spark):
    """One skill, an event every few seconds for days, choices that push each other over the ends of hundreds of blocks."""
    import random
    from datetime import datetime, timedelta

    from loopwright.operators import gold
    from loopwright.operators.matching import first_of_own, match_once, nearest_free

    rng = random.Random(11)
    start = datetime(2026, 1, 1)
    at = lambda: start + timedelta(seconds=rng.randrange(0, 86_400, 20))
    sugg = [(i, at(), f"u{rng.randrange(5)}", "k" if i % 50 else None) for i in range(1500)]
    used = [(i, at(), f"u{rng.randrange(5)}", "k" if i % 50 else None) for i in range(1300)]
    names = "event_id long, ts timestamp, session_id string, skill string"
    a, b = spark.createDataFrame(sugg, names), spark.createDataFrame(used, names)
    side = lambda rows, skill: [(int((x[1] - datetime(1970, 1, 1)).total_seconds()) * 10**6, x[0], x[2]) for x in sorted(rows, key=lambda x: (x[1], x[0])) if x[3] == skill]
    whole = {skill: len(first_of_own(side(sugg, skill), side(used, skill), set(), 1800 * 10**6)) for skill in ("k", None)}
    for rows_per_block in (200_000, 40):
        got = {r.skill: (r.suggested, r.converted) for r in S.skill_conversion(a, b, rows_per_block=rows_per_block).collect()}
        assert got == {skill: (sum(x[3] == skill for x in sugg), n) for skill, n in whole.items()}
    keyed = lambda d: d.select(F.col("skill").alias("key"), F.col("event_id").alias("id"), "ts", F.col("session_id").alias("who"))
    pairs = match_once(keyed(a), keyed(b), 0, 1800 * 10**6, first_of_own, 40).where("key = 'k'").collect()
    assert sorted((r.asker, r.taken) for r in pairs) == sorted(first_of_own(side(sugg, "k"), side(used, "k"), set(), 1800 * 10**6))
    text = lambda rows: sorted((t, str(i), "") for t, i, _ in side([(*x[:3], "k") for x in rows], "k"))
    want = sorted((x, y) for x, y in nearest_free(text(sugg), text(used), set(), 600 * 10**6))
    found = gold.match_in_time(a.withColumnRenamed("event_id", "entry_id"), b.select(F.col("event_id").alias("session_id"), "ts"), 1 / 6, rows_per_block=60)
    assert sorted((r.entry_id, r.session_id) for r in found.collect()) == want
    empty = a.limit(0)
    assert S.skill_conversion(empty, empty).count() == 0


def test_fixed_leaders_in_many_tasks_match_one_pass(spark):
    import random

    rng = random.Random(9)
    data = [(f"b{i % 2}", i, 1000 - i, [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 7))]) for i in range(160)]
    d = spark.createDataFrame(data, "block string, ordinal long, id long, tokens array<string>")
    for least in (0.4, 0.75):
        want, groups = {}, {}
        for block, _, i, tokens in data:
            mine = groups.setdefault(block, [])
            hit = next((x for x, t in mine if tokens and t and sum(w in t for w in tokens) / min(len(tokens), len(t)) >= least), None)
            if hit is None:
                mine.append((i, tokens))
            want[i] = i if hit is None else hit
        for rows_per_task in (50_000, 15):
            got = {r.id: r.leader for r in G.leader_groups(d, "block", least, False, rows_per_task).collect()}
            assert got == want


def test_pairs_of_hot_sessions_come_in_tiles_and_weak_ones_are_not_summed(spark):
    import random

    rng = random.Random(12)
    held = [(i, r, None if i % 7 == 0 else float(1 + i % 10)) for i in range(60) for r in rng.sample(range(40), rng.randrange(0, 9))]
    held += [(100, r, 9.0) for r in range(40)] + [(101, 5, 9.0), (101, 5, 2.0), (101, 999, 3.0)]
    s = spark.createDataFrame(held, "session_id long, rule_id long, rating double")
    n = spark.createDataFrame([(i,) for i in range(40)], "id long")
    rules, best = {}, {}
    for i, r, x in held:
        rules.setdefault(i, set()).update({r} & set(range(40)))
        best[i] = max(best.get(i, 0.0), x or 0.0)
    want = {}
    for i, rs in rules.items():
        w = max(0.3, min(10, max(1, best[i] or 5)) / 10)
        for a in rs:
            for b in rs:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + w
    for k, heavy, tile in ((200, 64, 512), (30, 10, 4), (10, 8, 512)):
        got = {(r.src, r.dst): r.strength for r in G.cooccurrence_edges(s, n, k=k, heavy=heavy, tile=tile).collect()}
        top = sorted(want.items(), key=lambda x: (-math.floor(x[1] / len(rules) * 1e9 + 0.5), x[0]))[:k]
        assert set(got) == {p for p, _ in top} and all(abs(got[p] - w / len(rules)) < 1e-8 for p, w in top)
    pairs = G.pairs_in_sessions(s, "rule_id", tile=4).where("session_id = 100")
    assert pairs.count() == 40 * 39 // 2 == pairs.select("src", "dst").distinct().count()
    # one session of a hundred thousand rules that stand nowhere else: no pair of theirs can be among the best
    hot = spark.range(1000, 101_000).select(F.lit(500).cast("long").alias("session_id"), F.col("id").alias("rule_id"), F.lit(10.0).alias("rating"))
    every = n.union(spark.range(1000, 101_000))
    got = G.cooccurrence_edges(s.union(hot), every, k=10, heavy=64).collect()
    assert {(r.src, r.dst) for r in got} == {p for p, _ in sorted(want.items(), key=lambda x: (-math.floor(x[1] / (len(rules) + 1) * 1e9 + 0.5), x[0]))[:10]}
