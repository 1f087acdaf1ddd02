"""Queries over session context, gold sets, learned lists and judged scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.functions.text import half_up
from loopwright.operators import context as C
from loopwright.operators import gold as G
from loopwright.operators import graph
from loopwright.operators import learned as L
from loopwright.operators import retrieval as T
from loopwright.operators import rules as R
from loopwright.operators.iterate import cut
from loopwright.operators.metric import within
from loopwright.plans import bindings as B
from loopwright.plans import q_retrieval as Q
from loopwright.plans import q_rules as QR
from loopwright.plans.bindings import BM25, r, sql
from loopwright.sources import logs
from loopwright.streaming import streams as S

PREFIXES = ("feedback", "success", "project", "reference", "other")
TYPES = ("feedback", "project", None, "learned")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _pick(values: tuple, by: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _id(doc: str) -> F.Column:
    return F.concat(_pick(PREFIXES, F.col(doc)), F.lit("_"), F.col(doc).cast("string"))


def _store(s: SparkSession, d: str) -> DataFrame:
    o = B.table(s, d, "orders").select(F.concat(F.lit("traj_"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_totalprice").alias("rating"), F.col("o_orderdate").alias("ts"), F.array("o_orderpriority", "o_orderstatus").alias("domains"))
    return R.trajectories(o)


def _asked(s: SparkSession, d: str) -> DataFrame:
    return B.queries(s, d).select("query_id", F.array(_pick(PRIORITIES, F.col("query_id")), F.lit("F")).alias("domains"))


def trajectory_query(s: SparkSession, d: str) -> DataFrame:
    return C.query_trajectories(_store(s, d), _asked(s, d), 5)


def context_rules(s: SparkSession, d: str) -> DataFrame:
    named = lambda x, c="rule_id": x.select(_id(c).alias("rule_id"), *[y for y in x.columns if y != c])
    cand = T.hybrid_retrieve(Q._lists(s, d), Q.WEIGHTS, 30).select("query_id", _id("item").alias("id"), "score")
    nodes = B.nodes(s, d).select(_id("id").alias("id"), _pick(TYPES, F.col("id")).alias("type"), "domains")
    lifts = named(R.differential_lift(QR._stats(s, d), B.injections(s, d)))
    gone = named(R.lifecycle_state(QR._log(s, d), QR.VALID).where("state = 'F'").select("rule_id"))
    evicted = named(R.auto_evict(QR._stats(s, d)).select("rule_id"))
    return C.context_rules(cand, cand.limit(0), nodes, lifts, gone, evicted, C.query_trajectories(_store(s, d), _asked(s, d), 10), 10)


def detect_domains(s: SparkSession, d: str) -> DataFrame:
    """Brands as domains with the words of their part names, part types with a size as queries."""
    p = B.table(s, d, "part")
    words = p.select(F.col("p_brand").alias("domain"), F.explode(F.split("p_name", " ")).alias("w")).distinct()
    seeds = words.groupBy("domain").agg(F.array_join(F.sort_array(F.collect_set("w")), " ").alias("text"))
    q = p.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    return C.detect_domains(q, seeds).select("query_id", "domain", F.col("rank").cast("long").alias("rank"), half_up(F.col("score"), 6).alias("score"))


def precision_compare(s: SparkSession, d: str) -> DataFrame:
    lists = Q._lists(s, d)
    return C.compare_precision(lists["bm25"], lists["vector"], QR._gold(s, d))


def primary_targets(s: SparkSession, d: str) -> DataFrame:
    return G.select_targets(B.nodes(s, d), 3, 10)


def codomain_siblings(s: SparkSession, d: str) -> DataFrame:
    return G.siblings(primary_targets(s, d), B.nodes(s, d), 2)


def target_distractors(s: SparkSession, d: str) -> DataFrame:
    return G.distractors(primary_targets(s, d), B.nodes(s, d))


def _used(s: SparkSession, d: str) -> DataFrame:
    return B.nodes(s, d).where("id % 3 <> 0").select("id", (F.col("id") % 11).alias("n"))


def _by_source(s: SparkSession, d: str) -> DataFrame:
    return B.queries(s, d).select("query_id", F.array(F.concat(F.lit("src"), F.col("query_id") % 20)).alias("domains"))


def gold_fallback(s: SparkSession, d: str) -> DataFrame:
    return G.domain_fallback(_by_source(s, d), B.nodes(s, d), _used(s, d))


def auto_label(s: SparkSession, d: str) -> DataFrame:
    """The ten best hits of each passage as what a classifier named."""
    named = T.bm25_search(B.table(s, d, "documents"), B.queries(s, d), 10).select("query_id", F.col("doc_id").alias("id"))
    return G.auto_label(named, _by_source(s, d), B.nodes(s, d), _used(s, d))


def leakage_filter(s: SparkSession, d: str) -> DataFrame:
    """User turns as generated texts, the turn before as their rule."""
    from pyspark.sql import Window as W

    t = B.turns(s, d).withColumn("rule", F.lag("text").over(W.partitionBy("session_id").orderBy("seq"))).where("rule is not null and role = 'user'")
    return t.select("session_id", "seq", G.leakage(120, 0.12).alias("outcome"))


def recall_bootstrap(s: SparkSession, d: str) -> DataFrame:
    """Errors as history entries, sessions of clicks by their first click."""
    e = B.corrections(s, d).select(F.col("event_id").alias("entry_id"), "ts")
    return G.match_in_time(e, B.invocations(s, d).groupBy("session_id").agg(F.min("ts").alias("ts")))


def _answers(s: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    t = F.concat(F.lit('Here: {"clarity": '), n.cast("string"), F.lit(', "tone": {"value": '), (n + 2).cast("string"), F.lit(', "reason": "so"}, "x": "none"} done'))
    return B.table(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("trace_id"), t.alias("text")).distinct()


def judge_scores(s: SparkSession, d: str) -> DataFrame:
    return G.judged(_answers(s, d))


def transcript_quality(s: SparkSession, d: str) -> DataFrame:
    t = B.turns(s, d).groupBy("session_id").agg(F.sum("char_count").alias("n"))
    o = F.when(F.col("session_id") % 2 == 0, F.concat(F.lit(', "overall": '), (F.col("n") % 50 / 10).cast("string"))).otherwise(F.lit(""))
    text = F.concat(F.lit('{"task_completion": '), (F.col("n") % 7).cast("string"), F.lit(', "coherence": '), (F.col("n") % 5).cast("string"), o, F.lit("}"))
    return G.transcript_quality(t.select("session_id", text.alias("text")))


def lesson_sessions(s: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("note "), F.col("event_id").cast("string")))
    return G.lesson_sessions(B.ratings(s, d).withColumn("comment", c))


# the parts as a learned list: each a document with one item; larger ones have statistics under an id of their own
def _name() -> F.Column:
    return F.concat_ws(" ", "p_name", "p_partkey")


def _entries(s: SparkSession, d: str) -> DataFrame:
    day = F.format_string("1998-%02d-%02d", (F.col("p_partkey") % 9 + 1).cast("int"), (F.col("p_partkey") % 28 + 1).cast("int"))
    item = F.concat(F.lit("# Learned\n\n- **"), _name(), F.lit(" (from run "), day, F.lit("):** keep it\n"))
    e = T.learned_rules(B.table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), item.alias("text")))
    return e.select(F.col("rule_id").alias("name"), F.col("doc_id").alias("place"), "dated")


def _named(s: SparkSession, d: str) -> DataFrame:
    p = B.table(s, d, "part")
    rule = F.when(F.col("p_size") > 40, _name()).when(F.col("p_size") > 10, F.concat(F.lit("feedback_"), F.replace(_name(), F.lit(" "), F.lit("_")))).otherwise(F.concat(F.lit("lone "), "p_partkey"))
    return QR._dated(s, d).join(p.select(F.col("p_partkey").alias("rule_id"), rule.alias("new")), "rule_id").withColumn("rule_id", F.col("new")).drop("new")


def learned_candidates(s: SparkSession, d: str) -> DataFrame:
    """Of the statistics only those of rules with an odd number of injections count as chosen before."""
    st = _named(s, d)
    now = QR._now(s, d)
    e = _entries(s, d).join(F.broadcast(now)).drop("as_of")
    as_of = F.lit(now.first()[0])
    return L.learned_candidates(e, st.drop("as_of"), st.where("n % 2 = 1").select("rule_id"), as_of)


def learned_prune(s: SparkSession, d: str) -> DataFrame:
    e = _entries(s, d)
    return L.prune_learned(e, _named(s, d), B.table(s, d, "part").where("p_size <= 45").count())


def _critical(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("# Rules\n### Critical Rules\n- **"), _name(), F.lit(" (from x 2020-01-01):** always\n- no rule\n## Others\n- **other "), _name(), F.lit(":** never\n"))
    return L.critical_names(B.table(s, d, "part").where("p_size % 2 = 0").select(text.alias("text")))


def critical_candidates(s: SparkSession, d: str) -> DataFrame:
    return L.critical_candidates(_critical(s, d), _named(s, d), F.col("as_of"))


def evict_apply(s: SparkSession, d: str) -> DataFrame:
    p = B.table(s, d, "part")
    c = QR.eviction_candidates(s, d).join(p.select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") < 5).alias("human")), "rule_id")
    return L.apply_evictions(c, p.where("p_size > 20").select(F.col("p_partkey").alias("rule_id")), p.where("p_size > 45").select(F.col("p_partkey").alias("rule_id")))


def prune_to_budget(s: SparkSession, d: str) -> DataFrame:
    listed = B.table(s, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_partkey").alias("place"))
    return L.prune_to_budget(QR.eviction_rank(s, d), listed, 107, 100)


def graduated(s: SparkSession, d: str) -> DataFrame:
    p = B.table(s, d, "part")
    names = p.where("p_size = 7").select(_name().alias("name"))
    stats = p.where("p_size <> 7").select(_name().alias("rule_id"))
    return L.graduated(names, stats, p.where("p_size > 45").select(_name().alias("rule_id")))


def backfill_learned(s: SparkSession, d: str) -> DataFrame:
    p = B.table(s, d, "part")
    return L.backfill(p.where("p_size = 9").select(_name().alias("name")), p.where("p_size > 12").select(_name().alias("id")))


def fuzzy_names(s: SparkSession, d: str) -> DataFrame:
    p = B.table(s, d, "part")
    return L.fuzzy_names(p.groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.concat(F.lit("the "), "p_name").alias("text")), p.select(_name().alias("name")))


def gap_patterns(s: SparkSession, d: str) -> DataFrame:
    block = lambda known: F.concat(F.lit("### Pattern 1: "), "p_name", F.lit("!\n**Existing feedback memory:** "), known, F.lit("\n**Common theme:** it is\n"), "p_type", F.lit("\n\n**Suggested rule:** take "), "p_brand", F.lit("\n---\n"))
    t = F.when(F.col("p_partkey") % 2 == 0, block(F.lit("NONE — NEW GAP"))).otherwise(block(F.lit("yes")))
    p = B.table(s, d, "part")
    return L.gap_patterns(p.select(F.col("p_partkey").alias("report_id"), t.alias("text")), p.where("p_partkey = 1").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug")))


def rules_by_domain(s: SparkSession, d: str) -> DataFrame:
    return L.by_domain(B.nodes(s, d))


def tier_counts(s: SparkSession, d: str) -> DataFrame:
    return L.tier_counts(B.nodes(s, d).select(F.when(F.col("severity") > 3, "universal").otherwise("graph").alias("tier"), "domains"))


def pattern_diff(s: SparkSession, d: str) -> DataFrame:
    """The fifteen best terms of each language against its five best and a word of its own."""
    m = cut(Q.tfidf_terms(s, d))
    seeds = m.where("rank <= 5").select("domain", "term").union(m.select("domain", F.concat(F.lit("Seed "), "domain")).distinct())
    return L.pattern_diff(m, seeds)


def near_dup_vectors(s: SparkSession, d: str) -> DataFrame:
    """Clusters of vectors joined by all pairs of .45 cosine or more."""
    v = B.table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "embedding")
    return graph.near_duplicate_clusters(cut(within(v, 0.45)))


def verify_benchmark(s: SparkSession, d: str) -> DataFrame:
    """Whether a stored hash is still that of its task; every third is not."""
    e = B.events(s, d).select(F.col("event_id").cast("string").alias("task_description"), (F.col("value") / 50).alias("implied_sentiment"))
    stored = logs.benchmark_tasks(e).select("task_description", F.when(F.col("task_description").cast("bigint") % 3 == 0, F.lit("old")).otherwise(F.col("task_id")).alias("task_id"))
    return logs.verify_tasks(stored)


def stream_sliding(s: SparkSession, d: str) -> DataFrame:
    e = S.read_table(s, d, "events", B.table(s, d, "events").schema).where("event_type = 'purchase'")
    w = S.to_table(S.sliding(e, "value"), "complete")
    return w.select(F.date_format("until", "yyyy-MM-dd").alias("until"), "n", half_up(F.col("mean"), 6).alias("mean"))


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    e = S.read_table(s, d, "events", B.table(s, d, "events").schema)
    return S.to_table(S.sessions(e, "user_id"), "complete").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


_NID = "(['feedback', 'success', 'project', 'reference', 'other'])[{0} % 5 + 1] || '_' || {0}"
_STORE = "store AS (SELECT 'traj_' || o_orderkey AS id, o_totalprice AS rating, o_orderpriority AS p, o_orderstatus AS s FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, 'traj_' || o_orderkey LIMIT 100)"
_TRAJ = "tj AS (SELECT query_id, id, rating, row_number() OVER (PARTITION BY query_id ORDER BY floor(j * 1e9 + 0.5::DOUBLE) DESC, rating DESC, id) AS place FROM (SELECT item_id AS query_id, id, rating, k / (4 - k)::DOUBLE AS j FROM (SELECT item_id, id, rating, (p = (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[item_id % 5 + 1])::INT + (s = 'F')::INT AS k FROM benchmark, store) WHERE k > 0))"
_CONTEXT = [
    QR._ST, Q._LISTS, _STORE, _TRAJ,
    f"cand AS (SELECT query_id, item, score FROM fused QUALIFY {Q._TOP} <= 30)",
    f"lift AS (SELECT rule_id, {r('mean - (SELECT avg(rating) FROM inj)', 3)} AS lift FROM st)",
    f"sc AS (SELECT query_id, item, {_NID.format('item')} AS id, lang AS domain, item % 4 AS ty, score * ([1.0::DOUBLE, 0.8::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE])[item % 5 + 1] * (1 + coalesce(lift, 0) / 10) AS score FROM cand JOIN documents ON doc_id = item LEFT JOIN lift ON rule_id = item)",
    "y AS (SELECT *, (SELECT count(DISTINCT domain) FROM sc z WHERE z.query_id = sc.query_id) AS nd, row_number() OVER (PARTITION BY query_id, domain ORDER BY floor(score * 1e9 + 0.5::DOUBLE) DESC, id) AS rd FROM sc)",
    "tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5::DOUBLE) DESC, id) AS rank FROM y WHERE rd <= ceil(10.0::DOUBLE / greatest(nd, 1))) WHERE rank <= 10)",
    "lg AS (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'F', 'P') GROUP BY 1 HAVING arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'F')",
    "rl AS (SELECT query_id, id AS rule_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM tp WHERE ty <> 1 AND item NOT IN (SELECT o_custkey FROM lg) AND item NOT IN (SELECT rule_id FROM st WHERE " + QR._TRIG + " IS NOT NULL))",
    "hl AS (SELECT item_id AS query_id, (SELECT count(*) FROM rl WHERE rl.query_id = item_id) AS n FROM benchmark)",
]
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: length(t) >= 2))"
_PN = "p_name || ' ' || p_partkey"
_NST = f"ns AS (SELECT p_partkey, p_size, {_PN} AS name, st.n, decayed, last_seen FROM st JOIN part ON p_partkey = rule_id)"
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-+', '-', 'g'), '-')"

#: One entry a step, in order of time, with the sessions that are taken so far.
_BOOTSTRAP = B.sql(["ev", "inv", "corr"], """SELECT entry_id, session_id, abs(epoch_us(ets) - epoch_us(ts)) / 1e6::DOUBLE AS seconds FROM steps JOIN firsts ON session_id = pick""", [
    "firsts AS (SELECT session_id, min(ts) AS ts FROM inv GROUP BY 1)",
    "asked AS (SELECT event_id::VARCHAR AS entry_id, ts, row_number() OVER (ORDER BY ts, event_id::VARCHAR) AS i FROM corr)",
    """steps AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, NULL::VARCHAR AS pick, NULL::VARCHAR AS entry_id, NULL::TIMESTAMP AS ets UNION ALL
SELECT i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick, entry_id, ets FROM (SELECT a.i, any_value(s.used) AS used, arg_min(f.session_id, (abs(epoch_us(f.ts) - epoch_us(a.ts)), f.ts, f.session_id)) AS pick, any_value(a.entry_id) AS entry_id, any_value(a.ts) AS ets
FROM steps s JOIN asked a ON a.i = s.i + 1 LEFT JOIN firsts f ON f.ts > a.ts - INTERVAL 2 HOUR AND f.ts < a.ts + INTERVAL 2 HOUR AND NOT list_contains(s.used, f.session_id) GROUP BY a.i))""",
]).replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {
    "context_rules": (context_rules, sql([*BM25, "inj"], f"SELECT query_id, rule_id, {r('score', 9)} AS score, place, 'rule' AS kind FROM rl UNION ALL SELECT query_id, id, {r('rating / 10', 9)}, n + row_number() OVER (PARTITION BY query_id ORDER BY place), 'trajectory' FROM tj JOIN hl USING (query_id) WHERE place <= 10 - n AND id NOT IN (SELECT rule_id FROM rl WHERE rl.query_id = tj.query_id)", _CONTEXT)),
    "trajectory_query": (trajectory_query, "WITH " + _STORE + ", " + _TRAJ + " SELECT query_id, id, rating, place FROM tj WHERE place <= 5"),
    "detect_domains": (
        detect_domains,
        "WITH d AS (SELECT p_brand AS domain, list_distinct(flatten(list(string_split(p_name, ' ')))) AS t FROM part GROUP BY 1), p AS (SELECT domain, len(t) AS len, unnest(t) AS term FROM d), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d), "
        "v AS (SELECT term, ln((any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM p, st GROUP BY 1), q AS (SELECT p_partkey AS query_id, term, count(*) AS times FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part) GROUP BY 1, 2), "
        "b AS (SELECT query_id, domain, sum(times * idf * 2.5::DOUBLE / (1 + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))) AS score FROM q JOIN p USING (term) JOIN v USING (term), st GROUP BY 1, 2) "
        f"SELECT query_id, domain, rank, {r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5::DOUBLE) DESC, domain) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM b) WHERE rank <= 3 AND score >= 0.3::DOUBLE * best",
    ),
    "precision_compare": (
        precision_compare,
        sql(BM25, "SELECT query_id, coalesce(one_5, 0) AS one_5, coalesce(two_5, 0) AS two_5, coalesce(one_10, 0) AS one_10, coalesce(two_10, 0) AS two_10, " + ", ".join(f"{r(f'coalesce(two_{k}, 0) - coalesce(one_{k}, 0)')} AS delta_{k}" for k in (5, 10)) + " FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)",
        [Q._LISTS, QR._GOLD, *[f"{n} AS (SELECT query_id, {r('count(*) FILTER (rank <= 5) / 5.0::DOUBLE')} AS {m}_5, {r('count(*) FILTER (rank <= 10) / 10.0::DOUBLE')} AS {m}_10 FROM (SELECT DISTINCT query_id, item, rank FROM lists WHERE l = '{l}') JOIN (SELECT DISTINCT query_id, item FROM gold) USING (query_id, item) GROUP BY 1)" for n, m, l in (("a", "one", "bm25"), ("b", "two", "vector"))]]),
    ),
    "primary_targets": (primary_targets, "SELECT id, domain, place FROM (SELECT doc_id AS id, coalesce(lang, 'unknown') AS domain, row_number() OVER (PARTITION BY coalesce(lang, 'unknown') ORDER BY 1 + doc_id % 5 DESC, doc_id) AS place FROM documents) WHERE place <= 3 ORDER BY domain, place LIMIT 10"),
    "target_distractors": (
        target_distractors,
        "WITH n AS (SELECT doc_id AS id, coalesce(lang, 'unknown') AS domain FROM documents), t AS (SELECT id, domain FROM (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY 1 + id % 5 DESC, id) AS place FROM n) WHERE place <= 3 ORDER BY domain, place LIMIT 10) SELECT t.id AS target, n.id, row_number() OVER (PARTITION BY t.id ORDER BY md5('5:' || n.id), n.id) AS place FROM t JOIN n ON n.domain <> t.domain QUALIFY place <= 3",
    ),
    "codomain_siblings": (
        codomain_siblings,
        "WITH t AS (SELECT id, lang, source FROM (SELECT doc_id AS id, lang, source, coalesce(lang, 'unknown') AS domain, row_number() OVER (PARTITION BY coalesce(lang, 'unknown') ORDER BY 1 + doc_id % 5 DESC, doc_id) AS place FROM documents) WHERE place <= 3 ORDER BY domain, place LIMIT 10) SELECT t.id AS target, d.doc_id AS id, 2::BIGINT AS shared FROM t JOIN documents d ON d.lang = t.lang AND d.source = t.source AND d.doc_id <> t.id",
    ),
    "gold_fallback": (gold_fallback, "SELECT item_id AS query_id, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN doc_id % 3 <> 0 THEN doc_id % 11 ELSE 0 END, doc_id) AS place FROM benchmark JOIN documents ON source = 'src' || (item_id % 20) QUALIFY place <= 25"),
    "auto_label": (
        auto_label,
        sql(BM25, "SELECT query_id, id, place, 'named' AS kind FROM nm UNION ALL SELECT query_id, id, place, 'domain' FROM fb WHERE query_id NOT IN (SELECT query_id FROM nm) AND place <= 5",
        ["nm AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_id % 3 <> 0 THEN doc_id % 11 ELSE 0 END, doc_id) AS place FROM bmr JOIN documents USING (doc_id) WHERE rank <= 10 AND source = 'src' || (query_id % 20) QUALIFY place <= 5)",
         "fb AS (SELECT item_id AS query_id, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN doc_id % 3 <> 0 THEN doc_id % 11 ELSE 0 END, doc_id) AS place FROM benchmark JOIN documents ON source = 'src' || (item_id % 20))"]),
    ),
    "leakage_filter": (
        leakage_filter,
        sql(["turns"], "SELECT session_id, seq, CASE WHEN length(text) < 120 THEN 'too-short' WHEN coalesce(len(list_intersect(x, y)) / nullif(len(x) + len(y) - len(list_intersect(x, y)), 0)::DOUBLE, 0) > 0.12::DOUBLE THEN 'leakage' ELSE 'kept' END AS outcome FROM "
        f"(SELECT session_id, seq, text, {_WORDS.format('text')} AS x, {_WORDS.format('b')} AS y FROM (SELECT *, lag(text) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM turns) WHERE b IS NOT NULL AND role = 'user')"),
    ),
    "recall_bootstrap": (recall_bootstrap, _BOOTSTRAP),
    "judge_scores": (judge_scores, "WITH z AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS trace_id, l_linenumber AS n FROM lineitem) SELECT trace_id, 'clarity' AS dimension, n::DOUBLE AS score, '' AS reasoning FROM z WHERE n BETWEEN 1 AND 5 UNION ALL SELECT trace_id, 'tone', (n + 2)::DOUBLE, 'so' FROM z WHERE n + 2 BETWEEN 1 AND 5"),
    "transcript_quality": (
        transcript_quality,
        sql(["turns"], f"SELECT session_id, a + b AS n_dimensions, {r('CASE WHEN session_id % 2 = 0 THEN n % 50 / 10.0::DOUBLE WHEN a + b > 0 THEN (a * (n % 7) + b * (n % 5)) / (a + b)::DOUBLE ELSE 0 END', 1)} AS overall FROM (SELECT session_id, n, (n % 7 BETWEEN 1 AND 5)::BIGINT AS a, (n % 5 BETWEEN 1 AND 5)::BIGINT AS b FROM (SELECT session_id, sum(char_count)::BIGINT AS n FROM turns GROUP BY 1))"),
    ),
    "lesson_sessions": (
        lesson_sessions,
        sql(["ev", "ratings"], f"SELECT session_id, CASE WHEN a <= 4 THEN 'feedback' ELSE 'success' END AS kind, {r('a')} AS avg_rating, c AS comments FROM (SELECT session_id, avg(rating) AS a, string_agg('note ' || event_id, chr(10) ORDER BY ts, event_id) FILTER (event_id % 3 <> 0) AS c FROM ratings GROUP BY 1) WHERE c IS NOT NULL AND (a <= 4 OR a >= 8)"),
    ),
    "learned_candidates": (
        learned_candidates,
        sql(["inj"], "SELECT name AS rule_id, reason, decayed FROM (SELECT name, decayed, n, CASE WHEN "
        f"{QR._STALE} THEN 'stale-learned' WHEN n >= 5 AND decayed < 3 THEN 'low-learned' END AS reason FROM ns WHERE p_size > 10 AND n % 2 = 0) WHERE reason IS NOT NULL UNION ALL "
        f"SELECT {_PN}, 'untracked', 0.0::DOUBLE FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM ns WHERE p_size > 10) AND (epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(make_timestamp(1998, p_partkey % 9 + 1, p_partkey % 28 + 1, 0, 0, 0.0))) / 86400000000.0::DOUBLE > 60",
        [QR._ST, _NST]),
    ),
    "learned_prune": (
        learned_prune,
        sql(["inj"], "SELECT name, score FROM (SELECT p.p_partkey, p.p_name || ' ' || p.p_partkey AS name, coalesce(ns.decayed, 0) AS score FROM part p LEFT JOIN ns ON ns.p_partkey = p.p_partkey AND p.p_size > 10) QUALIFY row_number() OVER (ORDER BY score, p_partkey) <= (SELECT count(*) FROM part WHERE p_size > 45)", [QR._ST, _NST]),
    ),
    "critical_candidates": (
        critical_candidates,
        sql(["inj"], f"SELECT name AS rule_id, reason, decayed, true AS human FROM (SELECT *, CASE WHEN {QR._STALE} THEN 'critical-stale' WHEN decayed < 3 THEN 'critical-low-correlation' WHEN n >= 10 AND decayed < 4 THEN 'critical-below-quality-floor' END AS reason FROM ns WHERE p_size > 10 AND p_size % 2 = 0 AND n >= 5) WHERE reason IS NOT NULL", [QR._ST, _NST]),
    ),
    "evict_apply": (
        evict_apply,
        sql(["inj"], f"SELECT rule_id, CASE WHEN p_size < 5 THEN 'skipped' WHEN p_size > 45 THEN 'demoted' WHEN p_size > 20 THEN 'evicted' ELSE 'not-found' END AS status FROM st JOIN part ON p_partkey = rule_id WHERE {QR._STALE} OR n >= 5 AND decayed < 3 OR n >= 10 AND decayed < 4", [QR._ST]),
    ),
    "prune_to_budget": (prune_to_budget, sql(["inj"], f"SELECT rule_id FROM (SELECT *, {QR._STALE} AS stale FROM st WHERE n > 5) ORDER BY stale DESC, decayed, low DESC, n DESC, rule_id LIMIT 7", [QR._ST])),
    "graduated": (graduated, f"SELECT a.name, min(b.name) AS rule_id FROM (SELECT {_PN} AS name, {_NORM.format(_PN)} AS k FROM part WHERE p_size = 7) a JOIN (SELECT {_PN} AS name, {_NORM.format(_PN)} AS k FROM part WHERE p_size <> 7 AND p_size <= 45) b ON contains(a.k, b.k) OR contains(b.k, a.k) GROUP BY 1"),
    "backfill_learned": (backfill_learned, f"SELECT name, k AS rule_id, 5.0::DOUBLE AS avg FROM (SELECT {_PN} AS name, {_NORM.format(_PN)} AS k FROM part WHERE p_size = 9) e WHERE NOT EXISTS (SELECT 1 FROM (SELECT {_NORM.format(_PN)} AS f FROM part WHERE p_size > 12) WHERE contains(e.k, f) OR contains(f, e.k))"),
    "fuzzy_names": (
        fuzzy_names,
        f"WITH n AS (SELECT min(p_partkey) AS id, list_filter(string_split(p_name, ' '), lambda w: length(w) > 3) AS w FROM part GROUP BY p_name) SELECT name, min(id) AS id FROM (SELECT {_PN} AS name FROM part) JOIN n ON len(w) > 0 AND len(list_filter(w, lambda x: contains(name, x))) / len(w)::DOUBLE > 0.6 GROUP BY 1",
    ),
    "gap_patterns": (
        gap_patterns,
        "SELECT min(p_partkey) AS report_id, p_name || '!' AS name, replace(p_name, ' ', '-') AS slug, arg_min('it is ' || p_type, p_partkey) AS theme, arg_min('take ' || p_brand, p_partkey) AS rule FROM part WHERE p_partkey % 2 = 0 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey = 1) GROUP BY p_name",
    ),
    "rules_by_domain": (rules_by_domain, "SELECT domain, count(*) OVER (PARTITION BY domain) AS n, id, row_number() OVER (PARTITION BY domain ORDER BY id) AS place FROM (SELECT doc_id AS id, unnest([lang, source]) AS domain FROM documents) QUALIFY place <= 5"),
    "tier_counts": (tier_counts, "WITH t AS (SELECT CASE WHEN 1 + doc_id % 5 > 3 THEN 'universal' ELSE 'graph' END AS tier, lang, source FROM documents) SELECT tier, NULL::VARCHAR AS domain, count(*) AS n FROM t GROUP BY 1 UNION ALL SELECT tier, d, count(*) FROM (SELECT tier, unnest([lang, source]) AS d FROM t WHERE tier = 'graph') GROUP BY 1, 2"),
    "pattern_diff": (pattern_diff, f"WITH m AS ({Q.QUERIES['tfidf_terms'][1]}) SELECT domain, term, 'added' AS side FROM m WHERE rank > 5 UNION ALL SELECT DISTINCT domain, 'seed ' || domain, 'removed' FROM m"),
    "near_dup_vectors": (
        near_dup_vectors,
        f"WITH RECURSIVE {Q._PAIRS}, e AS (SELECT least(query_id, item) AS a, greatest(query_id, item) AS b, max(sim) AS sim FROM nn WHERE sim >= 0.45::DOUBLE GROUP BY 1, 2), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT DISTINCT a AS id, a AS m FROM u UNION SELECT u.b, reach.m FROM reach JOIN u ON u.a = reach.id), c AS (SELECT id, min(m) AS component FROM reach GROUP BY 1) "
        f"SELECT component, count(*) AS size, (SELECT {r('max(sim)')} FROM e JOIN c c2 ON e.a = c2.id WHERE c2.component = c.component) AS best FROM c GROUP BY component",
    ),
    "verify_benchmark": (verify_benchmark, "SELECT event_id::VARCHAR AS task_description, event_id % 3 <> 0 AS ok FROM events WHERE value / 50 >= 7"),
    "stream_sliding": (
        stream_sliding,
        f"SELECT strftime(u, '%Y-%m-%d') AS until, count(*) AS n, {r('avg(value)')} AS mean FROM (SELECT date_trunc('day', ts) + to_days(CAST(i AS INT)) AS u, value FROM events, range(1, 8) t(i) WHERE event_type = 'purchase') GROUP BY 1",
    ),
    "stream_sessions": (
        stream_sessions,
        "SELECT user_id, min(epoch_us(ts)) AS start, max(epoch_us(ts)) + 1800000000 AS \"end\", count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, (coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES, true))::INT AS new FROM events)) GROUP BY user_id, g",
    ),
}
