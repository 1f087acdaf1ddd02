"""Report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.functions.text import half_up
from loopwright.operators import optimize as O
from loopwright.operators import reports as P
from loopwright.operators import signals as S
from loopwright.plans import bindings as B
from loopwright.plans import q_rules as R
from loopwright.plans import q_signals as Q
from loopwright.plans.bindings import r, sql


def extremes(s: SparkSession, d: str) -> DataFrame:
    return P.extremes(R._stats(s, d))


def health_alerts(s: SparkSession, d: str) -> DataFrame:
    gone = B.table(s, d, "part").where("p_size = 1")
    return P.health_alerts(R._stats(s, d), S.volume_drift(B.events(s, d), Q._now()), gone)


def freshness(s: SparkSession, d: str) -> DataFrame:
    return P.freshness(B.events(s, d).select(F.col("event_type").alias("log"), "ts"), Q._now())


def doctor(s: SparkSession, d: str) -> DataFrame:
    c = R.reconcile(s, d).select(F.lit("reconcile").alias("section"), "status")
    e = S.tool_audit(B.tool_audit(s, d)).select(F.lit("tools").alias("section"), F.when(F.col("flagged"), "warn").otherwise("ok").alias("status"))
    return P.worst_status(c.unionByName(e))


def cross_reference(s: SparkSession, d: str) -> DataFrame:
    a, b, c = (B.table(s, d, t).select(F.col(k).alias("id")) for t, k in (("documents", "doc_id"), ("labels", "doc_id"), ("embeddings", "vec_id")))
    return P.cross_reference(a, b, c)


def taxonomy_balance(s: SparkSession, d: str) -> DataFrame:
    return P.taxonomy_balance(B.nodes(s, d))


def inbox(s: SparkSession, d: str) -> DataFrame:
    part = B.table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("id"), F.col("p_name").alias("rule"), F.col("p_partkey").alias("frequency"))
    return P.inbox(part.where("frequency % 2 = 0"), part.where("frequency % 2 = 1"), F.lit(2)).select("id", "frequency", "tier")


def showcase(s: SparkSession, d: str) -> DataFrame:
    return P.showcase(R._stats(s, d), B.injections(s, d))


def baseline(s: SparkSession, d: str) -> DataFrame:
    x = B.injections(s, d).groupBy("session_id").agg(F.first("ts").alias("ts"), F.first("rating").alias("rating"), F.count(F.lit(1)).alias("load"))
    return P.baseline(x)


def worst_traces(s: SparkSession, d: str) -> DataFrame:
    t = B.table(s, d, "supplier").select(F.col("s_suppkey").alias("trace_id"))
    v = B.table(s, d, "lineitem").where("l_quantity > 25").select(F.col("l_suppkey").alias("trace_id"), (F.col("l_discount") * 50).alias("value"))
    return O.worst_traces(t, v)


def recent_errors(s: SparkSession, d: str) -> DataFrame:
    return P.recent_errors(B.corrections(s, d)).select("error_type", "ts", "n")


def rubric_compose(s: SparkSession, d: str) -> DataFrame:
    x = B.table(s, d, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("ordinal"), F.col("p_retailprice").alias("weight"))
    return O.compose_rubric(x)


def skill_shape(s: SparkSession, d: str) -> DataFrame:
    return O.skill_shape(B.table(s, d, "documents").select(F.col("doc_id").alias("skill"), "text")).select("skill", "words")


def centroid_distance(s: SparkSession, d: str) -> DataFrame:
    """Mean by label of each vector's squared distance to its label's centroid, in one pass of sums."""
    v = B.table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x")).withColumn("x", F.col("x").cast("double"))
    g = v.groupBy("label", "p").agg(F.var_pop("x").alias("v"))
    return g.groupBy(F.col("label").cast("long").alias("label")).agg(half_up(F.sum("v"), 6).alias("spread"))


_AGE = Q._AGE
QUERIES = {
    "status_extremes": (extremes, sql(["inj"], "SELECT 'top' AS side, rule_id, decayed, row_number() OVER (ORDER BY decayed DESC, rule_id) AS rank FROM st WHERE n >= 5 QUALIFY rank <= 5 UNION ALL (SELECT 'bottom', rule_id, decayed, row_number() OVER (ORDER BY decayed, rule_id) AS rank FROM st WHERE n >= 5 QUALIFY rank <= 5)", [R._ST])),
    "health_alerts": (
        health_alerts,
        sql(["inj"], "SELECT 'costly-rules' AS alert, v::DOUBLE AS value, CASE WHEN v > 0 THEN 'red' ELSE 'ok' END AS level FROM (SELECT count(*) FILTER (n > 200 AND decayed < 4) AS v FROM st) UNION ALL SELECT 'volume-drift', drift, CASE WHEN abs(drift) > 0.2 THEN 'red' ELSE 'ok' END FROM dr UNION ALL SELECT 'evictions', count(*)::DOUBLE, CASE WHEN count(*) > 0 THEN 'red' ELSE 'ok' END FROM part WHERE p_size = 1",
        [R._ST, f"dr AS ({Q.QUERIES['volume_drift'][1]})"]),
    ),
    "freshness": (freshness, f"SELECT event_type AS log, count(*) AS n, CASE WHEN {_AGE.replace('(ts)', '(max(ts))')} > 7 THEN 'RED' WHEN {_AGE.replace('(ts)', '(max(ts))')} > 2 THEN 'YELLOW' ELSE 'GREEN' END AS status FROM events GROUP BY 1"),
    "doctor_rollup": (doctor, f"WITH a AS ({R.QUERIES['reconcile'][1]}), b AS ({Q.QUERIES['tool_audit'][1]}) SELECT 'reconcile' AS section, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'ok' END AS status, count(*) AS checks FROM a UNION ALL SELECT 'tools', CASE WHEN bool_or(flagged) THEN 'warn' ELSE 'ok' END, count(*) FROM b"),
    "cross_reference": (cross_reference, "SELECT 'file-without-node' AS check, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'node-without-file', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'registry-without-node', count(*) FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'everywhere', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings)"),
    "taxonomy_balance": (taxonomy_balance, "SELECT domain, n, CASE WHEN n > 50 THEN 'too-many' WHEN n < 3 THEN 'too-few' ELSE 'ok' END AS status FROM (SELECT domain, count(*) AS n FROM (SELECT unnest([lang, source]) AS domain FROM documents) GROUP BY 1)"),
    "inbox": (inbox, f"SELECT id, frequency, CASE WHEN {Q._COUNT('rule', Q.C.BEHAVIOURAL)} > {Q._COUNT('rule', Q.C.PROCEDURAL)} THEN 'global' ELSE 'graph' END AS tier FROM (SELECT 'p' || p_size AS id, p_name AS rule, p_partkey AS frequency, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 2, p_partkey DESC) AS k FROM part) WHERE k = 1"),
    "showcase": (showcase, sql(["inj"], f"SELECT {r('avg((decayed >= 5)::INT)')} AS effective, count(*) AS rules, (SELECT {r('avg(n)')} FROM (SELECT count(*) AS n FROM inj GROUP BY session_id)) AS rules_per_session FROM st", [R._ST])),
    "baseline": (baseline, sql(["inj"], f"SELECT count(*) AS sessions, {r('avg(rating)', 1)} AS rating, {r('avg(load)', 1)} AS load FROM (SELECT session_id, any_value(ts) AS ts, any_value(rating) AS rating, count(*) AS load FROM inj GROUP BY 1 ORDER BY ts DESC, session_id LIMIT 10)")),
    "worst_traces": (worst_traces, f"SELECT s_suppkey AS trace_id, {r('coalesce(m, 2.5)')} AS mean FROM supplier LEFT JOIN (SELECT l_suppkey, avg(l_discount * 50) AS m FROM lineitem WHERE l_quantity > 25 GROUP BY 1) ON l_suppkey = s_suppkey ORDER BY mean, trace_id LIMIT 10"),
    "recent_errors": (recent_errors, sql(["ev", "corr"], "SELECT error_type, max(ts) AS ts, count(*) AS n FROM corr GROUP BY 1 ORDER BY ts DESC, error_type LIMIT 5")),
    "rubric_compose": (rubric_compose, f"SELECT name, {r('w / sum(w) OVER ()')} AS weight FROM (SELECT p_brand AS name, arg_max(p_retailprice, p_partkey) AS w FROM part GROUP BY 1)"),
    "skill_shape": (skill_shape, "SELECT doc_id AS skill, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS words FROM documents"),
    "centroid_spread": (centroid_distance, f"SELECT label::BIGINT AS label, {r('sum(v)')} AS spread FROM (SELECT label, pos, var_pop(x) AS v FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1"),
}
