"""Graph, clustering, source and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.functions.text import half_up, tok_fail, tok_review
from loopwright.operators import graph as G
from loopwright.operators import retrieval as T
from loopwright.plans import bindings as B
from loopwright.plans import q_retrieval as Q
from loopwright.plans import q_signals as QS
from loopwright.plans.bindings import BM25, r, sql
from loopwright.operators.iterate import cut, shared_folder
from loopwright.sources import logs as L
from loopwright.streaming import state
from loopwright.streaming import streams as S


def _folder(s: SparkSession, name: str) -> str:
    cut(s.range(1))  # sets the folder where the session has none
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _edges(s: SparkSession, d: str) -> DataFrame:
    """Same-domain edges of documents and nearest-vector edges."""
    near = Q.knn_edges(s, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("reinforces").alias("relationship"), "strength", F.lit("embedding").alias("source"))
    return G.same_domain_edges(B.nodes(s, d)).unionByName(near)


def _wanted(s: SparkSession, d: str) -> DataFrame:
    q = B.queries(s, d).select("query_id", F.array(F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("query_id") % 4 + 1).cast("int")), F.concat(F.lit("src"), F.col("query_id") % 20)).alias("domains"))
    return q


def same_domain_edges(s: SparkSession, d: str) -> DataFrame:
    return G.same_domain_edges(B.nodes(s, d))


def cooccurrence_edges(s: SparkSession, d: str) -> DataFrame:
    return G.cooccurrence_edges(B.injections(s, d), B.table(s, d, "part").select(F.col("p_partkey").alias("id"))).select("src", "dst", "strength")


def node_scores(s: SparkSession, d: str) -> DataFrame:
    return G.node_scores(B.nodes(s, d), _edges(s, d), _wanted(s, d))


def one_hop_expand(s: SparkSession, d: str) -> DataFrame:
    seeds = T.bm25_search(B.table(s, d, "documents"), B.queries(s, d), 5).select("query_id", F.col("doc_id").alias("id"))
    return G.expand_one_hop(seeds, _edges(s, d), 0.3).select("query_id", "id", F.col("hop").cast("long").alias("hop"))


def graph_report(s: SparkSession, d: str) -> DataFrame:
    return G.graph_report(B.nodes(s, d), _edges(s, d), 60)


def drift(s: SparkSession, d: str) -> DataFrame:
    """Documents without a vector and vectors without a document."""
    return G.drift(B.nodes(s, d).select("id"), B.table(s, d, "embeddings").select(F.col("vec_id").alias("id")))


def label_propagation(s: SparkSession, d: str) -> DataFrame:
    """Every third vector keeps its label, the others learn it over nearest-vector edges."""
    n = B.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 == 0, F.array(F.col("label").cast("string"))).otherwise(F.array().cast("array<string>")).alias("domains"))
    n = n.select("id", F.when(F.size("domains") > 0, F.col("domains")).otherwise(F.array(F.lit(None).cast("string"))).alias("domains"))
    e = Q.knn_edges(s, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("reinforces").alias("relationship"), "strength", F.lit("embedding").alias("source"))
    return G.propagate_labels(n, e).select("id", "domain", "source")


def near_dup_clusters(s: SparkSession, d: str) -> DataFrame:
    classes, near = T.lexical_classes(B.table(s, d, "documents"))
    return G.near_duplicate_clusters(near, classes)


def graph_query(s: SparkSession, d: str) -> DataFrame:
    return G.graph_query(B.nodes(s, d), _edges(s, d), _wanted(s, d))


def knn_label(s: SparkSession, d: str) -> DataFrame:
    top = T.bm25_search(B.table(s, d, "documents"), B.queries(s, d), 3).select("query_id", F.col("doc_id").alias("item"))
    return G.majority_label(top, B.table(s, d, "documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("domain")))


def target_nodes(s: SparkSession, d: str) -> DataFrame:
    return G.targets_by_domain(B.nodes(s, d)).select("domain", "id", F.col("rank").cast("long").alias("rank"))


def edge_weights(s: SparkSession, d: str) -> DataFrame:
    e = cooccurrence_edges(s, d).withColumns({"relationship": F.lit("co_occurred"), "source": F.lit("session")})
    return G.adjust_edges(e, B.table(s, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("rule_id")), 8.0).select("src", "dst", "strength")


def edge_weight_history(s: SparkSession, d: str) -> DataFrame:
    """Co-occurrence edges after all rated sessions."""
    e = cooccurrence_edges(s, d).withColumns({"relationship": F.lit("co_occurred"), "source": F.lit("session")})
    h = B.injections(s, d).select("session_id", F.col("ts").cast("timestamp").alias("ts"), "rating", "rule_id")
    return G.edge_history(e, h).select("src", "dst", "strength")


def failure_groups(s: SparkSession, d: str) -> DataFrame:
    """Groups of similar user turns, as a cycle over twenty conversations each would find them."""
    t = QS.spoken(s, d).where("role = 'user'").select(F.floor(F.col("session_id") / 20).alias("cycle"), (F.col("session_id") * 1000 + F.col("seq")).alias("id"), tok_fail(F.col("text")).alias("tokens"))
    g = G.leader_groups(t.withColumn("ordinal", F.col("id")), "cycle", 0.3, True)
    return g.groupBy("cycle", "leader").agg(F.count(F.lit(1)).alias("frequency")).where("frequency >= 2")


def review_clusters(s: SparkSession, d: str) -> DataFrame:
    """Clusters of three similar user turns or more, over all conversations."""
    t = B.turns(s, d).where("role = 'user'").select(F.lit("all").alias("block"), (F.col("session_id") * 1000 + F.col("seq")).alias("id"), tok_review(F.col("text")).alias("tokens"))
    g = G.leader_groups(t.withColumn("ordinal", F.col("id")), "block", 0.4, False)
    return g.groupBy("leader").agg(F.count(F.lit(1)).alias("frequency")).where("frequency >= 3")


def benchmark_tasks(s: SparkSession, d: str) -> DataFrame:
    """Reviews of the upper fifth of events as tasks with their hash."""
    e = B.events(s, d).select(F.col("event_id").cast("string").alias("task_description"), (F.col("value") / 50).alias("implied_sentiment"))
    return L.benchmark_tasks(e)


def score_events(s: SparkSession, d: str) -> DataFrame:
    return L.score_events(B.scores(s, d).select(F.col("dimension").alias("trace_id"), F.lit("quality").alias("dimension"), "value").distinct())


def _rate(s: SparkSession, d: str) -> DataFrame:
    return S.read_table(s, d, "events", B.table(s, d, "events").schema)


def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    return S.to_table(S.dedup(_rate(s, d), "event_id").select("event_id", "event_type"), "append")


def stream_weekly(s: SparkSession, d: str) -> DataFrame:
    e = S.to_table(S.weekly(_rate(s, d).where("event_type = 'purchase'"), "value"), "complete")
    return e.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "n", half_up(F.col("mean"), 6).alias("mean"))


def stream_interval_join(s: SparkSession, d: str) -> DataFrame:
    side = lambda kind: _rate(s, d).where(F.col("event_type") == kind).select("event_id", "ts", (F.get_json_object("props", "$.k").cast("bigint") % 20).alias("skill"))
    return S.to_table(S.interval_join(side("signup"), side("click"), "skill", 30), "append")


def stream_rule_stats(s: SparkSession, d: str) -> DataFrame:
    """The last state of every rule: users as rules, purchases as ratings, a life of ten days."""
    r_ = _rate(s, d).where("event_type = 'purchase'").select(F.col("user_id").alias("rule_id"), "ts", F.col("event_id").alias("session_id"), (F.col("value") / 50 + 1).alias("rating"))
    last = S.latest(S.to_table(state.rule_stats(r_, life=10, late="1 hour").withColumn("order", F.struct("n", "expired")), "append"), "rule_id", "order").drop("order")
    return last.withColumn("decayed", half_up(F.col("decayed"), 6))


def stream_compaction(s: SparkSession, d: str) -> DataFrame:
    """Orders as rated events in four batches by time, every fortieth a batch late: closed months, and how many rows came too late."""
    o = B.table(s, d, "orders")
    e = o.select(F.col("o_orderdate").cast("timestamp").alias("ts"), (2.0 * F.substring("o_orderpriority", 1, 1).cast("double")).alias("rating"), (F.col("o_orderkey") % 40 == 0).cast("int").alias("held"))
    first, last = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    quarter = F.floor(4 * ((F.unix_micros("ts") - F.lit(first or 0)) / F.lit((last or 0) - (first or 0) + 1)))
    e = cut(e.withColumn("batch", F.least(F.lit(3), quarter + F.col("held"))))
    c = state.Compactor(s, _folder(s, "compaction"), "1 day")
    for i in range(4):
        c.cycle(e.where(F.col("batch") == i), i)
    months = c.monthly().select("month", "weeks", "n", "mean")
    late = c.late().agg(F.lit("late").alias("month"), F.lit(None).cast("bigint").alias("weeks"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("mean"))
    return months.union(late)


def stream_late(s: SparkSession, d: str) -> DataFrame:
    """Events in order of arrival with those behind the time already seen left out, as a cursor over time does."""
    return L.after_cursor(B.events(s, d).select("event_id", "ts"), "event_id").select("event_id", "ts")


_SDE = """p AS (SELECT doc_id AS id, lang AS domain, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents),
o AS (SELECT domain, rn, unnest(list_filter([-1, 1, -2, 2, -3, 3, -4, 4], lambda x: rn + x BETWEEN 1 AND n)[1:4]) AS d FROM p),
sde AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM (SELECT DISTINCT domain, least(rn, rn + d) AS x, greatest(rn, rn + d) AS y FROM o) z JOIN p a ON a.domain = z.domain AND a.rn = x JOIN p b ON b.domain = z.domain AND b.rn = y)"""
_KNN = f"kn AS ({Q.QUERIES['knn_edges'][1]})"
_E = "e AS (SELECT src, dst, 'same_domain' AS rel, 0.5::DOUBLE AS strength, 'domain' AS source FROM sde UNION ALL SELECT a, b, 'reinforces', strength, 'embedding' FROM kn), e2 AS (SELECT * FROM e UNION ALL SELECT dst, src, rel, strength, source FROM e)"
_COO = f"coo AS (SELECT a.rule_id AS src, b.rule_id AS dst, {r('sum(greatest(0.3::DOUBLE, greatest(1, least(10, a.rating)) / 10)) / (SELECT count(DISTINCT session_id) FROM inj)', 9)} AS strength FROM inj a JOIN inj b ON a.session_id = b.session_id AND a.rule_id < b.rule_id GROUP BY 1, 2 ORDER BY strength DESC, src, dst LIMIT 200)"
_W = "wq AS (SELECT item_id AS query_id, [(['en', 'fr', 'de', 'es'])[item_id % 4 + 1], 'src' || (item_id % 20)] AS ds FROM benchmark)"

#: The n-th rated session of every edge at a time.
_HISTORY = sql(["inj"], "SELECT src, dst, arg_max(strength, k) AS strength FROM fold GROUP BY 1, 2", [
    _COO,
    "moved AS (SELECT rule_id, session_id, ts, CASE WHEN rating = floor(rating) OR rating >= 9 OR rating <= 1 THEN greatest(-0.15::DOUBLE, least(0.15::DOUBLE, round((rating - 5) * 0.05::DOUBLE, 2))) ELSE 0 END AS by_ FROM inj)",
    "hit AS (SELECT src, dst, by_, row_number() OVER (PARTITION BY src, dst ORDER BY ts, session_id) AS k FROM (SELECT DISTINCT src, dst, session_id, ts, by_ FROM coo JOIN moved ON rule_id = src OR rule_id = dst WHERE by_ <> 0))",
    f"""fold AS (SELECT src, dst, 0::BIGINT AS k, strength::DOUBLE AS strength FROM coo UNION ALL
SELECT f.src, f.dst, h.k, {r("least(2.0::DOUBLE, greatest(0.1::DOUBLE, strength * (1 + by_)))", 4)} FROM fold f JOIN hit h ON h.src = f.src AND h.dst = f.dst AND h.k = f.k + 1)""",
]).replace("WITH ", "WITH RECURSIVE ", 1)

#: One unlabelled node a step, in the order of ids, ten times over; `lab` holds all labels by place.
_PROPAGATE = f"""WITH RECURSIVE {_KNN},
n AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS i, CASE WHEN vec_id % 3 = 0 THEN label::VARCHAR END AS label FROM embeddings),
u AS (SELECT id, i, row_number() OVER (ORDER BY id) AS k FROM n WHERE label IS NULL),
nb AS (SELECT u.k, u.i, n.i AS j, (a, b) AS eo FROM u JOIN (SELECT a AS x, b AS y, a, b FROM kn UNION ALL SELECT b, a, a, b FROM kn) ON x = u.id JOIN n ON n.id = y),
st AS (SELECT 0::BIGINT AS step, (SELECT list(label ORDER BY i) FROM n) AS lab UNION ALL
SELECT step + 1, CASE WHEN best IS NOT NULL AND lab[i] IS NULL THEN list_concat(lab[:i - 1], [best], lab[i + 1:]) ELSE lab END FROM
(SELECT step, any_value(lab) AS lab, any_value(i) AS i, arg_min(vote, (-w, first)) FILTER (w >= 2 AND n >= 2) AS best FROM
(SELECT step, vote, any_value(lab) AS lab, any_value(i) AS i, sum(1.5::DOUBLE) AS w, min(eo) AS first, sum(count(*)) OVER (PARTITION BY step) AS n FROM
(SELECT st.step, st.lab, u.i, nb.eo, st.lab[nb.j] AS vote FROM st JOIN u ON u.k = st.step % (SELECT count(*) FROM u) + 1 LEFT JOIN nb ON nb.k = u.k AND st.lab[nb.j] IS NOT NULL WHERE st.step < 10 * (SELECT count(*) FROM u)) GROUP BY step, vote) GROUP BY step))
SELECT id, lab[i] AS domain, CASE WHEN label IS NOT NULL THEN 'given' WHEN lab[i] IS NOT NULL THEN 'propagation' END AS source FROM n, (SELECT lab FROM st ORDER BY step DESC LIMIT 1)"""


_RULE_STATE = f"""WITH p AS (SELECT user_id AS rule_id, ts, event_id::VARCHAR AS sid, value / 50 + 1 AS rating FROM events WHERE event_type = 'purchase'),
k AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts DESC, sid DESC) - 1 AS age FROM p),
w AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM p)
SELECT rule_id, count(*) AS n, {r("sum(rating * exp(-ln(2) / 10 * age)) FILTER (age < 20) / sum(exp(-ln(2) / 10 * age)) FILTER (age < 20)")} AS decayed, count(*) FILTER (rating >= 7) AS high, count(*) FILTER (rating <= 4) AS low,
max(ts) AS last_seen, date_trunc('millisecond', max(ts)) + INTERVAL 10 DAY <= any_value(wm) AS expired FROM k, w GROUP BY 1"""

#: A row is late if its week was closed by what the batches before its own had brought.
_COMPACTION = f"""WITH o AS (SELECT o_orderdate AS ts, 2.0::DOUBLE * CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS rating, (o_orderkey % 40 = 0)::INT AS held FROM orders),
b AS (SELECT ts, rating, least(3, floor(4 * ((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM o)) / ((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM o) + 1)::DOUBLE))::INT + held) AS batch FROM o),
m AS (SELECT batch + 1 AS batch, max(max(ts)) OVER (ORDER BY batch) - INTERVAL 1 DAY AS wm FROM b GROUP BY batch),
x AS (SELECT ts, rating, date_trunc('week', ts) AS week, coalesce(date_trunc('week', ts) + INTERVAL 7 DAY <= wm, false) AS late FROM b LEFT JOIN m USING (batch)),
e AS (SELECT max(wm) AS wm FROM m)
SELECT strftime(week, '%Y-%m') AS month, count(DISTINCT week) AS weeks, count(*) AS n, {r("avg(rating)")} AS mean FROM x, e WHERE NOT late AND date_trunc('week', last_day(week)) + INTERVAL 7 DAY <= wm GROUP BY 1
UNION ALL SELECT 'late', NULL, count(*) FILTER (late), NULL FROM x"""

_WORDS = lambda strip, into, least: f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '{strip}', '{into}', 'g'), '\\s+'), lambda t: length(t) >= {least})"
#: The n-th turn of every block at a time, with the groups so far.
_GROUPS = lambda turns, block, words, near, grown: sql(["turns"], "", [
    QS.SPOKEN,
    f"u AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY id) AS i FROM (SELECT {block} AS block, session_id * 1000 + seq AS id, {words} AS t FROM {turns} WHERE role = 'user'))",
    f"""st AS (SELECT DISTINCT block, 0::BIGINT AS i, []::STRUCT(leader BIGINT, t VARCHAR[], n BIGINT)[] AS gs FROM u UNION ALL
SELECT block, i, CASE WHEN p = 0 THEN list_append(gs, {{'leader': id, 't': t, 'n': 1}}) ELSE list_concat(gs[:p - 1], [{{'leader': gs[p].leader, 't': {grown}, 'n': gs[p].n + 1}}], gs[p + 1:]) END FROM
(SELECT s.block, u.i, u.id, u.t, s.gs, coalesce(list_position(list_transform(s.gs, lambda g: coalesce(len(u.t) > 0 AND len(g.t) > 0 AND {near}, false)), true), 0) AS p FROM st s JOIN u ON u.block = s.block AND u.i = s.i + 1))""",
    "gr AS (SELECT block, unnest(arg_max(gs, i)) AS g FROM st GROUP BY 1)",
]).replace("WITH ", "WITH RECURSIVE ", 1)
_FAILURES = _GROUPS("spoken", "session_id // 20", f"list_distinct({_WORDS('[^a-z0-9\\s]', ' ', 3)})", "len(list_intersect(g.t, u.t)) / len(list_distinct(list_concat(g.t, u.t)))::DOUBLE >= 0.3::DOUBLE", "list_distinct(list_concat(gs[p].t, t))") + 'SELECT block AS "cycle", g.leader AS leader, g.n AS frequency FROM gr WHERE g.n >= 2'
_REVIEWS = _GROUPS("turns", "'all'", _WORDS("[^a-z0-9\\s]", "", 2), "len(list_filter(u.t, lambda x: list_contains(g.t, x))) / least(len(u.t), len(g.t))::DOUBLE >= 0.4::DOUBLE", "gs[p].t") + "SELECT g.leader AS leader, g.n AS frequency FROM gr WHERE g.n >= 3"

QUERIES = {
    "same_domain_edges": (same_domain_edges, sql([], "SELECT src, dst, 'same_domain' AS relationship, 0.5::DOUBLE AS strength, 'domain' AS source FROM sde", [_SDE])),
    "cooccurrence_edges": (cooccurrence_edges, sql(["inj"], "SELECT * FROM coo", [_COO])),
    "edge_weight_history": (edge_weight_history, _HISTORY),
    "edge_weights": (edge_weights, sql(["inj"], f"SELECT src, dst, CASE WHEN src IN (SELECT p_partkey FROM part WHERE p_size <= 25) OR dst IN (SELECT p_partkey FROM part WHERE p_size <= 25) THEN {r('least(2.0::DOUBLE, greatest(0.1::DOUBLE, strength * 1.15::DOUBLE))', 4)} ELSE strength END AS strength FROM coo", [_COO])),
    "node_scores": (
        node_scores,
        sql([], f"SELECT query_id, id, {r('0.5::DOUBLE * k / 2 + 0.3::DOUBLE * (0.7::DOUBLE * coalesce(near, 0) + 0.3::DOUBLE * coalesce(al, 0)) + 0.2::DOUBLE * (CASE WHEN 1 + id % 5 >= 3 THEN 1 ELSE 0.5 END)')} AS score FROM hit LEFT JOIN (SELECT src AS id, avg(strength) AS al FROM e2 GROUP BY 1) USING (id) LEFT JOIN (SELECT query_id, src AS id, avg(strength) AS near FROM e2 JOIN (SELECT query_id, id AS dst FROM hit) USING (dst) GROUP BY 1, 2) USING (query_id, id)",
        [_SDE, _KNN, _E, _W, "hit AS (SELECT query_id, doc_id AS id, len(list_intersect(ds, [lang, source])) AS k FROM wq, documents WHERE list_contains(ds, lang) OR list_contains(ds, source))"]),
    ),
    "one_hop_expand": (one_hop_expand, sql(BM25, "SELECT query_id, id, min(hop)::BIGINT AS hop FROM (SELECT query_id, doc_id AS id, 0 AS hop FROM bmr WHERE rank <= 5 UNION ALL SELECT query_id, dst, 1 FROM bmr JOIN e2 ON src = doc_id WHERE rank <= 5 AND source = 'embedding' AND strength >= 0.3::DOUBLE) GROUP BY 1, 2", [_SDE, _KNN, _E])),
    "graph_report": (
        graph_report,
        sql([], f"SELECT 'nodes' AS metric, '' AS key, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'edges', '', count(*)::DOUBLE FROM e UNION ALL SELECT 'density', '', {r('2.0::DOUBLE * (SELECT count(*) FROM e) / (count(*) * (count(*) - 1))', 9)} FROM documents UNION ALL SELECT 'domain', d, n::DOUBLE FROM dom UNION ALL SELECT 'relationship', rel, count(*)::DOUBLE FROM e GROUP BY rel UNION ALL SELECT 'isolated', '', count(*)::DOUBLE FROM documents WHERE doc_id NOT IN (SELECT src FROM e2) UNION ALL SELECT 'thin', d, n::DOUBLE FROM dom WHERE n < 60",
        [_SDE, _KNN, _E, "dom AS (SELECT d, count(*) AS n FROM (SELECT unnest([lang, source]) AS d FROM documents) GROUP BY 1)"]),
    ),
    "drift": (drift, "SELECT doc_id AS id, 'file-only' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'node-only' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)"),
    "label_propagation": (label_propagation, _PROPAGATE),
    "near_dup_clusters": (
        near_dup_clusters,
        f"WITH RECURSIVE dup AS ({Q.QUERIES['lexical_duplicates'][1]}), u AS (SELECT a, b FROM dup UNION ALL SELECT b, a FROM dup), reach AS (SELECT DISTINCT a AS id, a AS m FROM u UNION SELECT u.b, reach.m FROM reach JOIN u ON u.a = reach.id), c AS (SELECT id, min(m) AS component FROM reach GROUP BY 1) SELECT component, count(*) AS size, (SELECT {r('max(sim)')} FROM dup JOIN c c2 ON dup.a = c2.id WHERE c2.component = c.component) AS best FROM c GROUP BY component",
    ),
    "graph_query": (graph_query, None),
    "knn_label": (knn_label, sql(BM25, "SELECT query_id, arg_max(domain, (n, domain)) AS domain FROM (SELECT query_id, lang AS domain, count(*) AS n FROM bmr JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1")),
    "target_nodes": (target_nodes, "SELECT d AS domain, doc_id AS id, row_number() OVER (PARTITION BY d ORDER BY 1 + doc_id % 5 DESC, doc_id) AS rank FROM (SELECT doc_id, unnest([lang, source]) AS d FROM documents) QUALIFY rank <= 3"),
    "failure_groups": (failure_groups, _FAILURES),
    "review_clusters": (review_clusters, _REVIEWS),
    "benchmark_tasks": (benchmark_tasks, "SELECT event_id::VARCHAR AS task_description, substr(sha256(event_id::VARCHAR), 1, 16) AS task_id FROM events WHERE value / 50 >= 7"),
    "score_events": (score_events, "SELECT trace_id, substr(sha256(trace_id || ':quality:' || CAST(CAST(value * 1000 AS BIGINT) AS VARCHAR)), 1, 36) AS event_id, value FROM (SELECT DISTINCT l_returnflag || l_linestatus AS trace_id, l_quantity / 10 AS value FROM lineitem)"),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT event_id, event_type FROM events"),
    "stream_weekly_digest": (stream_weekly, f"SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, {r('avg(value)')} AS mean FROM events WHERE event_type = 'purchase' GROUP BY 1"),
    "stream_interval_join": (stream_interval_join, "WITH z AS (SELECT event_id, ts, event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 20 AS skill FROM events) SELECT s.skill, s.event_id AS left_id, c.event_id AS right_id FROM z s JOIN z c ON s.skill = c.skill AND c.ts BETWEEN s.ts AND s.ts + INTERVAL 30 MINUTES WHERE s.event_type = 'signup' AND c.event_type = 'click'"),
    "stream_rule_stats": (stream_rule_stats, _RULE_STATE),
    "stream_compaction": (stream_compaction, _COMPACTION),
    "cursor_scan": (stream_late, "SELECT event_id, ts FROM (SELECT event_id, ts, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR ts > m"),
}
