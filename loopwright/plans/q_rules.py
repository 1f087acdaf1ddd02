"""Queries over rule statistics, lifecycle and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.functions.text import half_up, tok_bm25
from loopwright.operators import retrieval as T
from loopwright.operators import rules as R
from loopwright.operators.ordered import bootstrap_ci as bootstrap
from loopwright.plans import bindings as B
from loopwright.plans import q_retrieval as Q
from loopwright.plans.bindings import BM25, r, sql


def _stats(s: SparkSession, d: str) -> DataFrame:
    return R.rule_stats(B.injections(s, d))


def _now(s: SparkSession, d: str) -> DataFrame:
    return B.table(s, d, "orders").agg(F.max("o_orderdate").alias("as_of"))


def _dated(s: SparkSession, d: str) -> DataFrame:
    return _stats(s, d).join(F.broadcast(_now(s, d)))


def differential_lift(s: SparkSession, d: str) -> DataFrame:
    return R.differential_lift(_stats(s, d), B.injections(s, d))


def auto_evict(s: SparkSession, d: str) -> DataFrame:
    return R.auto_evict(_stats(s, d), B.table(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("rule_id")))


def eviction_rank(s: SparkSession, d: str) -> DataFrame:
    return R.eviction_rank(_dated(s, d), F.col("as_of"), 25)


def eviction_candidates(s: SparkSession, d: str) -> DataFrame:
    return R.eviction_candidates(_dated(s, d), F.col("as_of"))



def budget_status(s: SparkSession, d: str) -> DataFrame:
    n = B.table(s, d, "part").groupBy(F.split("p_type", " ")[0].alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return R.budget_status(n, {"STANDARD": 30, "SMALL": 300, "MEDIUM": 400, "LARGE": None})


def budget_excess(s: SparkSession, d: str) -> DataFrame:
    """The ten rules beyond a cap of ten under the number of rated rules."""
    st = _stats(s, d)
    n = st.count()
    return R.budget_excess(st.select("rule_id", "decayed"), n, n - 10)


VALID = ("O", "F", "P")


def _log(s: SparkSession, d: str) -> DataFrame:
    return B.table(s, d, "orders").select(F.col("o_custkey").alias("rule_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))


def lifecycle_state(s: SparkSession, d: str) -> DataFrame:
    return R.lifecycle_state(_log(s, d), VALID)


def undersampled(s: SparkSession, d: str) -> DataFrame:
    states = R.lifecycle_state(_log(s, d), VALID)
    n = B.table(s, d, "orders").groupBy(F.col("o_custkey").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))
    return R.undersampled(n, states, 10, ("F",))


def ledger_undo(s: SparkSession, d: str) -> DataFrame:
    return R.ledger_undo(_log(s, d).select("rule_id", "ts", "seq"), 25, ("ts", "seq"))


def effectiveness(s: SparkSession, d: str) -> DataFrame:
    o = B.table(s, d, "orders")
    p = o.groupBy(F.col("o_custkey").alias("rule_id")).agg((F.min("o_orderdate") + F.expr("INTERVAL 180 DAYS")).alias("promoted_at"))
    return R.effectiveness(p, o.where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("rule_id"), F.col("o_orderdate").alias("ts")))


def nearest_rating(s: SparkSession, d: str) -> DataFrame:
    sessions = B.corrections(s, d).groupBy("session_id").agg(F.min("ts").alias("ts"))
    return R.nearest_rating(sessions, B.ratings(s, d), 6)


def attribution(s: SparkSession, d: str) -> DataFrame:
    t = B.turns(s, d).withColumn("terms", tok_bm25(F.col("text")))
    rules = t.where("role = 'assistant'").select("session_id", F.col("seq").alias("rule_id"), "terms", F.lit(6.0).alias("session_score"))
    return R.attribution(rules, t.where("role = 'user'").select("session_id", F.col("seq").alias("correction_id"), "terms"))


def reconcile(s: SparkSession, d: str) -> DataFrame:
    return R.reconcile(_stats(s, d), B.injections(s, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n")))


def trajectories(s: SparkSession, d: str) -> DataFrame:
    o = B.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("rating"), F.col("o_orderdate").alias("ts"))
    return R.trajectories(o).select("id", "rating")


def _gold(s: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage: its words as a run."""
    return T.holders(B.table(s, d, "documents"), B.queries(s, d)).select("query_id", F.col("doc_id").alias("item"))


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return T.bm25_search(B.table(s, d, "documents"), B.queries(s, d), 15).select("query_id", F.col("doc_id").alias("item"), "rank")


def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    return R.retrieval_quality(_ranked(s, d), _gold(s, d))


def mean_quality(s: SparkSession, d: str) -> DataFrame:
    return R.aggregate_quality(recall_at_k(s, d))


def cluster_recall(s: SparkSession, d: str) -> DataFrame:
    classes, e = T.lexical_classes(B.table(s, d, "documents"))
    near = e.select(F.col("a").alias("item"), F.col("b").alias("other")).union(e.select("b", "a"))
    return R.cluster_recall(_ranked(s, d), _gold(s, d), near, classes.select(F.col("id").alias("item"), "lead"))


def domain_recall(s: SparkSession, d: str) -> DataFrame:
    pool = B.table(s, d, "documents").select(F.col("doc_id").alias("item"), F.array("source").alias("domains"))
    wanted = B.queries(s, d).select("query_id", F.array(F.concat(F.lit("src"), F.col("query_id") % 20)).alias("domains"))
    return R.domain_recall(_ranked(s, d), pool, wanted)


def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return bootstrap(recall_at_k(s, d).select("query_id", "rr"), "rr")


def rrf_grid(s: SparkSession, d: str) -> DataFrame:
    grid = s.createDataFrame([(f"{a}-{b}-{c}", float(a), b / 2, float(c)) for a in (1, 2) for b in (0, 1) for c in (0, 1)], "setting string, bm25 double, graph double, vector double")
    return R.weight_grid(Q._lists(s, d), _gold(s, d), grid)


def majority_vote(s: SparkSession, d: str) -> DataFrame:
    x = B.table(s, d, "lineitem").select(F.col("l_suppkey").alias("skill"), F.col("l_linenumber").alias("criterion"), (F.col("l_quantity") > 25).alias("passed"))
    return R.majority_vote(x)


_ST = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts DESC, session_id DESC) - 1 AS age FROM inj WHERE rating IS NOT NULL AND rating <> 0),
st AS (SELECT rule_id, count(*) AS n, {r('sum(rating * exp(-0.06931471805599453::DOUBLE * age)) FILTER (age < 20) / sum(exp(-0.06931471805599453::DOUBLE * age)) FILTER (age < 20)')} AS decayed, {r('avg(rating) FILTER (age < 20)')} AS mean,
string_agg(rating::INT::VARCHAR, ',' ORDER BY age DESC) FILTER (age < 20) AS ratings, count(*) FILTER (rating >= 7) AS high, count(*) FILTER (rating <= 4) AS low, max(ts) AS last_seen FROM rk GROUP BY 1)"""
_STALE = "(epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(last_seen)) / 86400000000.0::DOUBLE > 60"
_TRIG = "CASE WHEN n >= 5 THEN CASE WHEN n >= 150 AND decayed < 4 THEN 'high-injection-low-value' WHEN n > 50 AND decayed < 4 THEN 'low-avg-high-volume' WHEN high = 0 THEN 'never-helped' WHEN low > 2 * high AND n >= 10 THEN 'net-negative-roi' END END"
_GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_QUAL = lambda ranked: f"""q0 AS (SELECT query_id, count(*) AS ng FROM gold GROUP BY 1),
q1 AS (SELECT query_id, count(*) FILTER (rank <= 3 AND hit) AS h3, count(*) FILTER (rank <= 5 AND hit) AS h5, count(*) FILTER (rank <= 10 AND hit) AS h10, count(*) FILTER (rank <= 15 AND hit) AS h15, count(*) FILTER (rank <= 5) AS g5, min(rank) FILTER (hit) AS f FROM (SELECT x.*, EXISTS (SELECT 1 FROM gold g WHERE g.query_id = x.query_id AND g.item = x.item) AS hit FROM {ranked} x) GROUP BY 1),
qual AS (SELECT query_id, {r('coalesce(h3, 0) / ng::DOUBLE')} AS recall_3, {r('coalesce(h5, 0) / ng::DOUBLE')} AS recall_5, {r('coalesce(h10, 0) / ng::DOUBLE')} AS recall_10, {r('coalesce(h15, 0) / ng::DOUBLE')} AS recall_15, {r('coalesce(h5, 0) / 5.0::DOUBLE')} AS precision_5, {r('coalesce(h5 / nullif(g5, 0)::DOUBLE, 0)')} AS precision_5_got, {r('coalesce(1.0::DOUBLE / f, 0)')} AS rr FROM q0 LEFT JOIN q1 USING (query_id))"""  # noqa: E731
_RK = "(SELECT query_id, doc_id AS item, rank FROM bmr WHERE rank <= 15)"
_DUP = Q.QUERIES["lexical_duplicates"][1]

_ATTRIBUTION = sql(["turns"], f"""SELECT tk.session_id, seq AS rule_id, {r("greatest(1.0::DOUBLE, least(6.0::DOUBLE, 6.0::DOUBLE - 0.5::DOUBLE * coalesce(k, 0)))")} AS score, {r("coalesce(p, 0.0::DOUBLE)")} AS proximity
FROM tk LEFT JOIN h ON h.session_id = tk.session_id AND h.rule_id = tk.seq WHERE role = 'assistant'""", [
    "tk AS (SELECT session_id, seq, role, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'), lambda t: length(t) >= 2) AS t FROM turns)",
    "c AS (SELECT session_id, seq AS c, term, count(*) AS tf FROM (SELECT session_id, seq, unnest(t) AS term FROM tk WHERE role = 'user') GROUP BY ALL)",
    "ru AS (SELECT session_id, seq AS rule_id, len(t) AS n, unnest(list_distinct(t)) AS term FROM tk WHERE role = 'assistant')",
    "si AS (SELECT session_id, rule_id, c, sum(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE) * ln(2)) / any_value(n) AS sim FROM ru JOIN c USING (session_id, term) GROUP BY session_id, rule_id, c)",
    "h AS (SELECT session_id, rule_id, count(*) FILTER (sim > 0.3::DOUBLE) AS k, max(sim) AS p FROM si GROUP BY 1, 2)",
])


QUERIES = {
    "rule_stats": (_stats, sql(["inj"], "SELECT * FROM st", [_ST])),
    "differential_lift": (differential_lift, sql(["inj"], f"SELECT rule_id, {r('mean - (SELECT avg(rating) FROM inj)', 3)} AS lift FROM st", [_ST])),
    "auto_evict": (auto_evict, sql(["inj"], f"SELECT rule_id, {_TRIG} AS trigger, n FROM st WHERE {_TRIG} IS NOT NULL AND rule_id NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)", [_ST])),
    "eviction_rank": (eviction_rank, sql(["inj"], f"SELECT rule_id, stale, decayed, low, n, row_number() OVER (ORDER BY stale DESC, decayed, low DESC, n DESC, rule_id) AS rank FROM (SELECT *, {_STALE} AS stale FROM st WHERE n > 5) QUALIFY rank <= 25", [_ST])),
    "eviction_candidates": (eviction_candidates, sql(["inj"], f"SELECT rule_id, reason, decayed FROM (SELECT *, CASE WHEN {_STALE} THEN 'stale' WHEN n >= 5 AND decayed < 3 THEN 'low-rating' WHEN n >= 10 AND decayed < 4 THEN 'quality-floor' END AS reason FROM st) WHERE reason IS NOT NULL", [_ST])),
    "budget_status": (budget_status, "SELECT tier, n, cap, CASE WHEN cap IS NULL THEN 'unbounded' WHEN n > cap THEN 'over' WHEN n > cap - 5 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT string_split(p_type, ' ')[1] AS tier, count(*) AS n, (CASE string_split(p_type, ' ')[1] WHEN 'STANDARD' THEN 30 WHEN 'SMALL' THEN 300 WHEN 'MEDIUM' THEN 400 END)::BIGINT AS cap FROM part GROUP BY ALL)"),
    "budget_excess": (budget_excess, sql(["inj"], "SELECT rule_id, decayed FROM st ORDER BY decayed, rule_id LIMIT 10", [_ST])),
    "lifecycle_state": (lifecycle_state, "SELECT o_custkey AS rule_id, o_orderstatus AS state, p AS from_state, n AS changes FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')) WHERE r = 1"),
    "undersampled": (undersampled, "WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey AS rule_id, n FROM l WHERE n < 10 AND s <> 'F'"),
    "ledger_undo": (ledger_undo, "SELECT o_custkey AS rule_id, o_orderdate AS ts, o_orderkey AS seq FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) > 25"),
    "effectiveness": (effectiveness, "WITH p AS (SELECT o_custkey AS rule_id, min(o_orderdate) + INTERVAL 180 DAYS AS pa FROM orders GROUP BY 1), c AS (SELECT o_custkey AS rule_id, o_orderdate AS ts FROM orders WHERE o_orderpriority LIKE '1%'), g AS (SELECT rule_id, count(*) FILTER (ts < pa) AS before, count(*) FILTER (ts >= pa) AS after FROM p LEFT JOIN c USING (rule_id) GROUP BY 1) SELECT rule_id, before, after, after - before AS delta, before > 0 AND after < before AS effective FROM g"),
    "nearest_rating_asof": (nearest_rating, sql(["ev", "ratings", "corr"], f"SELECT session_id, arg_min(rating, (d, c, event_id)) AS rating, {r('min(d)', 3)} AS seconds FROM (SELECT s.session_id, e.rating, e.event_id, epoch_us(e.ts) / 1e6::DOUBLE AS c, abs(epoch_us(s.ts) / 1e6::DOUBLE - epoch_us(e.ts) / 1e6::DOUBLE) AS d FROM (SELECT session_id, min(ts) AS ts FROM corr GROUP BY 1) s JOIN ratings e ON e.ts > s.ts - INTERVAL 6 HOURS AND e.ts < s.ts + INTERVAL 6 HOURS) GROUP BY 1")),
    "attribution": (attribution, _ATTRIBUTION),
    "reconcile": (reconcile, sql(["inj"], "SELECT 'injected' AS name, max(n)::DOUBLE AS value, CASE WHEN max(n) <= 20 THEN 'ok' ELSE 'fail' END AS status FROM ld UNION ALL SELECT 'telemetry', sum(n)::DOUBLE, CASE WHEN sum(n) > 0 THEN 'ok' ELSE 'fail' END FROM ld UNION ALL SELECT 'roi', count(*) FILTER (n >= 100 AND decayed < 3)::DOUBLE, CASE WHEN count(*) FILTER (n >= 100 AND decayed < 3) = 0 THEN 'ok' ELSE 'warn' END FROM st", [_ST, "ld AS (SELECT session_id, count(*) AS n FROM inj GROUP BY 1)"])),
    "trajectories": (trajectories, "SELECT o_orderkey AS id, o_totalprice AS rating FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 100"),
    "recall_at_k": (recall_at_k, sql(BM25, "SELECT * FROM qual", [_GOLD, _QUAL(_RK)])),
    "mean_quality": (mean_quality, sql(BM25, "SELECT " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in ("recall_3", "recall_5", "recall_10", "recall_15", "precision_5", "precision_5_got", "rr")) + ", count(*) AS n FROM qual", [_GOLD, _QUAL(_RK)])),
    "cluster_recall": (cluster_recall, sql(BM25, "SELECT query_id, recall_5, rr FROM qual", [_GOLD, f"dup AS ({_DUP})", f"rk2 AS (SELECT query_id, item, min(rank) AS rank FROM (SELECT * FROM {_RK} UNION ALL SELECT query_id, o, rank FROM {_RK} x JOIN (SELECT a AS i, b AS o FROM dup UNION ALL SELECT b, a FROM dup) ON i = item) GROUP BY ALL)", _QUAL("rk2")])),
    "domain_recall": (domain_recall, sql(BM25, f"SELECT item_id AS query_id, coalesce(e, 0)::BIGINT AS expected, coalesce(h, 0)::BIGINT AS hits, {r('coalesce(coalesce(h, 0) / e::DOUBLE, 1)', 3)} AS recall FROM benchmark LEFT JOIN (SELECT b.item_id AS q, count(*) AS e, count(k.item) AS h FROM benchmark b JOIN documents d ON d.source = 'src' || (b.item_id % 20) LEFT JOIN {_RK} k ON k.query_id = b.item_id AND k.item = d.doc_id GROUP BY 1) ON q = item_id")),
    "bootstrap_ci": (bootstrap_ci, None),
    "rrf_grid": (rrf_grid, sql(BM25, f"SELECT setting, {r('avg(coalesce(p, 0))')} AS precision FROM grid CROSS JOIN (SELECT DISTINCT query_id FROM gold) LEFT JOIN (SELECT setting, query_id, count(*) FILTER (item IN (SELECT item FROM gold g WHERE g.query_id = t.query_id)) / 5.0::DOUBLE AS p FROM t GROUP BY ALL) USING (setting, query_id) GROUP BY 1", [Q._LISTS, _GOLD, "grid AS (SELECT a || '-' || b || '-' || c AS setting, a AS wa, b / 2.0::DOUBLE AS wb, c AS wc FROM (VALUES (1), (2)) x(a), (VALUES (0), (1)) y(b), (VALUES (0), (1)) z(c))",
        "t AS (SELECT * FROM (SELECT setting, query_id, item, row_number() OVER (PARTITION BY setting, query_id ORDER BY floor(s * 1e12 + 0.5::DOUBLE) DESC, item) AS rk FROM (SELECT setting, query_id, item, sum(CASE l WHEN 'bm25' THEN wa WHEN 'graph' THEN wb ELSE wc END / (60.0::DOUBLE + rank)) AS s FROM lists, grid GROUP BY ALL)) WHERE rk <= 5)"])),
    "majority_vote": (majority_vote, f"SELECT skill, {r('avg(ok::INT)')} AS pass_rate FROM (SELECT l_suppkey AS skill, l_linenumber, avg((l_quantity > 25)::INT) > 0.5 AS ok FROM lineitem GROUP BY ALL) GROUP BY 1"),
}
