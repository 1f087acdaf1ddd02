"""Queries over stores: traces and scores through the data source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.functions.text import half_up
from loopwright.operators.iterate import cut, shared_folder
from loopwright.plans import bindings as B
from loopwright.plans.bindings import r, sql
from loopwright.sources import keyed as K
from loopwright.sources import traces as T
from loopwright.sources import transcripts as X


def _folder(s: SparkSession, name: str) -> str:
    cut(s.range(1))  # sets the folder where the session has none
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _traces(s: SparkSession, d: str) -> DataFrame:
    """Every assistant turn with the user turn before it, by kind of conversation, an hour apart."""
    before = W.partitionBy("session_id").orderBy("seq")
    t = B.turns(s, d).withColumns({"input": F.lag("text").over(before), "by": F.lag("role").over(before)}).where("role = 'assistant' and by = 'user'")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("session_id") * 3600 + F.col("seq") * 60)
    return t.select(F.concat_ws(":", "session_id", "seq").alias("id"), F.concat(F.lit("kind-"), F.col("session_id") % 4).alias("name"), "input", F.col("text").alias("output"), ts.alias("ts"), "session_id")


def eval_traces(s: SparkSession, d: str) -> DataFrame:
    """Traces go to a store and, of every third conversation, their scores to a sink, some twice; of the kinds that are asked for, what is found, what is still to be judged, and the mean score."""
    made, store, sink = _traces(s, d), _folder(s, "traces"), _folder(s, "scores")
    T.cache(made, store)
    judged = made.where("session_id % 3 = 0").select(F.col("id").alias("trace_id"), F.explode(F.array(F.lit("length"), F.lit("echo"))).alias("dimension"), "input", "output", "ts")
    value = F.when(F.col("dimension") == "length", F.least(F.lit(5.0), 1 + F.length("output") / 100)).otherwise(F.when(F.length("input") > F.length("output"), 2.0).otherwise(4.0))
    judged = judged.select("trace_id", "dimension", value.alias("value"), F.col("input").alias("reasoning"), "ts")
    T.send_scores(judged, sink)
    T.send_scores(judged.where("dimension = 'echo'"), sink)
    found = T.cached(s, store, ["kind-0", "kind-1", "kind-2"], F.timestamp_seconds(F.lit(1_704_067_200 + 3600 * 5)))
    scores = T.sent_scores(s, sink, ["length", "echo"])
    left = T.unscored(found, scores)
    own = F.substring(F.sha2(F.concat_ws(":", F.lit("traces"), F.col("id")), 256), 1, 32)
    mean = found.select("name", own.alias("trace_id")).join(scores.select("trace_id", "value"), "trace_id").groupBy("name").agg(half_up(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n_scores"))
    counts = found.groupBy("name").agg(F.count(F.lit(1)).alias("found")).join(left.groupBy("name").agg(F.count(F.lit(1)).alias("to_judge")), "name", "left").join(mean, "name", "left")
    return counts.select("name", "found", F.coalesce("to_judge", F.lit(0)).alias("to_judge"), F.coalesce("n_scores", F.lit(0)).alias("n_scores"), "mean")


def vector_cache(s: SparkSession, d: str) -> DataFrame:
    """Documents as rule files, embedded (by their length) in two goes: four fifths first, then all, every third changed."""
    t = K.KeyedTable(s, _folder(s, "vectors"), K.VECTORS)
    docs = B.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("body"), "doc_id")
    prefix = lambda x: x.select("id", F.concat(F.lit("about "), "id").alias("prefix"))
    embed = lambda x: x.select("id", F.array(F.length("text").cast("double")).alias("vector"))
    K.embed_changed(t, docs.where("doc_id % 5 <> 0").select("id", "body"), prefix, embed)
    now = docs.select("id", F.when(F.col("doc_id") % 3 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"))
    K.embed_changed(t, now, prefix, embed)
    return t.read().select("id", "hash", "prefix", F.col("vector")[0].alias("n"))


def rule_registry(s: SparkSession, d: str) -> DataFrame:
    """Parts as learned rules: synced into the registry, then some evicted; what became of each, and what the registry and the lists hold."""
    p = B.table(s, d, "part").withColumn("id", F.concat(F.lit("p"), "p_partkey"))
    reg = K.KeyedTable(s, _folder(s, "registry"), K.RULES)
    lists = K.KeyedTable(s, _folder(s, "lists"), "id string, list string, line string")
    K.sync_rules(reg, p.select("id", F.col("p_name").alias("text")), F.filter(F.split("text", " "), lambda w: F.length(w) > 5))
    lists.merge(p.where("p_size <= 30").select("id", F.when(F.col("p_size") <= 10, "critical").otherwise("learned").alias("list"), F.concat(F.lit("- "), "p_name").alias("line")))
    reason = F.when(F.col("p_size") % 4 == 0, "stale for 90 days").when(F.col("p_size") % 4 == 1, "noise 0.4").when(F.col("p_size") % 4 == 2, "critical-stale").otherwise("avg 2.1")
    c = p.where("p_partkey % 3 = 0").select("id", reason.alias("reason"), (F.col("p_partkey") % 2 == 0).alias("confirm"))
    done = K.apply_evictions(reg, lists, c, F.lit("2024-01-31"))
    held = reg.read().select("id", F.array_join("domains", ",").alias("domains"))
    return held.join(done, "id", "full").join(lists.read(), "id", "full").select("id", "domains", "outcome", "trigger", "list", "line")


def transcript_signals(s: SparkSession, d: str) -> DataFrame:
    """Conversations written as three transcripts of nested JSON, some lines broken: ratings, corrections with what was said before, tools and skills."""
    c = B.table(s, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    rate = F.concat(F.lit("ok /rate M:8 S:7 Q:"), F.col("turn") % 10, F.lit(" "), F.col("text"))
    said = F.when(F.col("turn") % 3 == 0, rate).when(F.col("turn") % 3 == 1, F.concat(F.lit("No, "), "text")).otherwise(F.col("text"))
    block = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    plain = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(said.alias("content")).alias("message")))
    listed = F.to_json(F.struct(F.lit("user").alias("type"), F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), block(said)).alias("content")))
    tool = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.when(F.col("turn") % 4 == 0, "Skill").otherwise("Edit").alias("name"), F.struct(F.concat(F.lit("s"), F.col("turn") % 3).alias("skill")).alias("input")))
    answer = F.concat(F.lit('{"type":"assistant","message":{"content":['), F.when(F.col("turn") % 5 > 0, F.concat(F.to_json(block(F.col("text"))), F.lit(","))).otherwise(""), tool, F.lit("]}}"))
    prompt = F.when(F.col("conv_id") % 4 > 0, F.to_json(F.struct(F.lit("last-prompt").alias("type"), F.concat(F.lit("c"), "conv_id").alias("sessionId")))).otherwise('{"type":"last-prompt"}')
    user = F.when(F.col("conv_id") % 11 == 10, "broken {").when(F.col("conv_id") % 2 == 0, plain).otherwise(listed)
    value = F.when(F.col("role") == "system", prompt).when(F.col("role") == "user", user).otherwise(answer)
    lines = c.select(F.concat(F.lit("f"), F.col("conv_id") % 3).alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line"), value.alias("value"))
    x = X.signals(lines, 25)
    row = lambda name, d, session, key, value, n: d.select(F.lit(name).alias("part"), session.alias("session_id"), key.alias("key"), value.alias("value"), n.cast("long").alias("n"))
    none, no = F.lit(""), F.lit(0)
    out = row("rating", x["ratings"], F.col("session_id"), F.col("score"), none, F.col("line")).union(row("correction", x["corrections"], F.col("session_id"), F.col("phrase"), F.col("context"), F.col("line")))
    out = out.union(row("tool", x["tools"], none, F.col("tool"), none, F.col("n"))).union(row("skill", x["skills"], F.col("session_id"), F.col("skill"), none, F.col("line")))
    return out.union(row("scanned", x["files"], none, none, none, F.col("scanned"))).union(row("skipped", x["files"], none, none, none, F.col("skipped") + no))


_TRACES = """tr AS (SELECT session_id || ':' || seq AS id, 'kind-' || (session_id % 4) AS name, input, text AS output, session_id, 3600 * session_id + 60 * seq AS sec FROM
(SELECT *, lag(text) OVER w AS input, lag(role) OVER w AS said FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY seq)) WHERE role = 'assistant' AND said = 'user')"""

_TRANSCRIPTS = """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, 'f' || (conv_id % 3) AS file, conv_id * 1000 + turn AS line FROM conversations),
n AS (SELECT file, count(*) AS n FROM c GROUP BY 1),
l AS (SELECT *, CASE WHEN role = 'system' AND conv_id % 4 > 0 THEN 'c' || conv_id END AS named, CASE WHEN role NOT IN ('system', 'user') AND turn % 5 > 0 THEN t END AS said,
CASE WHEN role = 'user' AND conv_id % 11 <> 10 THEN CASE turn % 3 WHEN 0 THEN 'ok /rate M:8 S:7 Q:' || (turn % 10) || ' ' || t WHEN 1 THEN 'No, ' || t ELSE t END END AS ask FROM c JOIN n USING (file) WHERE n > 25),
x AS (SELECT *, coalesce(last_value(named IGNORE NULLS) OVER w, file) AS session_id, coalesce(last_value(said IGNORE NULLS) OVER w, '') AS before FROM l WINDOW w AS (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT 'rating' AS part, session_id, regexp_extract(ask, '(?i)M:\\d+\\s+S:\\d+\\s+Q:\\d+') AS key, '' AS value, line AS n FROM x WHERE regexp_matches(ask, '(?i)M:\\d+\\s+S:\\d+\\s+Q:\\d+')
UNION ALL SELECT 'correction', session_id, substr(ask, 1, 200), substr(before, 1, 200), line FROM x WHERE NOT regexp_matches(lower(trim(ask)), '^(no problem|no worries|not bad|no rush|no issue|no need|not a problem)') AND regexp_matches(lower(trim(ask)), '^(no |no,|wrong|stop|don''t|dont|not that|fix|undo|revert|that broke)')
UNION ALL SELECT 'tool', '', CASE WHEN turn % 4 = 0 THEN 'Skill' ELSE 'Edit' END, '', count(*) FROM x WHERE role NOT IN ('system', 'user') GROUP BY 3
UNION ALL SELECT 'skill', session_id, 's' || (turn % 3), '', line FROM x WHERE role NOT IN ('system', 'user') AND turn % 4 = 0
UNION ALL SELECT 'scanned', '', '', '', count(*) FILTER (n > 25) FROM n UNION ALL SELECT 'skipped', '', '', '', count(*) FILTER (n <= 25) FROM n"""

QUERIES = {
    "transcript_signals": (transcript_signals, _TRANSCRIPTS),
    "vector_cache": (
        vector_cache,
        "SELECT id, md5(body) AS hash, 'about ' || id AS prefix, length('about ' || id || chr(10) || body)::DOUBLE AS n FROM (SELECT doc_id::VARCHAR AS id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END AS body FROM documents)",
    ),
    "rule_registry": (
        rule_registry,
        """WITH p AS (SELECT 'p' || p_partkey AS id, *, list_filter(string_split(p_name, ' '), lambda w: length(w) > 5) AS ws, p_partkey % 3 = 0 AS asked, p_partkey % 3 = 0 AND p_partkey % 2 <> 0 AS gone,
CASE WHEN p_size <= 10 THEN 'critical' WHEN p_size <= 30 THEN 'learned' END AS old FROM part),
q AS (SELECT *, CASE WHEN gone AND old = 'learned' THEN NULL WHEN gone AND old = 'critical' THEN 'learned' ELSE old END AS list FROM p)
SELECT id, CASE WHEN NOT gone THEN CASE WHEN len(ws) > 0 THEN array_to_string(ws, ',') ELSE 'testing' END END AS domains, CASE WHEN asked THEN CASE WHEN NOT gone THEN 'skipped' WHEN old = 'critical' THEN 'demoted' ELSE 'evicted' END END AS outcome,
CASE WHEN gone THEN ['never-helped', 'high-injection-low-value', 'never-helped', 'low-avg-high-volume'][p_size % 4 + 1] END AS trigger, list,
CASE WHEN list IS NOT NULL THEN '- ' || p_name || CASE WHEN gone AND old = 'critical' THEN ' <!-- demoted from Critical on 2024-01-31 -->' ELSE '' END END AS line FROM q""",
    ),
    "eval_traces": (
        eval_traces,
        sql(["turns"], f"""SELECT name, count(DISTINCT f.id) AS found, count(DISTINCT f.id) FILTER (session_id % 3 <> 0) AS to_judge, count(v) AS n_scores, {r("avg(v)")} AS mean FROM f LEFT JOIN sc USING (id) GROUP BY 1""", [
            _TRACES,
            "f AS (SELECT * FROM tr WHERE name IN ('kind-0', 'kind-1', 'kind-2') AND sec >= 18000 AND length(input) > 0 AND length(output) > 0)",
            "sc AS (SELECT id, unnest([least(5.0::DOUBLE, 1 + length(output) / 100.0::DOUBLE), CASE WHEN length(input) > length(output) THEN 2.0::DOUBLE ELSE 4.0::DOUBLE END]) AS v FROM tr WHERE session_id % 3 = 0)",
        ]),
    ),
}
