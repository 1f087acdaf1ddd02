"""The fixture tables seen as the entities of the operators; the only module that knows the fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def turns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    return t.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("char_count", F.length("text"))


def events(spark: SparkSession, d: str) -> DataFrame:
    week = F.date_format(F.date_trunc("week", "ts"), "yyyyMMdd")
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "event_type", "value", F.concat_ws("-", F.col("user_id").cast("string"), week).alias("session_id"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    rating = 1 + F.pmod(F.floor(F.col("value") * 100), F.lit(91)) / 10
    return events(spark, d).where("event_type = 'purchase'").select("event_id", "ts", "session_id", rating.alias("rating"))


def corrections(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'error'").select("event_id", "ts", "session_id", F.concat(F.lit("E"), F.col("k") % 7).alias("error_type"))


def invocations(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'click'").select("event_id", "ts", "session_id", F.concat(F.lit("skill-"), F.col("k") % 20).alias("skill"))


def suggestions(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'signup'").select("event_id", "ts", "session_id", F.concat(F.lit("skill-"), F.col("k") % 20).alias("skill"))


def tool_audit(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("ts", "session_id", F.col("event_type").alias("tool"), (F.col("value") < 200).alias("ok"))


def injections(spark: SparkSession, d: str) -> DataFrame:
    """Rules injected into sessions, with the session's rating: parts in orders."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), (2.0 * F.substring("o_orderpriority", 1, 1).cast("double")).alias("rating"))
    i = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    i = i.repartition(1 + i.count() // 500_000, "l_orderkey").distinct()  # a bounded number of rows for a task
    return i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("rule_id"), F.col("l_orderkey").alias("session_id"), "ts", "rating")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("domains"), F.col("text").alias("description"), (1 + F.col("doc_id") % 5).alias("severity"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("dimension"), (F.col("l_quantity") / 10).alias("value"), F.col("l_shipdate").alias("ts"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: The same entities for DuckDB, as common table expressions.
SQL = {
    "ev": "ev AS (SELECT event_id, ts, event_type, value, user_id::VARCHAR || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS session_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)",
    "ratings": "ratings AS (SELECT event_id, ts, session_id, 1 + (CAST(floor(value * 100) AS BIGINT) % 91) / 10.0::DOUBLE AS rating FROM ev WHERE event_type = 'purchase')",
    "corr": "corr AS (SELECT event_id, ts, session_id, 'E' || (k % 7) AS error_type FROM ev WHERE event_type = 'error')",
    "inv": "inv AS (SELECT event_id, ts, session_id, 'skill-' || (k % 20) AS skill FROM ev WHERE event_type = 'click')",
    "sug": "sug AS (SELECT event_id, ts, session_id, 'skill-' || (k % 20) AS skill FROM ev WHERE event_type = 'signup')",
    "inj": "inj AS (SELECT l_partkey AS rule_id, l_orderkey AS session_id, o_orderdate AS ts, 2.0::DOUBLE * CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS rating FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey)",
    "turns": "turns AS (SELECT conv_id AS session_id, turn AS seq, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS char_count FROM conversations WHERE role IN ('user', 'assistant'))",
    "tok": "tok AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'), lambda t: length(t) >= 2) AS t FROM documents)",
    "post": "post AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL)",
    "stat": "stat AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM tok)",
    "vocab": "vocab AS (SELECT term, count(*) AS df, ln((any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM post, stat GROUP BY term)",
    "qt": "qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'), lambda t: length(t) >= 2)) AS term FROM benchmark) GROUP BY ALL)",
    "bm": "bm AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS score FROM post JOIN qt USING (term) JOIN vocab USING (term), stat GROUP BY ALL)",
    "bmr": "bmr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5::DOUBLE) DESC, doc_id) AS rank FROM bm)",
}
BM25 = ["tok", "post", "stat", "vocab", "qt", "bm", "bmr"]


def sql(names: list[str], body: str, more: list[str] | None = None) -> str:
    """A statement over the entities by name, and further expressions."""
    return "WITH " + ",\n".join([*[SQL[n] for n in names], *(more or [])]) + "\n" + body


def r(x: str, k: int = 6) -> str:
    """Rounding as half_up does it."""
    return f"floor(({x}) * 1e{k}::DOUBLE + 0.5::DOUBLE) / 1e{k}::DOUBLE"
