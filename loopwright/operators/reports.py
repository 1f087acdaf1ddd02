"""Report bundles: small unions of checks and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.functions.classifiers import route_tier, staleness
from loopwright.functions.text import half_up
from loopwright.operators.rules import age_days


def _rows(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def extremes(stats: DataFrame, k: int = 5, least: int = 5) -> DataFrame:
    """(side, rule_id, decayed, rank): the k best and worst rules with `least` injections, each side a top-k."""
    s = stats.where(F.col("n") >= least).select("rule_id", "decayed")
    side = lambda name, order: s.orderBy(*order).limit(k).select(F.lit(name).alias("side"), "rule_id", "decayed", F.row_number().over(W.orderBy(*order)).cast("long").alias("rank"))
    return side("top", [F.desc("decayed"), F.asc("rule_id")]).unionByName(side("bottom", [F.asc("decayed"), F.asc("rule_id")]))


def health_alerts(stats: DataFrame, drift: DataFrame, evicted_today: DataFrame) -> DataFrame:
    """(alert, value, level): costly rules, event drift, evictions of the last day."""
    row = lambda d, name, v, bad: d.select(F.lit(name).alias("alert"), v.cast("double").alias("value"), F.when(bad, "red").otherwise("ok").alias("level"))
    costly = stats.agg(F.count_if((F.col("n") > 200) & (F.col("decayed") < 4)).alias("v"))
    gone = evicted_today.agg(F.count(F.lit(1)).alias("v"))
    return _rows([row(costly, "costly-rules", F.col("v"), F.col("v") > 0), row(drift, "volume-drift", F.coalesce("drift", F.lit(0.0)), F.abs("drift") > 0.2), row(gone, "evictions", F.col("v"), F.col("v") > 0)])


def freshness(logs: DataFrame, as_of: Column) -> DataFrame:
    """(log, n, status) by the age of each log's last row (log, ts)."""
    g = logs.groupBy("log").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen"))
    return g.select("log", "n", staleness(age_days(as_of)).alias("status"))


def worst_status(checks: DataFrame) -> DataFrame:
    """One status by section: fail over warn over ok."""
    level = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    g = checks.groupBy("section").agg(F.max(level).alias("l"), F.count(F.lit(1)).alias("checks"))
    return g.select("section", F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), F.col("l") + 1).alias("status"), "checks")


def cross_reference(files: DataFrame, registry: DataFrame, nodes: DataFrame) -> DataFrame:
    """(check, n): ids that one side has and another lacks, and ids in all three."""
    ids = [d.select("id").distinct() for d in (files, registry, nodes)]
    n = lambda d, name: d.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
    f, r, g = ids
    return _rows([n(f.exceptAll(g), "file-without-node"), n(g.exceptAll(f), "node-without-file"), n(r.exceptAll(g), "registry-without-node"), n(f.intersect(r).intersect(g), "everywhere")])


def taxonomy_balance(nodes: DataFrame, most: int = 50, least: int = 3) -> DataFrame:
    d = nodes.select(F.explode("domains").alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("status", F.when(F.col("n") > most, "too-many").when(F.col("n") < least, "too-few").otherwise("ok"))


def inbox(failures: DataFrame, mined: DataFrame, projects: Column) -> DataFrame:
    """(id, rule, frequency, tier): both lists of patterns, an id from the first list where both have it, with its tier."""
    u = failures.withColumn("o", F.lit(0)).unionByName(mined.withColumn("o", F.lit(1)))
    first = u.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("o", F.desc("frequency")))).where("r = 1")
    return first.select("id", "rule", "frequency", route_tier(F.col("rule"), projects).alias("tier"))


def showcase(stats: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: share of rules with a mean of 5 or more, rules a session, number of rules."""
    a = stats.agg(half_up(F.avg((F.col("decayed") >= 5).cast("double")), 6).alias("effective"), F.count(F.lit(1)).alias("rules"))
    b = sessions.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).agg(half_up(F.avg("n"), 6).alias("rules_per_session"))
    return a.join(b)


def baseline(sessions: DataFrame, n: int = 10) -> DataFrame:
    """One row: means over the n latest sessions (session_id, ts, rating, load)."""
    last = sessions.orderBy(F.desc("ts"), "session_id").limit(n)
    return last.agg(F.count(F.lit(1)).alias("sessions"), half_up(F.avg("rating"), 1).alias("rating"), half_up(F.avg("load"), 1).alias("load"))


def pending_expiry(lines: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(doc_id, place, text, expired) of dated sections (`## yyyy-mm-dd ...`), by the age of their date."""
    date = F.regexp_extract("heading", r"(\d{4}-\d{2}-\d{2})", 1)
    d = lines.where(F.length(date) > 0).withColumn("last_seen", date.cast("timestamp"))
    return d.select("doc_id", "section", "heading", (age_days(as_of) > days).alias("expired"))


def stale_links(docs: DataFrame, files: DataFrame, as_of: Column, days: int = 60) -> DataFrame:
    """(doc_id, link, status): Markdown links to files that are missing or old; URLs are left out."""
    links = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)#\s]+)"), 1))
    d = docs.select("doc_id", F.explode(links).alias("link")).where(~F.col("link").rlike("^[a-z]+://"))
    j = d.join(files.select(F.col("name").alias("link"), F.col("modified").alias("last_seen")), "link", "left")
    return j.select("doc_id", "link", F.when(F.col("last_seen").isNull(), "missing").when(age_days(as_of) >= days, "stale").otherwise("fresh").alias("status"))


def failure_steps(failures: DataFrame, steps: DataFrame, k: int = 3) -> DataFrame:
    """(step, pattern, n, rank): the k most frequent failure patterns of each step a skill belongs to."""
    g = failures.join(steps, "skill").groupBy("step", "pattern").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("step").orderBy(F.desc("n"), "pattern"))).where(F.col("rank") <= k)


def recent_errors(incidents: DataFrame, n: int = 5) -> DataFrame:
    """The n kinds of error met last, newest first."""
    return incidents.groupBy("error_type").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("ts"), "error_type").limit(n)
