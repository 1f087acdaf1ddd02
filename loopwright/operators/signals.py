"""Aggregates, trends and patterns over logs of ratings, corrections, skills and tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.functions.classifiers import REBUTTALS, cohort
from loopwright.functions.text import half_up
from loopwright.operators.graph import pairs_in_sessions
from loopwright.operators.matching import first_of_own, match_once


def _age_days(as_of: Column, ts: str = "ts") -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000.0


def dimension_analysis(scores: DataFrame) -> DataFrame:
    g = scores.groupBy("dimension").agg(F.avg("value").alias("a"), F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_pop("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("dimension", half_up(F.col("a"), 2).alias("mean"), "low", "high", half_up(F.col("s"), 2).alias("sd"), "n")


def dimension_trend(scores: DataFrame, as_of: Column, days: int = 7, step: float = 0.3) -> DataFrame:
    """Mean of the last days against the time before; dimensions with both."""
    new = _age_days(as_of) <= days
    g = scores.groupBy("dimension").agg(F.avg(F.when(new, F.col("value"))).alias("recent"), F.avg(F.when(~new, F.col("value"))).alias("prior")).where("recent is not null and prior is not null")
    d = F.col("recent") - F.col("prior")
    return g.select("dimension", half_up(F.col("recent"), 6).alias("recent"), half_up(F.col("prior"), 6).alias("prior"), F.when(d > step, "improving").when(d < -step, "declining").otherwise("stable").alias("trend"))


def weekly_impact(ratings: DataFrame) -> DataFrame:
    """Ratings by a week key counted from January the 1st: mean, number, shares of high (7 up) and low (3 down)."""
    week = F.concat(F.year("ts").cast("string"), F.lit("-W"), F.lpad(F.ceil(F.dayofyear("ts") / 7).cast("string"), 2, "0"))
    g = ratings.groupBy(week.alias("week")).agg(F.avg("rating").alias("a"), F.count(F.lit(1)).alias("n"), F.avg((F.col("rating") >= 7).cast("double")).alias("h"), F.avg((F.col("rating") <= 3).cast("double")).alias("l"))
    return g.select("week", half_up(F.col("a"), 2).alias("mean"), "n", half_up(F.col("h"), 6).alias("high"), half_up(F.col("l"), 6).alias("low"))


def first_last(ratings: DataFrame, n: int = 20, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """One row: mean of the first and of the last n ratings; each side is a top-n, not a global sort."""
    side = lambda cols, name: ratings.orderBy(*cols).limit(n).agg(F.avg("rating").alias(name))
    return side([F.asc(c) for c in order], "first_mean").join(side([F.desc(c) for c in order], "last_mean")).select(half_up(F.col("first_mean"), 6).alias("first_mean"), half_up(F.col("last_mean"), 6).alias("last_mean"))


def tool_audit(audit: DataFrame, flag: float = 0.10) -> DataFrame:
    t = F.coalesce(F.nullif("tool", F.lit("")), F.lit("unknown"))
    g = audit.groupBy(t.alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("errors"))
    rate = F.col("errors") / F.col("calls")
    return g.select("tool", "calls", "errors", half_up(rate, 3).alias("error_rate"), (rate > flag).alias("flagged"))


def performance_summary(ratings: DataFrame, as_of: Column, step: float = 0.5) -> DataFrame:
    """One row: means of today, 7 and 30 days, their number and the trend of 7 against 30 days."""
    age = _age_days(as_of)
    mean = lambda d: F.avg(F.when((age <= d) & (age >= 0), F.col("rating")))
    g = ratings.agg(mean(1).alias("d1"), mean(7).alias("d7"), mean(30).alias("d30"), F.count(F.lit(1)).alias("total"))
    d = F.col("d7") - F.col("d30")
    return g.select(*[half_up(F.col(c), 6).alias(c) for c in ("d1", "d7", "d30")], F.when(d > step, "up").when(d < -step, "down").otherwise("stable").alias("trend"), "total")


def score_trend(ratings: DataFrame, as_of: Column) -> DataFrame:
    """One row: mean of the last 7 days and of the 7 before."""
    age = _age_days(as_of)
    g = ratings.agg(F.avg(F.when(age <= 7, F.col("rating"))).alias("recent"), F.avg(F.when((age > 7) & (age <= 14), F.col("rating"))).alias("prior"))
    return g.select(*[half_up(F.col(c), 6).alias(c) for c in ("recent", "prior")])


def half_trend(ratings: DataFrame, by: str, step: float = 0.5, least: int = 4, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """First half of each group against the rest, in time order, for groups of `least` ratings or more."""
    w = W.partitionBy(by).orderBy(*order)
    d = ratings.withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(by))).where(F.col("n") >= least)
    early = F.col("i") <= F.floor(F.col("n") / 2)
    g = d.groupBy(by).agg(F.avg(F.when(early, F.col("rating"))).alias("early"), F.avg(F.when(~early, F.col("rating"))).alias("late"))
    x = F.col("late") - F.col("early")
    return g.select(by, half_up(F.col("early"), 6).alias("early"), half_up(F.col("late"), 6).alias("late"), F.when(x > step, "improving").when(x < -step, "declining").otherwise("stable").alias("trend"))


def session_snapshot(ratings: DataFrame, corrections: DataFrame, skills: DataFrame) -> DataFrame:
    """Numbers of each signal and the mean rating by session; the three logs are summed before they meet."""
    none = F.lit(None).cast("double")
    rows = ratings.select("session_id", "ts", F.col("rating"), F.lit(0).alias("c"), F.lit(0).alias("s"))
    rows = rows.union(corrections.select("session_id", "ts", none, F.lit(1), F.lit(0))).union(skills.select("session_id", "ts", none, F.lit(0), F.lit(1)))
    g = rows.groupBy("session_id").agg(F.count("rating").alias("n_ratings"), F.sum("c").alias("n_corrections"), F.sum("s").alias("n_skills"), F.avg("rating").alias("a"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return g.select("session_id", "n_ratings", "n_corrections", "n_skills", half_up(F.coalesce("a", F.lit(0.0)), 6).alias("avg_rating"), "first_seen", "last_seen")


def low_rated_with_corrections(snapshot: DataFrame, most: float = 4.0, least: int = 2) -> DataFrame:
    g = snapshot.where((F.col("avg_rating") > 0) & (F.col("avg_rating") <= most) & (F.col("n_corrections") > 0))
    g = g.agg(F.count(F.lit(1)).alias("frequency"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).where(F.col("frequency") >= least)
    return g.withColumn("severity", F.least(F.col("frequency") + 3, F.lit(10)))


def skill_misses(skills: DataFrame, least: int = 2) -> DataFrame:
    """Invocations of skills seen in `least` sessions or more."""
    return skills.groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions")).where(F.col("sessions") >= least)


def score_drop(snapshot: DataFrame, rated: DataFrame, least: float = 1.5) -> DataFrame:
    """One row if the mean of the latest w rated sessions is `least` below that of the w earliest; w is at most 5."""
    s = rated.groupBy("session_id").agg(F.avg("rating").alias("r"), F.min("ts").alias("t"))
    n = s.count()
    w = min(n // 2, 5)
    if n < 4:
        return s.limit(0).select(F.lit(0.0).alias("early"), F.lit(0.0).alias("late"), F.lit(0.0).alias("drop"))
    early = s.orderBy("t", "session_id").limit(w).agg(F.avg("r").alias("early"))
    late = s.orderBy(F.desc("t"), F.desc("session_id")).limit(w).agg(F.avg("r").alias("late"))
    d = early.join(late).withColumn("drop", F.col("early") - F.col("late")).where(F.col("drop") >= least)
    return d.select(*[half_up(F.col(c), 6).alias(c) for c in ("early", "late", "drop")])


def dedupe_patterns(patterns: DataFrame, key: str = "id", order: str = "ordinal") -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc("severity"), order)
    return patterns.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cohorts(patterns: DataFrame) -> DataFrame:
    """(cohort, frequency, severity, rebuttal) of patterns (type, rule, frequency, severity)."""
    c = cohort(F.concat_ws(" ", "type", F.coalesce("rule", F.lit(""))))
    g = patterns.groupBy(c.alias("cohort")).agg(F.sum("frequency").alias("frequency"), half_up(F.avg("severity"), 2).alias("severity"))
    known = F.create_map(*[F.lit(x) for kv in REBUTTALS.items() for x in kv])
    return g.withColumn("rebuttal", F.try_element_at(known, "cohort"))


def incident_patterns(incidents: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """(session_id, error_type, n): kinds seen twice or more in sessions with two incidents or more, within the retention."""
    kept = incidents.where(_age_days(as_of) <= days)
    g = kept.groupBy("session_id", "error_type").agg(F.count(F.lit(1)).alias("n"))
    return g.where("n >= 2")


def weekly_digest(ratings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(week, mean, n) of weeks from Monday, ratings older than `days`."""
    g = ratings.where(_age_days(as_of) > days).groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"))
    return g.agg(half_up(F.avg("rating"), 2).alias("mean"), F.count(F.lit(1)).alias("n"))


def monthly_digest(weeks: DataFrame) -> DataFrame:
    """(month, mean, n, weeks): weekly means weighted by their numbers."""
    g = weeks.groupBy(F.substring("week", 1, 7).alias("month")).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("a"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("weeks"))
    return g.select("month", half_up(F.col("a"), 2).alias("mean"), "n", "weeks")


def usage_counts(skills: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    age = _age_days(as_of)
    return skills.where((age >= 0) & (age <= days)).groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


def volume_drift(events: DataFrame, as_of: Column, limit: float = 0.2) -> DataFrame:
    """One row: events of the last day against a day's share of the last week."""
    age = _age_days(as_of)
    g = events.agg(F.count_if((age >= 0) & (age < 1)).alias("today"), F.count_if((age >= 0) & (age < 7)).alias("week"))
    d = F.try_divide(F.col("today") - F.col("week") / 7, F.col("week") / 7)
    return g.select("today", "week", half_up(d, 6).alias("drift"), (F.abs(d) > limit).alias("alert"))


def session_composite(snapshot: DataFrame, sentiment: DataFrame) -> DataFrame:
    """.4 rating / 10 + .3 max(0, 1 - .5 corrections) + .3 sentiment / 10, with .5 where a part is unknown."""
    s = snapshot.join(sentiment, "session_id", "left")
    a = F.when(F.col("n_ratings") > 0, F.col("avg_rating") / 10).otherwise(0.5)
    b = F.greatest(F.lit(0.0), 1 - 0.5 * F.col("n_corrections"))
    return s.select("session_id", half_up(0.4 * a + 0.3 * b + 0.3 * F.coalesce(F.col("sentiment") / 10, F.lit(0.5)), 6).alias("composite"))


def skill_cooccurrence(skills: DataFrame) -> DataFrame:
    """(a, b, sessions): sessions that used both, each unordered pair once; sessions of very many skills are met in tiles."""
    return pairs_in_sessions(skills, "skill").groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count(F.lit(1)).alias("sessions"))


def skill_usage(skills: DataFrame, ratings: DataFrame) -> DataFrame:
    """Invocations, sessions, mean of the sessions' last ratings, and its distance to sessions without any skill."""
    last = ratings.groupBy("session_id").agg(F.max(F.struct("ts", "event_id", "rating"))["rating"].alias("rating"))
    used = skills.select("session_id").distinct()
    base = last.join(used, "session_id", "left_anti").agg(F.avg("rating").alias("base"))
    n = skills.groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))
    mean = skills.select("skill", "session_id").distinct().join(last, "session_id").groupBy("skill").agg(F.avg("rating").alias("a"))
    return n.join(mean, "skill", "left").join(F.broadcast(base)).select("skill", "n", "sessions", half_up(F.col("a"), 6).alias("avg_rating"), half_up(F.col("a") - F.col("base"), 6).alias("delta"))


def skill_conversion(suggestions: DataFrame, invocations: DataFrame, minutes: int = 30, rows_per_block: int = 200_000) -> DataFrame:
    """(skill, suggested, converted, rate): each invocation is claimed by one suggestion of its skill, first in time order,
    within `minutes`, of the same session first. Claims are matched in blocks of time (match_once), so a skill of any density is spread over tasks."""
    side = lambda d: d.select(F.col("skill").alias("key"), F.col("event_id").alias("id"), "ts", F.col("session_id").alias("who"))
    pairs = match_once(side(suggestions), side(invocations), 0, minutes * 60_000_000, first_of_own, rows_per_block)
    asked = suggestions.select("skill", F.lit(1).alias("s"), F.lit(0).alias("c")).union(pairs.select("key", F.lit(0), F.lit(1)))
    used = invocations.select("skill", F.lit(0), F.lit(0)).distinct()
    g = asked.union(used).groupBy("skill").agg(F.sum("s").alias("suggested"), F.sum("c").alias("converted"))
    return g.withColumn("rate", half_up(F.coalesce(F.try_divide(F.col("converted").cast("double"), F.col("suggested").cast("double")), F.lit(0.0)), 6))


def skill_accuracy(skills: DataFrame, expected: Column) -> DataFrame:
    """One row: sessions whose first skill is the expected one."""
    first = skills.groupBy("session_id").agg(F.min(F.struct("ts", "event_id", "skill"))["skill"].alias("skill"))
    return first.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("skill") == expected).alias("hits"))


def default_domains(history: DataFrame, n: int = 20, k: int = 3, domain: str = "skill") -> DataFrame:
    """The k most frequent domains of the n latest sessions."""
    last = history.groupBy("session_id").agg(F.max("ts").alias("t")).orderBy(F.desc("t"), "session_id").limit(n)
    g = history.join(F.broadcast(last), "session_id").groupBy(domain).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), domain).limit(k)


def pearson_unit(pairs: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(r + 1) / 2 by group; 0 under two rows or without variance."""
    g = pairs.groupBy(by).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    ok = (F.col("n") >= 2) & F.col("r").isNotNull() & ~F.isnan("r")
    return g.select(by, half_up(F.when(ok, (F.col("r") + 1) / 2).otherwise(0.0), 6).alias("score"))


def weighted_dimensions(scores: DataFrame, weights: dict[str, float], by: str) -> DataFrame:
    """Weighted mean over the dimensions that are present."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    s = scores.withColumn("w", F.try_element_at(w, "dimension")).where("w is not null")
    return s.groupBy(by).agg(half_up(F.sum(F.col("w") * F.col("value")) / F.sum("w"), 6).alias("score"))


def calibration(explicit: DataFrame, objective: DataFrame) -> DataFrame:
    """One row: mean absolute distance of first explicit ratings and objective scores by session."""
    first = explicit.groupBy("session_id").agg(F.min(F.struct("ts", "event_id", "rating"))["rating"].alias("rating"))
    return first.join(objective, "session_id").agg(half_up(F.avg(F.abs(F.col("rating") - F.col("score"))), 6).alias("divergence"), F.count(F.lit(1)).alias("n"))
