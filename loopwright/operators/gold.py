"""Gold sets and judged scores: targets, siblings, distractors, fallbacks, leakage, one-to-one matching in time, what a judge's answer holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.functions.text import half_up, sim_jaccard
from loopwright.operators.matching import match_once, nearest_free

#: What a transcript is judged on.
DIMENSIONS = ["task_completion", "tool_correctness", "rule_adherence", "coherence", "conciseness"]


def select_targets(nodes: DataFrame, per_domain: int, cap: int) -> DataFrame:
    """(id, domain, place): the most severe nodes of each first domain, domains in order, `cap` in all."""
    d = nodes.select("id", "severity", F.coalesce(F.get("domains", F.lit(0)), F.lit("unknown")).alias("domain"))
    d = d.withColumn("place", F.row_number().over(W.partitionBy("domain").orderBy(F.desc("severity"), "id"))).where(F.col("place") <= per_domain)
    return d.orderBy("domain", "place").limit(cap).select("id", "domain", F.col("place").cast("long").alias("place"))


def siblings(targets: DataFrame, nodes: DataFrame, least: int = 1) -> DataFrame:
    """(target, id, shared): nodes that share `least` domains with a target (id)."""
    own = nodes.join(targets.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("target"), F.explode(F.array_distinct("domains")).alias("d"))
    pairs = own.join(nodes.select("id", F.explode("domains").alias("d")), "d").where("id <> target")
    return pairs.groupBy("target", "id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def distractors(targets: DataFrame, nodes: DataFrame, k: int = 3, seed: int = 5) -> DataFrame:
    """(target, id, place): k nodes of other first domains for each target (id, domain), in one seeded order.

    The first k of all other domains are among the first k of each domain, so only those meet the targets.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    d = nodes.select("id", F.coalesce(F.get("domains", F.lit(0)), F.lit("unknown")).alias("own"), key.alias("key"))
    d = d.withColumn("r", F.row_number().over(W.partitionBy("own").orderBy("key", "id"))).where(F.col("r") <= k)
    domains = d.select("own").distinct()
    other = targets.select("domain").distinct().join(domains, F.col("domain") != F.col("own"))  # pairs of domains, not of nodes
    far = other.join(d, "own").withColumn("place", F.row_number().over(W.partitionBy("domain").orderBy("key", "id"))).where(F.col("place") <= k)
    return targets.select(F.col("id").alias("target"), "domain").join(far, "domain").select("target", "id", F.col("place").cast("long").alias("place"))


def domain_fallback(sessions: DataFrame, nodes: DataFrame, used: DataFrame, most: int = 25) -> DataFrame:
    """(query_id, id, place): for sessions (query_id, domains) the nodes of their domains, the least used (id, n) first, `most` of them."""
    pairs = sessions.select("query_id", F.explode("domains").alias("d")).join(nodes.select("id", F.explode("domains").alias("d")), "d").select("query_id", "id").distinct()
    n = F.coalesce("n", F.lit(0))
    order = W.partitionBy("query_id").orderBy(n, "id")
    return pairs.join(used.select("id", "n"), "id", "left").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "id", F.col("place").cast("long").alias("place"))


def auto_label(labels: DataFrame, sessions: DataFrame, nodes: DataFrame, used: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, id, place, kind): what a classifier named (query_id, id), if it is a node of the session's domains, the least used first; the
    fallback by domain for sessions where nothing is left."""
    valid = labels.select("query_id", "id").distinct().join(sessions, "query_id").join(nodes.select("id", F.col("domains").alias("own")), "id")
    valid = valid.where(F.arrays_overlap("domains", "own")).join(used.select("id", "n"), "id", "left")
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.coalesce("n", F.lit(0)), "id"))
    named = valid.withColumn("place", r).where(F.col("place") <= most).select("query_id", "id", F.col("place").cast("long").alias("place"), F.lit("named").alias("kind"))
    rest = sessions.join(named.select("query_id").distinct(), "query_id", "left_anti")
    return named.unionByName(domain_fallback(rest, nodes, used, most).withColumn("kind", F.lit("domain")))


def leakage(least_chars: int, most: float, text: str = "text", rule: str = "rule") -> Column:
    """What becomes of a generated text beside its rule: too-short, leakage if their words overlap by more than `most`, else kept."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 2))
    return F.when(F.length(text) < least_chars, "too-short").when(sim_jaccard(words(F.col(text)), words(F.col(rule))) > most, "leakage").otherwise("kept")


def match_in_time(entries: DataFrame, sessions: DataFrame, hours: float = 2.0, rows_per_block: int = 200_000) -> DataFrame:
    """(entry_id, session_id, seconds): entries (entry_id, ts), in order of time, each take the nearest session (session_id, ts) that none before took,
    the earlier of equals, if it is nearer than `hours`. Times are matched in blocks (match_once)."""
    width = int(hours * 3_600_000_000)
    side = lambda d, key: d.select(F.lit("").alias("key"), F.col(key).cast("string").alias("id"), "ts", F.lit("").alias("who"))
    pairs = match_once(side(entries, "entry_id"), side(sessions, "session_id"), width, width, nearest_free, rows_per_block)
    at = lambda d, key, name: d.select(F.col(key).cast("string").alias(name), F.unix_micros(F.col("ts").cast("timestamp")).alias(f"{name}_t"))
    timed = pairs.join(at(entries, "entry_id", "asker"), "asker").join(at(sessions, "session_id", "taken"), "taken")
    return timed.select(F.col("asker").alias("entry_id"), F.col("taken").alias("session_id"), (F.abs(F.col("asker_t") - F.col("taken_t")) / 1e6).alias("seconds"))


def judged(answers: DataFrame, key: str = "trace_id", text: str = "text") -> DataFrame:
    """(key, dimension, score, reasoning) in a judge's answers: the JSON object in the text, of which numbers from 1 to 5 count, given plain or as score or value."""
    found = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), "map<string,string>")
    d = answers.select(key, F.explode(found).alias("dimension", "value"))
    inner = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    score = F.coalesce(inner("score", "value").try_cast("double"), F.col("value").try_cast("double"))
    d = d.select(key, "dimension", score.alias("score"), F.coalesce(inner("reasoning", "reason"), F.lit("")).alias("reasoning"))
    return d.where("score between 1 and 5")


def transcript_quality(answers: DataFrame, key: str = "session_id", text: str = "text") -> DataFrame:
    """(key, n_dimensions, overall): scored dimensions of a transcript, and the judge's overall score or else their mean, to one place (0 if there is none)."""
    values = F.filter(F.array(*[F.get_json_object(text, f"$.{d}").try_cast("double") for d in DIMENSIONS]), lambda x: x.between(1, 5))
    d = answers.select(key, values.alias("v"), F.get_json_object(text, "$.overall").try_cast("double").alias("o"))
    mean = F.when(F.size("v") > 0, F.aggregate("v", F.lit(0.0), lambda a, b: a + b) / F.size("v")).otherwise(0.0)
    return d.select(key, F.size("v").cast("long").alias("n_dimensions"), half_up(F.coalesce("o", mean), 1).alias("overall"))


def transcript_tail(transcript: Column, chars: int = 4000) -> Column:
    """What a judge gets to read of a transcript."""
    return F.when(F.length(transcript) > chars, F.substring(transcript, -chars, chars)).otherwise(transcript)


def lesson_sessions(ratings: DataFrame) -> DataFrame:
    """(session_id, kind, avg_rating, comments): sessions rated 4 or less (feedback), 8 or more (success), with their comments in order; those without any are left out."""
    ordered = F.sort_array(F.collect_list(F.when(F.col("comment").isNotNull(), F.struct("ts", "event_id", "comment"))))
    g = ratings.groupBy("session_id").agg(F.avg("rating").alias("a"), F.array_join(F.transform(ordered, lambda x: x["comment"]), "\n").alias("comments"))
    kind = F.when(F.col("a") <= 4, "feedback").when(F.col("a") >= 8, "success")
    return g.withColumn("kind", kind).where((F.length(F.trim("comments")) > 0) & F.col("kind").isNotNull()).select("session_id", "kind", half_up(F.col("a"), 6).alias("avg_rating"), "comments")
