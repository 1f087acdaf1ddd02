"""Learned and critical rule lists: names matched with statistics, candidates to evict, pruning, gaps in reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.functions.classifiers import normal_id
from loopwright.operators.iterate import cut
from loopwright.operators.retrieval import if_small
from loopwright.operators.rules import age_days


def named_stats(names: DataFrame, stats: DataFrame) -> DataFrame:
    """(name, rule_id) of names (name) with a rule of that id or else of that normalised id, the first of several."""
    exact = names.select("name").distinct().join(stats.select("rule_id"), F.col("name") == F.col("rule_id")).select("name", "rule_id", F.lit(0).alias("how"))
    n = names.select("name", normal_id(F.col("name")).alias("key")).distinct()
    near = n.join(stats.select("rule_id", normal_id(F.col("rule_id")).alias("key")), "key").select("name", "rule_id", F.lit(1).alias("how"))
    return exact.union(near).groupBy("name").agg(F.min(F.struct("how", "rule_id"))["rule_id"].alias("rule_id"))


def containing(long: DataFrame, short: DataFrame) -> DataFrame:
    """(a, b) of rows (a, x) and (b, y) where the text x holds the text y, which is not empty.

    A part of x equals y exactly then, so parts that are as long as some y meet the different y by equality: the work follows the rows and the lengths of
    texts, however many texts begin alike. Parts travel as hashes; the texts confirm.
    """
    y = short.where(F.length("y") > 0)
    kinds = y.select("y").distinct().withColumns({"h": F.xxhash64("y"), "n": F.length("y")})
    sizes = kinds.agg(F.collect_set("n").alias("sizes"))  # lengths of texts: few, as their longest is long at most
    parts = F.flatten(F.transform("sizes", lambda n: F.transform(F.sequence(F.lit(1), F.length("x") - n + 1), lambda i: F.xxhash64(F.substring(F.col("x"), i, n)))))
    x = long.select("x").distinct().join(F.broadcast(sizes)).withColumn("sizes", F.filter("sizes", lambda n: n <= F.length("x")))
    met = x.select("x", F.explode(F.array_distinct(parts)).alias("h")).join(if_small(kinds.select("y", "h")), "h").where(F.contains("x", "y")).select("x", "y")
    return long.select("a", "x").join(met, "x").join(y.select("b", "y"), "y").select("a", "b").distinct()


def fuzzy_names(nodes: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """(name, id): for each name (name) the first node (id, text) of whose words over three letters it holds more than `least`."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) > 3)
    n = nodes.select("id", words.alias("w")).where(F.size("w") > 0)
    each = n.select("id", F.posexplode("w").alias("p", "y")).select(F.struct("id", "p").alias("b"), "y")
    found = containing(names.select(F.col("name").alias("a"), F.lower("name").alias("x")).distinct(), each)
    share = found.groupBy(F.col("a").alias("name"), F.col("b.id").alias("id")).agg(F.count(F.lit(1)).alias("k")).join(n, "id")
    return share.where(F.col("k") / F.size("w") > least).groupBy("name").agg(F.min("id").alias("id"))


def critical_names(docs: DataFrame, text: str = "text") -> DataFrame:
    """(name) of the rules that stand in the section of critical rules."""
    body = F.regexp_extract(text, r"(?ms)^### Critical Rules\b[^\n]*\n(.*?)(?=^## |^### |^---|\z)", 1)
    return docs.select(F.explode(F.regexp_extract_all(body, F.lit(r"(?m)^- \*\*(.+?)(?:\s*\(from\s.*?\))?:\*\*"), 1)).alias("n")).select(F.trim("n").alias("name"))


def critical_candidates(names: DataFrame, stats: DataFrame, as_of: Column, least: int = 5) -> DataFrame:
    """(rule_id, reason, decayed, human) of critical rules with `least` injections that are stale, low or under the floor; a person decides on each."""
    s = named_stats(names, stats).join(stats.where(F.col("n") >= least), "rule_id")
    low, floor = F.col("decayed") < 3, (F.col("n") >= 10) & (F.col("decayed") < 4)
    reason = F.when(age_days(as_of) > 60, "critical-stale").when(low, "critical-low-correlation").when(floor, "critical-below-quality-floor")
    return s.withColumn("reason", reason).where("reason is not null").select(F.col("name").alias("rule_id"), "reason", "decayed", F.lit(True).alias("human"))


def learned_candidates(entries: DataFrame, stats: DataFrame, chosen: DataFrame, as_of: Column, least: int = 5) -> DataFrame:
    """(rule_id, reason, decayed): learned entries (name, dated) with bad statistics whose rule is not `chosen` already, and entries
    over 60 days old that no statistic knows. Entries without a date are never untracked."""
    known = named_stats(entries.select("name"), stats)
    s = known.join(stats, "rule_id").join(chosen.select("rule_id").distinct(), "rule_id", "left_anti")
    reason = F.when(age_days(as_of) > 60, "stale-learned").when((F.col("n") >= least) & (F.col("decayed") < 3), "low-learned")
    bad = s.withColumn("reason", reason).where("reason is not null").select(F.col("name").alias("rule_id"), "reason", "decayed")
    old = entries.where("dated is not null").withColumn("day", F.try_to_timestamp("dated", F.lit("yyyy-MM-dd"))).where(age_days(as_of, "day") > 60)
    none = old.join(known.select("name"), "name", "left_anti").select(F.col("name").alias("rule_id"), F.lit("untracked").alias("reason"), F.lit(0.0).alias("decayed"))
    return bad.unionByName(none.distinct())


def prune_learned(entries: DataFrame, stats: DataFrame, cap: int) -> DataFrame:
    """(name, score): as many entries (name, place) as there are beyond the cap, those of least mean first (0 where unknown), then of least place."""
    excess = max(0, entries.count() - cap)
    s = named_stats(entries, stats).join(stats.select("rule_id", "decayed"), "rule_id").select("name", "decayed")
    scored = entries.join(s, "name", "left").select("name", "place", F.coalesce("decayed", F.lit(0.0)).alias("score"))
    return scored.orderBy("score", "place", "name").limit(excess).select("name", "score")


def prune_to_budget(ranked: DataFrame, listed: DataFrame, total: int, cap: int, most: int = 10) -> DataFrame:
    """(rule_id): rules to remove until the budget holds, `most` at once: by rank if there are ranked ones, else the last listed (rule_id, place)."""
    excess = max(0, min(total - cap, most))
    if ranked.limit(1).count():
        return ranked.orderBy("rank").limit(excess).select("rule_id")
    return listed.orderBy(F.desc("place")).limit(excess).select("rule_id")


def apply_evictions(candidates: DataFrame, present: DataFrame, critical: DataFrame) -> DataFrame:
    """(rule_id, status): flagged ones wait for a person, critical ones are demoted to the learned list, others evicted if they are there."""
    j = candidates.join(critical.select("rule_id").distinct().withColumn("c", F.lit(True)), "rule_id", "left").join(present.select("rule_id").distinct().withColumn("p", F.lit(True)), "rule_id", "left")
    status = F.when(F.col("human"), "skipped").when(F.col("c"), "demoted").when(F.col("p"), "evicted").otherwise("not-found")
    return j.select("rule_id", status.alias("status"))


def graduated(names: DataFrame, stats: DataFrame, states: DataFrame) -> DataFrame:
    """(rule_id, name): for each critical name the first rule without a state whose normalised id equals, holds or is held by the name's."""
    open_ = stats.join(states.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", normal_id(F.col("rule_id")).alias("k"))
    n = names.select("name", normal_id(F.col("name")).alias("k")).distinct()
    one = containing(open_.select(F.col("rule_id").alias("a"), F.col("k").alias("x")), n.select(F.col("name").alias("b"), F.col("k").alias("y"))).select(F.col("b").alias("name"), F.col("a").alias("rule_id"))
    two = containing(n.select(F.col("name").alias("a"), F.col("k").alias("x")), open_.select(F.col("rule_id").alias("b"), F.col("k").alias("y"))).select(F.col("a").alias("name"), F.col("b").alias("rule_id"))
    return one.union(two).groupBy("name").agg(F.min("rule_id").alias("rule_id"))


def backfill(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(name, rule_id, avg): learned entries (name) for which no rule file (id) holds the entry's id or is held by it, seeded with a mean of 5."""
    e = entries.select("name", normal_id(F.col("name")).alias("k")).distinct()
    f = files.select("id", normal_id(F.col("id")).alias("k"))
    one = containing(f.select(F.col("id").alias("a"), F.col("k").alias("x")), e.select(F.col("name").alias("b"), F.col("k").alias("y"))).select(F.col("b").alias("name"))
    two = containing(e.select(F.col("name").alias("a"), F.col("k").alias("x")), f.select(F.col("id").alias("b"), F.col("k").alias("y"))).select(F.col("a").alias("name"))
    return e.join(one.union(two).distinct(), "name", "left_anti").select("name", F.col("k").alias("rule_id"), F.lit(5.0).alias("avg"))


def gap_patterns(reports: DataFrame, known: DataFrame, report: str = "report_id", text: str = "text") -> DataFrame:
    """(report, name, slug, theme, rule) of the patterns that a report marks as new gaps, without slugs that are known (slug) and each slug once."""
    blocks = reports.select(report, F.explode(F.split(text, r"(?=###\s+Pattern\s+\d+:)")).alias("b"))
    blocks = blocks.where(F.contains("b", F.lit("**Existing feedback memory:** NONE — NEW GAP")))
    part = lambda p: F.nullif(F.trim(F.regexp_extract("b", p, 1)), F.lit(""))
    flat = lambda c: F.regexp_replace(c, "\n", " ")
    d = blocks.select(
        report,
        part(r"###\s+Pattern\s+\d+:\s+(.+)").alias("name"),
        flat(part(r"(?s)\*\*Common theme:\*\*\s+(.+?)(?=\n\n|\n\*\*)")).alias("theme"),
        flat(part(r"(?s)\*\*Suggested rule:\*\*\s+(.+?)(?=\n\n###|\n---|\n\*Generated|\z)")).alias("rule"),
    ).where("name is not null and theme is not null and rule is not null")
    clean = F.regexp_replace(F.regexp_replace(F.lower("name"), r"[^a-z0-9\s-]", ""), r"\s+", "-")
    d = d.withColumn("slug", F.substring(F.regexp_replace(F.regexp_replace(clean, "-+", "-"), "^-|-$", ""), 1, 50))
    once = d.groupBy("slug").agg(F.min(F.struct(report, "name", "theme", "rule")).alias("m")).join(known.select("slug"), "slug", "left_anti")
    return once.select(F.col(f"m.{report}").alias(report), F.col("m.name").alias("name"), "slug", F.col("m.theme").alias("theme"), F.col("m.rule").alias("rule"))


def by_domain(nodes: DataFrame, k: int = 5) -> DataFrame:
    """(domain, n, id, place): the first rules of each domain and how many it has."""
    d = nodes.select("id", F.explode("domains").alias("domain"))
    n = d.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    top = d.withColumn("place", F.row_number().over(W.partitionBy("domain").orderBy("id"))).where(F.col("place") <= k)
    return top.join(n, "domain").select("domain", "n", "id", F.col("place").cast("long").alias("place"))


def tier_counts(rules: DataFrame) -> DataFrame:
    """(tier, domain, n): rules of each tier (domain null), and those of the graph tier by domain."""
    whole = rules.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).select("tier", F.lit(None).cast("string").alias("domain"), "n")
    return whole.union(rules.where("tier = 'graph'").select("tier", F.explode("domains").alias("domain")).groupBy("tier", "domain").agg(F.count(F.lit(1)).alias("n")))


def pattern_diff(mined: DataFrame, seeds: DataFrame) -> DataFrame:
    """(domain, term, side): terms (domain, term) that are mined only or seeds only, whatever their case."""
    low = lambda d: d.select("domain", F.lower("term").alias("term")).distinct()
    a, b = cut(low(mined)), cut(low(seeds))  # each is read twice
    return a.join(b, ["domain", "term"], "left_anti").withColumn("side", F.lit("added")).union(b.join(a, ["domain", "term"], "left_anti").withColumn("side", F.lit("removed")))
