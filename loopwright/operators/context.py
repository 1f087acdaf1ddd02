"""Rules for a session's context: detection of domains, fused candidates, weights, diversity, filters, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.functions.text import half_up
from loopwright.operators.retrieval import best_of_few, bm25_scores, top_k

#: Weight of a rule by the prefix of its id (1 where none is listed), types that may be injected, files that are no rules.
TYPE_WEIGHTS = {"feedback": 1.0, "steering": 1.0, "success": 0.8, "project": 0.3, "reference": 0.5}
ALLOWED_TYPES = ["feedback", "steering", "success", "learned"]
INDEX_FILES = r"(?i)^(MEMORY|README|INDEX)$"


def detect_domains(queries: DataFrame, seeds: DataFrame, share: float = 0.3, most: int = 3) -> DataFrame:
    """(query_id, domain, score, rank): the domains, of seeds (domain, text), that score `share` of the query's best one by BM25, three at most."""
    few = best_of_few(seeds, queries, 16, "domain")
    if few is not None:
        best = F.array_max(F.transform("best", lambda x: x["score"]))
        near = few.select("query_id", F.explode(F.filter("best", lambda x: (x["score"] >= share * best) & (x["rank"] <= most))).alias("x"))
        return near.select("query_id", F.col("x.doc").alias("domain"), "x.score", "x.rank")
    ranks = top_k(bm25_scores(seeds, queries, "domain"), 16, "query_id", "domain")
    best = F.max("score").over(W.partitionBy("query_id"))
    return ranks.withColumn("best", best).where((F.col("score") >= share * F.col("best")) & (F.col("rank") <= most)).drop("best")


def type_weight(rule_id: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.split(rule_id, "_")[0]), F.lit(1.0))


def query_trajectories(store: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, rating, place): trajectories (id, domains, rating) by overlap of domains with the query's, then rating; the store is small by its rule."""
    w = wanted.select("query_id", "domains", F.explode("domains").alias("d"))
    pairs = w.join(store.select("id", "rating", F.col("domains").alias("own"), F.explode("domains").alias("d")), "d").dropDuplicates(["query_id", "id"])
    score = F.size(F.array_intersect("domains", "own")) / F.size(F.array_union("domains", "own"))
    order = W.partitionBy("query_id").orderBy(half_up(score, 9).desc(), F.desc("rating"), "id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "id", "rating", F.col("place").cast("long").alias("place"))


def context_rules(
    candidates: DataFrame, fallback: DataFrame, nodes: DataFrame, lifts: DataFrame, suppressed: DataFrame, evicted: DataFrame, trajectories: DataFrame, k: int = 10
) -> DataFrame:
    """(query_id, rule_id, score, place, kind): the rules that a session is given.

    Fused candidates (query_id, id, score), or where a query has none its fallback list, are weighed by type and by 1 + lift / 10 (lifts:
    rule_id, lift). Of the domains that stand first in a query's candidates each gives ceil(k / domains) rules at most, and all together k. Only
    then index files, types that may not be injected, suppressed and evicted rules go, so fewer than k may be left; trajectories (query_id, id, rating, place), as
    many as are lacking, fill up, without those that are there already. nodes: (id, type, domains); all ids are strings.
    """
    first = candidates.select("query_id", "id", "score")
    rows = first.unionByName(fallback.select("query_id", "id", "score").join(first.select("query_id").distinct(), "query_id", "left_anti"))
    n = nodes.select("id", "type", F.get("domains", F.lit(0)).alias("domain"))
    d = rows.join(n, "id", "left").join(lifts.select(F.col("rule_id").alias("id"), "lift"), "id", "left")
    d = d.withColumn("score", F.col("score") * type_weight(F.col("id")) * (1 + F.coalesce("lift", F.lit(0.0)) / 10))
    some = F.size(F.collect_set("domain").over(W.partitionBy("query_id")))  # null is no domain, but has places of its own
    order = (half_up(F.col("score"), 9).desc(), "id")
    d = d.withColumn("cap", F.ceil(F.lit(float(k)) / F.greatest(some, F.lit(1)))).withColumn("own", F.row_number().over(W.partitionBy("query_id", "domain").orderBy(*order)))
    top = top_k(d.where(F.col("own") <= F.col("cap")), k, "query_id", "id")
    top = top.where(~F.col("id").rlike(INDEX_FILES) & (F.col("type").isNull() | F.col("type").isin(ALLOWED_TYPES)))
    for gone in (suppressed, evicted):
        top = top.join(gone.select(F.col("rule_id").alias("id")).distinct(), "id", "left_anti")
    rules = top.select("query_id", F.col("id").alias("rule_id"), "score", F.row_number().over(W.partitionBy("query_id").orderBy("rank")).alias("place"), F.lit("rule").alias("kind"))
    held = rules.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    t = trajectories.join(held, "query_id", "left").where(F.col("place") <= k - F.coalesce("n", F.lit(0)))
    t = t.select("query_id", F.col("id").alias("rule_id"), (F.col("rating") / 10).alias("score"), F.coalesce("n", F.lit(0)).alias("n"), "place").join(rules.select("query_id", "rule_id"), ["query_id", "rule_id"], "left_anti")
    at = F.col("n") + F.row_number().over(W.partitionBy("query_id").orderBy("place"))
    t = t.select("query_id", "rule_id", "score", at.alias("place"), F.lit("trajectory").alias("kind"))
    out = rules.unionByName(t)
    return out.select("query_id", "rule_id", half_up(F.col("score"), 9).alias("score"), F.col("place").cast("long").alias("place"), "kind")


def compare_precision(one: DataFrame, two: DataFrame, gold: DataFrame, ks: tuple[int, int] = (5, 10)) -> DataFrame:
    """(query_id, one_5, two_5, delta_5, ...): precision of two ranked lists (query_id, item, rank) against gold (query_id, item), query by query."""
    g = gold.select("query_id", "item").distinct()
    cols = lambda name: [half_up(F.count_if(F.col("rank") <= k) / k, 6).alias(f"{name}_{k}") for k in ks]
    score = lambda d, name: d.join(g, ["query_id", "item"], "left_semi").groupBy("query_id").agg(*cols(name))
    j = g.select("query_id").distinct().join(score(one, "one"), "query_id", "left").join(score(two, "two"), "query_id", "left").fillna(0.0)
    return j.select("query_id", *[F.col(f"{x}_{k}") for k in ks for x in ("one", "two")], *[half_up(F.col(f"two_{k}") - F.col(f"one_{k}"), 6).alias(f"delta_{k}") for k in ks])

