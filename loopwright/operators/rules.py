"""Rule statistics, eviction, budgets, lifecycle ledgers, effectiveness and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.functions.text import half_up, sim_stem, sim_substr, split_space, tok_eff

DECAY = 0.06931471805599453  # ln 2 / 10


def rule_stats(injections: DataFrame, keep: int = 20) -> DataFrame:
    """By rule: injections, last `keep` ratings in order, decayed and plain mean of these, high (7 up), low (4 down), last seen.

    The decayed mean weighs a rating by exp(-age ln 2 / 10), its age counted from the newest. WindowGroupLimit prunes each
    rule to its last rows before the shuffle.
    """
    rated = injections.where("rating is not null and rating <> 0")
    w = W.partitionBy("rule_id").orderBy(F.desc("ts"), F.desc("session_id"))
    last = rated.withColumn("age", F.row_number().over(w) - 1).where(F.col("age") < keep)
    weight = F.exp(-DECAY * F.col("age"))
    recent = last.groupBy("rule_id").agg((F.sum(F.col("rating") * weight) / F.sum(weight)).alias("decayed"), F.avg("rating").alias("mean"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("age")).alias("o"), "rating"))), lambda x: x["rating"].cast("int").cast("string")), ",").alias("ratings"))
    whole = rated.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rating") >= 7).alias("high"), F.count_if(F.col("rating") <= 4).alias("low"), F.max("ts").alias("last_seen"))
    return whole.join(recent, "rule_id").select("rule_id", "n", half_up(F.col("decayed"), 6).alias("decayed"), half_up(F.col("mean"), 6).alias("mean"), "ratings", "high", "low", "last_seen")


def differential_lift(stats: DataFrame, ratings: DataFrame) -> DataFrame:
    whole = ratings.agg(F.avg("rating").alias("all"))
    return stats.join(F.broadcast(whole)).select("rule_id", half_up(F.col("mean") - F.col("all"), 3).alias("lift"))


def eviction_trigger(n: Column, avg: Column, high: Column, low: Column) -> Column:
    """The first trigger that holds, null for rules under five injections and for rules to keep."""
    return F.when(
        n >= 5,
        F.when((n >= 150) & (avg < 4), "high-injection-low-value").when((n > 50) & (avg < 4), "low-avg-high-volume").when(high == 0, "never-helped").when((low > 2 * high) & (n >= 10), "net-negative-roi"),
    )


def auto_evict(stats: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    s = stats if allow is None else stats.join(allow.select("rule_id").distinct(), "rule_id", "left_anti")
    return s.withColumn("trigger", eviction_trigger(F.col("n"), F.col("decayed"), F.col("high"), F.col("low"))).where("trigger is not null").select("rule_id", "trigger", "n")


def age_days(as_of: Column, ts: str = "last_seen") -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000.0


def eviction_rank(stats: DataFrame, as_of: Column, k: int = 5) -> DataFrame:
    """The k first rules to evict of those with more than five injections: stale ones, low means, many lows, many injections."""
    s = stats.where("n > 5").withColumn("stale", age_days(as_of) > 60)
    order = (F.desc("stale"), F.asc("decayed"), F.desc("low"), F.desc("n"), F.asc("rule_id"))
    top = s.orderBy(*order).limit(k)
    return top.select("rule_id", "stale", "decayed", "low", "n", F.row_number().over(W.orderBy(*order)).cast("long").alias("rank"))


def eviction_candidates(stats: DataFrame, as_of: Column) -> DataFrame:
    """(rule_id, reason): unseen for over 60 days, noisy, rated under 3, or under 4 with ten injections or more."""
    noise = F.col("noise") if "noise" in stats.columns else F.lit(0.0)
    reason = F.when(age_days(as_of) > 60, "stale").when(noise >= 1, "noise").when((F.col("n") >= 5) & (F.col("decayed") < 3), "low-rating").when((F.col("n") >= 10) & (F.col("decayed") < 4), "quality-floor")
    return stats.withColumn("reason", reason).where("reason is not null").select("rule_id", "reason", "decayed")


def budget_status(counts: DataFrame, caps: dict[str, int | None]) -> DataFrame:
    """(tier, n, cap, status) with over, warning within five of the cap, ok; a tier without cap is unbounded."""
    known = [(t, c) for t, c in caps.items()]
    cap = F.coalesce(*[F.when(F.col("tier") == t, F.lit(c).cast("long")) for t, c in known])
    status = F.when(F.col("cap").isNull(), "unbounded").when(F.col("n") > F.col("cap"), "over").when(F.col("n") > F.col("cap") - 5, "warning").otherwise("ok")
    return counts.withColumn("cap", cap).withColumn("status", status)


def budget_excess(candidates: DataFrame, total: int, cap: int, most: int | None = None) -> DataFrame:
    """As many candidates, worst first, as there are rules beyond the cap."""
    excess = max(0, total - cap)
    return candidates.orderBy("decayed", "rule_id").limit(excess if most is None else min(excess, most))


def lifecycle_state(log: DataFrame, valid: tuple[str, ...]) -> DataFrame:
    """(rule_id, state, from_state, changes): the latest valid transition of each rule and the state before it."""
    ok = log.where(F.col("state").isin(*valid))
    w = W.partitionBy("rule_id").orderBy("ts", "seq")
    d = ok.withColumns({"from_state": F.lag("state").over(w), "r": F.row_number().over(W.partitionBy("rule_id").orderBy(F.desc("ts"), F.desc("seq"))), "changes": F.count(F.lit(1)).over(W.partitionBy("rule_id"))})
    return d.where("r = 1").select("rule_id", "state", "from_state", "changes")


def undersampled(stats: DataFrame, states: DataFrame, least: int = 10, terminal: tuple[str, ...] = ("evicted", "graduated")) -> DataFrame:
    return stats.where(F.col("n") < least).join(states.where(F.col("state").isin(*terminal)).select("rule_id"), "rule_id", "left_anti").select("rule_id", "n")


def ledger_undo(ledger: DataFrame, n: int, order: tuple[str, ...]) -> DataFrame:
    """The ledger without its n newest rows, found as a top-n."""
    last = ledger.orderBy(*[F.desc(c) for c in order]).limit(n).select(*order)
    return ledger.join(F.broadcast(last), list(order), "left_anti")


def effectiveness(promotions: DataFrame, corrections: DataFrame) -> DataFrame:
    """(rule_id, before, after, delta, effective): matching corrections (rule_id, ts) on either side of each promotion."""
    j = promotions.join(corrections, "rule_id", "left")
    g = j.groupBy("rule_id").agg(F.count_if(F.col("ts") < F.col("promoted_at")).alias("before"), F.count_if(F.col("ts") >= F.col("promoted_at")).alias("after"))
    return g.select("rule_id", "before", "after", (F.col("after") - F.col("before")).alias("delta"), ((F.col("before") > 0) & (F.col("after") < F.col("before"))).alias("effective"))


def matching_corrections(rules: DataFrame, corrections: DataFrame, least: float = 0.2) -> DataFrame:
    """(rule_id, ts) for rules (rule_id, text) and corrections (correction_id, ts, text) whose words agree, stems included.

    Candidates share a first four letters or a whole word; only they are compared.
    """
    stem = lambda t: F.explode(F.array_distinct(F.transform(t, lambda x: F.substring(x, 1, 4))))
    rl = rules.select("rule_id", tok_eff(F.col("text")).alias("rt"))
    cl = corrections.select("correction_id", "ts", tok_eff(F.col("text")).alias("ct"))
    pairs = rl.select("rule_id", "rt", stem(F.col("rt")).alias("k")).join(cl.select("correction_id", "ts", "ct", stem(F.col("ct")).alias("k")), "k")
    return pairs.where(sim_stem(F.col("rt"), F.col("ct")) >= least).dropDuplicates(["rule_id", "correction_id"]).select("rule_id", "ts")


def nearest_rating(sessions: DataFrame, ratings: DataFrame, hours: int = 24) -> DataFrame:
    """(session_id, rating, seconds): the rating nearest in time within `hours`, the earlier of equals, of equal times the one of the smallest event_id.

    Only the last rating up to a session's time and the first one after it can be nearest. They stand in the session's bucket of `hours`, where one window over both
    sides finds them, or at the near end of the bucket before or after: no session meets ratings pair by pair.
    """
    width = hours * 3600
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    bucket = F.floor(F.col("t") / width)
    first = F.min(F.struct("event_id", "rating"))
    r = ratings.where("ts is not null").groupBy(sec.alias("t")).agg(first.alias("m")).select("t", bucket.alias("b"), F.struct("t", "m.event_id", "m.rating").alias("own"))
    s = sessions.where("ts is not null").select("session_id", sec.alias("t")).withColumn("b", bucket)
    ends = r.groupBy("b").agg(F.min("own").alias("head"), F.max("own").alias("tail"))
    none = F.lit(None).cast(r.schema["own"].dataType)
    both = r.select("b", "t", F.lit(0).alias("asks"), "own", F.lit(None).cast(s.schema["session_id"].dataType).alias("session_id"))
    both = both.union(s.select("b", "t", F.lit(1).alias("asks"), none.alias("own"), "session_id"))
    # a rating of the session's own time stands before it; both windows run on from row to row
    up, down = W.partitionBy("b").orderBy("t", "asks"), W.partitionBy("b").orderBy(F.desc("t"), F.desc("asks"))
    last = lambda w: F.last("own", True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    near = both.withColumns({"before": last(up), "after": last(down)}).where("asks = 1")
    near = near.join(ends.select((F.col("b") + 1).alias("b"), "tail"), "b", "left").join(ends.select((F.col("b") - 1).alias("b"), "head"), "b", "left")
    d = lambda c: F.abs(F.col("t") - F.col(f"{c}.t"))
    found = near.select("session_id", "t", F.coalesce("before", "tail").alias("x"), F.coalesce("after", "head").alias("y"))
    both = F.least(*[F.when(d(c) < width, F.struct(d(c).alias("d"), F.col(f"{c}.t").alias("c"), F.col(f"{c}.event_id").alias("event_id"), F.col(f"{c}.rating").alias("rating"))) for c in ("x", "y")])
    best = found.groupBy("session_id").agg(F.min(both).alias("m")).where("m is not null")
    return best.select("session_id", F.col("m.rating").alias("rating"), half_up(F.col("m.d"), 3).alias("seconds"))


def attribution(rules: DataFrame, corrections: DataFrame, least: float = 0.3) -> DataFrame:
    """(session_id, rule_id, score, proximity): a session's score less .5 for each near correction, held in 1 to the score.

    rules: (session_id, rule_id, terms, session_score); corrections: (session_id, correction_id, terms). Proximity is the sum over shared terms
    of 2.5 tf / (tf + 1.5) ln 2 over the rule's number of terms.
    """
    from loopwright.operators.retrieval import session_bm25

    c = corrections.select("session_id", F.col("correction_id").alias("c"), F.explode("terms").alias("t")).groupBy("session_id", "c", "t").agg(F.count(F.lit(1)).alias("tf"))
    r = rules.select("session_id", "rule_id", "session_score", F.size("terms").alias("n"), F.explode(F.array_distinct("terms")).alias("t"))
    sim = r.join(c, ["session_id", "t"]).groupBy("session_id", "rule_id", "c").agg((F.sum(session_bm25(F.col("tf"))) / F.first("n")).alias("sim"))
    hit = sim.groupBy("session_id", "rule_id").agg(F.count_if(F.col("sim") > least).alias("k"), F.max("sim").alias("proximity"))
    out = rules.select("session_id", "rule_id", "session_score").join(hit, ["session_id", "rule_id"], "left").fillna(0, ["k"]).fillna(0.0, ["proximity"])
    score = F.greatest(F.lit(1.0), F.least(F.col("session_score"), F.col("session_score") - 0.5 * F.col("k")))
    return out.select("session_id", "rule_id", half_up(score, 6).alias("score"), half_up(F.col("proximity"), 6).alias("proximity"))


def promotion_gate(candidates: DataFrame, as_of: Column, free: int, cooling_days: int = 7) -> DataFrame:
    """(rule_id, status): cooling, over-budget beyond the `free` first, contradiction, or promote."""
    cooling = F.coalesce(age_days(as_of, "last_promoted") < cooling_days, F.lit(False))
    d = candidates.withColumn("cooling", cooling)
    first = d.where("not cooling").select(F.col("rule_id").alias("first")).orderBy("first").limit(free)
    d = d.join(first, F.col("rule_id") == F.col("first"), "left")
    return d.select("rule_id", F.when(F.col("cooling"), "cooling").when(F.col("first").isNull(), "over-budget").when(F.col("contradicts"), "contradiction").otherwise("promote").alias("status"))


def reconcile(stats: DataFrame, load: DataFrame) -> DataFrame:
    """Three checks as rows: rules a session holds (20 at most), telemetry there at all, rules that cost more than they give."""
    checks = [
        load.agg(F.lit("injected").alias("name"), F.max("n").cast("double").alias("value")).withColumn("status", F.when(F.col("value") <= 20, "ok").otherwise("fail")),
        load.agg(F.lit("telemetry").alias("name"), F.sum("n").cast("double").alias("value")).withColumn("status", F.when(F.col("value") > 0, "ok").otherwise("fail")),
        stats.agg(F.lit("roi").alias("name"), F.count_if((F.col("n") >= 100) & (F.col("decayed") < 3)).cast("double").alias("value")).withColumn("status", F.when(F.col("value") == 0, "ok").otherwise("warn")),
    ]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


def similar_nodes(episodes: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(episode_id, id, sim): nodes whose text holds most of an episode's words. Candidates come from shared words."""
    from loopwright.functions.text import tok_cons

    e = episodes.select("episode_id", tok_cons(F.col("text")).alias("t"))
    cand = e.select("episode_id", "t", F.explode(F.array_distinct("t")).alias("w")).join(nodes.select("id", "description", F.explode(F.array_distinct(tok_cons(F.col("description")))).alias("w")), "w")
    cand = cand.dropDuplicates(["episode_id", "id"]).withColumn("sim", sim_substr(F.col("t"), F.col("description"))).where("sim > 0")
    w = W.partitionBy("episode_id").orderBy(half_up(F.col("sim"), 9).desc(), "id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("episode_id", "id", half_up(F.col("sim"), 6).alias("sim"), "rank")


def trajectories(rows: DataFrame, keep: int = 100) -> DataFrame:
    return rows.orderBy(F.desc("rating"), F.desc("ts"), "id").limit(keep)


def relevance_noise(injected: DataFrame, relevance: str = "relevance", least: float = 0.1) -> DataFrame:
    """(rule_id, noise): .1 for each injection of a rule with relevance under `least`."""
    return injected.groupBy("rule_id").agg(half_up(F.sum(F.when(F.col(relevance) < least, 0.1).otherwise(0.0)), 6).alias("noise"))


def retrieval_quality(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (3, 5, 10, 15)) -> DataFrame:
    """By query: recall@k, precision@5 over 5, precision@5 over what was retrieved, reciprocal rank. Gold: (query_id, item).

    Queries without gold have recall 0; queries without results too.
    """
    g = gold.select("query_id", "item").distinct()
    n = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = ranked.select("query_id", "item", "rank").join(g.withColumn("hit", F.lit(1)), ["query_id", "item"], "left")
    at = lambda k: F.count_if((F.col("rank") <= k) & F.col("hit").isNotNull())
    m = hits.groupBy("query_id").agg(*[at(k).alias(f"h{k}") for k in {*ks, 5}], F.count_if(F.col("rank") <= 5).alias("got5"), F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first"))
    d = n.join(m, "query_id", "left").fillna(0)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    rr = zero(F.when(F.col("first") > 0, 1.0 / F.col("first")))
    return d.select("query_id", *[half_up(zero(F.try_divide(F.col(f"h{k}").cast("double"), F.col("n_gold").cast("double"))), 6).alias(f"recall_{k}") for k in ks], half_up(F.col("h5") / 5, 6).alias("precision_5"), half_up(zero(F.try_divide(F.col("h5").cast("double"), F.col("got5").cast("double"))), 6).alias("precision_5_got"), half_up(rr, 6).alias("rr"))


def aggregate_quality(quality: DataFrame) -> DataFrame:
    return quality.agg(*[half_up(F.avg(c), 6).alias(c) for c in quality.columns if c != "query_id"], F.count(F.lit(1)).alias("n"))


def cluster_recall(ranked: DataFrame, gold: DataFrame, neighbours: DataFrame, classes: DataFrame, k: int = 5) -> DataFrame:
    """Recall and reciprocal rank where a retrieved item brings its neighbours at its own rank.

    Items of one class (item, lead) are neighbours of each other, and of all items of the classes that neighbours (item, other), pairs of leads both ways, join to theirs. Ranks
    travel from class to class, and only items of the gold set look theirs up, so classes are not expanded into pairs.
    """
    own = ranked.select("query_id", "item", "rank")
    least = F.min("rank").alias("rank")
    at = own.join(classes, "item").groupBy("query_id", "lead").agg(least)
    via = at.join(neighbours, F.col("lead") == F.col("item")).select("query_id", F.col("other").alias("lead"), "rank")
    told = at.union(via.select(at.columns)).groupBy("query_id", "lead").agg(least)
    g = gold.select("query_id", "item").distinct()
    brought = g.join(classes, "item").join(told, ["query_id", "lead"]).select("query_id", "item", "rank")
    best = own.union(brought).groupBy("query_id", "item").agg(least)
    return retrieval_quality(best, g, (k,)).select("query_id", f"recall_{k}", "rr")


def domain_recall(retrieved: DataFrame, pool: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, expected, hits, recall): items of the pool that share a domain with the query; 1 if none is expected."""
    w = wanted.select("query_id", F.explode("domains").alias("d"))
    exp = pool.select("item", F.explode("domains").alias("d")).join(w, "d").select("query_id", "item").distinct()
    hit = exp.join(retrieved.select("query_id", "item").distinct(), ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    n = exp.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    d = wanted.select("query_id").join(n, "query_id", "left").join(hit, "query_id", "left").fillna(0)
    return d.select("query_id", "expected", "hits", half_up(F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("expected").cast("double")), F.lit(1.0)), 3).alias("recall"))


def regression_gate(mean: float, watermark: float | None, drop: float = 0.05) -> tuple[bool, float]:
    """(passed, new watermark): a pass stores the new mean, even a lower one."""
    failed = watermark is not None and watermark - mean >= drop
    return not failed, watermark if failed else mean


def majority_vote(samples: DataFrame) -> DataFrame:
    """(skill, pass_rate): share of criteria that most samples (skill, criterion, passed) pass."""
    v = samples.groupBy("skill", "criterion").agg((F.avg(F.col("passed").cast("double")) > 0.5).alias("ok"))
    return v.groupBy("skill").agg(half_up(F.avg(F.col("ok").cast("double")), 6).alias("pass_rate"))


def weight_grid(lists: dict[str, DataFrame], gold: DataFrame, grid: DataFrame, k: int = 5) -> DataFrame:
    """Mean precision@k of rank fusion under every row of weights, in one job: the grid is a bounded table of settings."""
    rows = None
    for name, d in lists.items():
        one = d.select("query_id", "item", (1.0 / (60 + F.col("rank"))).alias("x"), F.lit(name).alias("list"))
        rows = one if rows is None else rows.union(one)
    long = grid.select("setting", F.explode(F.create_map(*[y for n in lists for y in (F.lit(n), F.col(n))])).alias("list", "w"))
    s = rows.join(F.broadcast(long), "list").groupBy("setting", "query_id", "item").agg(F.sum(F.col("x") * F.col("w")).alias("score"))
    w = W.partitionBy("setting", "query_id").orderBy(half_up(F.col("score"), 12).desc(), "item")
    top = s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    hit = top.join(gold.select("query_id", "item").distinct().withColumn("h", F.lit(1)), ["query_id", "item"], "left")
    per = hit.groupBy("setting", "query_id").agg((F.count("h") / k).alias("p"))
    n = gold.select("query_id").distinct()
    return grid.select("setting").join(n).join(per, ["setting", "query_id"], "left").groupBy("setting").agg(half_up(F.avg(F.coalesce("p", F.lit(0.0))), 6).alias("precision"))


def word_count_name(texts: DataFrame, by: str, stops: list[str], k: int = 4) -> DataFrame:
    """(by, name): the k most frequent words of each group, joined by hyphens."""
    w = texts.select(by, F.explode(F.filter(split_space(F.lower("text")), lambda t: (F.length(t) > 3) & ~t.isin(*stops))).alias("t")).groupBy(by, "t").agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "t"))
    return w.withColumn("r", r).where(F.col("r") <= k).groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), "-").alias("name"))
