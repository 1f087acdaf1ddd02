"""Scores and extractions over the turns of sessions: (session_id, seq, role, text, char_count)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from loopwright.functions import classifiers as C
from loopwright.functions.text import half_up, sim_overlap_min, split_space, tok_overlap

def by_turn() -> WindowSpec:
    """A session's turns in order."""
    return W.partitionBy("session_id").orderBy("seq")


def turn_features(turns: DataFrame) -> DataFrame:
    """Flags of every turn: correction, approval, frustration, debrief, reprompt; one shuffle by session serves all windows.

    A short turn is frustrated if it follows an assistant turn of over 200 characters and approves of nothing. A reprompt
    shares more than .6 of the smaller word set with the user turn before it, within the first 51 user turns.
    """
    user = F.col("role") == "user"
    low = F.lower("text")
    n = F.size(split_space(F.trim("text")))
    t = turns.withColumns({"prev_role": F.lag("role").over(by_turn()), "prev_chars": F.lag("char_count").over(by_turn())})
    t = t.withColumn("n_user", F.sum(user.cast("int")).over(by_turn().rowsBetween(W.unboundedPreceding, 0)))
    t = t.withColumn("prev_user", F.last(F.when(user, F.col("text")), True).over(by_turn().rowsBetween(W.unboundedPreceding, -1)))
    approval = C.holds(low, C.SESSION_APPROVALS)
    again = sim_overlap_min(tok_overlap(F.col("text")), tok_overlap(F.col("prev_user"))) > 0.6
    return t.withColumns(
        {
            "correction": user & C.holds(low, C.SESSION_CORRECTIONS),
            "approval": user & approval,
            "frustrated": user & (n < 5) & (F.coalesce("prev_role", F.lit("")) == "assistant") & (F.coalesce("prev_chars", F.lit(0)) > 200) & ~approval,
            "debrief": user & F.contains(low, F.lit("/debrief")),
            "reprompt": user & F.col("prev_user").isNotNull() & (F.col("n_user") <= 51) & again,
        }
    )


def assistant_runs(features: DataFrame) -> DataFrame:
    """(session_id, run, n, ended_by_correction): runs of assistant turns between user turns."""
    t = features.withColumn("run", F.sum((F.col("role") != "assistant").cast("int")).over(by_turn().rowsBetween(W.unboundedPreceding, 0)))
    nxt = F.lead("correction").over(by_turn())
    t = t.withColumn("stopped", F.coalesce(nxt, F.lit(False))).where("role = 'assistant'")
    return t.groupBy("session_id", "run").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("seq", "stopped"))["stopped"].alias("ended_by_correction"))


def uninterrupted_runs(features: DataFrame, least: int = 5) -> DataFrame:
    runs = assistant_runs(features)
    return runs.groupBy("session_id").agg(F.count_if((F.col("n") >= least) & ~F.col("ended_by_correction")).alias("runs"))


def session_score(features: DataFrame, runs: DataFrame) -> DataFrame:
    """Score 1 to 10 from 6: corrections, reprompts and frustration cost; approvals, a debrief and a long run pay."""
    count = lambda c: F.count_if(F.col(c)).alias(c + "s")
    g = features.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("humans"), *[count(c) for c in ("correction", "reprompt", "frustrated", "approval")], F.max("debrief").alias("debrief"))
    g = g.join(runs, "session_id", "left").fillna(0, ["runs"])
    score = 6.0 - F.least(0.5 * F.col("corrections"), F.lit(3.0)) - F.least(0.7 * F.col("reprompts"), F.lit(2.0)) - 0.3 * F.col("frustrateds") + F.least(0.4 * F.col("approvals"), F.lit(2.0))
    score = score + F.when(F.col("debrief"), 1.0).otherwise(0.0) + F.when(F.col("runs") > 0, 0.5).otherwise(0.0)
    confidence = F.when(F.col("humans") > 10, 0.9).when(F.col("humans") >= 5, 0.7).otherwise(0.5)
    return g.select("session_id", "corrections", "reprompts", "approvals", half_up(F.greatest(F.lit(1.0), F.least(F.lit(10.0), score)), 1).alias("score"), confidence.alias("confidence"))


def objective_score(sessions: DataFrame) -> DataFrame:
    """(session_id, score) from counts corrections, reprompts, iterations, first_passes, runs, frustrated, total_turns."""
    c = F.greatest(F.col("corrections") / F.greatest("total_turns", F.lit(1)) * -0.5 * 10, F.lit(-3.0))
    s = 5.0 + c + F.greatest(F.col("reprompts") * -0.3, F.lit(-1.5)) - F.col("iterations") * 0.3 + F.col("first_passes") * 1.0 + F.least(F.col("runs") * 0.3, F.lit(1.5)) - F.col("frustrated") * 0.3
    return sessions.select("session_id", half_up(F.greatest(F.lit(1.0), F.least(F.lit(10.0), s)), 1).alias("score"))


def sentiment_gate(sessions: DataFrame, rated: DataFrame) -> DataFrame:
    """Sessions with a correction or a first pass that nobody rated explicitly."""
    return sessions.where((F.col("corrections") > 0) | (F.col("first_passes") > 0)).join(rated.select("session_id").distinct(), "session_id", "left_anti")


def debrief(turns: DataFrame) -> DataFrame:
    """(session_id, turn_index, kind, severity, theme, phrase, context) of corrections and approvals in user turns."""
    last = F.last(F.when(F.col("role") == "assistant", F.col("text")), True).over(by_turn().rowsBetween(W.unboundedPreceding, -1))
    t = turns.withColumn("reply", last).where("role = 'user'").withColumn("turn_index", F.row_number().over(by_turn()) - 1)
    low = F.lower("text")
    theme = C.first_match(low, [("stop|don'?t", "behavioral-correction"), ("wrong|incorrect|not right", "accuracy-error"), ("missed|too much|didn'?t ask", "scope-mismatch")], "general-correction")
    context = F.when(F.col("reply").isNotNull(), F.concat(F.lit("User: "), F.substring("text", 1, 150), F.lit("\nAssistant: "), F.substring("reply", 1, 150))).otherwise(F.substring("text", 1, 300))
    phrase = C.first_phrase(low, C.DEBRIEF_APPROVALS)
    at = F.instr(low, phrase)
    left = F.trim(F.substring(F.col("text"), F.greatest(F.lit(1), at - 80), F.least(F.lit(80), at - 1)))
    c = t.withColumn("severity", C.correction_severity(F.col("text"))).where("severity is not null")
    c = c.select("session_id", "turn_index", F.lit("correction").alias("kind"), "severity", theme.alias("theme"), F.substring("text", 1, 300).alias("phrase"), context.alias("context"))
    a = t.withColumn("phrase", phrase).where("phrase is not null")
    return c.unionByName(a.select("session_id", "turn_index", F.lit("approval").alias("kind"), F.lit(None).cast("int").alias("severity"), F.lit(None).cast("string").alias("theme"), "phrase", left.alias("context")))


def debrief_candidates(found: DataFrame) -> DataFrame:
    """(session_id, theme, frequency, severity) of corrections by theme."""
    g = found.where("kind = 'correction'").groupBy("session_id", "theme").agg(F.count(F.lit(1)).alias("frequency"))
    return g.withColumn("severity", F.when(F.col("frequency") >= 3, 7).when(F.col("frequency") == 2, 5).otherwise(3))


def assertion_audit(messages: DataFrame, key: str = "message_id", text: str = "text") -> DataFrame:
    """(key, place, phrase, has_evidence) of negative assertions; evidence in the two sentences around hides one."""
    s = F.filter(F.split(text, "[.!?\n]+"), lambda x: F.length(F.trim(x)) > 10)
    d = messages.where(F.length(text) >= 20).select(key, F.posexplode(s).alias("place", "sentence"))
    near = F.max(C.any_of(F.col("sentence"), C.EVIDENCE).cast("int")).over(W.partitionBy(key).orderBy("place").rowsBetween(-2, 2)) == 1
    d = d.withColumn("own", C.any_of(F.col("sentence"), C.EVIDENCE)).withColumn("near", near).where(C.any_of(F.col("sentence"), C.ASSERTIONS))
    return d.where("own or not near").select(key, "place", F.substring(F.trim("sentence"), 1, 200).alias("phrase"), F.col("own").alias("has_evidence"))


def harvest(turns: DataFrame, least: int = 20) -> DataFrame:
    """(session_id, seq, kind, category, context): learnings in turns of `least` characters, with the qualifying turn before."""
    t = turns.where(F.length(F.trim("text")) >= least).withColumn("context", F.substring(F.lag("text").over(by_turn()), 1, 200))
    user = F.col("role") == "user"
    problem = C.any_of(F.col("text"), C.HARVEST_ERRORS) & F.col("text").rlike("(?i)fix|solved|resolved|the issue was|problem was")
    kinds = F.array_compact(
        F.array(
            F.when(user & C.any_of(F.col("text"), C.HARVEST_CORRECTIONS), "correction"),
            F.when(~user & problem, "error"),
            F.when(~user & C.any_of(F.col("text"), C.HARVEST_INSIGHTS), "insight"),
        )
    )
    return t.select("session_id", "seq", F.explode(kinds).alias("kind"), C.harvest_category(F.col("text")).alias("category"), "context")


def extract_task(turns: DataFrame) -> DataFrame:
    """(session_id, strategy, score, task): an issue in the first 20 turns, else the best-scored of the first 10 user turns or a
    branch named in the first 40 turns, whichever is surer, else the first user turn, wherever it is."""
    t = turns.withColumn("n", F.row_number().over(by_turn()))
    user = F.col("role") == "user"
    issue = F.coalesce(F.nullif(F.regexp_extract("text", r"gh\s+issue\s+view\s+(\d+)", 1), F.lit("")), F.when(user, F.nullif(F.regexp_extract("text", r"(?:^|\s)#(\d{1,5})(?:\s|$|[.,;!?)])", 1), F.lit(""))))
    branch = F.coalesce(F.nullif(F.regexp_extract("text", r"(?i)(?:checkout|merge|branch)\s+(?:-b\s+)?(\d+-[a-z0-9-]+)", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"\b(\d{2,4}-[a-z][a-z0-9-]{4,})\b", 1), F.lit("")))
    t = t.withColumn("u", F.sum(user.cast("int")).over(by_turn().rowsBetween(W.unboundedPreceding, 0))).withColumns({"issue": F.when(F.col("n") <= 20, issue), "branch": F.when(F.col("n") <= 40, branch), "score": C.message_score(F.col("text"))})
    low = C.holds(F.lower(F.trim("text")), C.GARBAGE)
    best = F.max(F.when(user & (F.col("u") <= 10) & (F.col("score") > 0.3) & ~low, F.struct("score", (-F.col("n")).alias("n"), "text")))
    g = t.groupBy("session_id").agg(F.min(F.when(F.col("issue").isNotNull(), F.struct("n", "issue"))).alias("i"), best.alias("b"), F.min(F.when(F.col("branch").isNotNull(), F.struct("n", "branch"))).alias("r"), F.min(F.when(user, F.struct("n", "text"))).alias("f"))
    row = lambda s, v, x: F.struct(F.lit(s).alias("strategy"), v.alias("score"), x.alias("task"))
    msg = F.when(F.col("b").isNotNull(), row("message", F.least(F.col("b.score"), F.lit(0.8)), F.col("b.text")))
    br = F.when(F.col("r").isNotNull(), row("branch", F.lit(0.7), F.col("r.branch")))
    pick = F.coalesce(F.when(F.col("i").isNotNull(), row("issue", F.lit(0.9), F.concat(F.lit("#"), F.col("i.issue")))), F.when(msg["score"] > F.coalesce(br["score"], F.lit(0.0)), msg), br, msg, F.when(F.col("f").isNotNull(), row("first", F.lit(0.2), F.col("f.text"))))
    return g.select("session_id", pick.alias("p")).where("p is not null").select("session_id", "p.*")


def work_learnings(work: DataFrame) -> DataFrame:
    """Category and insights of completed work (session_id, title, files, tools, agents arrays) where it was significant."""
    text = F.lower(F.concat_ws(" ", "title", F.array_join("tools", " ")))
    w = work.where((F.size("files") > 0) | (F.size("tools") > 5) | (F.size("agents") > 0))
    insights = F.array_compact(F.array(F.when(F.size("files") > 5, "many-files"), F.when(F.size("agents") > 0, "agents"), F.when(F.size("tools") > 10, "heavy-tools")))
    category = F.when(C.any_of(text, C.APPROACH[:6]), "approach").when(C.any_of(text, C.SYSTEM[:3]), "tooling").otherwise("general")
    return w.select("session_id", category.alias("category"), F.size("files").alias("n_files"), F.slice(F.array_distinct("tools"), 1, 20).alias("tools"), insights.alias("insights"))


def work_completion(audit: DataFrame) -> DataFrame:
    """(session_id, n_tools, minutes) of sessions with three audit rows or more."""
    g = audit.groupBy("session_id").agg(F.countDistinct("tool").alias("n_tools"), F.count(F.lit(1)).alias("n"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60_000_000.0).alias("m"))
    return g.where("n >= 3").select("session_id", "n_tools", half_up(F.col("m"), 0).alias("minutes"))
