"""Control loops over small settings; each evaluation is a Spark job, the loop itself holds a few numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.functions.text import half_up


@dataclass(frozen=True)
class Round:
    number: int
    before: float
    after: float
    kept: bool
    reason: str


def too_large(old: str, new: str, share: float = 0.15) -> bool:
    """Whether a change of length passes the share of the old length."""
    return abs(len(new) - len(old)) > share * max(len(old), 1)


def hill_climb(start: str, evaluate: Callable[[str], float], propose: Callable[[str, int], str], rounds: int = 5, jump: float = 0.15) -> tuple[str, list[Round]]:
    """Keeps a proposal if it is strictly better and not too large a change; jumps beyond `jump` are kept but flagged."""
    best, score, log = start, evaluate(start), []
    for i in range(1, rounds + 1):
        new = propose(best, i)
        if too_large(best, new):
            log.append(Round(i, score, score, False, "too large"))
            continue
        value = evaluate(new)
        kept = value > score
        log.append(Round(i, score, value, kept, "flagged" if kept and value - score > jump else "better" if kept else "not better"))
        if kept:
            best, score = new, value
    return best, log


def coordinate_search(start: dict[str, float], evaluate: Callable[[list[dict[str, float]]], list[float]], step: float = 0.25, rounds: int = 20, stall: int = 5, floor: float = 0.76) -> tuple[dict[str, float], float]:
    """Moves one weight after the other by the step, up or else down, and keeps each gain at once; weights stay at 0 or more.

    Both ways of a weight are evaluated in one call, so in one job: after a gain upwards the way down leads back to where it was. Ends after `stall`
    rounds in a row without gain. A best value under the floor gives the start back.
    """
    best, value, idle = dict(start), evaluate([start])[0], 0
    first = value
    for _ in range(rounds):
        gained = False
        for k in start:
            near = [{**best, k: max(0.0, best[k] + d)} for d in (step, -step)]
            near = [w for w in near if w[k] != best[k]]
            for w, got in zip(near, evaluate(near) if near else [], strict=True):
                if got > value:
                    best, value, gained = w, got, True
                    break
        idle = 0 if gained else idle + 1
        if idle >= stall:
            break
    return (best, value) if value >= floor else (dict(start), first)


def worst_traces(traces: DataFrame, scores: DataFrame, n: int = 10, default: float = 2.5) -> DataFrame:
    """The n traces of least mean score, unscored ones at the default."""
    mean = scores.groupBy("trace_id").agg(F.avg("value").alias("mean"))
    return traces.join(mean, "trace_id", "left").withColumn("mean", half_up(F.coalesce("mean", F.lit(default)), 6)).orderBy("mean", "trace_id").limit(n)


def modal_prompt(traces: DataFrame, column: str = "system_prompt") -> DataFrame:
    """One row: the most frequent prompt, the first by text of equals."""
    return traces.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1)


def skill_shape(skills: DataFrame, text: str = "text") -> DataFrame:
    """Counts of headings, bullets, code fences and words of skill documents."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return skills.select("skill", count(r"(?m)^#{1,6} ").alias("headings"), count(r"(?m)^[-*] ").alias("bullets"), (count("(?m)^```") / 2).cast("long").alias("fences"), count(r"\S+").alias("words"))


def compose_rubric(dimensions: DataFrame) -> DataFrame:
    """(name, weight) of rubrics laid over each other: the last of a name holds, weights add up to 1."""
    last = dimensions.groupBy("name").agg(F.max(F.struct("ordinal", "weight"))["weight"].alias("w"))
    whole = W.partitionBy(F.lit(0)).orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return last.select("name", half_up(F.col("w") / F.sum("w").over(whole), 6).alias("weight"))


def rubric_faults(dimensions: list[dict]) -> list[str]:
    """What is wrong with a rubric's structure."""
    faults = [] if dimensions else ["no dimensions"]
    names = [d.get("name") for d in dimensions]
    faults += [f"no name at {i}" for i, n in enumerate(names) if not n] + [f"name twice: {n}" for n in {n for n in names if n and names.count(n) > 1}]
    faults += [f"weight of {d.get('name')} is not positive" for d in dimensions if not d.get("weight") or d["weight"] <= 0]
    total = sum(d.get("weight") or 0 for d in dimensions)
    return faults + ([f"weights add up to {total:g}"] if dimensions and abs(total - 1) > 0.01 else [])
