"""Operators whose result depends on an order over all rows, spread over tasks: labels given one node after the other, edge strengths folded over a
history of ratings, and draws that add up over partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.functions.text import half_up
from loopwright.operators.iterate import cut

#: How much a neighbour's vote counts by relationship; others do not vote.
VOTES = {"co_occurred": 1.0, "reinforces": 1.5, "sibling": 0.8, "caused_by_same_root": 1.2, "caused_by": 1.0, "applies_when": 0.8, "co_occurred_in_failure": 0.8, "supersedes": 0.5}


def propagate_labels(nodes: DataFrame, edges: DataFrame, taxonomy: Sequence[str] | None = None, rounds: int = 10, rows_per_task: int = 50_000) -> DataFrame:
    """(id, domain, source) with votes of labelled neighbours, node after node in the order of ids, each label voting as soon as it is given.

    A node without a label (no domain, or an empty first one) takes the domain of most weight, 2 at least, if two of its edges or more lead to labelled nodes; a neighbour
    votes for all of its domains. Of equal weights the domain counts that the first edge, in the order of (src, dst), votes for. Rounds end when
    one changes nothing, or after `rounds`.

    In a round, a label depends on labels of the round before and on those that smaller ids were just given. Ids are cut into ranges, and each
    range is worked through in order with what it assumes of the others: nothing at first, then what they gave. When no range gives
    anything else than was assumed, the round is what a single pass would be, since the smallest id that differs from it would have been put right.
    """
    weight = F.create_map(*[F.lit(x) for kv in VOTES.items() for x in kv])
    e = edges.withColumn("w", F.try_element_at(weight, "relationship")).where("w > 0").withColumn("eo", F.struct("src", "dst"))
    e = cut(e.select("src", "dst", "w", "eo").union(e.select("dst", "src", "w", "eo")))
    known = F.coalesce(F.length(F.get("domains", F.lit(0)).cast("string")) > 0, F.lit(False))
    state = cut(nodes.select("id", F.when(known, F.array_compact("domains")).alias("domains"), F.when(known, "given").alias("source")))
    kind = state.schema["id"].dataType.simpleString()
    allowed = None if taxonomy is None else set(taxonomy)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict = {}
        for b in batches:
            ids, labels = [], []
            for r in b.to_pylist():
                weights, first, n = {}, {}, r["n"] or 0
                for v in r["votes"] or ():
                    weights[v["vote"]], first[v["vote"]] = v["w"], (tuple(v["first"]["eo"].values()), v["first"]["pos"])
                for x in r["later"] or ():
                    label = mine[x["dst"]] if x["dst"] in mine else x["label"]
                    if label is not None:
                        n += 1
                        weights[label] = weights.get(label, 0.0) + x["w"]
                        first[label] = min(first.get(label, ((math.inf,), 0)), (tuple(x["eo"].values()), 0))
                best = min(((-w, first[d], d) for d, w in weights.items() if allowed is None or d in allowed), default=None)
                label = best[2] if n >= 2 and best and -best[0] >= 2 else None
                mine[r["id"]] = label
                if label is not None:
                    ids.append(r["id"])
                    labels.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("id").type), pa.array(labels, pa.string())], ["id", "label"])

    for _ in range(rounds):
        unlabelled = state.where("domains is null").select(F.col("id").alias("src"))
        asked = e.join(unlabelled, "src", "left_semi")
        voters = state.where("domains is not null").select(F.col("id").alias("dst"), F.posexplode("domains").alias("pos", "vote"))
        by_vote = asked.join(voters, "dst").groupBy("src", "vote").agg(F.sum("w").alias("w"), F.min(F.struct("eo", "pos")).alias("first"), F.count_if(F.col("pos") == 0).alias("n"))
        votes = by_vote.groupBy("src").agg(F.collect_list(F.struct("vote", "w", "first")).alias("votes"), F.sum("n").alias("n"))
        later = asked.where("dst < src").join(unlabelled.select(F.col("src").alias("dst")), "dst", "left_semi")
        later = cut(later)
        fixed = cut(unlabelled.join(votes, "src", "left"))
        parts = max(1, -(-fixed.count() // rows_per_task))
        assumed = None
        while True:
            told = later.withColumn("label", F.lit(None).cast("string")) if assumed is None else later.join(assumed.select(F.col("id").alias("dst"), "label"), "dst", "left")
            told = told.groupBy("src").agg(F.collect_list(F.struct("dst", "w", "eo", "label")).alias("later"))
            rows = fixed.join(told, "src", "left").where("votes is not null or later is not null").select(F.col("src").alias("id"), "votes", "n", "later")
            given = cut(rows.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(decide, f"id {kind}, label string"))
            if parts == 1 or assumed is not None and given.exceptAll(assumed).isEmpty() and assumed.exceptAll(given).isEmpty():
                break
            assumed = given
        if given.isEmpty():
            break
        new = F.col("label").isNotNull()
        state = cut(state.join(given, "id", "left").select("id", F.when(new, F.array("label")).otherwise(F.col("domains")).alias("domains"), F.when(new, "propagation").otherwise(F.col("source")).alias("source")))
    return state.select("id", F.get("domains", F.lit(0)).alias("domain"), "source")


def adjustment(rating: Column) -> Column:
    """By how much a rating moves a strength: .05 for each point from 5, .15 at most; ratings between whole points below 9 and over 1 move nothing."""
    return F.when((rating == F.floor(rating)) | (rating >= 9) | (rating <= 1), F.greatest(F.lit(-0.15), F.least(F.lit(0.15), F.round((rating - 5) * 0.05, 2)))).otherwise(0.0)


#: The steps that adjustment() can give, the range of strengths and their grid.
STEPS = (-0.15, -0.1, -0.05, 0.05, 0.1, 0.15)
LOW, HIGH, GRID = 0.1, 2.0, 10_000


def step(strength: np.ndarray, code: int) -> np.ndarray:
    """Strengths after one rating, within LOW and HIGH, to four places."""
    new = np.minimum(HIGH, np.maximum(LOW, strength * (1 + STEPS[code])))
    return np.where(new == strength, strength, np.floor(new * GRID + 0.5) / GRID)


def composed(codes: bytes) -> tuple[list[float], list[float]]:
    """What a run of ratings makes of every strength on the grid, as a rising step function: from each `start` on the strength becomes `value`.

    Steps keep the order of strengths, and strengths that have met stay together, so the work shrinks as the run goes on."""
    start = np.arange(round(LOW * GRID), round(HIGH * GRID) + 1) / GRID
    value = start.copy()
    for c in codes:
        value = step(value, c)
        new = np.concatenate(([True], value[1:] != value[:-1]))
        start, value = start[new], value[new]
    return start.tolist(), value.tolist()


def edge_history(edges: DataFrame, sessions: DataFrame, relationship: str = "co_occurred", run: int = 2048) -> DataFrame:
    """`edges` with the strengths that a history of rated sessions (session_id, ts, rating, rule_id) leaves them with.

    In the order of (ts, session_id), each session moves the strength of every edge of the relationship that touches one of its rules. An
    edge's history is cut at blocks of time; a block of more than `run` ratings becomes a step function over the grid of strengths, and these
    are applied one after the other, so an edge with ratings without number is worked on by many tasks. Sessions without a rating move nothing.
    """
    moved = sessions.withColumn("by", adjustment(F.col("rating"))).where("by <> 0 and rating is not null")
    code = F.array_position(F.array(*map(F.lit, STEPS)), F.col("by")).cast("int") - 1
    moved = moved.select("rule_id", "session_id", "ts", code.alias("code"))
    span = moved.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count(F.lit(1))).first()
    first, last, n = span[0] or 0, span[1] or 0, span[2]
    width = max(1, (last - first) // max(1, n // 1_000_000) + 1)
    own = edges.where(F.col("relationship") == relationship).select("src", "dst").distinct()
    ends = own.select("src", "dst", F.explode(F.array("src", "dst")).alias("rule_id"))
    hits = ends.join(moved, "rule_id").groupBy("src", "dst", "session_id").agg(F.min("ts").alias("ts"), F.min("code").alias("code"))
    hits = hits.withColumn("block", F.floor((F.unix_micros("ts") - F.lit(first)) / F.lit(width)))
    pair = [(c, edges.schema[c].dataType.simpleString()) for c in ("src", "dst")]
    key = ", ".join(f"{c} {t}" for c, t in pair)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, out = None, bytearray(), []

        def flush() -> None:
            # the first rating of an edge may meet a strength off the grid, so it stays as it is
            row = {"src": now[0], "dst": now[1], "block": now[2], "head": bytes(codes[:1]), "codes": bytes(codes[1:]), "start": None, "value": None}
            if len(codes) > run:
                row["codes"] = b""
                row["start"], row["value"] = composed(bytes(codes[1:]))
                row["whole"] = composed(bytes(codes))
            row["ws"], row["wv"] = row.pop("whole", (None, None))
            out.append(row)

        for b in batches:
            shape = pa.schema(
                [("src", b.schema.field("src").type), ("dst", b.schema.field("dst").type), ("block", pa.int64()), ("head", pa.binary()), ("codes", pa.binary())] + [(c, pa.list_(pa.float64())) for c in ("start", "value", "ws", "wv")]
            )
            for at in zip(*(b.column(c).to_pylist() for c in ("src", "dst", "block", "code")), strict=True):
                if at[:3] != now:
                    if now:
                        flush()
                    now, codes = at[:3], bytearray()
                codes.append(at[3])
            if len(out) >= 64:
                yield pa.RecordBatch.from_pylist(out, shape)
                out.clear()
        if now:
            flush()
            yield pa.RecordBatch.from_pylist(out, shape)

    runs = hits.repartition("src", "dst", "block").sortWithinPartitions("src", "dst", "block", "ts", "session_id").mapInArrow(shorten, f"{key}, block long, head binary, codes binary, start array<double>, value array<double>, ws array<double>, wv array<double>")
    old = edges.where(F.col("relationship") == relationship)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("head", "binary"), ("codes", "binary"), *((c, "array<double>") for c in ("start", "value", "ws", "wv")))]
    starts = old.groupBy("src", "dst").agg(F.max("strength").alias("strength")).select("src", "dst", F.lit(-1).cast("long").alias("block"), "strength", *empty)
    line = starts.unionByName(runs.withColumn("strength", F.lit(None).cast("double")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s, fresh, out = None, 0.0, True, []
        through = lambda x, start, value: value[max(0, int(np.searchsorted(start, x, "right")) - 1)]
        for b in batches:
            shape = pa.schema([("src", b.schema.field("src").type), ("dst", b.schema.field("dst").type), ("new", pa.float64())])
            for r in b.to_pylist():
                if r["block"] == -1:
                    if now:
                        out.append({"src": now[0], "dst": now[1], "new": float(s)})
                    now, s, fresh = (r["src"], r["dst"]), r["strength"], True
                elif fresh or r["ws"] is None:
                    s = step(np.float64(s), r["head"][0])
                    for c in r["codes"]:
                        s = step(s, c)
                    s = through(s, r["start"], r["value"]) if r["start"] else s
                    fresh = False
                else:
                    s = through(s, r["ws"], r["wv"])
            if out:
                yield pa.RecordBatch.from_pylist(out, shape)
                out = []
        if now:
            yield pa.RecordBatch.from_pylist([{"src": now[0], "dst": now[1], "new": float(s)}], shape)

    new = line.repartition("src", "dst").sortWithinPartitions("src", "dst", "block").mapInArrow(fold, f"{key}, new double").select(F.col("src").alias("a"), F.col("dst").alias("b"), "new")
    touched = (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")) & (F.col("relationship") == relationship)
    return edges.join(new, touched, "left").withColumn("strength", F.coalesce("new", "strength")).drop("a", "b", "new")


def bootstrap_draws(values: DataFrame, column: str, rounds: int = 1000, seed: int = 7, values_per_part: int = 20_000) -> DataFrame:
    """(round, n, total): for each round the number of draws and the sum of what was drawn, with return, from all non-null values: n draws exactly.

    Equal values are drawn as one, by how often they stand there. Values are dealt to parts; the driver splits the n draws of each round over
    the parts by conditional binomials, a matrix of rounds by parts, and each part splits its own over its values in the same way. So a round is
    a multinomial draw, no row is multiplied, and only sums travel.
    """
    d = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("times"))
    d = cut(d)
    distinct, n = d.agg(F.count(F.lit(1)), F.coalesce(F.sum("times"), F.lit(0))).first()
    if not n:
        return values.sparkSession.createDataFrame([], "round int, n long, total double")
    parts = min(1024, max(1, -(-distinct // values_per_part)))
    d = d.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), F.col("v")), F.lit(parts)).cast("int"))
    sizes = dict(d.groupBy("part").agg(F.sum("times")).collect())
    weights = np.array([sizes.get(p, 0) for p in range(parts)], dtype=float)
    dealt = np.random.default_rng(seed).multinomial(n, weights / weights.sum(), size=rounds)
    given = values.sparkSession.createDataFrame([(p, dealt[:, p].tolist()) for p in range(parts)], "part int, draws array<long>")

    def draw(t: pa.Table, own: pa.Table) -> pa.Table:
        v, times = t.column("v").to_numpy(), t.column("times").to_numpy()
        order = np.argsort(v)
        v, times = v[order], times[order]
        rng = np.random.default_rng([seed, own.column("part")[0].as_py()])
        draws = own.column("draws")[0].as_py()
        total = [float(rng.multinomial(m, times / times.sum()) @ v) if m else 0.0 for m in draws]
        return pa.table({"round": pa.array(range(len(draws)), pa.int32()), "n": pa.array(draws, pa.int64()), "total": pa.array(total)})

    drawn = d.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(draw, "round int, n long, total double")
    return drawn.groupBy("round").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def bootstrap_ci(values: DataFrame, column: str, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """One row (mean, low, high): the mean and the 2.5 and 97.5 per cent places among the sorted means of bootstrap rounds; 0 without values."""
    values = cut(values.select(column))  # read for the draws and the mean
    means = bootstrap_draws(values, column, rounds, seed).select(half_up(F.col("total") / F.col("n"), 9).alias("m"))
    q = means.agg(F.sort_array(F.collect_list("m")).alias("s"))  # `rounds` numbers
    mean = values.agg(F.avg(column).alias("mean"))
    at = lambda share: F.coalesce(half_up(F.get("s", F.lit(int(rounds * share))), 6), F.lit(0.0))
    return mean.join(q).select(F.coalesce(half_up(F.col("mean"), 6), F.lit(0.0)).alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"))
