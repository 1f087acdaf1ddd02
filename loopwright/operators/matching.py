"""One-to-one matching in time: every asker takes at most one event, every event is taken at most once, askers choose in order of time.

Who is left for an asker depends on all choices before it, but only through events near in time. So time is cut into blocks that are matched side by
side; a block that turns out to have chosen among events that the block before it takes is matched again, until no block has to be.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.operators.iterate import cut

#: (microseconds, id, who)
Event = tuple[int, object, object]


def first_of_own(askers: list[Event], events: list[Event], taken: set, after: int) -> list[tuple]:
    """Each asker takes the first free event of its own `who` from its time to `after` later, else the first free one of anybody. Both queues only
    ever lose their heads, so the work follows the rows."""
    free, own, used, out = deque(range(len(events))), defaultdict(deque), {i for i, e in enumerate(events) if e[1] in taken}, []
    for i, e in enumerate(events):
        own[e[2]].append(i)
    for t, asker, who in askers:
        for queue in (own[who], free):
            while queue and (queue[0] in used or events[queue[0]][0] < t):
                queue.popleft()
            if queue and events[queue[0]][0] <= t + after:
                i = queue.popleft()
                used.add(i)
                out.append((asker, events[i][1]))
                break
    return out


def nearest_free(askers: list[Event], events: list[Event], taken: set, width: int) -> list[tuple]:
    """Each asker takes the free event nearest to its time if it is nearer than `width`; of equals the earlier, of equal times the first by id."""
    at = np.array([e[0] for e in events], dtype=np.int64)
    # nearest free event before (place i + 1 stands for event i, place 0 for none) and at or after
    left, right = np.arange(len(at) + 1), np.arange(len(at) + 1)

    def root(up: np.ndarray, i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def take(i: int) -> None:
        left[i + 1], right[i] = i, i + 1

    for i, e in enumerate(events):
        if e[1] in taken:
            take(i)
    out = []
    for t, asker, _ in askers:
        i = int(np.searchsorted(at, t))
        a, b = root(left, i) - 1, root(right, i)
        best = a if a >= 0 and (b >= len(at) or t - at[a] <= at[b] - t) else b if b < len(at) else -1
        if best < 0 or abs(int(at[best]) - t) >= width:
            continue
        if best == a:
            j = root(right, int(np.searchsorted(at, at[best])))
            best = j if j < len(at) and at[j] == at[best] else best
        out.append((asker, events[best][1]))
        take(best)
    return out


def match_once(askers: DataFrame, events: DataFrame, before: int, after: int, choose: Callable, rows_per_block: int = 200_000) -> DataFrame:
    """(key, asker, taken) from askers and events (key, id, ts, who): `choose` matches what has one key, given both sides in order of time and id and the
    ids that are taken; an asker at t may take events from t - `before` to t + `after` microseconds. Ids are not null and tell the rows of a side apart; rows without a
    time match nothing; null keys are a key.

    A block is so long that the most frequent key has about `rows_per_block` rows in it, and at least before + after; events are sent to
    every block whose askers reach them. Blocks are sorted by time and streamed, many to a task. A block passes on what is taken of the events that the next one reaches;
    only blocks that were told something else than they had assumed are matched again. A block's answer is final when the one before it is, so what no round
    changes is what a single pass over all rows gives. Rounds are as many as choices push each other over block ends in a row, mostly two or three.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    side = lambda d, kind: d.select("key", F.lit(kind).alias("kind"), t.alias("t"), "id", F.col("who").cast("string").alias("who")).where("t is not null")
    rows = side(askers, 1).union(side(events, 2))
    per_key = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    seen = per_key.agg(F.max("n"), F.min("a"), F.max("b")).first()
    most, first, last = (x or 0 for x in seen)
    width = max(before + after, (last - first + 1) * rows_per_block // max(most, 1), 1)
    block = lambda x: F.floor((x - F.lit(first)) / F.lit(width))
    reached = F.sequence(F.greatest(block(F.col("t") - after), F.lit(0)), block(F.col("t") + before))
    blocks = F.when(F.col("kind") == 1, F.array(block(F.col("t")))).otherwise(reached)
    rows = cut(rows.withColumn("block", F.explode(blocks)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    answer = f"key {kinds['key']}, block long, told array<{kinds['id']}>, passed array<{kinds['id']}>, pairs array<struct<asker:{kinds['id']},taken:{kinds['id']}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told, sides = None, set(), ([], [])

        def close() -> dict:
            pairs = choose(sides[0], sides[1], told, after)
            gone = told | {x for _, x in pairs}
            reach = first + (now[1] + 1) * width - before
            on = sorted(e[1] for e in sides[1] if e[1] in gone and e[0] >= reach)
            return {"key": now[0], "block": now[1], "told": sorted(told), "passed": on, "pairs": [{"asker": a, "taken": x} for a, x in pairs]}

        out: list[dict] = []
        for b in batches:
            types = {"key": b.schema.field("key").type, "id": b.schema.field("id").type}
            shape = pa.schema(
                [("key", types["key"]), ("block", pa.int64()), ("told", pa.list_(types["id"])), ("passed", pa.list_(types["id"])), ("pairs", pa.list_(pa.struct([("asker", types["id"]), ("taken", types["id"])])))]
            )
            for key, kind, at, own, who, where in zip(*(b.column(c).to_pylist() for c in ("key", "kind", "t", "id", "who", "block")), strict=True):
                if (key, where) != now:
                    if now:
                        out.append(close())
                    now, told, sides = (key, where), set(), ([], [])
                if kind:
                    sides[kind - 1].append((at, own, who))
                else:
                    told.add(own)
            if out:
                yield pa.RecordBatch.from_pylist(out, shape)
                out = []
        if now:
            yield pa.RecordBatch.from_pylist([close()], shape)

    def matched(d: DataFrame) -> DataFrame:
        d = d.select("key", "kind", "t", "id", "who", "block")
        return cut(d.repartition("key", "block").sortWithinPartitions("key", "block", "kind", "t", "id").mapInArrow(run, answer))

    state = matched(rows)
    same = lambda a, b: F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & (F.col(f"{a}.block") == F.col(f"{b}.block"))
    while last - first >= width:
        news = state.select("key", (F.col("block") + 1).alias("block"), F.col("passed").alias("now")).alias("n")
        again = state.alias("s").join(news, same("s", "n"), "left").select("s.key", "s.block", "told", F.coalesce("now", F.array().cast(f"array<{kinds['id']}>")).alias("now"))
        again = cut(again.where("told <> now"))
        if again.isEmpty():
            break
        told = again.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("t"), F.explode("now").alias("id"), F.lit(None).cast("string").alias("who"), "block")
        redo = rows.alias("r").join(again.alias("a"), same("r", "a"), "left_semi").select("key", "kind", "t", "id", "who", "block")
        state = cut(state.alias("s").join(again.alias("a"), same("s", "a"), "left_anti").union(matched(redo.union(told))))
    return state.select("key", F.explode("pairs").alias("p")).select("key", "p.asker", "p.taken")
