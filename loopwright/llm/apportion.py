"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.llm.common import bucket_bits, cut, n_words, running_total

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def seeded(seed: int, *parts: Column) -> Column:
    """A seeded place for each row: the first 60 bits of an MD5 digest spread over the signed 64-bit range, in the same order."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.shiftleft(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") - 2**59, 4)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) for (source, source_size).

    Targets share `share` times all words by weight; one that would pass `most` times its source's size stops there
    and the excess is shared again. That is water filling: in the order of size / weight, a source is full exactly if
    its limit is no more than its weight's share of what the sources before it leave.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    fill = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(0)).orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    s = s.withColumn("full", F.col("limit") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return s.select("source", "source_size", "weight", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * level).alias("target"))


def seats(targets: DataFrame, block: int, blocks: int) -> DataFrame:
    """(source, seat, rank): the `blocks` highest quotients target / (2 seat - 1), ranked; ties by source, then seat.

    Each source offers a few more seats than its share, so that no seat that could win is missing and rows stay
    near the number of blocks.
    """
    whole = W.partitionBy(F.lit(0)).orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offer = F.ceil(F.col("target") / block * (1 + F.count(F.lit(1)).over(whole) / F.lit(float(max(blocks, 1))))) + 2
    offered = targets.where("target > 0").withColumn("offer", offer).select("source", "target", F.explode(F.sequence(F.lit(1), F.col("offer").cast("int"))).alias("seat"))
    best = W.orderBy((F.col("target") / (2 * F.col("seat") - 1)).desc(), F.col("source").asc_nulls_last(), "seat")
    return offered.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= blocks).select("source", "seat", "rank")


def mix(
    docs: DataFrame, size: Column | None = None, share: float = 1.5, most: float = 2.0, shards: int = 24, blocks_per_shard: int = 1024, seed: int = 17, row: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (doc_id, source, size, source_size, target, start, taken, spans) and blocks
    (source, block, start, words, copies, part, shards).

    The documents of a source stand in a seeded order, as one run of words cut into equal blocks. Sainte-Lague
    seats give each source a whole number of blocks, dealt to shards in the order of their quotients, so that every
    shard has integer quotas. A seat takes a block's worth of words along a seeded order of the source's blocks, again from
    the front once all are taken; then the last seat is cut, or one more begun, so that a source's words meet its rounded
    target. That correction is of one block at most: where the seats are further from the target, they decide.
    `copies` counts whole takings of a block and `part` the words of its front taken once more. `spans` are a document's
    pieces (block, from, words, copies, part). `row` names columns that tell rows apart which agree in doc_id and size: they order such rows and are returned.

    Null texts have size 0; documents of size 0 take nothing; null sources are one source, last in order. A table
    without words, or without rows, takes nothing. Repeated rows stand beside each other; ties in quotients go to the source
    earlier by code point. Texts of any length are cut over as many blocks as they span. Other columns are ignored, whatever
    their names. No task gathers a source's documents (see running_total); a source's blocks, shards * blocks_per_shard of all at
    most and one more for each source, are ranked in one task.
    """
    size = n_words(F.col("text")) if size is None else size
    rows = cut(docs.select("doc_id", "source", size.alias("size"), *row))
    totals = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)
    totals = cut(totals)
    n, total, goal = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.lit(0)).first()
    goal = share * total
    blocks = shards * blocks_per_shard
    block = max(1, -int(-goal // blocks))
    blocks = int(goal // block)
    won = seats(totals, block, blocks)
    by_source = won.groupBy("source").agg(F.count(F.lit(1)).alias("quota"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    src = totals.join(by_source, same(totals, by_source), "left").select(totals["*"], F.coalesce("quota", F.lit(0)).alias("quota"))
    src = src.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)))
    rest = F.round("target").cast("long") - F.col("quota") * block
    src = src.withColumn("grant", F.greatest(F.col("quota") * block + F.greatest(F.least(rest, F.lit(block)), F.lit(-block)), F.lit(0)))
    # a source's blocks in seeded order; the words of its seats flow over them, epoch after epoch
    each = src.select("source", "source_size", "quota", "grant", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    each = each.withColumn("start", F.col("block") * block).withColumn("words", F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("start")))
    each = each.withColumn("key", seeded(seed, F.lit("block"), F.col("source"), F.col("source").isNull(), F.col("block")))
    drawn = W.partitionBy("source").orderBy("key", "block")
    each = each.withColumn("place", F.row_number().over(drawn)).withColumn("before", F.coalesce(F.sum("words").over(drawn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("grant") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    left = F.col("grant") - epochs * F.col("source_size")
    fill = F.least(F.greatest(left - F.col("before"), F.lit(0)), F.col("words"))
    each = each.withColumn("copies", epochs + F.when((fill == F.col("words")) & (F.col("words") > 0), 1).otherwise(0)).withColumn("part", F.when(fill == F.col("words"), 0).otherwise(fill).cast("long"))
    holders = won.join(src.select(F.col("source").alias("s2"), "n_blocks"), F.col("source").eqNullSafe(F.col("s2")))
    holders = holders.groupBy("source", ((F.col("seat") - 1) % F.col("n_blocks") + 1).alias("at")).agg(F.array_sort(F.collect_list(F.struct("seat", ((F.col("rank") - 1) % shards).alias("shard")))).alias("h"))
    holders = holders.select(F.col("source").alias("s3"), "at", F.transform("h", lambda x: x["shard"]).alias("shards"))
    each = each.join(holders, F.col("source").eqNullSafe(F.col("s3")) & (F.col("place") == F.col("at")), "left")
    each = each.select("source", "block", "start", "words", "copies", "part", "shards")
    # documents along the source's run of words
    keyed = rows.withColumn("key", seeded(seed, F.lit("doc"), F.col("doc_id"), F.col("size")))
    placed = running_total(keyed, "source", "key", ["doc_id", "size", *row], F.col("size"), bucket_bits(n), "start")
    spans = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.greatest("size", F.lit(1)) - 1) / block))
    # the ids number the rows of a written table, so a stage that is run again gives the same ones
    pieces = cut(placed).withColumn("id", F.monotonically_increasing_id()).withColumn("block", F.explode(spans))
    b = each.select(F.col("source").alias("bs"), F.col("block").alias("bb"), F.col("start").alias("b0"), "copies", "part")
    pieces = pieces.join(b, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")), "left")
    head, tail = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    run = F.greatest(tail - head, F.lit(0))
    again = F.greatest(F.least(tail, F.col("b0") + F.col("part")) - head, F.lit(0))
    pieces = pieces.withColumn("took", F.coalesce(run * F.col("copies") + F.when(F.col("part") > 0, again).otherwise(0), F.lit(0)))
    doc = pieces.groupBy("id").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "source", "size", "start", *row)],
        F.sum("took").alias("taken"),
        F.array_sort(F.collect_list(F.struct("block", (head - F.col("start")).alias("from"), run.alias("words"), "copies", F.when(F.col("part") > 0, again).otherwise(0).alias("part")))).alias("spans"),
    )
    t = totals.select(F.col("source").alias("ts"), "source_size", "target")
    doc = doc.join(t, F.col("source").eqNullSafe(F.col("ts")), "left").select("doc_id", "source", "size", "source_size", "target", "start", "taken", "spans", *row)
    return doc, each


def op9_sainte_lague(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of the contract, from mix()."""
    doc, _ = mix(docs)
    return doc.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
