"""Loops over DataFrames: reliable lineage cuts and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder the session names. Where none is set, a local master gets a temporary one, as in tests; a cluster gets an error."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loopwright-"))
    return sc._jsc.sc().getCheckpointDir().get()


def ranked(rows: DataFrame, group: str, order: str, into: str = "r") -> DataFrame:
    """Adds the 1-based place of each row in its group by `order`, which must tell rows apart.

    Rows are sorted by ranges of (group, order), written, and numbered by range, so no task holds a group; what is summed up is a row for
    each group and range that meet. Null groups are a group.
    """
    d = cut(rows.repartitionByRange(group, order).sortWithinPartitions(group, order))
    at = F.monotonically_increasing_id()  # range and place in the written table, the same whenever it is read
    d = d.withColumn("_at", at).withColumns({"_range": F.shiftrightunsigned("_at", 33), "_i": F.col("_at").bitwiseAND(F.lit(2**33 - 1))}).drop("_at")
    parts = d.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_g", "_r", (before - F.col("_first") + 1).alias("_shift"))
    j = d.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return j.withColumn(into, F.col("_i") + F.col("_shift")).drop("_g", "_r", "_range", "_i", "_shift")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in `links` (a, b): component is the smallest id that links reach.

    Each round tells every id the smallest label of its neighbours and jumps from label to label, until nothing changes.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    state = cut(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    for _ in range(max_rounds):
        told = edges.join(state, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        nxt = state.join(told, F.col("id") == F.col("a")).select("id", "component", F.least("component", "near").alias("low"))
        jump = nxt.select(F.col("id").alias("j"), F.col("low").alias("far"))
        nxt = cut(nxt.join(jump, F.col("low") == F.col("j")).select("id", "component", F.least("low", "far").alias("low")))
        if nxt.where("low <> component").isEmpty():
            return state
        state = nxt.select("id", F.col("low").alias("component"))
    raise RuntimeError("components did not settle")
