"""Pieces that several corpus operators share: table access, word splitting, lineage cuts, two-level ranks and components."""

from __future__ import annotations

import math
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed by the contracts: white space is space and \t..\r, everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that shared_folder names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, a local master gets a temporary one, as in tests; a cluster gets an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loopwright-"))
    return sc._jsc.sc().getCheckpointDir().get()


def numbered(df: DataFrame, into: str) -> DataFrame:
    """Adds a column that tells every row apart, the same whenever the table is read: the row's place in its file, or, where the rows do not come
    straight from files, in a checkpoint that is made of them."""
    try:
        return df.withColumn(into, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    except AnalysisException:
        return cut(df).withColumn(into, F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at")))


def bucket_bits(rows: int, rows_per_bucket: int = 20_000) -> int:
    """Bits of a hash that split `rows` rows into buckets of about `rows_per_bucket`; at least 64 buckets."""
    return max(6, math.ceil(math.log2(max(rows, 1) / rows_per_bucket + 1e-9)))


def within_bound(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The table with a broadcast hint if it has at most `most` rows, as counted now; else as it is, so that a join shuffles it."""
    return F.broadcast(df) if len(df.limit(most + 1).select(F.lit(1)).collect()) <= most else df


def running_total(df: DataFrame, group: str, key: str, tie: list[str], value: Column, bits: int, into: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the group that stand before this one in the order of the hash `key`.

    No task sees a whole group: the top `bits` of the hash cut each group into buckets, bucket sums are added up first,
    and only the rows of one bucket are sorted together. Null groups are a group of their own. Equal keys are ordered by `tie`.
    """
    b = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-(2**63)).cast("long")), 64 - bits)
    g = F.xxhash64(F.col(group), F.col(group).isNull())
    rows = df.withColumns({"_b": b, "_g": g, "_v": value})
    sums = rows.groupBy("_g", "_b").agg(F.sum("_v").alias("_s"))
    before = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_g", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = W.partitionBy("_g", "_b").orderBy(key, *tie).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(sums, ["_g", "_b"])
        .withColumn(into, F.col("_o") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_g", "_b", "_v", "_o")
    )


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in `links` (a, b): component is the smallest id that links reach.

    Alternates large-star and small-star steps, which shrink every component to a star around its smallest id in a
    logarithmic number of rounds; each round works on edges alone and is cut with a checkpoint.
    """
    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # joins sort both sides: a round leaves no broadcast behind on the executors, and what rounds before it left is let go
    release = links.sparkSession._jvm.System.gc
    # a > b in every edge
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = summary(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m")), F.struct(F.col("a").alias("x"), F.col("m")))).alias("e"))
        edges = cut(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        now = summary(edges)
        release()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    # a star around each smallest id
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
