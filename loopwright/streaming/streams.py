"""Structured Streaming forms: ingestion, state per rule, weekly windows, interval joins, deduplication, retention."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopwright.operators.iterate import cut


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A Parquet table as a stream of its files; times become instants, which watermarks need."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        d = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet")
    else:  # a stream reads folders: of this one, the file of that name
        d = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return d.withColumns({c: F.col(c).cast("timestamp") for c, t in d.dtypes if t == "timestamp_ntz"})


def read_signals(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """JSON lines as they are appended under a folder."""
    return spark.readStream.schema(schema).json(folder)


def dedup(events: DataFrame, key: str, ts: str = "ts", late: str = "7 days") -> DataFrame:
    """Each key once; state is dropped behind the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def weekly(events: DataFrame, value: str, ts: str = "ts", late: str = "7 days") -> DataFrame:
    """(week, n, mean) by tumbling weeks from Monday."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, "7 days", None, "4 days").alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("week"), "n", "mean")


def sliding(events: DataFrame, value: str, ts: str = "ts", size: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    g = events.withWatermark(ts, late).groupBy(F.window(ts, size, step).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.end").alias("until"), "n", "mean")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts", late: str = "1 day") -> DataFrame:
    g = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, minutes: int, late: str = "7 days") -> DataFrame:
    """(key, left_id, right_id): right events within `minutes` after a left one of the same key.

    Both sides meet by key and stretch of `minutes`, a left event in its own stretch and the next, so an event looks at what is near in time, never at all that its key holds.
    """
    stretch = lambda t: F.floor(F.unix_micros(t) / F.lit(minutes * 60_000_000))
    a = left.select(F.col(key).alias("k1"), F.col("event_id").alias("left_id"), F.col("ts").alias("t1")).withWatermark("t1", late)
    a = a.withColumn("s1", F.explode(F.array(stretch(F.col("t1")), stretch(F.col("t1")) + 1)))
    b = right.select(F.col(key).alias("k2"), F.col("event_id").alias("right_id"), F.col("ts").alias("t2")).withWatermark("t2", late).withColumn("s2", stretch(F.col("t2")))
    near = F.expr(f"k1 = k2 AND s1 = s2 AND t2 >= t1 AND t2 <= t1 + INTERVAL {minutes} MINUTES")
    return a.join(b, near).select(F.col("k1").alias(key), "left_id", "right_id")


def retain(events: DataFrame, as_of: F.Column, ts: str = "ts", days: int = 14) -> DataFrame:
    """Events of the last `days`; what is older does not go on."""
    return events.where(F.unix_seconds(F.col(ts).cast("timestamp")) >= F.unix_seconds(as_of.cast("timestamp")) - days * 86_400)


def fresh(rows: DataFrame, as_of: F.Column, hours: int = 24, ts: str = "ts") -> DataFrame:
    """Rows not older than `hours`: the life of a session's context."""
    return rows.where(F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp")) <= hours * 3600)


def run_stages(stages: list[tuple[str, Callable[[], DataFrame]]]) -> list[tuple[str, DataFrame | None, str | None]]:
    """Runs a cycle's stages one by one; a stage that fails leaves its error and the cycle goes on."""
    done: list[tuple[str, DataFrame | None, str | None]] = []
    for name, stage in stages:
        try:
            done.append((name, stage(), None))
        except Exception as e:  # noqa: BLE001
            done.append((name, None, str(e)))
    return done


def each_batch(stream: DataFrame, cycle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 minutes"):  # noqa: ANN201
    """The periodic cycle as a micro-batch every half hour."""
    return stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote; offsets and rows stand in the session's shared folder."""
    spark = stream.sparkSession
    cut(spark.range(1))  # sets the folder where the session has none
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(f"{base}/out")
    if mode == "complete":  # every batch holds the whole result
        rows = rows.join(F.broadcast(rows.agg(F.max("epoch").alias("epoch"))), "epoch", "left_semi")
    return rows.drop("epoch")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last update of each key."""
    others = [c for c in rows.columns if c not in (key, order)]
    g = rows.groupBy(key).agg(F.max(F.struct(order, *others)).alias("m"))
    return g.select(key, *[F.col(f"m.{c}").alias(c) for c in (order, *others)])
