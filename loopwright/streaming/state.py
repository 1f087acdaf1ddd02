"""State that ends: ratings by rule with event-time timers, session contexts with a time to live, and compaction of closed weeks and months."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loopwright.functions.text import half_up

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Composite state needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class RuleState(StatefulProcessor):
    """Of one rule: its last `keep` ratings in order of event time, counts, the sessions that were counted, and a timer `life` days after it was last seen."""

    def __init__(self, keep: int, life: int, key: str) -> None:
        self.keep, self.life, self.key = keep, life, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ratings = handle.getListState("ratings", "ts bigint, session string, rating double")
        self.sessions = handle.getMapState("sessions", "session string", "ts bigint")
        self.totals = handle.getValueState("totals", "n bigint, high bigint, low bigint, last bigint")

    def row(self, key, ratings, totals, expired):  # noqa: ANN001, ANN201
        import pandas as pd

        w = [math.exp(-math.log(2) / 10 * a) for a in range(len(ratings) - 1, -1, -1)]
        decayed = sum(r[2] * y for r, y in zip(ratings, w, strict=True)) / sum(w) if w else None
        n, high, low, last = totals
        return pd.DataFrame({self.key: [key[0]], "n": [n], "decayed": [decayed], "high": [high], "low": [low], "last_seen": [pd.Timestamp(last, unit="us")], "expired": [expired]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: ANN001
        """A late row that is still accepted takes its place by time, so it is not taken for the newest; a session counts once."""
        new = []
        for b in rows:
            for ts, session, rating in zip(b["ts"].astype("datetime64[us]").astype("int64").tolist(), b["session_id"].astype(str).tolist(), b["rating"].tolist(), strict=True):
                if rating is not None and rating == rating and rating != 0:
                    new.append((ts, session, rating))
        seen = self.totals.get() if self.totals.exists() else None
        n, high, low, last = seen if seen else (0, 0, 0, 0)
        held = [tuple(r) for r in self.ratings.get()] if seen else []
        watermark = timerValues.getCurrentWatermarkInMs()
        if seen and watermark > 0:  # what is behind the watermark cannot come again
            for (session,), (ts,) in list(self.sessions.iterator()):
                if ts < watermark * 1000:
                    self.sessions.removeKey((session,))
        for ts, session, rating in sorted(new):
            if self.sessions.containsKey((session,)):
                continue
            self.sessions.updateValue((session,), (ts,))
            held.append((ts, session, rating))
            n, high, low, last = n + 1, high + (rating >= 7), low + (rating <= 4), max(last, ts)
        if not n:
            return
        held = sorted(held)[-self.keep :]
        self.ratings.put(held)
        self.totals.update((n, int(high), int(low), last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last // 1000 + self.life * DAY)
        yield self.row(key, held, (n, int(high), int(low), last), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: ANN001, N803
        """The rule was not seen for its life: its last state goes out, and nothing of it is kept."""
        if self.totals.exists():
            yield self.row(key, [tuple(r) for r in self.ratings.get()], tuple(self.totals.get()), True)
        for s in (self.ratings, self.sessions, self.totals):
            s.clear()

    def close(self) -> None:
        pass


def rule_stats(injections: DataFrame, keep: int = 20, life: int = 60, late: str = "7 days", key: str = "rule_id") -> DataFrame:
    """(rule_id, n, decayed, high, low, last_seen, expired) for each batch that touches a rule (rule_id, session_id, ts, rating), and once more when it
    expires. Rows behind the watermark (`late`) are dropped; a rule that comes back after its end starts anew."""
    keep_state_in_rocksdb(injections.sparkSession)
    kind = injections.schema[key].dataType.simpleString()
    out = f"{key} {kind}, n bigint, decayed double, high bigint, low bigint, last_seen timestamp, expired boolean"
    d = injections.select(key, "ts", F.col("session_id").cast("string").alias("session_id"), F.col("rating").cast("double").alias("rating")).withWatermark("ts", late)
    return d.groupBy(key).transformWithStateInPandas(RuleState(keep, life, key), out, "append", "EventTime")


class ContextState(StatefulProcessor):
    """The context that a session was last given, for as long as it lives by the clock."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.context = handle.getValueState("context", "rules array<string>, given bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: ANN001
        import pandas as pd

        events = []
        for b in rows:
            events += zip(b["ts"].astype("datetime64[us]").astype("int64").tolist(), b["kind"].tolist(), b["rules"].tolist(), strict=True)
        out = []
        for ts, kind, rules in sorted(events, key=lambda x: (x[0], x[1] != "give")):
            if kind == "give":
                self.context.update((list(rules), ts))
            elif self.context.exists():
                held = self.context.get()
                out.append((key[0], ts, list(held[0])))
            else:
                out.append((key[0], ts, None))
        if out:
            rules = pd.Series([o[2] for o in out], dtype=object)
            yield pd.DataFrame({"session_id": [o[0] for o in out], "ts": pd.to_datetime([o[1] for o in out], unit="us"), "rules": rules})

    def close(self) -> None:
        pass


def session_contexts(events: DataFrame, hours: float = 24) -> DataFrame:
    """(session_id, ts, rules) for each row of kind `ask` among events (session_id, ts, kind, rules): the rules that the session's last `give` held,
    null if there was none or it was given more than `hours` ago by the clock. State by the clock asks for one batch after the other, also without data, so a
    query that shall end (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off."""
    keep_state_in_rocksdb(events.sparkSession)
    d = events.select("session_id", "ts", "kind", "rules")
    kind = d.schema["session_id"].dataType.simpleString()
    return d.groupBy("session_id").transformWithStateInPandas(ContextState(int(hours * 3_600_000)), f"session_id {kind}, ts timestamp, rules array<string>", "append", "ProcessingTime")


class Compactor:
    """Turns rated events, as they come in batches, into one row for each closed week and then for each closed month, in tables under a shared folder.

    `cycle` takes a batch and its number, as foreachBatch hands them over. The batch is staged; rows of weeks that are closed already go to `late`; the
    others meet the open weeks in a stream with a watermark, which hands a week over once it is closed and drops its state. A month all of whose weeks
    are closed is written once, under its own name, by a rename. Every step looks first at what is there, so a cycle that broke off at any point is
    run again with the same batch, and a batch that is done is passed over. One cycle runs at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, late: str = "7 days") -> None:
        self.spark, self.folder, self.delay = spark, folder, late
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state_rows = 0

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _done(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.folder}/{name}/_SUCCESS"))

    def watermark(self) -> int:
        """Milliseconds up to which the weekly stream has closed, as its own log of commits has it; 0 before the first."""
        log = self._path(f"{self.folder}/state/commits")
        if not self.fs.exists(log):
            return 0
        names = [int(s.getPath().getName()) for s in self.fs.listStatus(log) if s.getPath().getName().isdigit()]
        if not names:
            return 0
        text = self.spark.read.text(f"{self.folder}/state/commits/{max(names)}", wholetext=True).first()[0]
        return json.loads(text[text.index("{") :])["nextBatchWatermarkMs"]

    def cycle(self, rows: DataFrame, epoch: int) -> None:
        """One batch of (ts, rating)."""
        staged = f"staged/epoch={epoch}"
        if not self._done(staged):
            rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("rating").cast("double").alias("rating")).where("ts is not null").write.mode("overwrite").parquet(f"{self.folder}/{staged}")
        if not self._done(f"late/epoch={epoch}"):
            closed = F.unix_millis(F.date_trunc("week", "ts") + F.expr("INTERVAL 7 DAYS")) <= self.watermark()
            self.spark.read.parquet(f"{self.folder}/{staged}").where(closed).write.mode("overwrite").parquet(f"{self.folder}/late/epoch={epoch}")
        self._weeks()
        self._months()

    def _weeks(self) -> None:
        d = self.spark.readStream.schema("ts timestamp, rating double").parquet(f"{self.folder}/staged/epoch=*")
        g = d.withWatermark("ts", self.delay).groupBy(F.window("ts", "7 days", None, "4 days").alias("w"))
        g = g.agg(F.count("rating").alias("n"), F.sum("rating").alias("total"))

        def write(df: DataFrame, batch: int) -> None:
            df.select(F.col("w.start").alias("week"), "n", "total").write.mode("overwrite").parquet(f"{self.folder}/weekly/batch={batch}")

        q = g.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        if q.lastProgress and q.lastProgress["stateOperators"]:
            self.state_rows = q.lastProgress["stateOperators"][0]["numRowsTotal"]

    def weekly(self) -> DataFrame:
        """(week, n, total) of all closed weeks."""
        return self.spark.read.schema("week timestamp, n bigint, total double").parquet(f"{self.folder}/weekly")

    def _months(self) -> None:
        until = F.timestamp_millis(F.lit(self.watermark()))
        w = self.weekly().withColumn("month", F.date_format("week", "yyyy-MM"))
        full = w.where(F.date_trunc("week", F.last_day("week")).cast("timestamp") + F.expr("INTERVAL 7 DAYS") <= until)
        made = self._path(f"{self.folder}/monthly")
        known = [x.getPath().getName()[6:] for x in self.fs.listStatus(made)] if self.fs.exists(made) else []
        new = full.where(~F.col("month").isin(known)).groupBy("month").agg(F.count(F.lit(1)).alias("weeks"), F.sum("n").alias("n"), F.sum("total").alias("total"))
        new.repartition("month").write.mode("overwrite").partitionBy("month").parquet(f"{self.folder}/making")
        self.fs.mkdirs(made)
        for x in self.fs.listStatus(self._path(f"{self.folder}/making")):  # a folder a month
            target = self._path(f"{self.folder}/monthly/{x.getPath().getName()}")
            if x.isDirectory() and not self.fs.exists(target):
                self.fs.rename(x.getPath(), target)

    def monthly(self) -> DataFrame:
        """(month, weeks, n, mean) of all closed months."""
        schema = "weeks bigint, n bigint, total double, month string"
        if not self.fs.exists(self._path(f"{self.folder}/monthly")):
            return self.spark.createDataFrame([], "month string, weeks bigint, n bigint, mean double")
        d = self.spark.read.schema(schema).parquet(f"{self.folder}/monthly")
        return d.select("month", "weeks", "n", half_up(F.try_divide(F.col("total"), F.col("n").cast("double")), 6).alias("mean"))

    def late(self) -> DataFrame:
        return self.spark.read.schema("ts timestamp, rating double").parquet(f"{self.folder}/late")
