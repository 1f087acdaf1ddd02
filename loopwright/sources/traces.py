"""Traces and their scores as a Spark data source: `spark.read.format("loopwright_traces")`, and the same name for writing and for streams.

A store is a folder that the driver and all executors see. Rows stand in JSON lines, one file for each name and day that a task meets; what is committed
is a numbered log entry that lists the files of one write with their names, times and sizes. A file that no entry lists does not exist for readers, so a
task that dies leaves nothing behind, and a write is seen whole or not at all. Filters on name and time are held against the log before any file is opened.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

FORMAT = "loopwright_traces"
TRACES = "id string, name string, input string, output string, ts timestamp, metadata string"
SCORES = "id string, name string, trace_id string, type string, value double, comment string, ts timestamp"
#: (Spark's name, Arrow's type) by kind of store.
ARROW = {
    "traces": pa.schema([(c, pa.timestamp("us", "UTC") if c == "ts" else pa.string()) for c in ("id", "name", "input", "output", "ts", "metadata")]),
    "scores": pa.schema([(c, {"ts": pa.timestamp("us", "UTC"), "value": pa.float64()}.get(c, pa.string())) for c in ("id", "name", "trace_id", "type", "value", "comment", "ts")]),
}
ROWS_PER_FILE = 50_000


class Store:
    """Files and log of one folder."""

    def __init__(self, options: dict) -> None:
        self.kind = options.get("kind", "traces")
        self.fs, self.root = files.FileSystem.from_uri(options["path"])
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", 32 << 20)))
        self.writer = options.get("writer", "")

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(files.FileSelector(f"{self.root}/log", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def entry(self, version: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/log/{version:020d}.json") as f:
            return json.loads(f.read())

    def listed(self, after: int = -1, until: int | None = None) -> list[dict]:
        """The files of the log entries after one version, up to another; a replacing entry ends what stood before it."""
        out: list[dict] = []
        for v in self.versions():
            if v > after and (until is None or v <= until):
                e = self.entry(v)
                out = e["files"] if e["replace"] else out + e["files"]
        return out

    def commit(self, listed: list[dict], replace: bool, batch: str | None = None) -> None:
        """Adds the next log entry. A batch of a stream that stands in the log already is not added again. Two writers at once: one gets the version,
        the other tries the next."""
        known = self.versions()
        if batch is not None and any(self.entry(v).get("batch") == batch for v in known):
            self.discard(listed)
            return
        version = known[-1] + 1 if known else 0
        body = json.dumps({"files": listed, "replace": replace, "batch": batch}).encode()
        self.fs.create_dir(f"{self.root}/log", recursive=True)
        while not self._create(f"{self.root}/log/{version:020d}.json", body):
            version += 1

    def _create(self, path: str, body: bytes) -> bool:
        temp = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temp) as f:
            f.write(body)
        if isinstance(self.fs, files.LocalFileSystem):
            try:
                os.link(temp, path)  # fails if it exists
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(temp)
        if self.fs.get_file_info(path).type != files.FileType.NotFound:
            self.fs.delete_file(temp)
            return False
        self.fs.move(temp, path)
        return True

    def discard(self, listed: list[dict]) -> None:
        for e in listed:
            if self.fs.get_file_info(f"{self.root}/{e['file']}").type != files.FileType.NotFound:
                self.fs.delete_file(f"{self.root}/{e['file']}")

    def put(self, batches: Iterator[pa.RecordBatch]) -> list[dict]:
        """Writes rows by name and day, ROWS_PER_FILE at most to a file."""
        held: dict[tuple, list[dict]] = {}
        out: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                row["ts"] = row["ts"].astimezone(timezone.utc).isoformat() if row["ts"] else None
                key = row["name"], (row["ts"] or "none")[:10]
                held.setdefault(key, []).append(row)
                if len(held[key]) >= ROWS_PER_FILE:
                    out.append(self._file(key, held.pop(key)))
        return out + [self._file(k, rows) for k, rows in held.items()]

    def _file(self, key: tuple, rows: list[dict]) -> dict:
        name = f"data/{key[1]}/{uuid.uuid4().hex}.jsonl"
        body = "".join(json.dumps(r) + "\n" for r in rows).encode()
        self.fs.create_dir(f"{self.root}/data/{key[1]}", recursive=True)
        with self.fs.open_output_stream(f"{self.root}/{name}") as f:
            f.write(body)
        times = [r["ts"] for r in rows if r["ts"]]
        return {"file": name, "name": key[0], "first": min(times, default=None), "last": max(times, default=None), "rows": len(rows), "bytes": len(body)}

    def rows(self, names: list[str], step: int = 8192) -> Iterator[pa.RecordBatch]:
        schema = ARROW[self.kind]
        held: list[dict] = []
        for name in names:
            with self.fs.open_input_stream(f"{self.root}/{name}") as f:
                for line in f.read().decode().split("\n"):
                    if line:
                        r = json.loads(line)
                        r["ts"] = datetime.fromisoformat(r["ts"]) if r["ts"] else None
                        held.append(r)
                    if len(held) >= step:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    def splits(self, listed: list[dict]) -> list[FilesOf]:
        """Files together, as many as come to about splitBytes; names stay apart."""
        out: list[FilesOf] = []
        size = 0
        for e in sorted(listed, key=lambda e: (e["name"] or "", e["first"] or "", e["file"])):
            if not out or size + e["bytes"] > self.split_bytes or out[-1].name != e["name"]:
                out.append(FilesOf(e["name"], []))
                size = 0
            out[-1].files.append(e["file"])
            size += e["bytes"]
        return out


@dataclass
class FilesOf(InputPartition):
    name: str | None
    files: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.names, self.bounds = options, None, []

    def pushFilters(self, filters: list) -> Iterator:
        """A file holds one name, so equality of names is settled here; times rule out files, and Spark looks at the rows that are left."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("name",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
                continue
            if isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo) and f.attribute == ("ts",):
                self.bounds.append((type(f).__name__, f.value))
            yield f

    def chosen(self) -> list[dict]:
        def within(e: dict) -> bool:
            if self.bounds and e["first"] is None:
                return False
            first, last = (datetime.fromisoformat(e[k]) if e[k] else None for k in ("first", "last"))
            for kind, value in self.bounds:
                v = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
                if kind.startswith("Greater") and last < v or kind.startswith("Less") and first > v or kind == "EqualTo" and not first <= v <= last:
                    return False
            return True

        return [e for e in Store(self.options).listed() if (self.names is None or e["name"] in self.names) and within(e)]

    def partitions(self) -> list[FilesOf]:
        return Store(self.options).splits(self.chosen()) or [FilesOf(None, [])]

    def read(self, partition: FilesOf) -> Iterator[pa.RecordBatch]:
        return Store(self.options).rows(partition.files)


class StreamReader(DataSourceStreamReader):
    """Offsets are versions of the log: each batch reads what was committed since the one before."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"version": -1}

    def latestOffset(self) -> dict:
        return {"version": max(Store(self.options).versions(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[FilesOf]:
        s = Store(self.options)
        return s.splits(s.listed(start["version"], end["version"]))

    def read(self, partition: FilesOf) -> Iterator[pa.RecordBatch]:
        return Store(self.options).rows(partition.files)

    def commit(self, end: dict) -> None:
        pass  # the log stays


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(Store(self.options).put(iterator))

    def commit(self, messages: list[Written | None]) -> None:
        Store(self.options).commit([f for m in messages if m for f in m.files], self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        Store(self.options).discard([f for m in messages if m for f in m.files])


class StreamWriter(DataSourceStreamArrowWriter):
    """Commits each batch of the query that the option `writer` names once, however often it is run."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(Store(self.options).put(iterator))

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        s = Store(self.options)
        s.commit([f for m in messages if m for f in m.files], False, f"{s.writer}:{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        Store(self.options).discard([f for m in messages if m for f in m.files])


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCORES if self.options.get("kind") == "scores" else TRACES

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:  # noqa: ANN001
        return StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
        return Writer(dict(self.options), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:  # noqa: ANN001
        return StreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceSource)


def cached(spark: SparkSession, path: str, names: list[str] | None = None, since: Column | None = None) -> DataFrame:
    """The traces of a store that have both an input and an output, of some names and times."""
    register(spark)
    d = spark.read.format(FORMAT).option("path", path).load()
    d = d.where(F.col("name").isin(names)) if names is not None else d
    d = d.where(F.col("ts") >= since) if since is not None else d
    return d.where((F.coalesce(F.length("input"), F.lit(0)) > 0) & (F.coalesce(F.length("output"), F.lit(0)) > 0))


def cache(traces: DataFrame, path: str, mode: str = "append") -> None:
    """Adds traces, or the columns of them that there are, to a store."""
    register(traces.sparkSession)
    kinds = [c.split(" ") for c in TRACES.split(", ")]
    rows = traces.select(*[(F.col(c) if c in traces.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds])
    rows.write.format(FORMAT).mode(mode).option("path", path).save()


def score_rows(scores: DataFrame, source: str = "traces") -> DataFrame:
    """What a score (trace_id, dimension, value, reasoning, ts) becomes in the sink: one anchor for each trace and one event for each dimension of it.

    Ids depend on the source, trace and dimension alone, so sending a score again replaces it. The anchor has the time of the trace's first score.
    """
    key = lambda *parts: F.sha2(F.concat_ws(":", *parts), 256)
    trace = F.substring(key(F.lit(source), F.col("trace_id")), 1, 32)
    anchors = scores.groupBy("trace_id").agg(F.min("ts").alias("ts"))
    anchors = anchors.select(
        F.substring(key(F.lit("trace"), F.col("trace_id"), F.lit("anchor")), 1, 36).alias("id"), F.lit("anchor").alias("name"), trace.alias("trace_id"), F.lit("trace-create").alias("type"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("comment"), "ts",
    )
    events = scores.select(
        F.substring(key(F.lit("score"), F.col("trace_id"), F.col("dimension")), 1, 36).alias("id"), F.col("dimension").alias("name"), trace.alias("trace_id"), F.lit("score-create").alias("type"),
        F.col("value").cast("double").alias("value"), F.substring("reasoning", 1, 500).alias("comment"), "ts",
    )
    return anchors.union(events)


def send_scores(scores: DataFrame, path: str, source: str = "traces") -> None:
    register(scores.sparkSession)
    score_rows(scores, source).write.format(FORMAT).mode("append").option("path", path).option("kind", "scores").save()


def sent_scores(spark: SparkSession, path: str, dimensions: list[str] | None = None) -> DataFrame:
    """The score events of a sink; of events with one id the latest, then the largest value."""
    register(spark)
    d = spark.read.format(FORMAT).option("path", path).option("kind", "scores").load()
    d = d.where(F.col("name").isin(dimensions)) if dimensions is not None else d
    last = d.where("type = 'score-create'").groupBy("id").agg(F.max(F.struct("ts", "value", "name", "trace_id", "comment")).alias("m"))
    return last.select("id", "m.name", "m.trace_id", "m.value", "m.comment", "m.ts")


def unscored(traces: DataFrame, scores: DataFrame, source: str = "traces") -> DataFrame:
    """Traces without any score in the sink."""
    own = F.substring(F.sha2(F.concat_ws(":", F.lit(source), F.col("id")), 256), 1, 32)
    return traces.withColumn("_own", own).join(scores.select(F.col("trace_id").alias("_own")).distinct(), "_own", "left_anti").drop("_own")
