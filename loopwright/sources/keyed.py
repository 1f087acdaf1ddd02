"""A keyed table that is merged by copying what changes: rows stand in buckets of their key, a version is a list of one file set for each bucket, and a
merge writes the buckets it touches anew and then a new list. Readers see one version whole; what no list names does not exist."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopwright.operators.iterate import cut


class KeyedTable:
    """One row for each `key`, in `buckets` by its hash. The folder is one that driver and executors share. One writer at a time: of two that start from
    one version, the second finds its number taken and fails without harm."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, key: str = "id", buckets: int = 64) -> None:
        self.spark, self.folder, self.key = spark, folder, key
        self.schema = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = self.manifest()
        self.buckets = found["buckets"] if found else buckets  # settled by the first version

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        log = self._path(f"{self.folder}/log")
        if not self.fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """Buckets and the folder of each, as of a version or the last one."""
        known = self.versions()
        if not known:
            return None
        name = f"{self.folder}/log/{known[-1] if version is None else version:020d}.json"
        return json.loads(self.spark.read.text(name, wholetext=True).first()[0])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, of some buckets if asked for."""
        found = self.manifest(version)
        folders = [f for b, f in (found["files"].items() if found else ()) if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{f}" for f in folders])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys (a column of the key's name), from the buckets that these are in."""
        only = [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # `buckets` at most
        return self.read(only=only).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def merge(self, rows: DataFrame | None = None, gone: DataFrame | None = None, prefer: Column | None = None) -> dict:
        """Puts in `rows`, each in place of the row of its key, and takes out the keys of `gone`. Returns what was done: buckets written, rows put, the version.

        Of rows with one key the greatest by `prefer`, then by all columns, counts. Rows that are as they were touch nothing, nor do keys to take out
        that are not there; a merge that touches nothing makes no version.
        """
        names = self.schema.names
        order = F.struct(*([prefer] if prefer is not None else []), *names)
        new = self.spark.createDataFrame([], self.schema) if rows is None else rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        new = new.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(order).alias("m")).select(*[F.col(f"m.{n}").alias(n) for n in names])
        out = self.spark.createDataFrame([], f"{self.key} {self.schema[self.key].dataType.simpleString()}") if gone is None else gone.select(self.key).distinct()
        whole = self.read()
        put = cut(new.exceptAll(whole.join(new.select(self.key), self.key, "left_semi").select(*names)).join(out, self.key, "left_anti").select(*names))
        drop = cut(whole.join(out, self.key, "left_semi").select(self.key))
        touched = sorted(r[0] for r in put.select(self.bucket().alias("b")).union(drop.select(self.bucket())).distinct().collect())  # `buckets` at most
        known = self.versions()
        done = {"written": len(touched), "put": put.count(), "dropped": drop.count(), "version": known[-1] if known else -1}
        if not touched:
            return done
        kept = self.read(only=touched).join(put.select(self.key).union(drop.select(self.key)), self.key, "left_anti").select(*names)
        made = f"data/{uuid.uuid4().hex}"
        kept.union(put).withColumn("_bucket", self.bucket()).repartition(min(len(touched), 512), "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{made}")
        old = self.manifest()
        files = dict(old["files"]) if old else {}
        for b in touched:
            folder = f"{made}/_bucket={b}"
            if self.fs.exists(self._path(f"{self.folder}/{folder}")):
                files[str(b)] = folder
            else:  # nothing is left in it
                files.pop(str(b), None)
        self._swap(done["version"] + 1, {"buckets": self.buckets, "files": files})
        return done | {"version": done["version"] + 1}

    def _swap(self, version: int, body: dict) -> None:
        target = self._path(f"{self.folder}/log/{version:020d}.json")
        self.fs.mkdirs(target.getParent())
        if self.fs.exists(target):
            raise RuntimeError(f"version {version} was made by another writer")
        temp = self._path(f"{self.folder}/log/.{uuid.uuid4().hex}")
        out = self.fs.create(temp)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if not self.fs.rename(temp, target):
            raise RuntimeError(f"version {version} could not be put in place")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes lists but the last `keep`, and folders that none of these names; returns how many folders went."""
        for v in self.versions()[:-keep]:
            self.fs.delete(self._path(f"{self.folder}/log/{v:020d}.json"), False)
        used = {f.split("/")[1] for v in self.versions() for f in self.manifest(v)["files"].values()}
        data = self._path(f"{self.folder}/data")
        old = [s.getPath() for s in self.fs.listStatus(data) if s.getPath().getName() not in used] if self.fs.exists(data) else []
        for p in old:
            self.fs.delete(p, True)
        return len(old)


VECTORS = "id string, hash string, prefix string, vector array<double>"


def embed_changed(table: KeyedTable, files: DataFrame, prefix: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame]) -> dict:
    """Brings a vector table (VECTORS) up to rule files (id, body): bodies that are new or have changed get a prefix and a vector, the others keep theirs,
    and vectors of files that are gone go too. `prefix` takes (id, body) to (id, prefix), where a missing or empty one leaves the file for the next
    time; `embed` takes (id, text) to (id, vector). Both see changed rows only. Returns what the merge did, with how many were skipped."""
    f = files.select("id", "body", F.md5("body").alias("hash"))
    cached = table.read().where("vector is not null").select("id", "hash")
    todo = cut(f.join(cached, ["id", "hash"], "left_anti"))
    named = cut(todo.join(prefix(todo.select("id", "body")).where("length(prefix) > 0"), "id"))
    vectors = embed(named.select("id", F.concat_ws("\n", "prefix", "body").alias("text")))
    rows = named.join(vectors, "id").select("id", "hash", "prefix", "vector")
    done = table.merge(rows, table.read().select("id").join(files.select("id"), "id", "left_anti"))
    return done | {"skipped": files.count() - todo.count(), "failed": todo.count() - named.count()}


RULES = "id string, text string, domains array<string>, source string, status string"


def sync_rules(table: KeyedTable, rules: DataFrame, domains: Column, fallback: str = "testing") -> dict:
    """Adds learned rules (id, text) to the registry of rules (RULES) with the `domains` that their text shows, else the fallback; a rule that is there
    keeps its status."""
    d = rules.select("id", "text", F.when(F.size(domains) > 0, domains).otherwise(F.array(F.lit(fallback))).alias("domains"), F.lit("auto").alias("source"))
    old = table.read().select("id", "status")
    return table.merge(d.join(old, "id", "left").select("id", "text", "domains", "source", F.coalesce("status", F.lit("active")).alias("status")))


#: How the beginning of a reason names what led to an eviction; others mean a low mean at high volume.
TRIGGERS = [("stale", "never-helped"), ("untracked", "never-helped"), ("critical-stale", "never-helped"), ("noise", "high-injection-low-value")]


def trigger(reason: Column) -> Column:
    found = F.lit("low-avg-high-volume")
    for start, name in reversed(TRIGGERS):
        found = F.when(F.startswith(reason, F.lit(start)), name).otherwise(found)
    return found


def apply_evictions(registry: KeyedTable, lists: KeyedTable, candidates: DataFrame, today: Column) -> DataFrame:
    """Carries out evictions (id, reason, confirm) on the registry and the table of lists (id, list, line): returns (id, outcome, trigger).

    Candidates that a person must confirm are skipped. A rule of the critical list moves to the learned list with a note of the day, one of the learned
    list leaves it, and the registry forgets both.
    """
    c = cut(candidates.groupBy("id").agg(F.max(F.struct("confirm", "reason")).alias("m")).select("id", "m.reason", F.coalesce("m.confirm", F.lit(False)).alias("confirm")))
    go = c.where("not confirm").join(lists.read().select("id", "list", "line"), "id", "left")
    demoted = go.where("list = 'critical'").select("id", F.lit("learned").alias("list"), F.concat("line", F.lit(" <!-- demoted from Critical on "), today, F.lit(" -->")).alias("line"))
    outcome = F.when(F.col("confirm"), "skipped").when(F.col("list") == "critical", "demoted").otherwise("evicted")
    result = cut(c.join(lists.read().select("id", "list"), "id", "left").select("id", outcome.alias("outcome"), F.when(~F.col("confirm"), trigger(F.col("reason"))).alias("trigger")))
    lists.merge(demoted, go.where("list = 'learned'").select("id"))
    registry.merge(gone=c.where("not confirm").select("id"))
    return result
