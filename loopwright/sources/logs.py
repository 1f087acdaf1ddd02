"""Readers and sinks of the signal logs: JSON lines, Markdown rules, transcripts, hashes, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from loopwright.operators.iterate import cut

#: Other names under which fields and logs are met.
FIELD_ALIASES = {"sentiment_summary": "sentimentSummary", "ts": "timestamp", "tool": "toolName", "suggested_skills": "suggestions", "relevant_rules": "relevantRules", "injectionCount": "recalls"}
LOG_ALIASES = {"corrections": "correction-captures", "skills": "skill-invocations", "scores": "quality-scores"}


def read_signals(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are left out."""
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    raw = spark.read.schema(with_bad).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    return raw.where("_bad is null").drop("_bad")


def read_log(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A log under its own or its other name; a missing log is empty."""
    found = None
    jvm = spark.sparkContext._jvm
    for n in (name, LOG_ALIASES.get(name)):
        path = n and jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.jsonl")
        if path and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            found = read_signals(spark, f"{folder}/{n}.jsonl", schema)
            break
    return spark.createDataFrame([], schema) if found is None else found


def window_of_lines(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """`limit` rows after `offset`, in order, as a top-n and not a global rank."""
    return rows.orderBy(order).offset(offset).limit(limit)


def coalesce_aliases(rows: DataFrame) -> DataFrame:
    """Fields under one name where two are in use."""
    for name, other in FIELD_ALIASES.items():
        if other in rows.columns:
            rows = rows.withColumn(name, F.coalesce(name, other) if name in rows.columns else F.col(other)).drop(other)
    return rows


def append_signals(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """(id, front, body) of Markdown rules, but for MEMORY* and README* files; front holds `key: value` lines."""
    d = spark.read.text(folder, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.md$", "").alias("id"), F.col("value"))
    return d.where(~F.col("id").rlike("^(MEMORY|README)")).select("id", frontmatter(F.col("value")).alias("front"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?", "").alias("body"))


def frontmatter(text: F.Column) -> F.Column:
    """Keys and values of the lines between the opening fences, split at the first colon."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 1)
    pair = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(pair, lambda p: p["key"])), lambda k: F.struct(k, F.element_at(F.filter(pair, lambda p: p["key"] == k), -1)["value"])))


def parse_transcript(lines: DataFrame, text: str = "value", keep: tuple[str, ...] = ("session_id", "line")) -> DataFrame:
    """(keep..., role, text) of user and assistant lines; content is a string or a list of blocks, of which texts are joined."""
    kind = F.get_json_object(text, "$.type")
    plain = F.get_json_object(text, "$.message.content")
    blocks = F.from_json(plain, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), " ")
    d = lines.select(*keep, kind.alias("role"), F.trim(F.when(F.startswith(plain, F.lit("[")), joined).otherwise(plain)).alias("text"))
    return d.where(F.col("role").isin("user", "assistant") & (F.length("text") > 0))


def tool_blocks(lines: DataFrame, base: str = "", text: str = "value") -> DataFrame:
    """(session_id, path, tool, line): files that Write and Edit blocks touch, first time each."""
    blocks = F.from_json(F.get_json_object(text, "$.message.content"), "array<struct<type:string,name:string,input:struct<file_path:string>>>")
    d = lines.select("session_id", "line", F.explode(blocks).alias("b")).where("b.type = 'tool_use' and b.name in ('Write', 'Edit') and b.input.file_path is not null")
    path = F.when(F.startswith(F.col("b.input.file_path"), F.lit(base)) & F.lit(base != ""), F.substring(F.col("b.input.file_path"), F.lit(len(base) + 1), F.length("b.input.file_path"))).otherwise(F.col("b.input.file_path"))
    return d.groupBy("session_id", path.alias("path")).agg(F.min(F.struct("line", "b.name")).alias("m")).select("session_id", "path", F.col("m.name").alias("tool"), F.col("m.line").alias("line"))


def long_sessions(turns: DataFrame, more_than: int = 50) -> DataFrame:
    n = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return turns.join(n.select("session_id"), "session_id", "left_semi")


def trace_prompts(traces: DataFrame, column: str = "input") -> DataFrame:
    """System and user prompts of trace inputs (JSON): a list of messages, an object with them, or an object with prompt fields."""
    msgs = F.from_json(F.coalesce(F.get_json_object(column, "$.messages"), F.when(F.startswith(F.col(column), F.lit("[")), F.col(column))), "array<struct<role:string,content:string>>")
    role = lambda r: F.array_join(F.transform(F.filter(msgs, lambda m: m["role"] == r), lambda m: m["content"]), "\n")
    pick = lambda r, *names: F.coalesce(F.nullif(role(r), F.lit("")), *[F.get_json_object(column, "$." + n) for n in names])
    return traces.select("*", pick("system", "systemPrompt", "system").alias("system_prompt"), pick("user", "userPrompt", "prompt", "user").alias("user_prompt"))


def benchmark_tasks(reflections: DataFrame, least: float = 7.0, words: tuple[str, ...] = ()) -> DataFrame:
    """(task_id, task_description) of well-felt reflections, with any of the words if some are given."""
    d = reflections.where(F.col("implied_sentiment") >= least)
    if words:
        d = d.where(F.col("task_description").rlike("(?i)" + "|".join(words)))
    return d.select("task_description", F.substring(F.sha2("task_description", 256), 1, 16).alias("task_id"))


def verify_tasks(tasks: DataFrame) -> DataFrame:
    """(task_description, ok): whether each stored task_id is the hash of its task."""
    return tasks.select("task_description", (F.col("task_id") == F.substring(F.sha2("task_description", 256), 1, 16)).alias("ok"))


def content_hash(tasks: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row: the hash of all task descriptions in order, joined by bars."""
    s = tasks.agg(F.sort_array(F.collect_list(F.struct(order, "task_description"))).alias("s"))
    return s.select(F.sha2(F.array_join(F.transform("s", lambda x: x["task_description"]), "|"), 256).alias("hash"))


def score_events(scores: DataFrame) -> DataFrame:
    """(trace_id, event_id, value): score events whose ids depend on their content alone, so that sending twice is harmless."""
    key = F.concat_ws(":", "trace_id", "dimension", (F.col("value") * 1000).cast("bigint").cast("string"))
    return scores.select("trace_id", F.substring(F.sha2(key, 256), 1, 36).alias("event_id"), "value")


def changed_rows(rows: DataFrame, cache: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """Rows whose body is new or changed since the cache (key, hash)."""
    return rows.withColumn("hash", F.md5(body)).join(cache.select(key, "hash"), [key, "hash"], "left_anti")


def after_cursor(rows: DataFrame, order: str, ts: str = "ts") -> DataFrame:
    """Rows later than all that arrived before them; equal times are lost, as with a cursor over time.

    Rows are written in ranges of the arrival order: each range's latest time is found first, then rows look at their own range and at
    the latest time of the ranges before. There are as many ranges as shuffle partitions, so the small side does not grow with the rows.
    """
    d = cut(rows.repartitionByRange(order)).withColumn("_b", F.shiftrightunsigned(F.monotonically_increasing_id(), 33))
    top = d.groupBy("_b").agg(F.max(ts).alias("_m")).withColumn("_before", F.max("_m").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).select("_b", "_before")
    own = F.max(ts).over(W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    d = d.join(F.broadcast(top), "_b").withColumn("_own", own).withColumn("_seen", F.greatest("_own", "_before"))
    return d.where(F.col("_seen").isNull() | (F.col(ts) > F.col("_seen"))).drop("_b", "_before", "_own", "_seen")


def audit_markdown(gold: DataFrame) -> DataFrame:
    """(session_id, text): a check list of each session's rules, in order."""
    line = F.concat(F.when(F.col("relevant"), "- [x] ").otherwise("- [ ] "), "rule_id")
    g = gold.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    return g.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def parse_audit(audits: DataFrame) -> DataFrame:
    """(session_id, place, rule_id, relevant) read back from check lists."""
    d = audits.select("session_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^- \[[ x]\] .+$"), 0)).alias("place", "line"))
    return d.select("session_id", "place", F.substring("line", 7, 1_000_000).alias("rule_id"), F.startswith(F.col("line"), F.lit("- [x]")).alias("relevant"))


def export_state(tables: dict[str, DataFrame], folder: str, secret: tuple[str, ...] = ("apiKey", "secretKey")) -> None:
    """Writes each table as Parquet under the folder, secret columns masked."""
    for name, d in tables.items():
        d.withColumns({c: F.lit("***") for c in secret if c in d.columns}).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def import_state(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def file_report(spark: SparkSession, folder: str, max_bytes: int) -> DataFrame:
    """(name, bytes, modified, rotate) of a folder's files, read from their metadata."""
    d = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return d.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), (F.col("length") > max_bytes).alias("rotate"))
