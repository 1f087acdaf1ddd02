"""Transcripts as VARIANT: lines of nested JSON whose content is a string or a list of blocks, read without a schema of theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loopwright.operators.iterate import cut

#: How a correction begins, and beginnings that look like one.
STARTERS = ["no ", "no,", "wrong", "stop", "don't", "dont", "not that", "fix", "undo", "revert", "that broke"]
NOISE = ["no problem", "no worries", "not bad", "no rush", "no issue", "no need", "not a problem"]
MARKS = r"M:\d+\s+S:\d+\s+Q:\d+"


def carried(rows: DataFrame, group: str, order: str, values: list[str]) -> DataFrame:
    """Each of `values` is replaced by the last one of its group, in order, that is not null, up to the row itself.

    Rows are written in ranges of (group, order); a range's last values are found first, then rows look at their own range and at what the
    ranges before leave. So no task holds a group, and what is summed up is a row for each group and range that meet.
    """
    d = cut(rows.repartitionByRange(group, order)).withColumn("_r", F.shiftrightunsigned(F.monotonically_increasing_id(), 33))
    last = d.groupBy(F.col(group).alias("_g"), F.col("_r").alias("_b")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in values])
    before = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    last = last.select("_g", "_b", *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in values])
    own = W.partitionBy(group, "_r").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.join(last, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_b")))
    return d.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(own), F.col(f"_{c}")) for c in values}).drop("_g", "_b", "_r", *[f"_{c}" for c in values])


def text_of(value: Column, path: str) -> Column:
    """A string at a path; null for anything else that stands there."""
    v = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(value, path, "string"))


def blocks_of(line: Column) -> Column:
    """The content blocks of a line, of its message or of itself; none if the content is a string or missing."""
    return F.coalesce(F.try_variant_get(line, "$.message.content", "array<variant>"), F.try_variant_get(line, "$.content", "array<variant>"), F.array().cast("array<variant>"))


def is_correction(text: Column) -> Column:
    start = lambda phrases: F.greatest(*[F.startswith(F.lower(F.trim(text)), F.lit(p)) for p in phrases])
    return ~start(NOISE) & start(STARTERS)


def parsed(lines: DataFrame, more_than: int = 50) -> DataFrame:
    """(file, line, kind, session_id, text, said, blocks, ts) of the lines (file, line, value) of files with more than `more_than` lines that are not blank.

    Lines that are no JSON are left out. session_id is the last one named up to the line, the file's name before that; said is the assistant's last text up to it.
    """
    full = lines.where(F.length(F.trim("value")) > 0)
    long = full.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    v = full.join(long.select("file"), "file", "left_semi").withColumn("v", F.try_parse_json("value")).where("v is not null")
    kind, blocks = text_of(F.col("v"), "$.type"), blocks_of(F.col("v"))
    of_type = lambda t: F.filter(blocks, lambda b: F.coalesce(text_of(b, "$.type") == t, F.lit(False)))
    first = F.get(F.filter(F.transform(of_type("text"), lambda b: text_of(b, "$.text")), lambda t: t.isNotNull()), F.lit(0))
    user = F.when(kind == "user", F.coalesce(text_of(F.col("v"), "$.message.content"), text_of(F.col("v"), "$.content"), first))
    said = F.when((kind == "assistant") & (F.size(of_type("text")) > 0), F.coalesce(text_of(F.element_at(of_type("text"), -1), "$.text"), F.lit("")))
    named = F.when(kind == "last-prompt", F.nullif(text_of(F.col("v"), "$.sessionId"), F.lit("")))
    tools = F.when(kind == "assistant", F.transform(of_type("tool_use"), lambda b: F.struct(F.coalesce(text_of(b, "$.name"), F.lit("unknown")).alias("tool"), F.nullif(text_of(b, "$.input.skill"), F.lit("")).alias("skill"))))
    d = v.select("file", "line", kind.alias("kind"), named.alias("session_id"), user.alias("text"), said.alias("said"), tools.alias("tools"), text_of(F.col("v"), "$.timestamp").alias("ts"))
    return carried(d, "file", "line", ["session_id", "said"]).withColumn("session_id", F.coalesce("session_id", "file"))


def signals(lines: DataFrame, more_than: int = 50) -> dict[str, DataFrame]:
    """What transcripts tell: ratings (session_id, line, score, ts), corrections (session_id, line, phrase, context), tools (tool, n), skills (session_id, line,
    skill), and files (scanned, skipped)."""
    d = cut(parsed(lines, more_than))
    text = d.where("kind = 'user' and length(text) > 0")
    marks = F.coalesce(F.nullif(F.regexp_extract("text", rf"(?i)/rate\s+({MARKS})", 1), F.lit("")), F.nullif(F.regexp_extract("text", f"(?i){MARKS}", 0), F.lit("")))
    used = d.select("session_id", "line", F.explode("tools").alias("t")).select("session_id", "line", "t.*")
    counts = lines.where(F.length(F.trim("value")) > 0).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return {
        "ratings": text.withColumn("score", marks).where("score is not null").select("session_id", "line", "score", "ts"),
        "corrections": text.where(is_correction(F.col("text"))).select("session_id", "line", F.substring("text", 1, 200).alias("phrase"), F.substring(F.coalesce("said", F.lit("")), 1, 200).alias("context")),
        "tools": used.groupBy("tool").agg(F.count(F.lit(1)).alias("n")),
        "skills": used.where("tool = 'Skill' and skill is not null").select("session_id", "line", "skill"),
        "files": counts.agg(F.count_if(F.col("n") > more_than).alias("scanned"), F.count_if(F.col("n") <= more_than).alias("skipped")),
    }
