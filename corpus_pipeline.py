"""The corpus pipeline: quality filter, near-duplicate removal, passage removal, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as Parquet and reads again as the docs of
the next stage. All but the last return the columns of documents. Extra columns of documents are left behind at the first stage.
An empty table stays empty through all stages; texts of any length are treated whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.llm.apportion import mix
from loopwright.llm.bbit_minhash import near_duplicates
from loopwright.llm.common import n_words, numbered, shared_folder, table
from loopwright.llm.nbest import encode
from loopwright.llm.pu_quality import filter_quality
from loopwright.llm.registry import MODEL
from loopwright.llm.suffix_dedup import strip_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, trained on the labelled ones among docs, scores 0.3 or more. Null and empty texts
    are scored like others; rows that repeat are scored each for itself; without labels every document stays (score 0.5)."""
    return filter_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest doc_id, of each group linked at 0.8 or more of five-word shingles. Texts without words link with
    nothing and stay, as do rows without a doc_id; rows that repeat a doc_id stay or go together."""
    groups = near_duplicates(docs, k=5, percent=80)
    kept = groups.where("kept").select("doc_id").distinct()
    null = docs.where("doc_id is null")  # no id, no group to drop it for
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS).union(null.select(*COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 100 bytes or more that stood earlier; documents of which nothing is left go, those that were empty stay. Every row keeps its own
    lang and source, whether its doc_id is null, repeated or neither (strip_passages has the order of such rows). Null texts become empty."""
    done = strip_passages(docs.select(*COLUMNS), 100, with_text=True, carry=("lang", "source"))
    text = F.when(F.col("n_bytes") > 0, F.col("text")).otherwise(F.lit(""))
    out = done.where("n_bytes = 0 or n_removed < n_bytes")
    return out.select("doc_id", text.alias("text"), "carried.lang", "carried.source", F.length(text).cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the block that holds its middle word is taken, so whole documents meet the source targets. Texts
    without words go with the block they stand in; null sources are one source. Each row is placed and taken for itself: rows that agree in doc_id and
    size are ordered by their contents, so reruns take the same texts as often; an empty table stays empty."""
    own = numbered(docs, "at").withColumn("content", F.xxhash64("text", "lang", "n_chars"))
    placed, blocks = mix(own, size=n_words(F.col("text")), row=("content", "at"))
    half = F.floor(F.col("size") / 2)
    at = F.element_at(F.filter("spans", lambda s: (s["from"] <= half) & ((s["from"] + s["words"] > half) | (F.col("size") == 0))), 1)
    b = blocks.select(F.col("source").alias("bs"), F.col("start").alias("b0"), "block", "copies", "part")
    d = placed.withColumn("mid", F.col("start") + half).withColumn("in", at["block"])
    d = d.join(b, F.col("source").eqNullSafe(F.col("bs")) & (F.col("in") == F.col("block")), "left")
    times = F.coalesce(F.col("copies") + F.when(F.col("mid") - F.col("b0") < F.col("part"), 1).otherwise(0), F.lit(0))
    d = d.select("at", times.cast("int").alias("times")).where("times > 0")
    return own.join(d, "at").withColumn("n", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids and n-best digests of every document that the mix holds, copies too; null and empty texts have no ids. A megabyte of text
    at a time: the executors still hold what earlier stages left in their heap."""
    return encode(docs, MODEL, 4, at_once=1 << 20)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("mixing", mixing), ("encoding", encoding)]

#: SQL can state neither the classifier nor the encoder; tests hold the stages against brute force or, for the classifier, labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written and read again in the shared folder the session names. A stage's
    table is deleted when the next one's is written; the last, which the result reads, stays."""
    docs, last = table(spark, sf_dir, "documents"), None
    base = shared_folder(spark)
    for name, stage in STAGES[:-1]:
        path = f"{base}/pipeline-{uuid.uuid4().hex}-{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            old = spark._jvm.org.apache.hadoop.fs.Path(last)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
