"""Sharding by a uniform shuffle whose partition-to-shard counts are drawn from the multivariate hypergeometric law."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import bucket_bits, cut, running_total


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Marked balls among `draws` taken without return; beyond the library's range by inversion around the mode."""
    if draws <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return draws
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    whole = good + bad
    mean = draws * good / whole
    spread = math.sqrt(mean * (bad / whole) * max(whole - draws, 1) / (whole - 1)) + 1
    low, high = max(0, draws - bad, int(mean - 12 * spread)), min(draws, good, int(mean + 12 * spread) + 1)
    # ratios of neighbouring probabilities, summed in logarithms from the low end
    k = np.arange(low, high, dtype=np.float64)
    log = np.concatenate(([0.0], np.cumsum(np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1))))
    p = np.exp(log - log.max())
    return low + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right"))


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard, for a uniform shuffle: margins are exact."""
    rng = np.random.default_rng(seed)
    left = list(shards)
    out = np.zeros((len(rows), len(shards)), dtype=np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for j in range(len(left)):
            rest -= left[j]
            x = hypergeometric(rng, left[j], rest, n)
            out[i, j], n = x, n - x
            left[j] -= x
    return out


def shuffle_into_shards(rows: DataFrame, key: list[str], shards: int = 24, rows_per_partition: int = 20_000, most_partitions: int = 4096, seed: int = 29) -> DataFrame:
    """Adds shard and slot to `rows`: a uniform random order cut into shards whose row counts differ by one at most.

    `key` names the columns that identify a row and decide its place, so that reruns agree. Rows are first dealt by a hash
    of the key to partitions of about `rows_per_partition` rows, or of more where that would be over `most_partitions`: the
    driver draws the partitions x shards matrix, which so has a bounded size. Each partition orders its rows by one seeded hash and
    cuts them at the drawn counts; in their shards rows are ordered again by a second hash, of which slot is the gapless rank.
    Both ranks are taken in buckets of the hash (running_total), so no task holds a partition or a shard.

    Rows that agree in every key column are placed one by one, in any order, and any nulls in it are values like others. An
    empty table stays empty. The names shard, slot and those that begin with _ must be free in `rows`.
    """
    spark = rows.sparkSession
    rows = cut(rows)
    n = rows.count()
    parts = min(most_partitions, max(shards, math.ceil(n / rows_per_partition)))
    dealt = rows.withColumn("_p", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(parts)).cast("int")).withColumn("_k1", F.xxhash64(F.lit(seed + 1), *key))
    counts = dict(dealt.groupBy("_p").count().collect())
    sizes = [n // shards + (j < n % shards) for j in range(shards)]
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], sizes, seed)
    cuts = spark.createDataFrame([(p, c.tolist()) for p, c in enumerate(matrix.cumsum(axis=1))], "_p int, _cuts array<bigint>")
    dealt = running_total(dealt, "_p", "_k1", key, F.lit(1).cast("long"), bucket_bits(n // parts), "_r")
    dealt = dealt.join(F.broadcast(cuts), "_p").withColumn("shard", F.expr("size(filter(_cuts, c -> c <= _r))").cast("int"))
    dealt = cut(dealt.drop("_p", "_cuts", "_r", "_k1").withColumn("_k2", F.xxhash64(F.lit(seed + 2), *key)))
    placed = running_total(dealt, "shard", "_k2", key, F.lit(1).cast("long"), bucket_bits(n // shards), "slot")
    return placed.drop("_k2")


def op10_hypergeometric(docs: DataFrame) -> DataFrame:
    """The contract's columns under the law `rows`. Null texts count as empty: size 8, crc32 0. Only doc_id and text are read,
    texts of any length whole; null ids are a value like others; repeated rows and equal texts get a slot each."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
