"""URL filters: rules stand in a file of sorted 64-bit digests that every task maps into memory, probes by binary search and confirms on full strings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.llm.common import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased, and then up to ? # or the end; null or no :// gives two empty strings."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    part = lambda i: F.coalesce(F.regexp_extract(rest, r"\A([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


class DigestArray:
    """Strings by sorted digest, as one block of bytes: count, digests, a number for each string, ends, texts. Equal digests keep all their strings."""

    @staticmethod
    def write(strings: list[str], numbers: list[int], hashed=digest) -> bytes:  # noqa: ANN001
        rows = sorted((hashed(s), s.encode(), n) for s, n in zip(strings, numbers, strict=True))
        ends = np.cumsum([0, *(len(s) for _, s, _ in rows)], dtype=np.int64)
        head = [np.array([len(rows)], np.int64), np.array([d for d, _, _ in rows], np.uint64), np.array([n for *_, n in rows], np.int64), ends]
        return b"".join(x.tobytes() for x in head) + b"".join(s for _, s, _ in rows)

    def __init__(self, data: np.ndarray, hashed=digest) -> None:  # noqa: ANN001
        """`data` is the block as bytes, such as a memory map, of which only the parts that are touched are read."""
        n = int(data[:8].view(np.int64)[0])
        self.hashed = hashed
        self.digests, self.numbers = data[8 : 8 + 8 * n].view(np.uint64), data[8 + 8 * n : 8 + 16 * n].view(np.int64)
        self.ends, self.texts = data[8 + 16 * n : 16 + 24 * n].view(np.int64), data[16 + 24 * n :]

    def probe(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(string, entry) for all entries that a string equals: one binary search over all, then every entry of an equal digest is compared in full."""
        keys = np.array([self.hashed(s) for s in strings], dtype=np.uint64)
        low, high = np.searchsorted(self.digests, keys, "left"), np.searchsorted(self.digests, keys, "right")
        at = np.repeat(np.arange(len(strings)), high - low)
        entry = np.arange(len(at)) + np.repeat(low - np.concatenate(([0], np.cumsum(high - low)[:-1])), high - low) if len(at) else np.zeros(0, np.int64)
        same = np.fromiter((self.text(j) == strings[i] for i, j in zip(at.tolist(), entry.tolist(), strict=True)), bool, len(at))
        return at[same], entry[same]

    def text(self, entry: int) -> str:
        return self.texts[self.ends[entry] : self.ends[entry + 1]].tobytes().decode()


def suffixes(host: str) -> list[str]:
    """The host and every domain above it."""
    return [host, *(host[i + 1 :] for i, c in enumerate(host) if c == ".")]


def fit(rules: DigestArray, hosts: DigestArray, host: list[str], path: list[str]) -> np.ndarray:
    """The entry in `rules` of the longest rule that fits each host and path, -1 where none does. `hosts` has an entry for each host of a
    rule and length of its path, so that only prefixes that some rule of the host could have are looked up."""
    names = {h: i for i, h in enumerate(dict.fromkeys(host))}
    above = [(i, s) for h, i in names.items() for s in suffixes(h)]
    lengths: dict[int, list[tuple[str, int]]] = {}
    for at, entry in zip(*(x.tolist() for x in hosts.probe([s for _, s in above])), strict=True):
        i, s = above[at]
        lengths.setdefault(i, []).append((s, int(hosts.numbers[entry])))
    asked = [(row, s + p[:n], len(s)) for row, (h, p) in enumerate(zip(host, path, strict=True)) for s, n in lengths.get(names[h], ()) if n <= len(p)]
    best: dict[int, tuple[int, int, int]] = {}
    for at, entry in zip(*(x.tolist() for x in rules.probe([s for _, s, _ in asked])), strict=True):
        row, s, n = asked[at]
        best[row] = max(best.get(row, (-1, -1, -1)), (len(s), n, entry))
    return np.array([best[i][2] if i in best else -1 for i in range(len(host))], dtype=np.int64)


def publish(spark: SparkSession, data: bytes) -> str:
    """Writes a file to the shared folder and hands it to every executor; returns the name that SparkFiles knows. A lost executor's successor fetches it again."""
    name = f"rules-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(str(fs.makeQualified(path).toString()))
    return name


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", most: int = 1_000_000) -> DataFrame:
    """Adds host, path, rule and verdict to `pages`, whose `url` is judged. `rules` are (verdict, host, path).

    A rule fits its host and all subdomains if the URL's path starts with the rule's, by character; of several the longest rule (host and path together)
    wins, then the one with the longer host. A rule given twice counts as it was given last. `default` is the verdict without a rule. At most
    `most` rules are taken, so that the files have a bounded size; more raise an error. Nothing is shuffled.
    """
    if len(rules) > most:
        raise ValueError(f"{len(rules)} rules; the digest files are made for {most} at most")
    spark = pages.sparkSession
    found = {(h.translate(str.maketrans(UPPER, LOWER)), p): v for v, h, p in rules}
    if any("/" in h for h, _ in found) or any(p and p[0] != "/" for _, p in found):
        raise ValueError("a rule's host holds no / and its path begins with one")
    kinds = sorted({v for v in found.values()})
    ends = sorted({(h, len(p)) for h, p in found})
    rule_file = publish(spark, DigestArray.write([h + p for h, p in found], [kinds.index(v) for v in found.values()]))
    host_file = publish(spark, DigestArray.write([h for h, _ in ends], [n for _, n in ends]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array, hosts = (DigestArray(np.memmap(SparkFiles.get(f), dtype=np.uint8, mode="r")) for f in (rule_file, host_file))
        for b in batches:
            at = fit(array, hosts, b.column("host").to_pylist(), b.column("path").to_pylist()).tolist()
            rule = pa.array([array.text(i) if i >= 0 else None for i in at], pa.string())
            verdict = pa.array([kinds[int(array.numbers[i])] if i >= 0 else default for i in at], pa.string())
            yield b.append_column("rule", rule).append_column("verdict", verdict)

    host, path = host_and_path(F.col("url"))
    d = pages.withColumns({"host": host, "path": path})
    return d.mapInArrow(judge, d.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("")}).schema)


#: Fixed by the contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op12_url_filter(pages: DataFrame) -> DataFrame:
    """The contract's columns, a row for each row of `pages`. A URL no rule fits is allowed. Null URLs and those without :// have an empty host and path, which no rule
    fits. A path is compared as it is written, so one that is empty does not start with /. User names and ports count as part of the host, as
    the contract has it. Only page_id and url are read; null ids, repeated rows and URLs of any length are judged like others."""
    return filter_urls(pages.select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")
