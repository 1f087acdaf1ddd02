"""Quality rules by distribution divergence, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import cut, words

#: Frequent function words of four languages, one bin of the word histogram each language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "it", "that", "for", "was", "on", "are", "as", "with", "be", "by", "at", "this", "from", "or", "an", "a", "not"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur", "avec", "ce", "elle"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como"),
}
#: Character classes counted one by one; white space, characters beyond ASCII and all the rest complete the histogram.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:?]", "bang": "[!]", "symbol": r"[#*$%&|<>]"}


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms (arrays of shares that add up to 1), from 0 to 1."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts the rules and histograms need, one row a document.

    Repeated three-word windows are found by hashing the windows of a text and sorting (hash, place): equal
    neighbours are windows found twice or more; the work is n log n in the words of one text.
    """
    text = F.coalesce("text", F.lit(""))
    count = lambda pattern: (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")
    d = docs.select("doc_id", "lang", text.alias("text"))
    d = d.select("doc_id", "lang", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        "doc_id",
        "lang",
        "w",
        F.length("text").cast("long").alias("chars"),
        F.length(F.regexp_replace("text", r"[\x00-\x7F]+", "")).cast("long").alias("beyond"),
        F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        *[count(p).alias(c) for c, p in CLASSES.items()],
    )
    three = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))
    plain = F.transform("w", lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?#*$%&"))))
    d = d.withColumns({"h": F.when(F.size("w") >= 3, three).otherwise(F.array().cast("array<bigint>")), "plain": plain})
    listed = lambda ws: F.size(F.filter("plain", lambda x: x.isin(*ws))).cast("long")
    bins = [listed(ws).alias(f"common_{lang}") for lang, ws in COMMON.items()]
    s = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.select("doc_id", "lang", F.size("w").cast("long").alias("n_words"), "chars", "beyond", "word_chars", "n_dup_lines", *CLASSES, *bins, s.alias("s"))
    again = F.filter("s", lambda e, k: (F.get("s", k - 1)["h"] == e["h"]) | (F.get("s", k + 1)["h"] == e["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    return d.withColumn("n_repeat_words", F.when(F.col("s").isNull(), 0).otherwise(covered).cast("long")).drop("s")


def histograms(f: DataFrame) -> DataFrame:
    """Adds char_counts and word_counts, the two histograms, as arrays of doubles."""
    space = F.col("chars") - F.col("word_chars")
    rest = F.greatest(F.col("word_chars") - sum((F.col(c) for c in CLASSES), F.lit(0)) - F.col("beyond"), F.lit(0))
    chars = F.array(*[F.col(c).cast("double") for c in (*CLASSES, "beyond")], space.cast("double"), rest.cast("double"))
    bins = [F.col(f"common_{x}").cast("double") for x in COMMON]
    other = F.greatest(F.col("n_words") - F.greatest(*[F.col(f"common_{x}") for x in COMMON]), F.lit(0)).cast("double")
    return f.withColumn("char_counts", chars).withColumn("word_counts", F.array(*bins, other))


def judge(
    docs: DataFrame, max_char_distance: float = 0.26, max_word_distance: float = 0.24, min_words: int = 50, min_chars: int = 200, min_documents: int = 10, most_languages: int = 4096
) -> DataFrame:
    """Rule counts of every document and its verdict.

    References are the summed histograms of all documents of one `lang` that pass the base rules, for every language with
    at least `min_documents` of those; null is no language. A document's distances are those to the nearest reference. Guards: a text under
    `min_words` words fails the base rules; one under `min_chars` characters, one whose language has too few documents
    for a reference, or a table without references, has no distances and keeps the base verdict: no text is held against foreign
    languages alone. The references travel with the tasks; more than `most_languages` of them raise an error.

    Null and empty texts have no words and fail. Very long texts are counted whole. Repeated rows are judged each for itself and
    count each in their language's reference. Distances at a limit pass. Columns other than doc_id, text and lang are ignored,
    whatever their names. An empty table gives an empty result.
    """
    f = cut(text_features(docs))
    f = f.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    f = histograms(f)
    n_char, n_word = len(CLASSES) + 3, len(COMMON) + 1
    total = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    passed = f.where("not base_failed")
    by_lang = passed.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), total("char_counts", n_char).alias("rc"), total("word_counts", n_word).alias("rw"))
    refs = by_lang.where(F.col("n") >= min_documents).limit(most_languages + 1)
    refs = refs.agg(F.array_sort(F.collect_list(F.struct("lang", shares(F.col("rc")).alias("rc"), shares(F.col("rw")).alias("rw")))).alias("refs"))
    many = F.raise_error(F.lit(f"more than {most_languages} languages"))
    refs = refs.select(F.when(F.size("refs") <= most_languages, F.col("refs")).otherwise(many).alias("refs"))
    f = f.join(F.broadcast(refs)).withColumns({"pc": shares(F.col("char_counts")), "pw": shares(F.col("word_counts"))})
    known = F.col("lang").isNull() | F.exists("refs", lambda r: r["lang"] == F.col("lang"))
    long_enough = (F.col("chars") >= min_chars) & (F.size("refs") > 0) & known
    f = f.withColumn("char_distance", F.when(long_enough, F.array_min(F.transform("refs", lambda r: js_distance(F.col("pc"), r["rc"])))))
    f = f.withColumn("word_distance", F.when(long_enough, F.array_min(F.transform("refs", lambda r: js_distance(F.col("pw"), r["rw"])))))
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return f.withColumn("kept", ~F.col("base_failed") & ~far)


def op1_divergence(docs: DataFrame) -> DataFrame:
    """The contract's columns, with the two distances, to six places, after them."""
    six = [(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("char_distance", "word_distance")]
    cols = ["doc_id", "n_words", "word_chars", F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "base_failed", "kept", *six]
    return judge(docs).select(*cols)
