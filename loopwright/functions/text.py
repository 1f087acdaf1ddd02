"""Tokenizers, similarities and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that two of the tokenizers leave out.
EFFECT_STOPS = "the is at of on in to a an and or for was not but with this that from by are be has have had its you your can will all each any than then also".split()
THEME_STOPS = (
    "a an and are as at be been by do for from has have he her him his how i if in is it its me my no not of on or our the their them they this to up us was we what when which who will with you that but"
).split()


def half_up(c: Column, k: int) -> Column:
    """Rounds halves towards plus infinity on the double itself, as floor(x * 10^k + 0.5) / 10^k."""
    return F.floor(c * F.lit(float(10**k)) + F.lit(0.5)).cast("double") / F.lit(float(10**k))


def split_space(c: Column) -> Column:
    return F.split(c, r"\s+")


def _tokens(c: Column, strip: str, into: str, least: int) -> Column:
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), strip, into)
    return F.filter(split_space(text), lambda t: F.length(t) >= least)


def tok_bm25(c: Column) -> Column:
    return _tokens(c, r"[^a-z0-9\s_-]", " ", 2)


def tok_fail(c: Column) -> Column:
    return F.array_distinct(_tokens(c, r"[^a-z0-9\s]", " ", 3))


def tok_dup(c: Column) -> Column:
    return F.array_distinct(_tokens(c, r"[^a-z0-9\s-]", " ", 3))


def tok_sig(c: Column) -> Column:
    return _tokens(c, r"[^a-z0-9\s]", " ", 4)


def tok_review(c: Column) -> Column:
    return _tokens(c, r"[^a-z0-9\s]", "", 2)


def tok_eff(c: Column) -> Column:
    return F.filter(_tokens(c, r"[^a-z0-9\s]", " ", 3), lambda t: ~t.isin(*EFFECT_STOPS))


def tok_gold(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= 2))


def tok_overlap(c: Column) -> Column:
    return F.array_distinct(F.filter(split_space(F.lower(F.coalesce(c, F.lit("")))), lambda t: F.length(t) > 2))


def tok_rel(c: Column) -> Column:
    return F.array_distinct(_tokens(c, r"[^a-z0-9\s]", " ", 4))


def tok_cons(c: Column) -> Column:
    return _tokens(c, r"[^a-z0-9\s]", " ", 4)


def tok_theme(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"), lambda t: (F.length(t) > 3) & ~t.isin(*THEME_STOPS))


def sim_jaccard(a: Column, b: Column) -> Column:
    """Sets given as distinct arrays; 0 if their union is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def sim_overlap_min(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)).cast("double")), F.lit(0.0))


def sim_review(a: Column, b: Column) -> Column:
    """Share of the first list's tokens, repeats counted, that the second holds, over the shorter length."""
    hits = F.size(F.filter(a, lambda w: F.array_contains(b, w)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.least(F.size(a), F.size(b)).cast("double")), F.lit(0.0))


def sim_stem(rule: Column, correction: Column) -> Column:
    """Share of rule tokens that equal a correction token or prefix one, or the other way round, with 4 letters at least."""
    def close(w: Column) -> Column:
        short = lambda x, y: (F.length(x) >= 4) & F.startswith(y, x)
        return F.exists(correction, lambda t: (t == w) | short(t, w) | short(w, t))

    return F.coalesce(F.try_divide(F.size(F.filter(rule, close)).cast("double"), F.size(rule).cast("double")), F.lit(0.0))


def sim_substr(tokens: Column, haystack: Column) -> Column:
    hits = F.size(F.filter(tokens, lambda w: F.instr(F.lower(haystack), w) > 0))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(tokens).cast("double")), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sim_cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n >= 2, F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(1))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def strip_frontmatter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A---.*?---\n?", "")


def strip_markdown(c: Column) -> Column:
    for pattern, into in (
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"(?m)^#{1,6}\s+", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"\*([^*]+)\*", "$1"),
        ("`[^`]+`", " "),
        ("(?s)```.*?```", " "),
    ):
        c = F.regexp_replace(c, pattern, into)
    return c
