"""The source audit, the URL filter and the vector codes against plain loops on small and awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopwright.llm import filtering_lloyd, source_audit, url_filter

DOC = "doc_id bigint, text string, lang string, source string, term string, n bigint"
PAGE = "page_id bigint, url string, host string, rule string"


def plain_audit(rows):
    """All groups, languages and kept terms in full, zeros too."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    out = []
    for lang in {x[0] for x in docs}:
        kept = [t for t, n in held[lang].items() if n >= 3]
        groups = {s for x, s, _ in docs if x == lang}
        p = {}
        for s in [*groups, None]:
            c = counts[lang, s]
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups - {s}]
            term = [(-f(p[s][t], p[None][t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, 200)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def audit_rows(seed=4, n=150):
    rng = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "straße", "don't", "a1b", "x_y", "ﬀ", "日本", "tie1", "tie2"] + [f"w{c}{d}" for c in "abcdefgh" for d in "ijklmnopqrstuv"]
    rows = []
    for i in range(n):
        source = rng.choice(["s0"] * 4 + ["s1", "s2", None, "", "é"])
        text = " ".join(rng.choice(words if source != "s1" else words[:30]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "en", "fr", None, ""]), source))
    return rows + [rows[0], rows[0], (None, "en", "s9"), ("", "lone", "s1"), ("one two three", "few", "s1"), (" ".join(f"long{'a' * (i % 40)}" for i in range(200_000)), "en", "s0")]


def test_audit_against_a_plain_loop(spark):
    rows = audit_rows()
    d = spark.createDataFrame([(i, t, lang, s, "x", 1) for i, (t, lang, s) in enumerate(rows)], DOC).repartition(5)
    want = plain_audit(rows)
    assert sorted(map(tuple, source_audit.op11_source_audit(d).collect())) == want
    # a sketch of few cells lets many terms through that the exact counts then drop
    few = source_audit.audit(d.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]), most_bits=4)
    assert sorted(map(tuple, few.collect())) == want
    assert source_audit.op11_source_audit(d.limit(0)).count() == 0


def test_sketch_never_underestimates_and_drops_most(spark):
    rng = np.random.default_rng(3)
    h, times = rng.integers(0, 2**64, 3000, dtype=np.uint64), rng.integers(1, 4, 3000)
    parts = [source_audit.Sketch(12) for _ in range(3)]
    for i, s in enumerate(parts):
        s.add(h, np.where(times > i, 1, 0))
    merged = source_audit.Sketch(12, np.minimum(sum(s.cells.astype(int) for s in parts), source_audit.FULL).astype(np.uint8))
    assert (merged.estimate(h) >= times).all()
    assert (source_audit.Packed(12, source_audit.pack(merged.cells.reshape(-1))).estimate(h) == merged.estimate(h)).all()
    assert (source_audit.unpack(source_audit.pack(merged.cells.reshape(-1))) == merged.cells.reshape(-1)).all()
    rows = [(f"common shared only{'abcdefghij'[i // 100]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i % 10]} common", "en", f"s{i % 3}") for i in range(1000)]
    d = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    sketch = source_audit.sketch_frequencies(d, 16)
    found = source_audit.surviving_counts(d, sketch, 3).collect()
    exact = {(r.source, r.term): (r.n, r.docs) for r in found}
    assert exact["s0", "common"] == (668, 334) and exact["s0", "shared"] == (334, 334)
    assert len(found) <= 6 + 20  # of a thousand terms that one document holds, hardly any reach the shuffle


def test_shares_do_not_overflow(spark):
    d = spark.createDataFrame([(4 * 10**12, 9 * 10**12, 10**9), (0, 0, 1), (6, 6, 1)], "c long, n long, v long")
    got = [r[0] for r in d.select(source_audit.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in ((4 * 10**12, 9 * 10**12, 10**9), (0, 0, 1), (6, 6, 1))]


URLS = [
    "http://example.net/en/1", "https://a.b.example.net/en/", "https://a.example.net/de/x", "HTTP://X.EXAMPLE.NET/EN/1", "http://example.com/de/1?q=/en/", "http://sub.example.com/fr/", "http://notexample.com/de/",
    "http://x.org/fr/1#a", "http://org/fr/", "http://x.org/en", "net/", "http://net", "http://net/", "http://net?x", "http://a.net#/", "ftp://u@a.net:80/", "://net/", "a://b://c.net/", "http:///x", "http://.net/", "http://Ä.net/é?x", "", None,
    "http://" + "a." * 3000 + "net/" + "p" * 500_000, "http://x.org/fr/\nline", "http://x.org/fr/1",
]


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_urls_against_a_plain_loop(spark):
    urls = [*URLS, URLS[0]]
    d = spark.createDataFrame([(i if i else None, u, "x", "y") for i, u in enumerate(urls)], PAGE)
    got = sorted(map(tuple, url_filter.op12_url_filter(d).collect()), key=repr)
    assert got == sorted(((i if i else None, *plain_verdict(u, url_filter.RULES)) for i, u in enumerate(urls)), key=repr)
    assert url_filter.op12_url_filter(d.limit(0)).count() == 0


def test_many_rules_and_no_rule(spark):
    rng = random.Random(5)
    label = lambda: rng.choice("abcd")
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + label() * rng.randint(0, 2) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (rng.choice(["allow", "block", "hold"]), h, p) for h, p in ((host(), path()) for _ in range(400))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(800)]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(d, rules, default="none").collect()}
    assert got == {i: plain_verdict(u, rules, "none") for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.filter_urls(d, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.filter_urls(d, rules, most=3)


def test_equal_digests_are_told_apart_by_their_strings():
    strings = [f"s{i}" for i in range(50)]
    array = url_filter.DigestArray(np.frombuffer(url_filter.DigestArray.write(strings, list(range(50)), len), dtype=np.uint8), len)  # the digest is the length
    asked = ["s49", "s7", "s50", "", "zz", "s0"]
    at, entry = array.probe(asked)
    assert [(asked[i], array.text(j), int(array.numbers[j])) for i, j in zip(at, entry, strict=True)] == [("s49", "s49", 49), ("s7", "s7", 7), ("s0", "s0", 0)]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry."""
    kept = sorted(((i is None, i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], r[1] or 0, r[2]))
    d = len(kept[0][2]) // parts
    x = np.array([[math.floor(256 * np.float32(c)) for c in r[2]] for r in kept]).reshape(len(kept), parts, d)
    books = x[:entries].copy()
    near = lambda: ((x[:, None] - books[None]) ** 2).sum(axis=3).argmin(axis=1)
    for _ in range(rounds):
        at = near()
        for p in range(parts):
            for e in set(at[:, p]):
                own = x[at[:, p] == e, p]
                books[e, p] = [int(s) // len(own) for s in own.sum(axis=0)]
    at = near()
    error = [int(((x[i] - books[at[i], range(parts)]) ** 2).sum()) for i in range(len(kept))]
    by_label = Counter()
    for r, e in zip(kept, error, strict=True):
        by_label[r[3]] += e
    told = hashlib.sha256(",".join(str(c) for p in range(parts) for b in books for c in b[p]).encode()).hexdigest()
    return [(r[1], "".join(f"{c:02x}" for c in a), e, by_label[r[3]], told) for r, a, e in zip(kept, at, error, strict=True)]


def vector_rows(n, seed=6, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    rows = [(int(i), [float(np.float32(c)) for c in (centres[rng.integers(9)] + rng.normal(size=dim) * 0.1 if i % 3 else centres[0])], int(i % 4) if i % 5 else None) for i in rng.permutation(n)]
    bad = [(n, None, 1), (n + 1, [], 1), (n + 2, [None] * dim, 1), (n + 3, [float("nan")] * dim, 1), (n + 4, [float("inf")] * dim, 1), (n + 5, [0.0] * dim, 1), (None, [1.0] * dim, None)]
    return rows + bad + [rows[0], rows[0]]


@pytest.mark.parametrize("n", [3, 60, 700])
def test_codes_against_a_plain_loop(spark, n):
    rows = vector_rows(n)
    d = spark.createDataFrame([(*r, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, code string, part int").repartition(3)
    got = sorted(map(tuple, filtering_lloyd.op13_filtering_lloyd(d).collect()), key=repr)
    assert got == sorted(plain_codes(rows), key=repr)
    assert filtering_lloyd.op13_filtering_lloyd(d.limit(0)).count() == 0


def test_trees_agree_with_every_point_against_every_entry():
    rng = np.random.default_rng(8)
    for n, k, wide in ((1, 1, 5), (40, 7, 3), (3000, 64, 400), (3000, 64, 4), (2000, 256, 30)):  # narrow ranges make ties
        x, c = rng.integers(-wide, wide, size=(n, 4)), rng.integers(-wide, wide, size=(k, 4))
        at, count, total = filtering_lloyd.Tree(x, 8).assign(c)
        want = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (at == want).all() and (count == np.bincount(want, minlength=k)).all()
        assert all((total[e] == x[want == e].sum(axis=0)).all() for e in range(k))


def test_subtrees_are_assigned_whole():
    """Where points stand in tight bunches, boxes settle nearly all of them: without its points, a tree still knows counts and sums."""
    rng = np.random.default_rng(9)
    c = np.array([[a, b, 0, 0] for a in range(0, 8000, 1000) for b in range(0, 8000, 1000)])
    x = np.repeat(c, 256, axis=0) + rng.integers(-5, 5, size=(64 * 256, 4))
    tree = filtering_lloyd.Tree(x)
    want = tree.assign(c)
    tree.points = np.full_like(tree.points, 99_999)  # a leaf that stays undecided would read them
    _, count, total = tree.assign(c)
    assert (count == want[1]).all() and (total == want[2]).all() and (count == 256).all()


def test_lengths_that_cannot_be_cut_alike(spark):
    rows = [(1, [0.5] * 16, 0), (2, [0.25] * 32, 0), (3, [1.0] * 5, 0), (4, [0.75] * 16, 1)]
    got = filtering_lloyd.op13_filtering_lloyd(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(r.vec_id for r in got) == [1, 4]
    with pytest.raises(Exception, match="beyond"):
        filtering_lloyd.compress(spark.createDataFrame([(1, [1e9] * 16, 0)], "vec_id long, embedding array<float>, label int"))
