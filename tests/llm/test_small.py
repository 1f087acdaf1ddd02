"""Corpus operators against brute force on small fixtures, with nulls, empty texts, ties, repeats and empty tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopwright.llm import apportion, bbit_minhash, byte_gru, common, divergence, hypershuffle, nbest, pagediff, pu_quality, rp_forest, suffix_dedup
from loopwright.llm import registry as corpus

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, block string, row string"
GAP = r"[^\x20\x09-\x0D]+"


def documents(spark, texts, sources=None):
    """Documents with two columns whose names clash with ones the operators use."""
    n = len(texts)
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, sources[i] if sources else f"s{i % 3}", 0, "x", "y") for i, t in enumerate(texts)], DOC) if n else spark.createDataFrame([], DOC)


def some_texts(seed=1, n=40):
    rng = random.Random(seed)
    words = ["the", "of", "and", "word", "Ünder", "straße", "x1", "###", "long" * 30, "été"]
    base = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    base += [base[0], base[0], base[1].replace("word", "work", 1), base[2] + " end", None, "", " \n\t", "one", "one", "ONE two", "a" * 400, "ab" * 300, "Shared line.\n" * 30]
    shared = " ".join(f"passage{i}" for i in range(60))
    return base + [f"{t} {shared} {t}" for t in ("alpha", "beta", "gamma")]


def test_repeated_rows_and_empty_tables_do_not_crash(spark):
    for name, op in (("op1", divergence.op1_divergence), ("op4", suffix_dedup.op4_suffix_lpf), ("op8", bbit_minhash.op8_bbit_minhash), ("op9", apportion.op9_sainte_lague), ("op10", hypershuffle.op10_hypergeometric), ("op3", lambda d: nbest.op3_nbest(d, corpus.MODEL)), ("op7", byte_gru.op7_byte_gru)):
        assert op(documents(spark, [])).count() == 0, name
        twice = documents(spark, ["same text here", None]).union(documents(spark, ["same text here", None]))
        assert op(twice).count() == 4, name


def test_running_total_matches_a_plain_order(spark):
    d = spark.createDataFrame([(i, None if i % 3 == 0 else "g", i % 5) for i in range(200)], "id long, g string, v long").withColumn("k", F.xxhash64("id"))
    got = {r.id: r.t for r in common.running_total(d, "g", "k", ["id"], F.col("v"), 6, "t").collect()}
    rows = sorted(((r.k, r.id, r.g, r.v) for r in d.collect()))
    for g in (None, "g"):
        t = 0
        for _, i, _, v in (r for r in rows if r[2] == g):
            assert got[i] == t
            t += v


def test_components_of_chains_and_stars(spark):
    e = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(300, 200), (5, 5)]
    got = dict(common.components(spark.createDataFrame(e, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 120)) and got[300] == 200


def test_divergence_counts(spark):
    texts = some_texts()
    got = {r.doc_id: r for r in divergence.op1_divergence(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(GAP, t or "")
        at = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + j for k in range(len(w) - 2) if at[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(GAP, x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_js_distance_of_known_histograms(spark):
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [1.0, 0.0])], "p array<double>, q array<double>, r array<double>")
    got = d.select(divergence.js_distance(F.col("p"), F.col("q")).alias("far"), divergence.js_distance(F.col("p"), F.col("r")).alias("same")).first()
    assert (got.far, got.same) == (1.0, 0.0)


@pytest.mark.parametrize("sizes", [{}, {"hot": 0}, {"block_bytes": 500, "bucket_bytes": 500}])
def test_passages_match_brute_force(spark, sizes):
    texts = some_texts(3)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.strip_passages(documents(spark, texts), 100, **sizes).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [2, 3])
def test_passages_of_crowded_and_lone_stretches_match_brute_force(spark, hot):
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = []
    for _ in range(60):  # one text shares its right side with four others and windows of its left side with the last alone
        base = some(180)
        texts += [base, *[some(70) + base[70:] for _ in range(4)], base[:110] + some(70)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(t[k : k + 100])
        want[i] = (sum(gone), hashlib.sha256(bytes(x for x, g in zip(t.encode(), gone, strict=True) if not g)).hexdigest())
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.strip_passages(documents(spark, texts), 100, hot=hot).collect()}
    assert got == want


def test_longest_previous_matches_brute_force():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 400, dtype=np.uint8)
    data[200:330] = data[20:150]
    at, kind = np.arange(360), rng.integers(0, 3, 360)
    order, group, common = suffix_dedup.suffix_order(data, at, kind, 40)
    text = data.tobytes()
    assert [(kind[i], text[i : i + 40], i) for i in order] == sorted((kind[i], text[i : i + 40], i) for i in range(360))
    got = np.zeros(360, dtype=int)
    got[order] = suffix_dedup.longest_previous(order, group, common)

    def shared(i, j):
        return next((x for x in range(40) if text[i + x] != text[j + x]), 40)

    assert got.tolist() == [max([shared(i, j) for j in range(i) if kind[j] == kind[i]], default=0) for i in range(360)]
    assert 0 < (got == 40).sum() < (got > 10).sum()


def test_passages_of_rows_without_ids(spark):
    text = "a passage " * 5 + "of more than one hundred bytes that several rows without any id have in common, word for word"
    d = documents(spark, [text, text + "x", None, text]).withColumn("doc_id", F.when(F.col("doc_id") == 0, 7))
    got = suffix_dedup.op4_suffix_lpf(d).collect()
    assert [r.n_removed for r in got if r.doc_id == 7] == [0] and sorted(r.n_removed for r in got) == [0, 0, len(text), len(text)]


@pytest.mark.parametrize(("k", "sizes"), [(2, {}), (5, {}), (5, {"rows": 16, "weight": 1500})])
def test_near_duplicates_match_brute_force(spark, k, sizes):
    texts = some_texts(5)
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 500)}" for _ in range(150)]
    for _ in range(60):  # a group of near copies around one text, some of them too far from all others
        x = list(base)
        for _ in range(rng.choice((1, 3, 8, 14))):
            x[rng.randrange(len(x))] = f"e{rng.randint(0, 9999)}"
        texts.append(" ".join(x))

    def shingles(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(GAP, t or "")]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in bbit_minhash.near_duplicates(documents(spark, texts), k, 80, **sizes).collect()}
    assert got == {i: (len(s), top(i), top(i) == i) for i, s in enumerate(sets)}


def test_sets_link_by_full_counts():
    import pyarrow as pa

    rng = random.Random(2)
    rows = [sorted(rng.sample(range(30), rng.randint(1, 25))) for _ in range(40)]
    s = bbit_minhash.Sets(pa.chunked_array([pa.array(rows, pa.list_(pa.int64()))]))
    for i in range(40):
        others = np.array([j for j in range(40) if j != i and rng.random() < 0.7])
        assert s.linked(i, others, 40).tolist() == [j for j in others if 100 * len({*rows[i]} & {*rows[j]}) >= 40 * len({*rows[i]} | {*rows[j]})]


def test_tiles_let_every_two_rows_meet_once(spark):
    rng = random.Random(7)
    d = [(h, h * 100 + r, rng.random() < 0.5, rng.choice((90, 100, 115, 400))) for h in (1, 2) for r in range(40)]
    cells = spark.createDataFrame([(h, m, r, r, n) for h, r, m, n in d], "hub long, main boolean, rep long, c long, n long")
    tiles = {}
    for r in bbit_minhash._tiles(cells, 0.8, 5, 10**6).collect():
        tiles.setdefault(r.tile, ([], []))[r.side].append(r.rep)
    met = Counter()
    for a, b in tiles.values():
        met.update(frozenset((x, y)) for x, y in (itertools.product(a, b) if b else itertools.combinations(a, 2)))
    assert max(met.values()) == 1 and max(len(a) + len(b) for a, b in tiles.values()) <= 20
    for (h, x, p, n), (g, y, q, m) in itertools.combinations(d, 2):
        if h == g and not (p and q) and 100 * min(n, m) >= 80 * max(n, m):
            assert frozenset((x, y)) in met
        assert frozenset((x, y)) not in met or h == g and not (p and q)


def test_bit_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 900, dtype=np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 2**64, 100, dtype=np.uint64)))
    h = np.concatenate((np.sort(a), np.sort(b)))
    s = bbit_minhash.pack(bbit_minhash.minima(np.repeat([0, 1], 900), h, 2)).view(np.uint64)
    x = s[0] ^ s[1]
    differ = int(np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
    assert abs(((1 - differ / 128) - 0.25) / 0.75 - 0.8) < 0.17


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(300)] + [None, ""]
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    rows = apportion.op9_sainte_lague(documents(spark, texts, sources)).collect()
    again = apportion.op9_sainte_lague(documents(spark, texts, sources).repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(texts)
    size = {s: sum(len((t or "").split()) for t, x in zip(texts, sources, strict=True) if x == s) for s in set(sources)}
    weight = dict(zip(sorted((s for s in size if s), key=str) + [None], itertools.cycle((5, 2, 1)), strict=False))
    goal, full = 1.5 * sum(size.values()), {}
    while True:
        left = {s: w for s, w in weight.items() if s not in full}
        share = (goal - sum(full.values())) / sum(left.values())
        over = {s: 2.0 * size[s] for s, w in left.items() if w * share > 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: full.get(s, weight[s] * share) for s in size}
    taken = Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_seats_are_those_of_the_highest_quotients(spark):
    targets = {"a": 53.0, "b": 24.0, "c": 23.0}
    d = spark.createDataFrame([(s, t) for s, t in targets.items()], "source string, target double")
    got = Counter(r.source for r in apportion.seats(d, 10, 10).collect())
    best = sorted(((t / (2 * k - 1), s) for s, t in targets.items() for k in range(1, 11)), reverse=True)[:10]
    assert got == Counter(s for _, s in best)


def test_quotas_decide_what_is_taken(spark, monkeypatch):
    d = documents(spark, ["w " * 40] * 60, ["a", "b", "c"] * 20)
    seats, sums = apportion.seats, []
    for less in (0, 3):
        monkeypatch.setattr(apportion, "seats", lambda *a, less=less: (x := seats(*a)).where((F.col("source") != "a") | (F.col("seat") <= x.where("source = 'a'").count() - less)))
        doc, _ = apportion.mix(d, shards=4, blocks_per_shard=8)
        sums.append({r.source: r.t for r in doc.groupBy("source").agg(F.sum("taken").alias("t")).collect()})
    # blocks of 113 words; the target of a is 1600, of which 14 seats hold 1582
    assert (sums[0]["a"], sums[1]["a"]) == (1600, 12 * 113) and sums[0]["b"] == sums[1]["b"]


def test_shards_are_even_and_uniform(spark):
    rows = hypershuffle.op10_hypergeometric(documents(spark, [f"t{i}" for i in range(1000)] + [None])).collect()
    n = Counter(r.shard for r in rows)
    assert sorted(n) == list(range(24)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    assert all(r.text_crc32 == zlib.crc32(f"t{r.doc_id}".encode()) for r in rows if r.doc_id < 1000)
    assert [(r["size"], r.text_crc32) for r in rows if r.doc_id == 1000] == [(8, 0)]
    low = Counter(r.shard for r in rows if r.doc_id < 500)
    assert max(low.values()) < 36  # 500 of 1001 rows over 24 shards


def test_matrix_margins_and_large_draws():
    m = hypershuffle.communication_matrix([5, 0, 17, 30], [20, 20, 12], 3)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 30] and m.sum(axis=0).tolist() == [20, 20, 12]
    rng = np.random.default_rng(5)
    x = [hypershuffle.hypergeometric(rng, 2 * 10**9, 6 * 10**9, 1000) for _ in range(200)]
    assert abs(np.mean(x) - 250) < 4 and 10 < np.std(x) < 18


def test_matrix_follows_the_law_of_enumeration():
    # 6 rows in partitions of 3 and 3, dealt to shards of 2, 2 and 2: every one of the 6! orders is as likely
    law = Counter()
    for order in itertools.permutations(range(6)):
        law[tuple(sum(x < 3 for x in order[2 * j : 2 * j + 2]) for j in range(3))] += 1 / 720
    runs = 6000
    got = Counter(tuple(hypershuffle.communication_matrix([3, 3], [2, 2, 2], seed)[0].tolist()) for seed in range(runs))
    assert set(got) <= set(law) and sum((got[k] - runs * p) ** 2 / (runs * p) for k, p in law.items()) < 25  # 6 degrees of freedom


def test_few_partitions_and_small_buckets_keep_shards_even(spark):
    d = documents(spark, [f"t{i}" for i in range(997)]).select("doc_id", "text")
    rows = hypershuffle.shuffle_into_shards(d, ["doc_id"], shards=5, most_partitions=3).collect()
    n = Counter(r.shard for r in rows)
    assert sorted(n.values()) == [199, 199, 199, 200, 200] and all(sorted(r.slot for r in rows if r.shard == s) == list(range(n[s])) for s in n)


@pytest.fixture(scope="module")
def pieces():
    return nbest.Pieces.load(corpus.MODEL)


def test_n_best_matches_brute_force(pieces):
    rng = random.Random(1)
    encoder = nbest.Encoder(pieces, 4)
    for _ in range(150):
        s = "".join(rng.choice("the an inéß x\n\n€ q  ▁z") for _ in range(rng.randint(0, 11)))
        marked = "▁" + s.replace(" ", "▁") if s else ""
        ways = [[] for _ in range(len(marked) + 1)]
        ways[0] = [0.0]
        for b in range(1, len(marked) + 1):
            for a, _, w in pieces.ending(marked, b):
                ways[b] += [d + w for d in ways[a]]
        ids, scores, counts, sums, same = next(iter(encoder.encode([s])))
        assert np.allclose(scores, sorted(ways[-1], reverse=True)[:4]) and (pieces.decode(ids.tolist()) == s) == same
        assert len(set(sums)) == len(sums) and counts[0] == len(ids)


def test_encoding_round_trip(spark):
    texts = [t for t in some_texts(9)] + ["  two  spaces \n and more ", "x" * 3000, "日本語 text"]
    e = nbest.encode(documents(spark, texts), corpus.MODEL)
    back = {r.doc_id: r.text for r in nbest.decode(e, corpus.MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)} and all(r.round_trip for r in e.collect())


@pytest.mark.parametrize("text", ["-" * 1_000_000, base64.b64encode(random.Random(4).randbytes(750_000)).decode(), "é" * 40_000 + "=" * 700])
def test_unbroken_texts_end_in_bounded_memory(pieces, text):
    def encoded(t):
        ids, scores, _, sums, same = next(iter(nbest.Encoder(pieces, 4).encode([t])))
        assert same and pieces.decode(ids.tolist()) == t and len(set(sums)) == 4 and scores == sorted(scores, reverse=True)

    encoded(text)
    part = text[:50_000]
    tracemalloc.start()
    encoded(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 900 * len(part)


def test_n_best_of_ties_is_that_of_enumeration(pieces):
    for s in ("-" * 17, "=" * 9 + "a" * 5, "ab" * 8):
        ways = [[] for _ in range(len(s) + 1)]
        ways[0] = [0.0]
        for b in range(1, len(s) + 1):
            for a, _, w in pieces.ending(s, b):
                ways[b] += [d + w for d in ways[a]]
        got = nbest.n_best(pieces, s, 6)
        assert [w for w, _ in got] == sorted(ways[-1], reverse=True)[:6] and len({tuple(x.tolist()) for _, x in got}) == 6


PAGE = "<html><head><title>T</title></head><body><nav><a>Menu</a></nav>{}<footer>Foot</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (PAGE.format("<article><h1>A &amp; B</h1><p><b>One<br>two<p>Three <script>x</script></article>"), "A & B\nOne two\nThree"),
        (PAGE.format("<div class='sidebar'>S</div><div>Main text</div><div id=comments><p>C</p></div>"), "Main text"),
        (PAGE.format("<article><p>Text</p><section class='comments'><p>No</p></section><aside>x</aside></article><div>Out</div>"), "Text"),
        ("<p>open <!-- c --> text", "open text"),
        (None, ""),
        ("", ""),
        ('<article><p title="the hidden gem">kept</p><p hidden>gone</p><p style="display: none">gone</p></article>', "kept"),
        ('<article><p>See <a href="/x?id=comments">the link text</a></p><p data-id="share">one</p><p id="reply">two</p></article>', "See the link text\none\ntwo"),
        ('<article><h2 id="related-work" class="nav">Related work</h2><p id="search-algorithms">On search</p></article>', "Related work\nOn search"),
        ('<article><section class="alert-systems"><p>Sirens</p></section><div class="cookie-recipes">Dough</div></article>', "Sirens\nDough"),
        ("<article><p>Let <math><mi>x</mi></math> be <svg><text>drawn</text></svg></p><video>no film</video></article>", "Let x be drawn\nno film"),
        ('<article><p class="x>Hello</p><p>there</p></article>', "Hello\nthere"),
        ("<article><p title=it's>Don't drop</p><p>a < b and c > d</p></article>", "Don't drop\na < b and c > d"),
        ("<main><p>Beside</p><article><p>Inside</p></article></main><p>Out</p>", "Beside\nInside"),
        ('<article><div role="navigation">x</div><div class="Ad big">y</div><form>z</form><p>w</p></article>', "w"),
    ],
)
def test_page_text(html, want):
    assert "\n".join(pagediff.differ([pagediff.lines(html)])[0]) == want


def test_parsing_ends_on_texts_that_never_close():
    for s in ("<a " * 100_000, "<" * 300_000, "<p>" * 50_000, '<a b="' * 1001, "&" * 200_000, "x" * 1_000_000):
        assert len(pagediff.lines(s)[0]) <= 1
    assert pagediff.lines("<p>word</p>" * 20_000)[0] == ["word"] * 20_000


def test_differing_deletes_shared_guesses_and_nothing_of_the_article():
    a = (["Top bar", "First page text that is long", "Bottom"], [False] * 3)
    b = (["Top bar", "Second page text that is long", "Bottom"], [False] * 3)
    assert pagediff.differ([a, b]) == [["First page text that is long"], ["Second page text that is long"]]
    c = (["Same line", "more of it here"], [True, True])
    assert pagediff.differ([c, c]) == [c[0], c[0]]


def test_boilerplate_inside_articles_goes_by_differencing(spark):
    page = '<article><p>Story {} has words of its own, many of them.</p><div class="related-stories">Read more here</div><p>Same motto</p><div class="share-{}">Own note {}</div></article>'
    d = spark.createDataFrame([(i, f"http://h.example/x/{i}", page.format(i, i, i)) for i in range(7)] + [(7, "http://lone.example/", page.format(7, 7, 7))], "page_id long, url string, html string")
    got = {r.page_id: r for r in pagediff.op2_page_differencing(d).collect()}
    for i in range(7):
        assert got[i].text == f"Story {i} has words of its own, many of them.\nSame motto\nOwn note {i}" and got[i].n_shared == 1
    assert "Read more here" in got[7].text and got[7].n_shared == 0


def test_pages_of_one_id_and_url_keep_their_own_lines(spark):
    rows = [(1, "http://h.example/a", "<div>shared</div><div>first text of some length</div>"), (1, "http://h.example/a", "<div>other text of some length</div><div>shared</div>")] * 2
    d = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, row string, host int")
    got = sorted(r.text for r in pagediff.op2_page_differencing(d).collect())
    assert got == ["first text of some length"] * 2 + ["other text of some length"] * 2
    assert pagediff.op2_page_differencing(d.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<body><form id="aspnetForm"><div class="menu">Menu</div><article><p>Text <b>of</b> it</p><form>Mail <input></form></article><p>rest</p></form></body>', "Text of it"),
        ('<form><main><h1>Head</h1><form action="/find">find</form><p>Body</p></main>after</form>', "Head\nBody"),
        ('<body>Skip<form id="f"><nav>Home</nav><p>A long text <i>that</i> fills the page</p><p>Second</p></form></body>', "A long text that fills the page\nSecond"),
        ("<body><p>The text of the page is here</p><form>Your name <input><button>Send</button></form></body>", "The text of the page is here"),
        ("<article><p>Text</p><form>A comment that is longer than all the text<article>x</article></form></article>", "Text"),
        ("<form><article><p>One</p></article><aside>side</aside></form><p>outside of it all</p>", "One"),
    ],
)
def test_forms_around_articles(html, want):
    found, own = pagediff.lines(html)
    if "<article" in html or "<main" in html:
        assert all(own)
    assert "\n".join(x for x in found if x != "Skip") == want


def test_common_lines_of_long_pages_follow_their_matches():
    a = [f"line {i}" for i in range(30_000)]
    b = a[:]
    random.Random(2).shuffle(b)
    left, right = pagediff.common_lines(a, b)
    assert len(left) == len(right) and sorted(a[i] for i in left) == sorted(b[j] for j in right)
    assert [a[i] for i in sorted(left)] == [b[j] for j in sorted(right)] and 250 < len(left) < 450  # about twice the root of their number


def test_common_lines_is_a_longest_subsequence():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        left, right = pagediff.common_lines(a, b)
        halved = pagediff.common_lines(a, b, cells=4)
        assert len(halved[0]) == t[-1][-1] and [a[i] for i in sorted(halved[0])] == [b[j] for j in sorted(halved[1])]
        assert len(left) == len(right) == t[-1][-1] and [a[i] for i in sorted(left)] == [b[j] for j in sorted(right)]


def test_pages_pair_within_hosts(spark):
    urls = [f"http://h.example/a/{i}" for i in range(101)] + ["http://other.example/z", None, "no url"]
    d = spark.createDataFrame([(i, u, PAGE.format(f"<div>own {i} line with words</div><div>shared</div>")) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in pagediff.op2_page_differencing(d).collect()}
    assert len(got) == len(urls) and sum("shared" not in t for t, _ in got.values()) == 101 and all(f"own {i}" in got[i][0] and got[i][1] == len(got[i][0]) for i in got)


def test_forest_recall_and_exact_links(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    x[500:900] = x[:400] + rng.normal(scale=0.12, size=(400, 16))
    x[900:910] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [1.0, 0.0])]
    got = {r.vec_id: r for r in rp_forest.op5_projection_forest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum() and true.sum() > 700
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (2000, 2001, 2002, 2003)) and got[905].component_id == 0


@pytest.mark.parametrize("spread", [0.025, 0.05])
def test_links_within_a_large_near_copy_group(spark, spread):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(9000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:3000] = x[0] + rng.normal(scale=spread, size=(3000, 64))  # a third of the vectors, of mutual cosine about .96 or .86
    x[3000:3300] = x[4000:4300] + rng.normal(scale=0.03, size=(300, 64))
    x[3300] = x[1] * 3  # the same direction twice
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(axis=1) - 1
    near, group = u[:3000] @ u[:3000].T >= 0.9, np.arange(3000)
    for _ in range(20):
        group = np.where(near, group, 3000).min(axis=1)
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for chunk in (4096, 500):
        got = {r.vec_id: r for r in rp_forest.near_vectors(d, chunk=chunk).collect()}
        found = np.array([got[i].n_links for i in range(len(x))])
        assert [got[i].component_id for i in range(3000)] == group.tolist()
        assert (found <= true).all() and found[:3000].sum() >= 0.9999 * true[:3000].sum() and found[3000:].sum() >= 0.97 * true[3000:].sum()


def test_pu_quality_held_out(spark, small):
    d, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = pu_quality.op6_positive_unlabelled(d, labels).join(labels, "doc_id").collect()
    ours = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in ours]) > 0.93
    none = pu_quality.op6_positive_unlabelled(d.limit(5), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 5


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_pu_risk_and_gradient(prior):
    rng = np.random.default_rng(3)
    net, p, u = pu_quality.Net(), rng.normal(0.5, 1, (30, pu_quality.FEATURES)), rng.normal(0, 1, (50, pu_quality.FEATURES))

    def value():
        f = lambda x: 1 / (1 + np.exp(-(np.tanh(x @ net.w[0] + net.w[1]) @ net.w[2] + net.w[3][0])))
        plus, minus = prior * np.mean(1 - f(p)), np.mean(f(u)) - prior * np.mean(f(p))
        return plus, minus

    plus, minus, grads = net.risk(p, u, prior)
    assert np.allclose((plus, minus), value()) and (minus >= 0) == (prior < 0.5)
    for w, g in zip(net.w, grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, both = w[i], []
        for step in (1e-5, -1e-5):
            w[i] = old + step
            a, b = value()
            both.append(a + b if minus >= 0 else -b)
        w[i] = old
        assert abs(g[i] - (both[0] - both[1]) / 2e-5) < 1e-6


def test_pu_prior_and_scale_come_without_negatives():
    rng = np.random.default_rng(8)
    positive, unlabelled = rng.normal(2, 1, 40_000), np.concatenate((rng.normal(2, 1, 24_000), rng.normal(-1.5, 1, 16_000)))
    assert abs(pu_quality.estimate_prior(positive, unlabelled) - 0.6) < 0.06
    net = pu_quality.Net()
    net.raw = lambda x: x
    net.calibrate(positive, unlabelled, 0.6)
    score = net.score(unlabelled)
    up, down = (c * np.exp(-((unlabelled - m) ** 2) / 2) for c, m in ((0.6, 2), (0.4, -1.5)))
    assert abs(score.mean() - 0.6) < 0.01 and np.abs(score - up / (up + down)).mean() < 0.02


def test_quality_of_odd_tables(spark):
    d = documents(spark, ["good text here"] * 3 + [None, ""]).unionByName(documents(spark, ["good text here"]))
    labels = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (2, 0, "x"), (None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    for docs, marks, n in ((d, labels, 6), (d.limit(0), labels, 0), (d, labels.limit(0), 6)):
        rows = pu_quality.op6_positive_unlabelled(docs, marks).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_embeddings_of_odd_tables(spark):
    rows = [(1, [1.0, 0.0], "a", 1), (1, [1.0, 0.0], "a", 1), (2, [2.0, 0.1], "b", 2), (None, None, None, 3), (3, [None, 1.0], "c", 4), (4, [], "d", 5)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string, links int")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links) for r in rp_forest.op5_projection_forest(d).collect())
    assert got == [(False, 1, 2), (False, 1, 2), (False, 2, 2), (False, 3, 0), (False, 4, 0), (True, 0, 0)]
    assert rp_forest.op5_projection_forest(d.limit(0)).count() == 0


def test_languages_beyond_the_sample_raise(spark):
    d = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        byte_gru.train(d, most_documents=8)


def test_rare_languages_are_not_held_against_foreign_ones(spark):
    many = [" ".join(random.Random(i).choices("the of and to in is it that for was on are as with".split(), k=80)) for i in range(30)]
    rare = " ".join(random.Random(1).choices("漢字 かな 文章 言葉 日本".split(), k=80))
    d = documents(spark, [*many, rare, rare]).withColumn("lang", F.when(F.col("doc_id") < 30, "en").when(F.col("doc_id") == 30, "ja"))
    got = {r.doc_id: r for r in divergence.judge(d, max_char_distance=0.3).collect()}
    assert got[30].char_distance is None and got[30].kept == (not got[30].base_failed) and got[31].char_distance > 0.3 and not got[31].kept
    assert got[30].beyond == sum(ord(c) > 127 for c in rare)


def test_gru_gradients_match_differences():
    g = byte_gru.Tagger(["a", "b"])
    x = np.random.default_rng(0).integers(97, 123, (6, 5)).astype(np.uint8)
    y = np.array([0, 1, 0, 1, 1])

    def loss():
        o = g.logits(x)[0].astype(float)
        p = o - np.log(np.exp(o).sum(axis=1, keepdims=True))
        return -np.mean([[p[t, y[n], n] for n in range(5)] for t in range(6)])

    grads = g.step(x, y)
    for grad, p in zip(grads, [g.fore.e, g.fore.u, g.fore.b, g.back.e, g.back.u, g.back.b, g.v, g.c], strict=True):
        i = np.unravel_index(np.abs(grad).argmax(), p.shape)
        old = p[i]
        p[i] = old + 1e-2
        a = loss()
        p[i] = old - 1e-2
        b = loss()
        p[i] = old
        assert abs(grad[i] - (a - b) / 2e-2) < 2e-4


def test_languages_held_out(spark):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 ###")], "doc_id long, text string")
    rows = byte_gru.op7_byte_gru(d.unionByName(more, allowMissingColumns=True)).join(d.select("doc_id", "lang"), "doc_id", "left").collect()
    ours = [r for r in rows if r.held_out and r.lang]
    assert np.mean([r.lang_pred == r.lang for r in ours]) > 0.95
    assert {r.lang_pred for r in rows if r.doc_id < 0} == {"und"} and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("name", ["op1_divergence", "op4_suffix_lpf", "op5_projection_forest", "op8_bbit_minhash", "op9_sainte_lague"])
def test_corpus_sql(spark, small, name):
    import oracle

    assert oracle.compare(spark, oracle.connect(small), small, corpus.queries()[name], corpus.oracle_sql()[name]) == ""


def test_op3_gives_the_ids_of_all_its_best(spark, pieces):
    rows = nbest.op3_nbest(documents(spark, ["hello there world", "", None, "a b\nc é x"]), corpus.MODEL).collect()
    for r in rows:
        assert [zlib.crc32(np.array(w, dtype="<i4").tobytes()) for w in r.nbest] == r.crcs and [len(w) for w in r.nbest] == r.pieces
        assert list(r.ids) == list(r.nbest[0]) and len(r.nbest) == len(r.scores) == len({tuple(w) for w in r.nbest})
        assert len({pieces.decode(list(w)) for w in r.nbest}) == 1
    assert max(len(r.nbest) for r in rows) == 4
