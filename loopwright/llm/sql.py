"""DuckDB statements for the corpus queries that SQL can state whole."""

#: Two-word shingles met through an inverted index; links by exact set sizes; components by reachability.
_NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS m FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.id),
c AS (SELECT id, min(m) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = doc_id"""

_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9::DOUBLE),
r AS (SELECT a AS id, a AS m FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(m) AS c FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, v.vec_id) AS component_id, v.vec_id = coalesce(c, v.vec_id) AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.id = v.vec_id"""

#: Every 100-byte string as 200 hexadecimal digits, with where it starts first; removed places are a running maximum of the ends.
_PASSAGES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, s, substr(h, (2 * s + 1)::BIGINT, 200) AS x FROM (SELECT doc_id, unnest(range(0, n - 99)) AS s, h FROM d WHERE n >= 100)),
f AS (SELECT x, min((doc_id, s)) AS f FROM p GROUP BY 1 HAVING count(*) > 1),
k AS (SELECT doc_id, s, CASE WHEN (doc_id, s) = f THEN 1 ELSE 2 END AS r FROM p JOIN f USING (x)),
g AS (SELECT doc_id, s, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, -1) AS first FROM k WHERE r > 1),
sp AS (SELECT doc_id, x, min(s) AS lo, max(s) + 100 AS hi FROM (SELECT *, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY s) AS x FROM g) GROUP BY 1, 2),
kp AS (SELECT doc_id, x, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM (SELECT doc_id, x, lo, hi FROM sp UNION ALL SELECT doc_id, NULL, n, n FROM d)),
t AS (SELECT doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY b, a) AS kept FROM kp JOIN d USING (doc_id) WHERE b > a GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce((SELECT sum(hi - lo) FROM sp WHERE sp.doc_id = d.doc_id), 0)::BIGINT AS n_removed, (SELECT count(*) FROM sp WHERE sp.doc_id = d.doc_id) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""


#: Water-filled targets, seats by highest quotients, words along the seeded blocks, and the part of each document in them.
_MIX = r"""WITH w AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM w GROUP BY 1),
a AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM a),
t AS (SELECT source, source_size, CASE WHEN most <= weight * level THEN most ELSE weight * max(level) FILTER (NOT most <= weight * level) OVER () END AS target FROM l),
g AS (SELECT goal, block, floor(goal / block)::BIGINT AS blocks FROM (SELECT goal, greatest(1, ceil(goal / 24576))::BIGINT AS block FROM (SELECT 1.5::DOUBLE * sum(source_size) AS goal FROM s))),
o AS (SELECT source, target, unnest(range(1, (ceil(target / block * (1 + (SELECT count(*) FROM t) / greatest(blocks, 1)::DOUBLE)) + 3)::BIGINT)) AS seat FROM t, g WHERE target > 0),
q AS (SELECT source, count(*) AS quota FROM (SELECT source, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, source NULLS LAST, seat) AS r FROM o) WHERE r <= (SELECT blocks FROM g) GROUP BY 1),
c AS (SELECT t.source, source_size, block, greatest(1, ceil(source_size / block::DOUBLE))::BIGINT AS n_blocks, coalesce(quota, 0) * block AS seated, round(target)::BIGINT AS want FROM t LEFT JOIN q ON t.source IS NOT DISTINCT FROM q.source, g),
d AS (SELECT *, greatest(seated + greatest(least(want - seated, block), -block), 0) AS take FROM c),
e AS (SELECT *, unnest(range(0, n_blocks)) AS b FROM d),
f AS (SELECT *, b * block AS b0, least(block, source_size - b * block) AS words, md5('17:block:' || coalesce(source, '') || ':' || (source IS NULL)::VARCHAR || ':' || b)[:15] AS k FROM e),
h AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY k, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS front, (CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END)::BIGINT AS epochs FROM f),
i AS (SELECT *, least(greatest(take - epochs * source_size - front, 0), words) AS fill FROM h),
j AS (SELECT source, b, b0, block, epochs + (fill = words AND words > 0)::BIGINT AS copies, CASE WHEN fill = words THEN 0 ELSE fill END AS part FROM i),
p AS (SELECT row_number() OVER () AS id, doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('17:doc:' || coalesce(doc_id::VARCHAR, '') || ':' || size)[:15], doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM w),
x AS (SELECT p.*, unnest(range(lo // block, (lo + greatest(size, 1) - 1) // block + 1)) AS b FROM p, g),
y AS (SELECT id, sum((least(lo + size, b0 + block) - greatest(lo, b0)) * copies + greatest(least(lo + size, b0 + block, b0 + part) - greatest(lo, b0), 0)) AS taken FROM x JOIN j ON x.source IS NOT DISTINCT FROM j.source AND x.b = j.b WHERE size > 0 GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN y USING (id) JOIN t ON p.source IS NOT DISTINCT FROM t.source"""


def _divergence() -> str:
    """Counts, histograms by language and the nearest Jensen-Shannon distances, as the operator defines them."""
    from loopwright.llm.divergence import CLASSES, COMMON

    quoted = lambda ws: ", ".join(f"'{w}'" for w in ws)
    less = lambda pattern: f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"
    counts = ", ".join(f"{less(p)} AS c_{c}" for c, p in CLASSES.items())
    bins = ", ".join(f"len(list_filter(p, lambda x: x IN ({quoted(ws)}))) AS b_{lang}" for lang, ws in COMMON.items())
    rest = "greatest(word_chars - (" + " + ".join(f"c_{c}" for c in CLASSES) + ") - beyond, 0)"
    chars = "[" + ", ".join(f"c_{c}::DOUBLE" for c in CLASSES) + f", beyond::DOUBLE, (chars - word_chars)::DOUBLE, {rest}::DOUBLE]"
    best = "greatest(" + ", ".join(f"b_{x}" for x in COMMON) + ")"
    hist = "[" + ", ".join(f"b_{x}::DOUBLE" for x in COMMON) + f", greatest(n_words - {best}, 0)::DOUBLE]"
    total = lambda c, n: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, n + 1)) + "]"
    term = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END"
    js = lambda p, q: f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term(f'{p}[i]', f'(({p}[i] + {q}[i]) / 2)')} + {term(f'{q}[i]', f'(({p}[i] + {q}[i]) / 2)')})) / 2, 0))"
    share = lambda c: f"CASE WHEN list_sum({c}) > 0 THEN list_transform({c}, lambda x: x / list_sum({c})) END"
    six = lambda c: f"floor({c} * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"
    return rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
e AS (SELECT *, list_transform(w, lambda x: lower(rtrim(x, '.,;:!?#*$%&'))) AS p FROM d),
f AS (SELECT doc_id, lang, len(w) AS n_words, length(t) AS chars, length(regexp_replace(t, '[\x00-\x7F]+', '', 'g')) AS beyond, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(l) - len(list_distinct(l)) AS n_dup_lines, {counts}, {bins} FROM e),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS k FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE k > 1) GROUP BY 1),
g AS (SELECT f.*, coalesce(rep.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words AS base_failed, {chars} AS cc, {hist} AS cw FROM f LEFT JOIN rep USING (doc_id)),
ref AS (SELECT lang, {share('rc')} AS rc, {share('rw')} AS rw FROM (SELECT lang, count(*) AS n, {total('cc', len(CLASSES) + 3)} AS rc, {total('cw', len(COMMON) + 1)} AS rw FROM g WHERE NOT base_failed AND lang IS NOT NULL GROUP BY 1) WHERE n >= 10),
s AS (SELECT g.*, {share('cc')} AS pc, {share('cw')} AS pw FROM g),
j AS (SELECT doc_id, min({js('pc', 'rc')}) AS jc, min({js('pw', 'rw')}) AS jw FROM s, ref WHERE chars >= 200 AND (s.lang IS NULL OR s.lang IN (SELECT lang FROM ref)) GROUP BY 1)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, c_symbol::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(jc, 0) <= 0.26::DOUBLE AND coalesce(jw, 0) <= 0.24::DOUBLE AS kept, {six('jc')} AS char_distance, {six('jw')} AS word_distance FROM s LEFT JOIN j USING (doc_id)"""


#: Every kept term for every group and language, zeros included.
_AUDIT = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::BIGINT AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
l AS (SELECT lang, count(*)::BIGINT AS v, sum(n)::BIGINT AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, coalesce(sum(c.n) OVER (PARTITION BY g.lang, g.source), 0)::BIGINT AS total, v, k.n AS all_n, l.total AS all_total FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS p, 1 + (1000000000::HUGEINT * (all_n + 1)) // (all_total + v) AS q FROM x),
t AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM u) QUALIFY part = 'pair' OR rank <= 200"""

_URLS = r"""WITH u AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT id, page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
r (verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT id, r.host || r.path AS rule, verdict FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN f USING (id)"""


def _codes() -> str:
    """Two rounds of Lloyd and a last assignment, each part of each vector against all 64 entries."""
    near = lambda i: f"""n{i} AS (SELECT id, part, entry, far FROM (SELECT v.id, v.part, b.entry, list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j])))::BIGINT AS far FROM v JOIN b{i} b ON v.part = b.part)
QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY far, entry) = 1)"""  # noqa: E731
    mean = lambda i: f"""m{i} AS (SELECT part, entry, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM (SELECT n{i}.part, entry, x, unnest(range(1, len(x) + 1)) AS j FROM n{i} JOIN v USING (id, part)) GROUP BY 1, 2, 3),
a{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM m{i} GROUP BY 1, 2),
b{i + 1} AS (SELECT b.part, b.entry, coalesce(a.c, b.c) AS c FROM b{i} b LEFT JOIN a{i} a ON a.part = b.part AND a.entry = b.entry)"""  # noqa: E731
    return f"""WITH w AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e, len(embedding) // 16 AS d FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT id, part, e[part * d + 1 : part * d + d] AS x FROM (SELECT id, e, d, unnest(range(0, 16)) AS part FROM w)),
b0 AS (SELECT part, id - 1 AS entry, x AS c FROM v WHERE id <= 64),
{near(0)},
{mean(0)},
{near(1)},
{mean(1)},
{near(2)},
f AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM n2 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS told FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, told AS codebooks_sha256 FROM w JOIN f USING (id), h"""


ORACLE: dict[str, str] = {
    "op1_divergence": _divergence(),
    "op4_suffix_lpf": _PASSAGES,
    "op5_projection_forest": _VECTORS,
    "op8_bbit_minhash": _NEAR,
    "op9_sainte_lague": _MIX,
    "op11_source_audit": _AUDIT,
    "op12_url_filter": _URLS,
    "op13_filtering_lloyd": _codes(),
}
