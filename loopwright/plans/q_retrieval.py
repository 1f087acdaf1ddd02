"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.functions.text import half_up, sim_jaccard, tok_bm25, tok_rel
from loopwright.operators import retrieval as R
from loopwright.plans import bindings as B
from loopwright.plans.bindings import BM25, r, sql


def _rank(d: DataFrame, item: str, score: str = "score", k: int = 6, query: str = "query_id") -> DataFrame:
    return d.select(query, F.col(item).alias("item"), F.col("rank").cast("long").alias("rank"), half_up(F.col(score), k).alias("score"))


def token_stats(s: SparkSession, d: str) -> DataFrame:
    t = tok_bm25(F.col("text"))
    return B.table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def bm25_vocab(s: SparkSession, d: str) -> DataFrame:
    docs = B.table(s, d, "documents")
    return R.vocabulary(R.postings(docs), R.corpus_stats(docs)).select("term", "df", half_up(F.col("idf"), 9).alias("idf"))


def bm25_search(s: SparkSession, d: str) -> DataFrame:
    return _rank(R.bm25_search(B.table(s, d, "documents"), B.queries(s, d), 10), "doc_id")


def bm25_diagnostics(s: SparkSession, d: str) -> DataFrame:
    return R.bm25_diagnostics(B.table(s, d, "documents"), B.queries(s, d))


def bm25_list_filter(s: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as the list of rules, region names and their like as queries."""
    rules = B.table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return _rank(R.bm25_filter(rules, B.queries(s, d), 10), "doc_id")


def knn_topk(s: SparkSession, d: str) -> DataFrame:
    v = B.table(s, d, "embeddings")
    return _rank(R.cosine_topk(None, v, 5), "item", "sim")


def centroid_by_label(s: SparkSession, d: str) -> DataFrame:
    return R.centroid(B.table(s, d, "embeddings"), "label").select(F.col("label").cast("long").alias("label"), F.col("pos").cast("long").alias("pos"), half_up(F.col("value"), 9).alias("value"))


def knn_edges(s: SparkSession, d: str) -> DataFrame:
    e = R.knn_edges(B.table(s, d, "embeddings"), 8, 0.35, ((0.45, 1.0), (0.40, 0.6), (0.35, 0.3)))
    return e.select("a", "b", half_up(F.col("sim"), 6).alias("sim"), "strength")


def lexical_duplicates(s: SparkSession, d: str) -> DataFrame:
    return R.lexical_duplicates(B.table(s, d, "documents"), 0.85)


def _lists(s: SparkSession, d: str) -> dict[str, DataFrame]:
    q, docs, v = B.queries(s, d), B.table(s, d, "documents"), B.table(s, d, "embeddings")
    bm = R.bm25_search(docs, q, 50).select("query_id", F.col("doc_id").alias("item"), "rank")
    own = q.select("query_id").join(v.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    vec = R.cosine_topk(own, v, 50).select("query_id", "item", "rank")
    near = bm.where("rank = 1").select("query_id", F.col("item").alias("doc_id")).join(docs.select("doc_id", "source"), "doc_id").select("query_id", "source")
    graph = R.graph_list(near, docs.select(F.col("doc_id").alias("item"), "source", (1 + F.col("doc_id") % 5).cast("double").alias("score")))
    return {"bm25": bm, "graph": graph, "vector": vec}


WEIGHTS = {"bm25": 2.0, "graph": 0.5, "vector": 1.0}


def hybrid_retrieve(s: SparkSession, d: str) -> DataFrame:
    top = R.hybrid_retrieve(_lists(s, d), WEIGHTS)
    return top.select("query_id", "item", F.col("rank").cast("long").alias("rank"), half_up(F.col("score"), 9).alias("score"), "bm25_rank", "graph_rank", "vector_rank")


def diversity_topk(s: SparkSession, d: str) -> DataFrame:
    docs = B.table(s, d, "documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("domain"))
    scored = R.bm25_search(B.table(s, d, "documents"), B.queries(s, d), 30).select("query_id", F.col("doc_id").alias("item"), "score").join(docs, "item")
    return _rank(R.diversity_topk(scored, 10), "item")


def embedding_seed(s: SparkSession, d: str) -> DataFrame:
    v = B.table(s, d, "embeddings")
    seeds = R.bm25_search(B.table(s, d, "documents"), B.queries(s, d), 5).select("query_id", F.col("doc_id").alias("item"))
    return _rank(R.embedding_seed(seeds.join(v.select(F.col("vec_id").alias("item")), "item", "left_semi"), v), "item")


def tfidf_terms(s: SparkSession, d: str) -> DataFrame:
    m = R.mined_terms(B.table(s, d, "documents").withColumnRenamed("lang", "domain"))
    return m.select("domain", "term", F.col("rank").cast("long").alias("rank"), half_up(F.col("score"), 6).alias("score"))


def line_sections(s: SparkSession, d: str) -> DataFrame:
    """Sections that begin at lines of more than 400 characters."""
    x = R.sections(B.table(s, d, "documents"), r"^(?=.{401})")
    return x.select("doc_id", F.col("section").cast("long").alias("section"), F.col("start").cast("long").alias("start"), F.col("n_lines").cast("long").alias("n_lines"), F.md5("body").alias("body_md5"))


def query_overlap(s: SparkSession, d: str) -> DataFrame:
    return R.result_overlap(R.bm25_search(B.table(s, d, "documents"), B.queries(s, d), 10).select("query_id", F.col("doc_id").alias("item")))


def relevance(s: SparkSession, d: str) -> DataFrame:
    """Token overlap of each conversation turn with the one before it."""
    from pyspark.sql import Window as W

    t = B.turns(s, d).withColumn("before", F.lag("text").over(W.partitionBy("session_id").orderBy("seq")))
    return t.where("before is not null").select("session_id", "seq", half_up(sim_jaccard(tok_rel(F.col("text")), tok_rel(F.col("before"))), 6).alias("relevance"))


_REL = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 3))"
_PAIRS = "vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), pr AS (SELECT a.vec_id AS query_id, b.vec_id AS item, list_cosine_similarity(a.e, b.e) AS sim FROM vec a, vec b WHERE a.vec_id <> b.vec_id), nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(sim * 1e9 + 0.5::DOUBLE) DESC, item) AS rank FROM pr)"
_LISTS = f"""gq AS (SELECT query_id, source FROM bmr JOIN documents USING (doc_id) WHERE rank = 1),
gr AS (SELECT query_id, d.doc_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY 1 + d.doc_id % 5 DESC, d.doc_id) AS rank FROM gq JOIN documents d USING (source)),
{_PAIRS},
lists AS (SELECT query_id, doc_id AS item, rank, 'bm25' AS l, 2.0::DOUBLE AS w FROM bmr WHERE rank <= 50 UNION ALL SELECT query_id, item, rank, 'graph', 0.5::DOUBLE FROM gr WHERE rank <= 50
  UNION ALL SELECT query_id, item, rank, 'vector', 1.0::DOUBLE FROM nn WHERE rank <= 50 AND query_id IN (SELECT item_id FROM benchmark)),
fused AS (SELECT query_id, item, sum(w / (60 + rank)) AS score, min(CASE WHEN l = 'bm25' THEN rank END) AS bm25_rank, min(CASE WHEN l = 'graph' THEN rank END) AS graph_rank, min(CASE WHEN l = 'vector' THEN rank END) AS vector_rank FROM lists GROUP BY ALL)"""
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5::DOUBLE) DESC, item)"

QUERIES = {
    "token_stats": (token_stats, sql(["tok"], "SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM tok")),
    "bm25_vocab": (bm25_vocab, sql(["tok", "post", "stat", "vocab"], f"SELECT term, df, {r('idf', 9)} AS idf FROM vocab")),
    "bm25_search": (bm25_search, sql(BM25, f"SELECT query_id, doc_id AS item, rank, {r('score')} AS score FROM bmr WHERE rank <= 10")),
    "bm25_diagnostics": (
        bm25_diagnostics,
        sql(BM25, f"""SELECT item_id AS query_id, coalesce(n_terms, 0)::BIGINT AS n_terms, coalesce(n_missing, 0)::BIGINT AS n_missing, {r('idf_min')} AS idf_min, {r('idf_max')} AS idf_max, {r('idf_mean')} AS idf_mean, {r('idf_sd')} AS idf_sd,
CASE WHEN coalesce(n_terms, 0) = 0 THEN 'empty' WHEN n_terms < 2 THEN 'short' WHEN n_missing * 2 > n_terms THEN 'missing' WHEN idf_sd < 0.5 THEN 'flat-idf' WHEN coalesce(score_sd, 0) < 0.01 THEN 'low-variance' ELSE 'healthy' END AS cause
FROM benchmark LEFT JOIN t ON item_id = t.query_id LEFT JOIN b ON item_id = b.query_id""",
        ["t AS (SELECT query_id, sum(times) AS n_terms, sum(CASE WHEN idf IS NULL THEN times ELSE 0 END) AS n_missing, min(idf) AS idf_min, max(idf) AS idf_max, avg(idf) AS idf_mean, stddev_pop(idf) AS idf_sd FROM qt LEFT JOIN vocab USING (term) GROUP BY 1)",
         "b AS (SELECT query_id, stddev_pop(score) AS score_sd FROM bmr WHERE rank <= 10 GROUP BY 1)"]),
    ),
    "bm25_list_filter": (
        bm25_list_filter,
        sql(BM25, f"SELECT query_id, item, rank, {r('score')} AS score FROM (SELECT *, {_TOP} AS rank FROM (SELECT q.item_id AS query_id, d.item_id AS item, coalesce(bm.score, 0) AS score FROM benchmark q CROSS JOIN benchmark d LEFT JOIN bm ON bm.query_id = q.item_id AND bm.doc_id = d.item_id)) WHERE rank <= 10").replace("FROM documents", "FROM (SELECT item_id AS doc_id, text FROM benchmark)"),
    ),
    "knn_topk": (knn_topk, f"WITH {_PAIRS} SELECT query_id, item, rank, {r('sim')} AS score FROM nn WHERE rank <= 5"),
    "centroid_by_label": (centroid_by_label, f"SELECT label::BIGINT AS label, pos - 1 AS pos, {r('avg(v)', 9)} AS value FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY label, pos"),
    "knn_edges": (knn_edges, f"WITH {_PAIRS} SELECT least(query_id, item) AS a, greatest(query_id, item) AS b, {r('max(sim)')} AS sim, (CASE WHEN max(sim) >= 0.45 THEN 1.0 WHEN max(sim) >= 0.40 THEN 0.6 ELSE 0.3 END)::DOUBLE AS strength FROM nn WHERE rank <= 8 AND sim >= 0.35 GROUP BY 1, 2"),
    "lexical_duplicates": (
        lexical_duplicates,
        "WITH s AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda t: length(t) > 2)) AS t FROM documents WHERE length(text) >= 20), p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS na, len(b.t) AS nb FROM s a JOIN s b ON a.doc_id < b.doc_id AND least(len(a.t), len(b.t)) >= 0.85 * greatest(len(a.t), len(b.t)) WHERE len(a.t) > 0) "
        f"SELECT a, b, {r('i / (na + nb - i)::DOUBLE', 3)} AS sim FROM p WHERE i / (na + nb - i)::DOUBLE >= 0.85::DOUBLE",
    ),
    "hybrid_retrieve": (hybrid_retrieve, sql(BM25, f"SELECT query_id, item, rank, {r('score', 9)} AS score, bm25_rank, graph_rank, vector_rank FROM (SELECT *, {_TOP} AS rank FROM fused) WHERE rank <= 15", [_LISTS])),
    "diversity_topk": (
        diversity_topk,
        sql(BM25, f"SELECT query_id, item, rank, {r('score')} AS score FROM (SELECT *, {_TOP} AS rank FROM y WHERE rd <= ceil(10.0 / nd)) WHERE rank <= 10",
        ["x AS (SELECT query_id, doc_id AS item, score, lang FROM bmr JOIN documents USING (doc_id) WHERE rank <= 30)",
         "y AS (SELECT *, (SELECT count(DISTINCT lang) FROM x z WHERE z.query_id = x.query_id) AS nd, row_number() OVER (PARTITION BY query_id, lang ORDER BY floor(score * 1e9 + 0.5::DOUBLE) DESC, item) AS rd FROM x)"]),
    ),
    "embedding_seed": (
        embedding_seed,
        sql(BM25, f"SELECT query_id, item, rank, {r('score')} AS score FROM (SELECT *, {_TOP} AS rank FROM c) WHERE rank <= 10",
        [_PAIRS, "sd AS (SELECT query_id, doc_id AS seed FROM bmr WHERE rank <= 5 AND doc_id IN (SELECT vec_id FROM embeddings))",
         "c AS (SELECT sd.query_id, nn.item, avg(sim) AS score FROM sd JOIN nn ON nn.query_id = sd.seed AND nn.rank <= 10 WHERE NOT EXISTS (SELECT 1 FROM sd s2 WHERE s2.query_id = sd.query_id AND s2.seed = nn.item) GROUP BY ALL)"]),
    ),
    "tfidf_terms": (
        tfidf_terms,
        sql(["tok"], f"SELECT domain, term, rank, {r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY floor(score * 1e9 + 0.5::DOUBLE) DESC, term) AS rank FROM (SELECT lang AS domain, term, tf * ln((n + 1) / (df + 0.5::DOUBLE)) AS score FROM tf JOIN sp USING (term), (SELECT count(DISTINCT lang) AS n FROM documents) WHERE df <= greatest(floor(10 * n / 14), 2) AND NOT (df >= 3 AND cv < 0.5::DOUBLE))) WHERE rank <= 15",
        ["g AS (SELECT lang, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tok JOIN documents USING (doc_id))", "tf AS (SELECT lang, term, count(*) AS tf FROM g GROUP BY ALL)", "sp AS (SELECT term, count(*) AS df, stddev_pop(tf) / avg(tf) AS cv FROM tf GROUP BY 1)"]),
    ),
    "line_sections": (
        line_sections,
        "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents), h AS (SELECT *, sum((length(line) > 400)::INT) OVER (PARTITION BY doc_id ORDER BY no) AS sec FROM l) "
        "SELECT doc_id, (sec - 1)::BIGINT AS section, min(no) AS start, count(*) AS n_lines, md5(trim(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (no > first_no), ''))) AS body_md5 FROM (SELECT *, min(no) OVER (PARTITION BY doc_id, sec) AS first_no FROM h WHERE sec > 0) GROUP BY doc_id, sec",
    ),
    "query_overlap": (
        query_overlap,
        sql(BM25, f"SELECT x.query_id AS a, y.query_id AS b, {r('count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE')} AS overlap FROM z x JOIN z y ON x.doc_id = y.doc_id AND x.query_id < y.query_id GROUP BY 1, 2", ["z AS (SELECT query_id, doc_id, count(*) OVER (PARTITION BY query_id) AS n FROM bmr WHERE rank <= 10)"]),
    ),
    "relevance": (
        relevance,
        sql(["turns"], f"SELECT session_id, seq, {r('CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE END')} AS relevance FROM (SELECT session_id, seq, {_REL.format('text')} AS x, {_REL.format('b')} AS y FROM (SELECT *, lag(text) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM turns) WHERE b IS NOT NULL)"),
    ),
}
