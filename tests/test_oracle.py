"""Every query with SQL against DuckDB over the smallest tables; the others must run."""

from __future__ import annotations

import oracle
import pytest

from loopwright.plans import registry


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


FAMILIES = {f: __import__(f"loopwright.plans.{f}", fromlist=["QUERIES"]).QUERIES for f in registry.FAMILIES}


@pytest.mark.parametrize("name", [n for q in FAMILIES.values() for n in q])
def test_query(spark, con, small, name):
    run, text = next(q[name] for q in FAMILIES.values() if name in q)
    if text:
        assert oracle.compare(spark, con, small, run, text) == ""
    else:
        run(spark, small).count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "query_id" in entry.entry(spark).columns


def test_entry_without_the_corpus_package(monkeypatch):
    import importlib
    import sys

    for name in [n for n in sys.modules if n.startswith("loopwright.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("loopwright.llm", "corpus_pipeline"):  # None makes an import fail
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delattr("loopwright.llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_gold_holds_every_document_with_a_passage(spark, tmp_path):
    import duckdb

    passage = "the quick brown fox jumps over a lazy dog"
    texts = [f"{passage} {'' if i % 3 else 'filler ' * i} number{i}" for i in range(260)] + [f"un{passage}s", "the quick dog", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, passage), (2, "quick"), (3, "er1"), (4, "fox never seen here"), (5, None)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("recall_at_k", "mean_quality"):
        run, text = FAMILIES["q_rules"][name]
        assert oracle.compare(spark, con, str(tmp_path), run, text) == "", name
