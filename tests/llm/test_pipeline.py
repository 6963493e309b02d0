from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from skyledger.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "benchmark", "secrets", "pieces"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert docs.columns == COLUMNS and 0 < docs.count() <= before
        before = docs.count()
        assert docs.filter("n_chars <> length(text)").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == before and last.filter("not exact").isEmpty()
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(tuple(r) for r in last.collect())


def test_stages_take_effect(make_docs, spark, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    text = " ".join(f"word{i} and" for i in range(100))
    rows = make_docs([(1, f"{text} {benchmark} {text}"), (2, f"{text} token = abcdefghijkl0123 end"), (3, None), (3, None), (4, "")])
    cut = {r.doc_id: r for r in corpus_pipeline.STAGES[2][1](spark, rows, sf).collect()}
    assert benchmark not in cut[1].text and cut[1].n_chars == len(cut[1].text) and cut[2].text == rows.filter("doc_id = 2").first().text
    clean = {r.doc_id: r.text for r in corpus_pipeline.STAGES[3][1](spark, rows, sf).collect()}
    assert clean[2] == f"{text} [SECRET] end" and clean[3] is None
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, make_docs([(1, text), (2, text), (3, "other")]), sf).collect()) == [1, 3]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql_gives_the_same(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
