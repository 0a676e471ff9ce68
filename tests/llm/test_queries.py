"""The registered queries: SQL where there is some, and the pipeline's stages one after the other."""

from __future__ import annotations

import ast
from pathlib import Path

import pytest

import corpus_pipeline
from prosegauge.llm import queries

from ..conftest import ROOT, duck, same_rows
from .test_operators import brute_hits, brute_links, brute_pii, no_language


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, tiny, name):
    same_rows(queries.QUERIES[name](spark, tiny), duck(tiny), queries.ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_nothing_else_imports_the_package():
    for p in Path(ROOT, "prosegauge").rglob("*.py"):
        if "llm" not in p.parts:
            names = [n.module or "" for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in n.split(".") for n in names), p


def test_pipeline_stages(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tiny).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    ran = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, tiny).collect()}
    assert ran == {r.doc_id: r.taken for r in docs.collect()}


def test_pipeline_stages_equal_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, docs, tiny).cache()
    first = {r.doc_id: r for r in docs.collect()}
    assert {r.doc_id for r in one.collect()} >= {i for i, r in first.items() if any(c.isalpha() for c in r.text)}

    rows = sorted(one.collect())
    two = stages[1](spark, one, tiny).cache()
    _, label = brute_links([r.text for r in rows])
    assert sorted(two.collect()) == [r for i, r in enumerate(rows) if label[i] == i]

    rows = sorted(two.collect())
    three = stages[2](spark, two, tiny).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    assert sorted(three.collect()) == [r for r, (_, n, _) in zip(rows, brute_hits([r.text for r in rows], items), strict=True) if n == 0]

    rows = {r.doc_id: r for r in three.collect()}
    four = {r.doc_id: r for r in stages[3](spark, three, tiny).collect()}
    assert four.keys() == rows.keys()
    for i, r in rows.items():
        if found := brute_pii(r.text):
            assert not any(r.text[s:e] in four[i].text for k, s, e in found if k in (0, 3)) and len(four[i].text) == four[i].n_chars
        elif not any(c.isdigit() or c == "@" for c in r.text):
            assert four[i] == r


def test_pipeline_drops_texts_in_no_language(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    made = [(10**6 + i, t, "en" if i % 2 else None, "src0", len(t)) for i, t in enumerate(no_language(3, 20))]
    more = docs.unionByName(spark.createDataFrame(made, docs.schema))
    kept = corpus_pipeline.STAGES[0][1](spark, more, tiny).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline_on_odd_documents(spark, tiny, odd_docs, tmp_path):
    for name, rows in (("odd", odd_docs), ("none", odd_docs.where("1 = 0"))):
        docs = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, tiny)
            out.write.parquet(str(tmp_path / name / str(k)))
            docs = spark.read.parquet(str(tmp_path / name / str(k)))
            if k < 4:
                assert docs.columns == odd_docs.columns
        assert docs.count() <= rows.count()
