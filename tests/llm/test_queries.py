"""Registered queries against their SQL, and the pipeline against its stages by brute force."""

from collections import Counter

import pytest
from compare import connect, differences
from cases import groups, shingles, tokens

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tendero.llm.queries import ORACLE, QUERIES
from tendero.llm.toxicity import fit
from test_decontaminate import holds


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = connect(sf_dir)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) == []


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_has_a_row_for_each_row(name, spark, sf_dir):
    table = {"op4": "embeddings", "op2": "pages", "op5": "pages"}.get(name.split("_")[0], "documents")
    assert QUERIES[name](spark, sf_dir).count() >= spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_pipeline_is_its_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model:
        rows = {i: t for i, t in rows.items() if model.score(t) < 0.5}
    sets = {i: shingles(t, 5) for i, t in rows.items()}
    top = groups(sets, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    rows = {i: t for i, t in rows.items() if top[i] == i}
    counts = Counter()
    for text in rows.values():
        found = tokens(text)
        counts.update(tuple(found[k:k + 35]) for k in range(len(found) - 34))
    cut = {}
    for i, text in rows.items():
        found = tokens(text)
        gone = set()
        for k in range(len(found) - 34):
            if counts[tuple(found[k:k + 35])] > 1:
                gone.update(range(k, k + 35))
        if not gone:
            cut[i] = text
        else:
            cut[i] = b" ".join(w for k, w in enumerate(found) if k not in gone).decode()
    items = [tokens(r["text"], True) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {i: t for i, t in cut.items() if not any(holds(tokens(t, True), v) for v in items)}
    found = corpus_pipeline.run(spark, sf_dir)
    assert {r[0]: r[1] for r in found.groupBy("doc_id").sum("n_tokens").collect()} == {i: len(tokens(t)) + 1 for i, t in kept.items()}


def test_stages_keep_the_columns_and_take_empty_tables(spark, sf_dir, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == docs.schema.names
            assert stage(spark, no_docs, sf_dir).schema.names == no_docs.schema.names
