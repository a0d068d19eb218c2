"""The registered queries and the pipeline, stage by stage."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import llm_data as data  # noqa: E402

import corpus_pipeline  # noqa: E402
from trickle.llm import mixing, packing, queries, secret_scan, simhash, toxicity  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.all_queries()) < set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.all_queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_oracle(spark, name):
    from oracle_check import compare, duck

    query, sql = queries.all_queries()[name], queries.all_oracles()[name]
    ok, message = compare(query(spark, data.SF01), duck(data.SF01), sql)
    assert ok, message


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{data.SF001}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)

    clean = steps["toxicity"](spark, docs, data.SF001).cache()
    labels = spark.read.parquet(f"{data.SF001}/labels.parquet")
    bad = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    assert clean.columns == COLUMNS
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad

    single = steps["simhash_near_dedup"](spark, clean, data.SF001).cache()
    groups = simhash.near_duplicates(clean).collect()
    assert single.columns == COLUMNS
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})

    masked = steps["secret_scan"](spark, single, data.SF001).cache()
    assert masked.columns == COLUMNS and masked.count() == single.count()
    assert secret_scan.scan(masked).where("spans <> ''").count() == 0

    mixed = steps["mix_sources"](spark, masked, data.SF001).cache()
    assert mixed.columns == COLUMNS
    want = sum(r.taken for r in mixing.mix(masked).collect())
    assert sum(len(data.WORD.findall(r.text)) for r in mixed.collect()) == want

    packed = steps["pack_sequences"](spark, mixed, data.SF001).collect()
    assert sum(1 for r in packed if r.piece == 0) == mixed.count()
    assert all(len(r.ids) == r.length for r in packed)


def test_run(spark):
    rows = corpus_pipeline.run(spark, data.SF001).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096


@pytest.mark.parametrize("step", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_awkward_documents(spark, step):
    docs = data.documents(spark)
    out = step(spark, docs, data.SF001)
    if step is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == docs.columns
    assert out.count() > 0
    assert step(spark, docs.limit(0), data.SF001).collect() == []
