"""The registered queries against their SQL, and the pipeline against plain Python."""

import math
import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from residua.llm import decontaminate, packing, pii, quality, simhash
from residua.llm.catalog import ORACLES, QUERIES
from residua.plans.registry import table
from test_dedup import groups_slowly
from test_filters import hits_slowly
from test_models import check_packing

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(bool(re.match(f"op{n}_", name)) for name in names) == 1
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    frame = QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    assert sorted(names) == columns
    mine = sorted((tuple(r) for r in frame.select(columns).collect()), key=repr)
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert mine == theirs and mine


def test_results_without_sql(spark, small):
    ids = {r.doc_id for r in table(spark, small, "documents").select("doc_id").collect()}
    near = QUERIES["op5_simhash_near_duplicates"](spark, small).collect()
    assert {r.doc_id for r in near} == ids and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in near)
    spans = QUERIES["op8_pii"](spark, small).collect()
    assert {r.doc_id for r in spans} == ids
    for r in spans:
        made = [s.split(":") for s in r.spans.split(",") if s]
        assert all(k in pii.KINDS and int(a) < int(b) for k, a, b in made)
        assert len(made) >= r.n_email + r.n_ip + r.n_card + r.n_phone
    for r in QUERIES["op4_lm_scoring"](spark, small).collect():
        assert r.n_known <= r.n_tokens and math.isfinite(r.score) and r.score < 0
    for r in QUERIES["op7_language_id"](spark, small).collect():
        assert r.lang_pred in ("en", "de", "fr", "es", "und") and 0 <= r.score <= 1
    sizes = {r.doc_id: [len(r.text.encode().split()) + 1] for r in table(spark, small, "documents").collect()}
    check_packing(QUERIES["op9_best_fit_packing"](spark, small).collect(), sizes, packing.CAPACITY)


def test_pipeline_equals_brute_force(spark, small):
    docs = table(spark, small, "documents")
    names = docs.columns
    before = [r.asDict() for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    frame = stages["quality_rules"](spark, docs, small).cache()
    expected = {}
    for r in before:
        found = quality.measure(r["text"])
        if found["kept"]:
            expected[r["doc_id"]] = found["clean_text"]
    assert frame.columns == names and {r.doc_id: r.text for r in frame.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in frame.collect())

    kept = stages["simhash_near_duplicates"](spark, frame, small).cache()
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    full = [((a & (2**64 - 1)) << 64) | (b & (2**64 - 1)) for a, b in (simhash.wide_fingerprint(t) for _, t in rows)]
    radius = simhash.wide_radius()
    groups = groups_slowly(full, [i for i, _ in rows], lambda a, b: (a ^ b).bit_count() <= radius)
    wanted, got = set(groups), {r.doc_id for r in kept.collect()}
    assert kept.columns == names and len(wanted ^ got) <= 0.01 * len(rows)

    clean = stages["benchmark_decontamination"](spark, kept, small).cache()
    items = [tuple(r) for r in table(spark, small, "benchmark").select("item_id", "text").collect()]
    left = set()
    for r in kept.collect():
        n, hit, _ = hits_slowly(r.text, items)
        if not (hit > 0 and 20 * hit >= n):
            left.add(r.doc_id)
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == left

    masked = stages["pii"](spark, clean, small).cache()
    model = pii.fit(clean)
    texts = {r.doc_id: r.text for r in clean.collect()}
    for r in masked.collect():
        spans = [{"start": a, "end": b, "kind": k} for a, b, k in pii.all_spans(model, texts[r.doc_id])[1]]
        assert r.text == pii._masked(texts[r.doc_id], spans) and not pii.strict_spans(r.text)
    assert masked.columns == names and masked.count() == clean.count()

    packed = stages["best_fit_packing"](spark, masked, small).collect()
    check_packing(packed, {r.doc_id: [len(r.text.encode().split()) + 1] for r in masked.collect()}, packing.CAPACITY)


def test_pipeline_runs_whole(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_stages_take_edges(spark, small, edge_docs):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (edge_docs, edge_docs.limit(0)):
            out = stage(spark, docs, small)
            assert name == "best_fit_packing" or out.columns == docs.columns
            out.collect()


def test_contamination_rule_is_the_operators(spark, small):
    found = QUERIES["op1_benchmark_decontamination"](spark, small)
    bad = {r.doc_id for r in found.filter("contaminated").collect()}
    docs = table(spark, small, "documents")
    kept = decontaminate.remove_documents(docs, table(spark, small, "benchmark"))
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == bad
