"""Stages take effect one after the other; queries agree with SQL where SQL can say them."""

import os
import random

import brute
import duckdb
import pytest

import corpus_pipeline
from recordrisk.llm.decontaminate import find_passages
from recordrisk.llm.quality import fit_quality, score_quality
from recordrisk.llm.queries import ORACLES, QUERIES


def test_stages_by_brute_force(spark, data, tables, documents):
    docs, kept = tables("documents"), dict(documents)
    scores = {r["doc_id"]: r["score"] for r in score_quality(docs, fit_quality(docs, tables("labels"))).collect()}
    hits = {r["doc_id"] for r in find_passages(docs, tables("benchmark")).collect()}
    for (name, stage), want in zip(corpus_pipeline.STAGES, (
        lambda rows: {d for d in rows if scores[d] >= 0.3},
        lambda rows: {d for d, *_, same, _ in brute.groups(list(rows.items())) if same},
        lambda rows: {d for d, c in brute.near_classes(list(rows.items())).items() if d == c},
        lambda rows: set(rows) - hits,
    )):
        after = stage(spark, docs, data)
        assert after.columns == docs.columns, name
        kept = {d: kept[d] for d in want(kept)}
        assert {r["doc_id"] for r in after.select("doc_id").collect()} == set(kept), name
        docs = spark.createDataFrame(after.collect(), after.schema)
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, data).collect()
    assert {p["doc_id"] for p in pieces} == set(kept)


def test_run(spark, data):
    pieces = corpus_pipeline.run(spark, data).collect()
    assert pieces and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_and_no_rows(spark, data, odd, none, stage):
    name, run = stage
    assert run(spark, none, data).collect() == []
    got = run(spark, odd, data)
    assert got.collect()
    if name != "packing":
        assert got.columns == odd.columns


@pytest.fixture(scope="module")
def shared_ids(spark):
    """Rows under few ids or none, with copies, near copies, and a column named as the stages name theirs."""
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(6)]

    def near(text):
        words = text.split()
        words[rng.randrange(len(words))] = "other"
        return " ".join(words)

    rows = [(rng.choice([None, None, 7, 8, *range(20, 40)]), rng.choice([b, b, near(b)])) for b in base for _ in range(6)]
    rows += [(7, base[0])] * 3 + [(None, base[1])] * 3 + [(None, None), (5, None), (5, ""), (None, "")]
    table = [(i, t, "en", f"s{n}", n) for n, (i, t) in enumerate(rows)]
    return rows, spark.createDataFrame(table, "doc_id long, text string, lang string, source string, _row int").repartition(3)


def test_copies_go_row_by_row(spark, shared_ids):
    rows, docs = shared_ids
    got = corpus_pipeline.exact_dedup(spark, docs, None)
    want = {}
    for i, t in rows:
        want[t or ""] = max(want.get(t or "", -2), -1 if i is None else i)
    assert got.columns == docs.columns
    assert sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in got.collect()) == sorted(want.items())


def test_near_copies_go_row_by_row(spark, shared_ids):
    rows, docs = shared_ids
    last, classes = 10**9, {}
    for n, c in brute.near_classes([(n, t or "") for n, (_, t) in enumerate(rows)]).items():
        classes.setdefault(c, []).append(last if rows[n][0] is None else rows[n][0])
    got = corpus_pipeline.near_dedup(spark, docs, None).collect()
    assert sorted(last if r["doc_id"] is None else r["doc_id"] for r in got) == sorted(min(ids) for ids in classes.values())


def test_quality_goes_row_by_row(spark, data, tables):
    model = fit_quality(tables("documents"), tables("labels"))
    scored = score_quality(tables("documents"), model).join(tables("documents"), "doc_id")
    good, bad = (scored.where(test).limit(5).collect() for test in ("score >= 0.6", "score < 0.1"))
    rows = [(r["doc_id"], r["text"], 0) for r in tables("documents").collect()]
    rows += [(None, r["text"], 1) for r in good] + [(None, r["text"], 2) for r in bad] + [(10**6, good[0]["text"], 3), (10**6, bad[0]["text"], 4)]
    got = corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, kind int"), data)
    kinds = [r["kind"] for r in got.where("kind > 0").collect()]
    assert sorted(kinds) == [1] * len(good) + [3]


def test_a_run_leaves_its_stages_only(spark, data, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir")
    spark.conf.set("spark.checkpoint.dir", str(tmp_path))
    try:
        corpus_pipeline.run(spark, data)
    finally:
        spark.conf.set("spark.checkpoint.dir", before)
    assert sorted(n.rsplit("-", 1)[0] for n in os.listdir(tmp_path)) == sorted(f"stage-{n}" for n, _ in corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, data)
    places = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=str)


def test_a_query_for_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
