"""Mergeable summaries within their bounds, and appends that add nothing twice."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordrisk.operators.profile import top_k_values
from recordrisk.operators.sketches import append_summary, count_error, frequent_values, merged_quantile, rank_error
from recordrisk.sources import once as O
from recordrisk.workspace import durable, shared_folder


def test_quantiles_stay_within_the_bound(spark):
    rng, path = np.random.default_rng(1), shared_folder(spark, "summary")
    assert merged_quantile(spark, path, "x", [0.5]).collect() == []
    everything = np.zeros(0)
    for batch in range(4):
        values = rng.lognormal(size=30_000) * (batch + 1)
        everything = np.concatenate([everything, values])
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 5, "x double").repartition(3)
        append_summary(df, path, batch, quantiles=["x"])
        append_summary(df, path, batch, quantiles=["x"])  # repeated: replaces its own
        for r in merged_quantile(spark, path, "x", [0.0, 0.05, 0.5, 0.99, 1.0]).collect():
            assert r["n"] == len(everything) and abs((everything <= r["value"]).mean() - r["q"]) <= rank_error() + 1e-4


@pytest.mark.parametrize("skew", [True, False])
def test_frequent_values_are_exact(spark, skew):
    rng, path = random.Random(3), shared_folder(spark, "summary")
    rows = [(f"v{int(rng.paretovariate(0.8)) if skew else rng.randrange(3000)}" if i % 50 else None, i) for i in range(20_000)]
    df = durable(spark.createDataFrame(rows, "v string, i long"))
    for batch in range(3):
        append_summary(df.where(F.col("i") % 3 == batch), path, batch, frequent=["v"], tracked=500)
    got = frequent_values(df, path, "v", 8, tracked=500)
    want = top_k_values(df, "v", 8)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert count_error(500, 1000) == 3.5 * 1000 / 1024


def test_filters_miss_nothing():
    rng = np.random.default_rng(5)
    for n in (1, 2, 63, 1000, 50_000):
        h = rng.integers(-2**63, 2**63 - 1, n)
        bits = O.bloom(h)
        assert O.may_hold(bits, h).all()
        assert O.may_hold(bits, rng.integers(-2**63, 2**63 - 1, 20_000)).mean() < 0.01


def test_repeated_appends_add_nothing_and_new_ones_read_little(spark):
    path, schema = shared_folder(spark, "once"), "k long, v string"
    assert O.read_once(spark, path, schema).collect() == []
    make = lambda lo, hi: spark.createDataFrame([(i, f"v{i}") for i in range(lo, hi)], schema)
    assert O.append_once(make(0, 500), path, "a", "k", 8) == 0
    assert O.append_once(make(0, 500), path, "a", "k", 8) == 0  # by its name
    assert O.append_once(make(0, 500), path, "again", "k", 8) == 8  # by its keys: every bucket of the first
    assert O.read_once(spark, path, schema).count() == 500
    assert O.append_once(make(500, 560), path, "b", "k", 8) <= 2  # new keys: false hits only
    assert O.append_once(make(300, 301), path, "one", "k", 8) <= 2
    assert O.append_once(make(400, 700), path, "c", "k", 8) <= 8 * 4
    got = O.read_once(spark, path, schema)
    assert sorted(r["k"] for r in got.collect()) == list(range(700))
    plan = O._read(spark, path, schema, O._paths(spark, path, O.folders_asked(make(300, 301), path, "k", 8)))
    assert {f.split("append=")[1].split("/")[0] for f in plan.inputFiles()} == {"a"} and len(plan.inputFiles()) <= 2


def test_null_and_repeated_keys(spark):
    path, schema = shared_folder(spark, "once"), "k string, v int"
    rows = spark.createDataFrame([(None, 1), ("x", 1), ("x", 2), ("", 3)], schema)
    for name in ("a", "b"):
        O.append_once(rows, path, name, "k", 4)
    assert sorted(((r["k"] is not None, r["k"] or "", r["v"]) for r in O.read_once(spark, path, schema).collect())) == [(False, "", 1), (False, "", 1), (True, "", 3), (True, "x", 1), (True, "x", 2)]
    O.append_once(rows.limit(0), path, "none", "k", 4)
    assert O.read_once(spark, path, schema).count() == 5
    with pytest.raises(ValueError):
        O.append_once(rows.withColumnRenamed("v", "bucket"), path, "c", "k")


def test_a_broken_append_is_not_there(spark):
    path, schema = shared_folder(spark, "once"), "k long, v string"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    rows.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/log/append=x")
    assert O.read_once(spark, path, schema).collect() == []
    O.append_once(rows, path, "x", "k", 4)
    assert O.read_once(spark, path, schema).count() == 2
