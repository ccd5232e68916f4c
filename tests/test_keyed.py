"""Live tables merged by key: equal to the batch answer after every batch, and written only where keys changed."""

import os
import random

import pytest
from pyspark.sql import functions as F

from recordrisk.operators import evaluate as H, profile as P
from recordrisk.streaming import keyed as K, streams as J
from recordrisk.workspace import shared_folder


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def bag(df):
    return sorted(map(str, df.collect()))


def test_parts_follow_their_keys(spark):
    folder, path, schema = shared_folder(spark, "in"), shared_folder(spark, "table"), "k string, n long"
    assert K.read_merged(spark, path, "k string, count long").collect() == []
    seen = []
    for rows in ([(f"k{i}", i) for i in range(40)] + [(None, 1)], [("k3", 1)], [("k3", 2), (None, 5), ("new", 1)], [("k7", 1)]):
        arrive(spark, folder, rows, schema)
        seen += rows
        before = K.merged_state(spark, path)["versions"]
        live = J.read_stream(spark, folder, schema, files_per_trigger=1).groupBy("k").agg(F.count(F.lit(1)).alias("count"))
        K.merge_published(live, path, ["k"], f"{path}-progress", parts=8, once=True).awaitTermination()
        assert bag(K.read_merged(spark, path, live.schema)) == bag(spark.createDataFrame(seen, schema).groupBy("k").agg(F.count(F.lit(1)).alias("count")))
        after = K.merged_state(spark, path)["versions"]
        if before:
            keys = spark.createDataFrame([(k,) for k, _ in rows], "k string").select(K.hash_part(["k"], 8).alias("p")).distinct().collect()
            assert {p for p in after if after[p] != before.get(p)} == {str(r["p"]) for r in keys}
    assert len(J.published(spark, path)) == 2
    left = [os.listdir(f"{path}/{n}") for n in os.listdir(path) if n.startswith("batch=")]
    assert sum(f.startswith("part=") for files in left for f in files) <= 2 * 8


def test_a_repeated_batch_changes_nothing(spark):
    """A crash after the files and before the pointer: the batch runs again."""
    folder, path, schema = shared_folder(spark, "in"), shared_folder(spark, "table"), "k string, n long"
    live = lambda: J.read_stream(spark, folder, schema, files_per_trigger=1).groupBy("k").agg(F.sum("n").alias("n"))
    arrive(spark, folder, [("a", 1), ("b", 2)], schema)
    K.merge_published(live(), path, ["k"], f"{path}-progress", parts=4, once=True).awaitTermination()
    arrive(spark, folder, [("a", 10)], schema)
    spark.createDataFrame([("zz", 99)], schema).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(f"{path}/batch=1")
    assert bag(K.read_merged(spark, path, schema)) == bag(spark.createDataFrame([("a", 1), ("b", 2)], schema))
    K.merge_published(live(), path, ["k"], f"{path}-progress", parts=4, once=True).awaitTermination()
    assert bag(K.read_merged(spark, path, schema)) == bag(spark.createDataFrame([("a", 11), ("b", 2)], schema))


def test_latest_rows_in_any_order(spark):
    rng = random.Random(2)
    schema = "who string, at long, what string, size double"
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(30)]), rng.choice(["x", "y", None]), rng.choice([None, 1.0, 2.5])) for _ in range(300)]
    folder, path = shared_folder(spark, "in"), shared_folder(spark, "table")
    with K.state_store(spark):
        for start in range(0, 300, 100):
            arrive(spark, folder, rows[start : start + 100], schema)
            live = K.live_latest(J.read_stream(spark, folder, schema, files_per_trigger=1), "who", "at")
            assert live.columns == ["who", "at", "what", "size"]
            K.merge_published(live, path, ["who"], f"{path}-progress", once=True).awaitTermination()
            want = P.latest_prediction(spark.createDataFrame(rows[: start + 100], schema), "at", "who")
            assert bag(K.read_merged(spark, path, live.schema).select(want.columns)) == bag(want)


def test_latest_ties_do_not_depend_on_placement(spark):
    rows = [("a", 1, x) for x in ("p", "z", "m", None)]
    for order in (rows, rows[::-1]):
        got = P.latest_prediction(spark.createDataFrame(order, "k string, at int, v string").repartition(3), "at", "k").collect()
        assert [tuple(r) for r in got] == [("a", 1, "z")]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_live_area_under_the_curve(spark, parts):
    rng = random.Random(parts)
    schema = "label int, score double"
    folder, path = shared_folder(spark, "in"), shared_folder(spark, "table")
    assert K.live_auc(spark, path) is None
    seen = []
    for batch in range(3):
        rows = [(int(rng.random() < 0.4), rng.choice([None, 0.0, 1.0, 0.5, round(rng.random(), 2)])) for _ in range(150)] if batch else [(1, 0.3), (1, 0.9)]
        seen += rows
        arrive(spark, folder, rows, schema)
        K.publish_scores(J.read_stream(spark, folder, schema, files_per_trigger=1), path, f"{path}-progress", parts, once=True).awaitTermination()
        assert K.live_auc(spark, path) == H.roc_auc(spark.createDataFrame(seen, schema)).first()["roc_auc"]
