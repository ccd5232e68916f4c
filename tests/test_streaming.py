from pyspark.sql import functions as F

from recordrisk.operators import profile as P, score as I
from recordrisk.sources import io, views as V
from recordrisk.streaming import streams as J
from recordrisk.workspace import shared_folder


def source(spark, data, parts):
    """The events written as several files, read one file per trigger."""
    folder = shared_folder(spark, "arriving")
    events = V.table(spark, data, "events")
    events.repartition(parts, "event_id").write.parquet(folder)
    return events, V.prediction_log(J.read_stream(spark, folder, events.schema, files_per_trigger=1))


def sorted_rows(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.collect())


def test_stream_equals_batch_over_files(spark, data):
    events, stream = source(spark, data, 4)
    folder = shared_folder(spark, "stream")
    J.score_stream(V.requests_from(stream), f"{folder}/log", f"{folder}/a", once=True).awaitTermination()
    batch = io.log_rows(I.log_of(I.score_batch(V.requests_from(V.prediction_log(events)))))
    assert sorted_rows(io.read_predictions(spark, f"{folder}/log")) == sorted_rows(batch)

    # a restart finds nothing new and appends nothing
    J.score_stream(V.requests_from(stream), f"{folder}/log", f"{folder}/a", once=True).awaitTermination()
    assert io.read_predictions(spark, f"{folder}/log").count() == batch.count()


def test_live_numbers_equal_the_table(spark, data):
    events, stream = source(spark, data, 3)
    log = V.prediction_log(events)
    folder = shared_folder(spark, "live")
    kpis = J.live_kpis(stream)
    J.publish(kpis, f"{folder}/kpis", f"{folder}/a", once=True).awaitTermination()
    got, want = J.read_published(spark, f"{folder}/kpis", kpis.schema).first(), P.log_kpis(log).first()
    for name in ("total", "safe", "failed", "survival_rate", "avg_confidence_text"):
        assert got[name] == want[name]
    counts = J.live_outcome_counts(stream, "City")
    J.publish(counts, f"{folder}/counts", f"{folder}/b", once=True).awaitTermination()
    assert sorted_rows(J.read_published(spark, f"{folder}/counts", counts.schema).select("City", "Failed", "Safe")) == sorted_rows(
        P.crosstab(log, "City", "Prediction", P.OUTCOMES).select("City", "Failed", "Safe"))


def test_appended_log_rounds_confidence(spark):
    path = shared_folder(spark, "log")
    row = spark.createDataFrame([(1, 0.123456)], "pred_id long, Confidence double")
    io.append_predictions(row, path)
    io.append_predictions(row.withColumn("pred_id", F.lit(2).cast("long")), path)
    assert [r["Confidence"] for r in io.read_predictions(spark, path).collect()] == [0.1235, 0.1235]


def test_published_tables_are_whole_and_repeatable(spark):
    path = shared_folder(spark, "published")
    assert J.read_published(spark, path, "n int").collect() == []
    arriving = shared_folder(spark, "arriving")
    for keys in (["a"], ["a", "b"], ["b"], ["c"]):
        spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).write.mode("append").parquet(arriving)
        live = J.read_stream(spark, arriving, "k string", files_per_trigger=1).groupBy("k").count()
        J.publish(live, path, f"{path}-progress", once=True).awaitTermination()
    assert sorted_rows(J.read_published(spark, path, live.schema)) == [("a", 2), ("b", 2), ("c", 1)]
    # a batch that was written but not marked is not read
    spark.createDataFrame([("z", 9)], live.schema).write.parquet(f"{path}/batch=99")
    assert ("z", 9) not in sorted_rows(J.read_published(spark, path, live.schema))
    kept = [s.getPath().getName() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done"))]
    assert len(kept) == 2


def test_appending_a_job_again_adds_nothing(spark):
    path = shared_folder(spark, "log")
    rows = spark.createDataFrame([(1, 0.5), (2, 0.5)], "pred_id long, Confidence double")
    for _ in range(2):
        io.append_predictions(rows, path, once_by="pred_id")
    assert io.read_predictions(spark, path).count() == 2
