"""Streaming jobs: score arriving requests, keep live numbers over the log.

The log has no event time, so the live numbers are unwindowed aggregates; their state is
one row, or one row per key.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordrisk.operators.profile import OUTCOMES, kpi_columns, kpi_texts
from recordrisk.operators.score import log_of, score_batch
from recordrisk.sources.io import log_rows, save_document
from recordrisk.workspace import remove


def read_stream(spark: SparkSession, path, schema, format="parquet", files_per_trigger=None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def start(writer, checkpoint, once):
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_stream(requests: DataFrame, path, checkpoint, model=None, fit=None, encodings=None, style="service", once=False):
    """Scores each request as it arrives and appends it to the log at ``path``."""
    scored = log_rows(log_of(score_batch(requests, model, fit, encodings, style)))
    return start(scored.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, once)


def live_kpis(log: DataFrame) -> DataFrame:
    """Running total, outcomes, survival rate and average confidence."""
    return kpi_texts(log.groupBy().agg(*kpi_columns()))


def live_outcome_counts(log: DataFrame, key) -> DataFrame:
    """Running Safe and Failed counts per key from one aggregate."""
    present = log.where(F.col(key).isNotNull())
    return present.groupBy(key).agg(*[
        F.count_if(F.col("Prediction") == outcome).alias(outcome) for outcome in OUTCOMES])


def publish(live: DataFrame, path, checkpoint, once=False):
    """Keeps the table at ``path`` equal to a live aggregate (see ``read_published``).

    A batch is written to a folder of its own, and a small pointer file is added last. So readers always find a whole table, a
    crash leaves the last one in place, and a repeated batch writes the same folder again. Folders before the previous
    batch are removed.
    """
    spark = live.sparkSession

    def replace(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        save_document(spark, {"batch": number}, f"{path}/done/{number:020d}")
        for old in published(spark, path)[:-2]:
            for folder in (f"{path}/done/{old:020d}", f"{path}/batch={old}"):
                remove(spark, folder)

    return start(live.writeStream.outputMode("complete").foreachBatch(replace), checkpoint, once)


def published(spark, path):
    """Numbers of the batches that are complete, oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [s.getPath() for s in files.listStatus(place)]
    marked = [p for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in marked)


def read_published(spark: SparkSession, path, schema) -> DataFrame:
    """The table of the last complete batch; empty before the first."""
    done = published(spark, path)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={done[-1]}")
