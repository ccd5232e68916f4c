"""Readers and writers for records, encodings, the prediction log, models and metrics."""

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recordrisk.functions import tables as R
from recordrisk.schemas import ENCODING, METRIC, PREDICTION_LOG
from recordrisk.workspace import lookup

CORRUPT = "_corrupt_record"
# Quotes are doubled, and white space around a value is part of it.
CSV = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_records(spark: SparkSession, path: str, schema, format="csv", mode="PERMISSIVE", corrupt=None,
                 multiline=False) -> DataFrame:
    """Records under a declared schema; NaN in double columns is read as missing.

    A line of CSV with bad values or too many or few fields is an error with ``mode="FAILFAST"``. Otherwise its good
    values are kept, and with ``corrupt`` a column of that name has the whole line, or NULL for good ones; ``corrupt_rows``
    counts them. With ``multiline`` quoted texts may hold line breaks; a file is then read by one task.
    """
    if format != "csv":
        df = spark.read.schema(schema).format(format).load(path)
    else:
        full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = spark.read.schema(full).option("header", True).option("mode", mode).option("multiLine", multiline)
        df = reader.option("columnNameOfCorruptRecord", CORRUPT).options(**CSV).csv(path)
    doubles = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    nan = F.lit(float("nan"))
    kept = [F.nullif(F.col(n), nan).alias(n) if n in doubles else F.col(n) for n in schema.names]
    if corrupt:
        kept.append((F.col(CORRUPT) if format == "csv" else F.lit(None).cast("string")).alias(corrupt))
    return df.select(*kept)


def corrupt_rows(spark: SparkSession, path: str, schema) -> int:
    """How many lines of a CSV table do not fit the schema."""
    rows = read_records(spark, path, schema, corrupt=CORRUPT)
    every = F.xxhash64(*schema.names)  # a line is only parsed whole if all its columns are asked for
    return rows.agg(F.count_if(F.col(CORRUPT).isNotNull()), F.max(every)).first()[0]


def write_records(df: DataFrame, path: str, format="parquet", mode="overwrite") -> None:
    """One file per task; the output is never gathered into a single file."""
    writer = df.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True).options(**CSV)
    writer.format(format).save(path)


def encoding_table(spark: SparkSession, maps: dict) -> DataFrame:
    """``{feature: {value: code}}`` as the long encoding table."""
    rows = [(feature, value, code) for feature, m in maps.items() for value, code in m.items()]
    return spark.createDataFrame(rows, ENCODING)


SERVICE_CODES = {"City": R.SERVICE_CITY_CODES, "Industry": R.SERVICE_INDUSTRY_CODES}
DASHBOARD_CODES = {
    "City": R.DASHBOARD_CITY_CODES, "Industry": R.DASHBOARD_INDUSTRY_CODES, "Stage": R.DASHBOARD_STAGE_CODES,
}


def save_encodings(encodings: DataFrame, path: str, format="json") -> None:
    encodings.select(*ENCODING.names).write.mode("overwrite").format(format).save(path)


def load_encodings(spark: SparkSession, path: str, format="json") -> DataFrame:
    return spark.read.schema(ENCODING).format(format).load(path)


def log_rows(df: DataFrame) -> DataFrame:
    """Scored rows in the shape of the log: confidence at four decimals, all columns typed."""
    typed = []
    for field in PREDICTION_LOG.fields:
        col = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name == "Confidence":
            col = F.bround(col.cast("double"), 4)
        typed.append(col.cast(field.dataType).alias(field.name))
    return df.select(*typed)


def append_predictions(df: DataFrame, path: str, once_by=None) -> None:
    """Appends to the log; with ``once_by`` (a key column of the log) rows whose key it has already are left out.

    So a job can be repeated.
    """
    rows = log_rows(df)
    if once_by and exists(df.sparkSession, path):
        rows = rows.join(read_predictions(df.sparkSession, path).select(once_by), once_by, "left_anti").select(*PREDICTION_LOG.names)
    rows.write.mode("append").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_LOG).parquet(path)


def upgrade_log_v1(old: DataFrame, encodings: DataFrame = None) -> DataFrame:
    """The older log in the present shape: codes become text, absent columns are missing.

    With an encoding table the codes are turned back into names.
    """
    out = old
    for name in ("City", "Industry"):
        if encodings is None:
            out = out.withColumn(name, F.col(name).cast("string"))
        else:
            names = encodings.where(F.col("feature") == name).select(
                F.col("code").cast("long").alias(name), F.col("value").alias("_name"))
            out = lookup(out, names, name).withColumn(
                name, F.coalesce("_name", F.col(name).cast("string"))).drop("_name")
    return log_rows(out)


def combine_logs(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.unionByName(upgrade_log_v1(old), allowMissingColumns=True)


def export_log(df: DataFrame, path: str) -> None:
    write_records(df, path, "csv")


def save_model(model, path: str) -> None:
    """A pipeline in Spark's own format, a ``BoostedModel`` as a document."""
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
    else:
        model.save(SparkSession.active(), f"{path}/boosted")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def load_model(path: str, spark: SparkSession = None):
    """The saved model, or None if there is none at the path; scoring then falls back to the rule.

    Any other failure is an error.
    """
    spark = spark or SparkSession.active()
    if exists(spark, f"{path}/boosted"):
        from recordrisk.operators.boosting import BoostedModel

        return BoostedModel.load(spark, f"{path}/boosted")
    return PipelineModel.load(path) if exists(spark, path) else None


def save_document(spark: SparkSession, document: dict, path: str) -> None:
    """A small document as one JSON line."""
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_metrics(metrics: DataFrame, path: str) -> None:
    metrics.select(*METRIC.names).write.mode("overwrite").json(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC).json(path)


def metrics_document(metrics: DataFrame, best_model: str, features) -> dict:
    """The run as one nested document: best model, features, and the metrics by model.

    Its size is the number of models and run-level numbers.
    """
    doc = {"best_model": best_model, "features": list(features)}
    for row in metrics.collect():
        doc.setdefault(row["model"], {})[row["metric"]] = row["value"]
    return doc
