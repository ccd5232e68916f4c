"""Categorical encoding: keyword classes, rare-value folding, ordinal codes."""

from pyspark.sql import DataFrame, Window as W, functions as F

from recordrisk.functions import columns as C
from recordrisk.operators.ordering import running_totals
from recordrisk.workspace import SMALL_ROWS, lookup, small_or_none

OTHER = "Other"
# Up to this many values a lookup is a CASE expression and needs no join.
CASE_VALUES = 64


def encode_stage(df: DataFrame, col="Stage", rules="train", out="StageEncoded") -> DataFrame:
    return df.withColumn(out, C.stage_code(col, rules))


def classify_industry(df: DataFrame, col="Industry", rules="train", out="IndustryClean") -> DataFrame:
    return df.withColumn(out, C.industry_class(col, rules))


def frequent_values(df: DataFrame, col, n=15, counts=False) -> DataFrame:
    """The ``n`` most frequent values, ties in value order."""
    found = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    top = found.orderBy(F.desc("n"), col).limit(n)
    return top if counts else top.select(col)


def fold_rare(df: DataFrame, col, n=15, other=OTHER, frequent: DataFrame = None) -> DataFrame:
    """Keep the most frequent values; the rest and missing become ``other``.

    Pass ``frequent`` to reuse the values of an earlier fit.
    """
    if frequent is None:
        frequent = frequent_values(df, col, n)
    kept = frequent.select(F.col(col), F.lit(True).alias("_kept"))
    joined = lookup(df, kept, col)
    return joined.withColumn(col, F.when(F.col("_kept"), F.col(col)).otherwise(other)).select(*df.columns)


def ordinal_codes(values) -> dict:
    """Codes 0..k-1 of a few values in sorted order."""
    return {value: code for code, value in enumerate(sorted(values))}


def fit_ordinal(df: DataFrame, col, feature=None, null_label=None) -> DataFrame:
    """Sorted distinct values to 0..k-1, as rows of an encoding table.

    A short list of values is numbered by one sort; a long one is range-sorted over the
    cluster. ``null_label`` names a category for missing, which are left out otherwise.
    """
    values = df.select((C.stringify(col, null_label) if null_label else F.col(col).cast("string")).alias("value"))
    values = values.where(F.col("value").isNotNull()).distinct()
    rows = small_or_none(values)
    if rows is not None:
        spark = df.sparkSession
        numbered = spark.createDataFrame(rows, values.schema).withColumn(
            "code", F.row_number().over(W.orderBy("value")) - 1)
    else:
        numbered = running_totals(values.withColumn("_one", F.lit(1)), ["value"], {"_rank": "_one"})
        numbered = numbered.withColumn("code", F.col("_rank") - 1)
    return numbered.select(F.lit(feature or col).alias("feature"), "value", F.col("code").cast("int").alias("code"))


def unique_codes(encoding: DataFrame, feature) -> DataFrame:
    """(_value, _code) of a feature, one row a value: of contradicting codes the smallest holds."""
    codes = encoding.where((F.col("feature") == feature) & F.col("value").isNotNull())
    return codes.groupBy(F.col("value").alias("_value")).agg(F.min("code").alias("_code"))


def apply_encoding(df: DataFrame, col, encoding, default=None, out=None, feature=None,
                   null_label=None, case_values=CASE_VALUES, small_rows=SMALL_ROWS) -> DataFrame:
    """Code of each value; values the encoding does not have get ``default``.

    ``encoding`` is an encoding table or ``{feature: {value: code}}``. A value that a table lists more than once has
    its smallest code. Up to ``case_values`` values become one expression, more are broadcast if their rows and
    bytes are few, and a larger table is joined; the answer is the same in all three.
    """
    out, feature = out or f"{col}Encoded", feature or col
    key = C.stringify(col, null_label) if null_label else F.col(col).cast("string")
    if isinstance(encoding, dict):
        rows, codes = list(encoding[feature].items()), None
    else:
        codes = unique_codes(encoding, feature)
        rows = small_or_none(codes, small_rows)
    if rows is not None and len(rows) <= case_values:
        code = C.map_literal(key, dict(map(tuple, rows)))
        return df.withColumn(out, (code if default is None else F.coalesce(code, F.lit(default))).cast("int"))
    if rows is not None:
        codes = F.broadcast(df.sparkSession.createDataFrame(rows, "_value string, _code int"))
    code = F.col("_code") if default is None else F.coalesce("_code", F.lit(default))
    kept = [c for c in df.columns if c != out]
    return df.withColumn("_value", key).join(codes, "_value", "left").select(*kept, code.cast("int").alias(out))


def apply_ordinal(df: DataFrame, col, encoding: DataFrame, out=None, null_label=None) -> DataFrame:
    return apply_encoding(df, col, encoding, None, out, null_label=null_label)


def membership_flag(df: DataFrame, col, values, out) -> DataFrame:
    return df.withColumn(out, C.membership_flag(col, values))


def band(df: DataFrame, col, out="FundingBand") -> DataFrame:
    return df.withColumn(out, C.band(col))


def decode_labels(df: DataFrame, col, mapping, out) -> DataFrame:
    return df.withColumn(out, C.decode_label(col, mapping))
