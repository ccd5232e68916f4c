"""Projection, filtering and cleaning."""

from pyspark.sql import DataFrame, functions as F

from recordrisk.functions import columns as C


def select_columns(df: DataFrame, cols, existing_only=False) -> DataFrame:
    """Column subset; ``existing_only`` skips names the table does not have."""
    return df.select(*[c for c in cols if not existing_only or c in df.columns])


def rename_columns(df: DataFrame, names) -> DataFrame:
    """New names by position, or by name when a dictionary is given."""
    return df.withColumnsRenamed(names) if isinstance(names, dict) else df.toDF(*names)


def filter_equals(df: DataFrame, col, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def filter_in(df: DataFrame, col, values) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def binary_target(df: DataFrame, col, positive=1, out="target") -> DataFrame:
    return df.withColumn(out, C.binary_target(col, positive))


def map_values(df: DataFrame, col, mapping, out=None) -> DataFrame:
    """Dictionary map: values the dictionary does not have become missing."""
    return df.withColumn(out or col, C.map_literal(col, mapping))


def replace_values(df: DataFrame, col, mapping) -> DataFrame:
    """Dictionary replace: values the dictionary does not have stay as they are."""
    return df.replace(mapping, subset=[col])


def parse_money(df: DataFrame, col, errors="raise") -> DataFrame:
    return df.withColumn(col, C.money(col, errors))


def to_number(df: DataFrame, col, default=0.0) -> DataFrame:
    return df.withColumn(col, C.number_or(col, default))


def fill_missing(df: DataFrame, values: dict) -> DataFrame:
    """Literal fill per column; NaN counts as missing."""
    return df.na.fill(values)


def stringify_category(df: DataFrame, col, null_label="nan") -> DataFrame:
    return df.withColumn(col, C.stringify(col, null_label))


def null_audit(df: DataFrame, cols=None, only_missing=True) -> DataFrame:
    """Missing count per column, from one pass over the table."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = counts.unpivot([], cols, "column_name", "missing")
    return long.where("missing > 0") if only_missing else long


def table_shape(df: DataFrame) -> DataFrame:
    """Row count and column count as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def head_rows(df: DataFrame, order, n=5) -> DataFrame:
    """The first rows in a stated order, so that the answer is repeatable."""
    return df.orderBy(*order).limit(n)
