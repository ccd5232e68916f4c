"""Aggregates that describe a table or the prediction log."""

from pyspark.sql import DataFrame, functions as F

from recordrisk.functions import columns as C

OUTCOMES = ["Failed", "Safe"]


def value_counts(df: DataFrame, col) -> DataFrame:
    """Rows per value, most frequent first; missing values are not counted."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), col)


def top_k_values(df: DataFrame, col, k) -> DataFrame:
    return value_counts(df, col).limit(k)


def class_balance(df: DataFrame, label) -> DataFrame:
    """Rows per class, with the ratio of the largest class to each class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n").alias("m")).scalar()
    return counts.select(label, "n", (largest / F.col("n")).alias("ratio"))


def rate_by(df: DataFrame, key, label, top=None, by_key=False) -> DataFrame:
    """Mean of a 0/1 label per group, highest first or in key order."""
    rates = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(label).alias("rate"), F.count(label).alias("n"))
    rates = rates.orderBy(key) if by_key else rates.orderBy(F.desc("rate"), key)
    return rates if top is None else rates.limit(top)


def crosstab(df: DataFrame, row, col, values) -> DataFrame:
    """Rows by two keys with one output column per listed value, zero where there are none."""
    present = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    return present.groupBy(row).agg(*[F.count_if(F.col(col) == F.lit(v)).alias(str(v)) for v in values])


def summary_stats(df: DataFrame, specs: dict) -> DataFrame:
    """One row of named aggregates; ``specs`` maps a name to (function, column)."""
    functions = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}
    return df.agg(*[functions[f](c).alias(name) for name, (f, c) in specs.items()])


def distribution_by_code(df: DataFrame, col, labels) -> DataFrame:
    """Rows per code in code order, with the display label; absent codes are left out."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(col, C.decode_label(col, labels).alias("label"), "n").orderBy(col)


def rate_tier(df: DataFrame, col, high, low, out="tier") -> DataFrame:
    return df.withColumn(out, C.rate_tier(col, high, low))


def correlation_with_target(df: DataFrame, features, target) -> DataFrame:
    """Pearson correlation of every feature with the target, lowest first, in one pass.

    A constant feature has no correlation (NULL) and comes last.
    """
    t = F.col(target).cast("double")

    def correlation(c):
        x = F.col(c).cast("double")
        spread = F.stddev_pop(F.when(t.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), t))
        return F.try_divide(F.covar_pop(x, t), spread)

    row = df.agg(*[correlation(c).alias(c) for c in features])
    return row.unpivot([], list(features), "feature", "correlation").orderBy(F.asc_nulls_last("correlation"), "feature")


def latest_prediction(log: DataFrame, order, key=None) -> DataFrame:
    """The newest row of the log, per key if one is given, as a partial aggregate.

    Rows without an order are left out. Of rows of the same order the greatest counts, column by column, missing values least.
    """
    rest = [c for c in log.columns if c != key]
    ranked = F.when(F.col(order).isNotNull(), F.struct(F.col(order).alias("_order"), *[F.col(c) for c in rest if c != order]))
    newest = F.max_by(F.struct(*rest), ranked).alias("_row")
    grouped = log.groupBy(*([key] if key else [])).agg(newest)
    return grouped.where(F.col("_row").isNotNull()).select(*([key] if key else []), "_row.*")


def kpi_columns():
    """Aggregates behind the live numbers; the same for a table and for a stream."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("Prediction") == "Safe").alias("safe"),
        F.count_if(F.col("Prediction") == "Failed").alias("failed"),
        F.avg("Confidence").alias("avg_confidence"),
    ]


def kpi_texts(kpis: DataFrame) -> DataFrame:
    """Adds the displayed rate (rounded half to even) and confidence; ``_`` when empty."""
    rate = F.bround(F.try_divide(F.col("safe").cast("double"), F.col("total").cast("double")) * 100, 0)
    return kpis.select(
        "total", "safe", "failed", "avg_confidence",
        F.coalesce(F.concat(rate.cast("long").cast("string"), F.lit("%")), F.lit("_")).alias("survival_rate"),
        F.coalesce(C.percent_text("avg_confidence"), F.lit("_")).alias("avg_confidence_text"),
    )


def log_kpis(log: DataFrame) -> DataFrame:
    return kpi_texts(log.agg(*kpi_columns()))


def outcome_by_industry(log: DataFrame) -> DataFrame:
    return crosstab(log, "Industry", "Prediction", OUTCOMES)
