"""Summaries of a growing table that are kept per append and merged, instead of reading the table again.

Quantiles come from KLL sketches, within a bound on the rank. Frequent values come from summaries with counted error:
they name candidates, which are counted exactly. Where the error leaves open whether another value belongs to the
answer, all values are counted.
"""

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordrisk.operators.profile import top_k_values
from recordrisk.sources.io import exists
from recordrisk.workspace import lookup

QUANTILE_K = 800
TRACKED = 10_000


def rank_error(k: int = QUANTILE_K) -> float:
    """Bound on the error of a rank, as a share of all rows, that a KLL sketch keeps in 99 of 100 cases."""
    return 2.296 / k**0.9723


def count_error(tracked: int, n: int) -> float:
    """Bound on what a summary of ``n`` rows leaves out of the count of a value."""
    return 3.5 * n / 2 ** math.ceil(math.log2(tracked / 0.75))


def append_summary(df: DataFrame, path: str, batch, quantiles=(), frequent=(), k: int = QUANTILE_K, tracked: int = TRACKED) -> None:
    """Adds the sketches of the rows of one append, named ``batch``, to the summary at ``path``.

    A repeated batch replaces its own. Missing values are not counted. All appends take the same columns.
    """
    parts = [F.expr(f"kll_sketch_agg_double(CAST(`{c}` AS DOUBLE), {k})").alias(f"q_{c}") for c in quantiles]
    parts += [F.expr(f"approx_top_k_accumulate(`{c}`, {tracked}) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"t_{c}") for c in frequent]
    parts += [F.count(c).alias(f"n_{c}") for c in dict.fromkeys([*quantiles, *frequent])]
    df.agg(*parts).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def merged_quantile(spark: SparkSession, path: str, col: str, shares) -> DataFrame:
    """q, n, value: quantiles of all appends, within ``rank_error`` of their rank; no rows where there are no values."""
    if not exists(spark, path):
        return spark.createDataFrame([], "q double, n long, value double")
    one = spark.read.parquet(path).where(F.col(f"n_{col}") > 0).agg(F.expr(f"kll_merge_agg_double(`q_{col}`)").alias("s"), F.sum(f"n_{col}").alias("n")).where("n > 0")
    asked = [F.struct(F.lit(float(q)).alias("q"), F.col("n"), F.expr(f"kll_sketch_get_quantile_double(s, {float(q)!r}D)").alias("value")) for q in shares]
    return one.select(F.inline(F.array(*asked)))


def frequent_values(df: DataFrame, path: str, col: str, top: int, tracked: int = TRACKED) -> DataFrame:
    """The ``top`` values of ``df`` with their exact counts, ties by value, as ``top_k_values`` has them.

    The merged summary at ``path``, of the same rows, names the candidates; only they are counted. A value that it leaves out
    has at most twice ``count_error`` rows, so the answer stands if the last candidate has more; else all values are counted.
    """
    spark = df.sparkSession
    merged = spark.read.parquet(path).agg(F.expr(f"approx_top_k_combine(`t_{col}`, {tracked})").alias("s"), F.sum(f"n_{col}").alias("n"))
    names = merged.select("n", F.explode(F.expr(f"approx_top_k_estimate(s, {tracked})")).alias("e")).select("n", F.col("e.item").alias(col))
    total = merged.first()["n"]
    counted = lookup(df.where(F.col(col).isNotNull()), names.select(col), col, "inner")
    best = top_k_values(counted, col, top).collect()
    if len(best) == top and best[-1]["n"] > 2 * count_error(tracked, total):
        return spark.createDataFrame(best, top_k_values(df, col, top).schema)
    return top_k_values(df, col, top)
