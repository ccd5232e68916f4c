"""Ranks and running totals over a whole table without a one-task sort."""

from pyspark.sql import DataFrame, Window as W, functions as F

from recordrisk.functions.columns import HASH_BITS, hash60
from recordrisk.workspace import durable

BUCKET_BITS = 16
_PLACE_BITS = 33


def running_totals(df: DataFrame, order, totals: dict) -> DataFrame:
    """Running sums in global order: ``totals`` maps output name to input column.

    The table is range-sorted, which balances the tasks whatever the distribution, and
    written durably with each row's place in it. A task then sums its own range; the sums
    of the earlier ranges (one row per task of the sort) are added.
    """
    placed = durable(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", _PLACE_BITS))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_base_{n}") for n, c in totals.items()])
    bases = bases.select("_part", *[
        F.coalesce(F.sum(f"_base_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in totals])
    inside = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.join(F.broadcast(bases), "_part")  # one row per partition of the sort
        .select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"_base_{n}")).alias(n)
                               for n, c in totals.items()])
    )


def class_index(df: DataFrame, key, label, seed, out="idx") -> DataFrame:
    """Zero-based position of each row within its class, in hash order of the key.

    A row's bucket is the leading bits of its hash, so buckets are even within a class
    however uneven the classes are, and follow the hash order. Rows are counted per
    (class, bucket), the counts are summed up bucket by bucket, and only the few rows that
    share a bucket are sorted.
    """
    hashed = df.withColumn("_hash", hash60(seed, F.col(key)))
    hashed = hashed.withColumn("_bucket", F.shiftright("_hash", HASH_BITS - BUCKET_BITS).cast("int"))
    earlier = W.partitionBy(label).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select(label, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = W.partitionBy(label, "_bucket").orderBy("_hash", key)
    return (
        hashed.join(bases, [label, "_bucket"])
        .withColumn(out, F.col("_base") + F.row_number().over(inside) - 1)
        .drop("_hash", "_bucket", "_base")
    )


def counter_rows(df: DataFrame, count_col, out="j", chunk=100_000) -> DataFrame:
    """Each row repeated ``count_col`` times with a counter from 0.

    The numbers are generated in chunks spread over the cluster, so one row with a huge
    count does not become one task.
    """
    n = F.col(count_col)
    chunks = (
        df.where(n > 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("long"))))
        .repartition("_chunk")
    )
    first = F.col("_chunk") * chunk
    last = F.least(n, first + chunk) - 1
    return chunks.withColumn(out, F.explode(F.sequence(first.cast("long"), last.cast("long")))).drop("_chunk")
