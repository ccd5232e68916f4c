"""Live tables that a batch changes only where its keys lie, and state of any kind per key.

A table is dealt to parts. A batch brings the new rows of some keys; the parts they lie in are written again, in a folder of
the batch, and a small pointer file says last which batch holds each part now. So readers find a whole table, a crash leaves the
last one in place, and a repeated batch writes the same again. The pointer may also hold sums per part, so that a
number over the whole table follows from the parts that changed.
"""

import contextlib

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor

from recordrisk.sources.io import load_document, save_document
from recordrisk.streaming.streams import published, start
from recordrisk.workspace import remove

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in the store that state of any kind needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _Latest(StatefulProcessor):
    """Keeps the row of the highest order of its key; of equal ones the greatest, column by column, missing values least."""

    def __init__(self, key: str, schema: str, names: list):
        self.key, self.schema, self.names = key, schema, names

    def init(self, handle) -> None:
        self.kept = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        before = self.kept.get()
        best = before = None if before is None else tuple(before)
        for row in rows:
            mine = tuple(row[n] for n in self.names)
            if best is None or _rank(mine) > _rank(best):
                best = mine
        if best != before:
            self.kept.update(best)
            yield Row(**dict(zip([self.key, *self.names], [key[0], *best])))

    def close(self) -> None:
        pass


def _rank(values):
    return tuple((v is not None, 0 if v is None else v) for v in values)


def live_latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row per key, whatever order rows arrive in; to be written in update mode, inside ``state_store``.

    Rows without an order are left out. The tie rule is that of ``latest_prediction``.
    """
    rest = [order, *[c for c in log.columns if c not in (key, order)]]
    types = dict(log.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in rest)
    processor = _Latest(key, fields, rest)
    found = log.where(F.col(order).isNotNull()).groupBy(key).transformWithState(processor, f"`{key}` {types[key]}, {fields}", "Update", "None")
    return found.select(log.columns)


def hash_part(keys, parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def range_part(score: str, parts: int) -> Column:
    """Parts in the order of a score from 0 to 1."""
    return F.least(F.greatest(F.floor(F.col(score) * parts), F.lit(0)), F.lit(parts - 1)).cast("int")


def merge_published(live: DataFrame, path: str, keys, checkpoint: str, parts: int = 16, part: Column = None, summary=None, once: bool = False):
    """Keeps the table at ``path`` equal to ``live``, of which each batch holds the rows that changed (update mode).

    ``part`` tells a row's part, 0 to ``parts`` - 1, from its keys; by default their hash. ``summary`` makes one row per part,
    with its number as ``part``, from rows that have it; those rows stand in the pointer. Keys may be null.
    """
    spark, keys = live.sparkSession, list(keys)
    place = hash_part(keys, parts) if part is None else part

    def merge(batch, number):
        changed = batch.withColumn("part", place).persist()
        try:
            touched = sorted(r["part"] for r in changed.select("part").distinct().collect())  # parts of them at most
            earlier = [n for n in published(spark, path) if n < number]
            state = load_document(spark, f"{path}/done/{earlier[-1]:020d}") if earlier else {"versions": {}, "sums": {}}
            old = _rows(spark, path, state, live.schema, touched).withColumn("part", place)
            same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
            kept = old.alias("old").join(changed.alias("new"), same, "left_anti")
            merged = kept.unionByName(changed).repartition("part", F.pmod(F.xxhash64(*keys), F.lit(8)))
            merged.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")
            versions = state["versions"] | {str(p): number for p in touched}
            state = {"versions": versions, "sums": state["sums"]}
            if summary and touched:
                now = _rows(spark, path, state, live.schema, touched).withColumn("part", place)
                state["sums"] = state["sums"] | {str(r["part"]): {k: str(v) for k, v in r.asDict().items() if k != "part"} for r in summary(now).collect()}
            save_document(spark, state, f"{path}/done/{number:020d}")
            _clean(spark, path)
        finally:
            changed.unpersist()

    return start(live.writeStream.outputMode("update").foreachBatch(merge), checkpoint, once)


def _rows(spark, path, state, schema, only=None) -> DataFrame:
    wanted = [f"{path}/batch={n}/part={p}" for p, n in sorted(state["versions"].items()) if only is None or int(p) in only]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def _clean(spark, path):
    """Removes pointers but the last two, and the parts that these two don't name."""
    done = published(spark, path)
    named = {f"batch={n}/part={p}" for d in done[-2:] for p, n in load_document(spark, f"{path}/done/{d:020d}")["versions"].items()}
    for old in done[:-2]:
        for p, n in load_document(spark, f"{path}/done/{old:020d}")["versions"].items():
            if f"batch={n}/part={p}" not in named:
                remove(spark, f"{path}/batch={n}/part={p}")
        remove(spark, f"{path}/done/{old:020d}")


def merged_state(spark: SparkSession, path: str) -> dict:
    """The last pointer: which batch holds each part, and the sums per part."""
    done = published(spark, path)
    return load_document(spark, f"{path}/done/{done[-1]:020d}") if done else {"versions": {}, "sums": {}}


def read_merged(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table after the last complete batch; empty before the first."""
    return _rows(spark, path, merged_state(spark, path), schema)


# ---- evaluation of a stream of scores ---------------------------------------------------------------------------------


def live_score_counts(scored: DataFrame, label="label", score="score") -> DataFrame:
    """Positives and negatives per score."""
    return scored.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """Per part: positives, negatives, and twice the pairs within it that the positive wins, ties counting half."""
    above = F.coalesce(F.sum("pos").over(W.partitionBy("part").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = "decimal(19,0)"
    return counts.withColumn("above", above).groupBy("part").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("neg").cast(whole) * (2 * F.col("above") + F.col("pos")).cast(whole)).alias("won"))


def publish_scores(scored: DataFrame, path: str, checkpoint: str, parts: int = 64, label="label", score="score", once: bool = False):
    """Keeps counts per score, from 0 to 1, at ``path``, and what ``live_auc`` needs."""
    return merge_published(live_score_counts(scored, label, score), path, ["score"], checkpoint, parts, range_part("score", parts), pair_counts, once)


def live_auc(spark: SparkSession, path: str):
    """Exact area under the ROC curve of all scores so far, from the sums of the parts; None if a class is absent."""
    won = positives = negatives = 0
    for _, sums in sorted(((int(p), s) for p, s in merged_state(spark, path)["sums"].items()), reverse=True):
        won += int(sums["won"]) + 2 * int(sums["neg"]) * positives
        positives, negatives = positives + int(sums["pos"]), negatives + int(sums["neg"])
    return won / (2.0 * positives * negatives) if positives and negatives else None
