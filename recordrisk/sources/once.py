"""A log to which a repeated job adds nothing, without reading the log to see what it holds.

An append is a folder of its own, dealt to buckets by the hash of the key. Beside it lies one Bloom filter per bucket. A new append asks
the filters of earlier ones; only folders of buckets whose filter may hold one of its keys are read and compared. An append counts
when its filters are written, so one that broke off is not there.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordrisk.sources.io import exists
from recordrisk.workspace import durable, scratch, small_or_none

BITS = 12  # of a filter per key: a key that isn't there passes about 3 times in 1,000
TESTS = 8
_HASH = F.xxhash64


def _positions(h: np.ndarray, size: int) -> np.ndarray:
    """The bits (rows, TESTS) of hashed keys in a filter of ``size`` bits, a power of two."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(TESTS, dtype=np.uint64)[None] * step[:, None]) & np.uint64(size - 1)


def bloom(h: np.ndarray) -> np.ndarray:
    """The filter of some hashed keys, as bytes."""
    size = 1 << max(6, int(len(h) * BITS - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[_positions(h, size).ravel()] = True
    return np.packbits(bits, bitorder="little")


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashed keys may be among those of the filter."""
    at = _positions(h, len(bits) * 8)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _filters(table: pa.Table) -> pa.Table:
    bits = bloom(table.column("h").to_numpy())
    return pa.table({"bucket": table.column("bucket")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})


def _asked(new: pa.Table, filters: pa.Table) -> pa.Table:
    """The appends whose filter of this bucket may hold one of the new keys."""
    found = []
    if len(new):
        h = new.column("h").to_numpy()
        found = [(b, a) for b, a, bits in zip(*(filters.column(c).to_pylist() for c in ("bucket", "append", "bits"))) if may_hold(np.frombuffer(bits, np.uint8), h).any()]
    return pa.table({"bucket": pa.array([b for b, _ in found], pa.int32()), "append": pa.array([a for _, a in found], pa.string())})


def appends(spark: SparkSession, path: str) -> list:
    """Names of the appends that are complete, in order of their names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/filters")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    inside = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().getName().split("=", 1)[1] for s in files.listStatus(place) if files.exists(inside(s.getPath(), "_SUCCESS")))


def folders_asked(df: DataFrame, path: str, key: str, buckets: int) -> list | None:
    """(append, bucket) folders of the log that may hold keys of ``df``; None for too many to name."""
    spark, names = df.sparkSession, appends(df.sparkSession, path)
    if not names:
        return []
    filters = spark.read.schema("bucket int, bits binary, append string").parquet(f"{path}/filters").where(F.col("append").isin(names))
    asked = keyed(df, key, buckets).select("bucket", "h").distinct().groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_asked, "bucket int, append string")
    rows = small_or_none(asked.distinct())
    return None if rows is None else sorted((r["append"], r["bucket"]) for r in rows)


def keyed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows with the hash of their key and its bucket; null keys have neither filter nor match."""
    h = F.when(F.col(key).isNotNull(), _HASH(F.lit(5), F.col(key)))
    return df.withColumn("h", h).withColumn("bucket", F.coalesce(F.pmod(_HASH(F.col(key)), F.lit(buckets)), F.lit(0)).cast("int"))


def append_once(df: DataFrame, path: str, name: str, key: str, buckets: int = 64) -> int:
    """Adds rows whose key the log lacks, as append ``name``, and says how many folders it read.

    A name that is complete is left as it is. Of rows of ``df`` with one key all are added. Rows with a null key are
    always added. ``buckets`` stays the same for a log; keys of one bucket of one append fit a task. Columns ``h`` and ``bucket`` are
    the log's own.
    """
    spark = df.sparkSession
    if {"h", "bucket", "append"} & set(df.columns):
        raise ValueError("columns h, bucket and append are the log's own")
    if str(name) in appends(spark, path):
        return 0
    with scratch(spark):
        rows = durable(keyed(df, key, buckets))
        asked = folders_asked(df, path, key, buckets)
        new = rows
        if asked or asked is None:
            known = _read(spark, path, df.schema, _paths(spark, path, asked)).select(key)
            new = rows.join(known, key, "left_anti").select(*rows.columns)
        new.drop("h").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/log/append={name}")
        written = _read(spark, path, df.schema, [f"{path}/log/append={name}"])
        filters = keyed(written, key, buckets).where("h IS NOT NULL").select("bucket", "h").groupBy("bucket").applyInArrow(_filters, "bucket int, bits binary")
        filters.write.mode("overwrite").parquet(f"{path}/filters/append={name}")
    return len(asked) if asked is not None else -1


def _paths(spark, path, asked):
    if asked is None:
        return [f"{path}/log/append={a}" for a in appends(spark, path)]
    wanted = [f"{path}/log/append={a}/bucket={b}" for a, b in asked]
    return [p for p in wanted if exists(spark, p)]  # a bucket without rows has none


def read_once(spark: SparkSession, path: str, schema) -> DataFrame:
    """All complete appends."""
    names = appends(spark, path)
    return _read(spark, path, schema, [f"{path}/log/append={n}" for n in names])


def _read(spark, path, schema, folders) -> DataFrame:
    """Rows of some folders of the log, without the columns that the folders' names hold."""
    empty = spark.createDataFrame([], schema)
    return spark.read.option("basePath", f"{path}/log").schema(schema).parquet(*folders).select(empty.columns) if folders else empty
