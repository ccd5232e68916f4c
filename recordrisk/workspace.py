"""Where jobs put durable intermediate data, and how small results are recognised."""

import contextlib
import contextvars
import os
import tempfile
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession, functions as F

# Largest result that is moved to the driver and sent to every executor: rows, and bytes of their texts.
SMALL_ROWS = 20_000
SMALL_BYTES = 8 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder the cluster names, or below that of the enclosing ``scratch``.

    Only a local session may fall back to a temporary folder of the machine.
    """
    base = _SCRATCH.get() or _shared_base(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _shared_base(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="recordrisk-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


# The innermost folder; each thread has its own, and those of ``concurrently`` start with that of the caller.
_SCRATCH: contextvars.ContextVar = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Owner of the durable tables made inside: they are removed at its end, also after an error.

    What is returned from it must not depend on them: write it elsewhere, or take values.
    """
    folder = f"{_shared_base(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    before = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(before)
        remove(spark, folder)


def concurrently(spark: SparkSession, calls, at_once: int = 4) -> list:
    """Results of the calls in their order, up to ``at_once`` running at a time, each in a scheduler pool of its own.

    Jobs of different calls share the cluster. If one fails, the others end first and its error is raised.
    """
    from pyspark import inheritable_thread_target

    def pooled(number, call):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"part-{number}")
        try:
            return call()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        waiting = [pool.submit(contextvars.copy_context().run, inheritable_thread_target(spark)(pooled), n, call) for n, call in enumerate(calls)]
        wait(waiting)
    return [w.result() for w in waiting]


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame, folder: str = None) -> DataFrame:
    """The rows written once as a table in the shared folder, and read from there.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and values that
    depend on row placement (partition numbers) stay what they were. Later passes read only
    the columns they need, and Catalyst knows the size. The table stays until the enclosing ``scratch`` ends; ``folder``
    puts it elsewhere.
    """
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}" if folder else shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_none(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES):
    """The rows as a local list if they are few and short enough, else None.

    Both bounds hold before anything is collected: the sizes of at most ``max_rows + 1`` rows are summed up first.
    """
    sizes = [F.octet_length(F.col(f"`{n}`").cast("string")) if t == "string" else F.lit(16) for n, t in df.dtypes]
    n, size = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)), F.sum(sum((F.coalesce(c, F.lit(0)).cast("long") for c in sizes), F.lit(0)))).first()
    return df.collect() if n <= max_rows and (size or 0) <= max_bytes else None


def lookup(df: DataFrame, table: DataFrame, on, how="left", max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """Join a lookup table, broadcasting it only if its counted rows and bytes allow.

    A larger table is joined by shuffle; adaptive execution splits hot keys there.
    """
    rows = small_or_none(table, max_rows, max_bytes)
    if rows is None:
        return df.join(table, on, how)
    local = df.sparkSession.createDataFrame(rows, table.schema)
    return df.join(F.broadcast(local), on, how)


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers of a session that was started without it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="recordrisk-"), "recordrisk.zip")  # only the driver reads it
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("recordrisk", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()
