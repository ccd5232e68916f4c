"""Exact deduplication by sorting contents.

Rows are range-partitioned by splitters that Spark samples from a short key of the text (its first bytes, a digest, the
id), sorted inside their range by an external sort, and compared whole with their neighbour. The key keeps the sample
small however long texts are; the id in it lets a text that fills a third of the table spread over many ranges.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from recordrisk.llm.shared import input_bytes, pieces_for, texts
from recordrisk.workspace import durable, lookup

PREFIX_CHARS = 8


def _runs(keep_largest: bool):
    """Finds the runs of equal texts in a sorted partition, a batch at a time.

    Only the ids of the run at hand are held back. ``open`` marks the first and last run, which may go on in a
    neighbouring partition.
    """
    def work(batches):
        from pyspark import TaskContext

        part, run, tail, held = TaskContext.get().partitionId(), 0, None, []

        def rows(chunks, number, is_open):
            ids = np.concatenate([c[0] for c in chunks])
            null = np.concatenate([c[1] for c in chunks])
            known = ids[~null]
            best = None if not len(known) else int(known.max() if keep_largest else known.min())
            n = len(ids)
            sha = chunks[0][2]
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64(), mask=null), pa.array([sha] * n, pa.string()), pa.array(np.full(n, part, np.int32)),
                pa.array(np.full(n, number, np.int64)), pa.array(np.full(n, is_open)), pa.array(np.arange(n) == 0),
                pa.array([best] * n, pa.int64()), pa.array(np.full(n, n, np.int64))], _NAMES)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text, sha, id_column = batch.column("text"), batch.column("sha"), batch.column("doc_id")
            null = np.asarray(id_column.is_null())
            ids = np.asarray(pc.fill_null(id_column, 0))
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = np.asarray(pc.not_equal(text.slice(1), text.slice(0, n - 1)))
            if tail is not None and text[0].as_py() == tail:
                new[0] = False
            tail = text[n - 1].as_py()
            starts = np.flatnonzero(new)
            stop = starts[0] if len(starts) else n
            if stop:
                held.append((ids[:stop], null[:stop], held[0][2] if held else sha[0].as_py()))
            if not len(starts):
                continue
            if held:
                yield rows(held, run, run == 0)
                run += 1
            # the runs that end in this batch, all at once
            ends = starts[1:]
            whole = int(ends[-1]) if len(ends) else int(starts[0])
            if len(ends):
                lo = int(starts[0])
                body, gone = ids[lo:whole], null[lo:whole]
                at = starts[:-1] - lo
                sizes = ends - starts[:-1]
                worst = np.iinfo(np.int64).min if keep_largest else np.iinfo(np.int64).max
                best = (np.maximum if keep_largest else np.minimum).reduceat(np.where(gone, worst, body), at)
                all_null = np.logical_and.reduceat(gone, at)
                numbers = run + np.arange(len(at))
                first = np.zeros(whole - lo, bool)
                first[at] = True
                yield pa.RecordBatch.from_arrays([
                    pa.array(body, pa.int64(), mask=gone), sha.slice(lo, whole - lo), pa.array(np.full(whole - lo, part, np.int32)),
                    pa.array(np.repeat(numbers, sizes)), pa.array(np.repeat(numbers == 0, sizes)), pa.array(first),
                    pa.array(np.repeat(best, sizes), pa.int64(), mask=np.repeat(all_null, sizes)), pa.array(np.repeat(sizes, sizes))], _NAMES)
                run += len(at)
            held = [(ids[whole:], null[whole:], sha[whole].as_py())]
        if held:
            yield rows(held, run, True)

    return work


_NAMES = ["doc_id", "text_sha256", "part", "run", "open", "first", "best", "size"]
_OUT = "doc_id long, text_sha256 string, part int, run long, open boolean, first boolean, best long, size long"


def exact_groups(docs: DataFrame, keep: str = "largest", normalise=None, target_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every input row.

    Rows are equal when their whole normalised texts are (``normalise``: a function of a Column; none by default).
    Null texts count as empty. The row with the largest (or ``keep="smallest"``) doc_id stays; rows whose id is null
    stay only if all ids of their group are, and of rows repeated under one id all say ``kept``, so a caller who needs one
    row drops repeated rows. An empty table gives an empty one. Other columns are left behind.
    """
    base = texts(docs)
    if normalise is not None:
        base = base.withColumn("text", normalise(F.col("text")))
    keyed = base.select("doc_id", "text", F.sha2("text", 256).alias("sha"), F.substring("text", 1, PREFIX_CHARS).alias("_prefix"), F.xxhash64("text").alias("_digest"))
    n = pieces_for(input_bytes(base), target_bytes, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.repartitionByRange(n, "_prefix", "_digest", "doc_id")
    dealt = dealt.sortWithinPartitions("_prefix", "_digest", "text", F.col("doc_id").desc())
    found = durable(dealt.select("doc_id", "text", "sha").mapInArrow(_runs(keep == "largest"), _OUT))
    best = F.max if keep == "largest" else F.min
    # two runs a partition at most are open: one row each
    edges = found.where("open AND first").groupBy("text_sha256").agg(best("best").alias("_best"), F.sum("size").alias("_size"))
    return (
        lookup(found, edges, "text_sha256")
        .withColumn("open", F.col("open") & F.col("_size").isNotNull())
        .withColumn("keep_id", F.when(F.col("open"), F.col("_best")).otherwise(F.col("best")))
        .withColumn("group_size", F.when(F.col("open"), F.col("_size")).otherwise(F.col("size")))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
