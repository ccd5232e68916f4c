"""Token counts through a digest cache.

A count belongs to the digest of a text and the version of the tokenizer. Texts whose pair is in the cache are never
encoded again; of the others, every distinct one is encoded once, and its count joins the cache.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordrisk.llm.shared import hot_join, texts
from recordrisk.llm.tokenizer import encoded, version_of
from recordrisk.workspace import durable

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def _exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def cached_counts(spark, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) kept for one version, one row a digest even if two jobs wrote it."""
    if not _exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    kept = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    return kept.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    ``tokenizer`` is the path of a vocabulary file that every executor has; ``cache`` is a folder that all of them
    reach, made if missing. Null texts count as empty (0 tokens); null and repeated ids are kept as they are; an empty
    table gives an empty one. Texts are counted whole, without added begin or end tokens; special strings in a text
    are handled as the library does by default. A job that is repeated or loses executors finds finished counts in
    the cache, because Spark's writer shows only the files of finished tasks.
    """
    spark, version = docs.sparkSession, version_of(tokenizer)
    base = texts(docs).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    unknown = base.select("digest", "text")
    if _exists(spark, cache):
        unknown = unknown.join(cached_counts(spark, cache, version), "digest", "left_anti")
    # copies meet on the map side first, so a text that fills a third of the table is sent once per task
    unknown = unknown.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches):
        for batch in batches:
            counts = [np.diff(begins) for _, _, begins in encoded(tokenizer, batch.column(1))]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    unknown.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    # copies of one text may be a third of the rows: such are salted, so they reach their count in many tasks
    rows = durable(base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    return (
        hot_join(rows, cached_counts(spark, cache, version), ["digest"], "doc_id", "left")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
