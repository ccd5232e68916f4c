"""A corpus from raw documents: quality, exact and near copies, benchmark passages, packing.

Each stage reads what its predecessor kept; all but the last return documents with their columns. The last returns the
pieces of documents in sequences. Stages decide by row: where ids are missing or repeat, a stage gives its rows a number that
the operators carry, so such rows are judged one by one, too.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordrisk.llm.decontaminate import without_passages
from recordrisk.llm.exact_dedup import exact_groups
from recordrisk.llm.near_dedup import near_classes
from recordrisk.llm.packing import pack
from recordrisk.llm.quality import fit_quality, score_quality
from recordrisk.llm.queries import vocabulary
from recordrisk.llm.shared import table
from recordrisk.workspace import durable, scratch, ship_package, shared_folder

LEAST_QUALITY = 0.3


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, and the column that tells them apart: their id if each has its own, else a number they are written with."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("doc_id IS NULL OR _n > 1").isEmpty():
        return docs, "doc_id"
    name = "_row"
    while name in docs.columns:
        name += "_"
    return durable(docs.withColumn(name, F.monotonically_increasing_id())), name


def _texts(rows: DataFrame, number: str) -> DataFrame:
    """What an operator sees: the number in place of the id, and the text."""
    return rows.select(F.col(number).alias("doc_id"), "text")


def _only(rows: DataFrame, number: str, kept: DataFrame) -> DataFrame:
    """Rows whose number is among the doc_ids of ``kept``."""
    left = rows.join(kept.select(F.col("doc_id").alias(number)), number, "left_semi")
    return left if number == "doc_id" else left.drop(number)


def _one_each(rows: DataFrame, number: str, groups: DataFrame, group: str, first) -> DataFrame:
    """The row of each group that comes ``first`` by id, then by number: groups hold (doc_id, group) by number."""
    if number == "doc_id":
        return _only(rows, number, groups.where("kept"))
    ids = rows.select(F.col("doc_id").alias("_id"), F.col(number).alias("doc_id"))
    best = groups.select("doc_id", group).join(ids, "doc_id").groupBy(group).agg(first.alias("_best"))
    return _only(rows, number, best.select(F.col("_best.doc_id").alias("doc_id")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learnt from the labelled ones among them, rejects."""
    ship_package(spark)
    rows, number = _numbered(docs)
    scored = score_quality(_texts(rows, number), fit_quality(docs, table(spark, sf_dir, "labels")))
    return _only(rows, number, scored.where(F.col("score") >= LEAST_QUALITY))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps one row, that of the largest doc_id; rows without an id stay only where all lack one."""
    ship_package(spark)
    rows, number = _numbered(docs)
    return _one_each(rows, number, exact_groups(_texts(rows, number), keep="largest"), "keep_id", F.max(F.struct("_id", "doc_id")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every class of near copies, that of the least doc_id; rows without an id come last."""
    ship_package(spark)
    rows, number = _numbered(docs)
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "doc_id"))
    return _one_each(rows, number, near_classes(_texts(rows, number)), "class_id", first)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    ship_package(spark)
    return without_passages(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2,048 tokens."""
    ship_package(spark)
    return pack(docs, vocabulary(), capacity=2048)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

# SQL has neither the classifier nor the signatures, alignments and linear programs; tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again; what a stage writes besides is removed at its end."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
