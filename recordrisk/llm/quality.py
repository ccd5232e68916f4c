"""Quality of texts by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is compressed with each, in
blocks small enough for the dictionary to matter; the difference of the sizes over the larger of them says which
kind it resembles, and a logistic curve fitted on labelled texts that made no dictionary turns it into a score.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordrisk.llm.shared import inverse_of, raw, texts

BLOCK = 2048
LEVEL = 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple  # of the features

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x * np.array(self.weights)).sum(axis=1), -30, 30)))


def _compressor(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False)
    made = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_dict_id=False)


def compressed(bodies, good: bytes, bad: bytes) -> np.ndarray:
    """Compressed sizes of whole texts with the good and with the bad dictionary, and their own sizes."""
    a, b = _compressor(good), _compressor(bad)
    out = np.zeros((len(bodies), 3))
    for i, body in enumerate(bodies):
        x = y = 0
        for at in range(0, len(body), BLOCK):
            block = body[at : at + BLOCK]
            x += len(a.compress(block))
            y += len(b.compress(block))
        out[i] = x, y, len(body)
    return out


def features(sizes: np.ndarray) -> np.ndarray:
    """The normalised difference, the same by length, and how far either dictionary shrinks the text at all.

    The last tells a text that repeats itself, whose difference is next to nothing.
    """
    good, bad, own = sizes.T
    difference = (bad - good) / np.maximum(np.maximum(good, bad), 1)
    rate = np.log((np.minimum(good, bad) + 1) / (own + 1))
    return np.column_stack([np.ones(len(own)), 10 * difference, difference * np.log1p(own), np.where(own > 0, rate, 0), np.where(own > 0, rate * rate, 0)])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
        gradient = (x * (weight * (y - p))[:, None]).sum(axis=0) - (penalty * w).sum(axis=1)
        curve = x * (weight * p * (1 - p))[:, None]
        hessian = np.array([(curve * column[:, None]).sum(axis=0) for column in x.T]) + penalty + 1e-9 * np.eye(len(w))
        inverse = inverse_of(hessian)
        if inverse is None:
            break
        step = (inverse * gradient).sum(axis=1)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def in_fold(id_col="doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether the row is held out: crc32 of the id as text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit_quality(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1500, text_bytes: int = 32_768, dictionary_bytes: int = 65_536) -> QualityModel:
    """Learns from a bounded sample of labelled rows that aren't held out.

    At most ``rows_per_class`` labelled rows of each class are taken, those of the least hash, and of these only texts of
    at most ``text_bytes``, so the driver gets at most 2 * rows_per_class * text_bytes bytes. Ids with contradicting
    or null labels teach nothing. Two thirds of the sample build dictionaries, the rest the curve; its rows are weighted
    so that classes count as in all labels. Without both classes the score is the share of good labels (or 0.5).
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~in_fold())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_other")).where("quality = _other")
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for kind in (0, 1):
        some = known.where(F.col("quality") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class).select("doc_id", "quality")
        picked = some if picked is None else picked.unionAll(some)
    rows = texts(docs).where(F.octet_length("text") <= text_bytes).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    rows = sorted((r["doc_id"], r["quality"], r["text"].encode()) for r in rows.collect())
    build, curve = [], []
    for row in rows:
        (curve if zlib.crc32(f"split {row[0]}".encode()) % 3 == 0 else build).append(row)
    good, bad = (_dictionary([t for _, q, t in build if q == kind], dictionary_bytes) for kind in (1, 0))
    n = sum(totals.values())
    if not all(any(q == k for _, q, _ in curve) for k in (0, 1)):
        share = (totals.get(1, 0) + 1) / (n + 2)
        return QualityModel(good, bad, (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0, 0.0))
    body = [t for _, _, t in curve]
    y = np.array([q for _, q, _ in curve], float)
    x = features(compressed(body, good, bad))
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    return QualityModel(good, bad, fit_logistic(x, y, weight * len(y) / weight.sum()))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of few samples the texts themselves."""
    import zstandard

    blocks = [s[at : at + BLOCK] for s in samples for at in range(0, len(s), BLOCK)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, blocks)) // 8)), blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-size:]


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row from its whole text alone; null counts as empty, and empty texts get a score too.

    Repeated rows and null ids are scored as they come; an empty table gives an empty one.
    """
    def work(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            body = memoryview(data)
            each = [body[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            score = model.score(features(compressed(each, model.good, model.bad)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return texts(docs).mapInArrow(work, "doc_id long, score double")
