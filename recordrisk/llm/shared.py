"""What the operators share: how documents are read, and how texts become numpy arrays inside tasks.

Texts reach Python as Arrow batches. A batch is looked at as one array of UTF-8 bytes with the offsets of its
documents, cut into slices of a few megabytes, so that no step makes a Python object per word.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordrisk.workspace import small_or_none

SLICE_BYTES = 3 << 19
# ASCII white space separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row; a null text counts as empty. Other columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col="doc_id", text_col="text") -> Column:
    """Key of a (doc_id, text) row, of 64 bits; repeated rows have the same one."""
    return F.xxhash64(F.lit(7), id_col, text_col)


def input_bytes(df: DataFrame) -> int:
    """Bytes of all texts: decides numbers of partitions, never results."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def pieces_for(n_bytes: float, each: float, least: int = 1) -> int:
    return max(least, int(-(-n_bytes // each)))


# ---- inside tasks -------------------------------------------------------------------------------------------


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary array, without a copy where its offsets allow."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        raise TypeError(f"a string or binary column is needed, not {column.type}")
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(data: np.ndarray, offsets: np.ndarray, budget: int = SLICE_BYTES):
    """(first document, end, their bytes, their offsets), each slice of about ``budget`` bytes or one document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + budget, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; words end at document borders. ``letters`` tells which bytes make words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = letters[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class _Hash:
    """Values of bytes and powers of an odd base, all modulo 2**64, from a fixed seed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.base = self.values[:1] * np.uint64(4) + np.uint64(5)
        self.inverse = np.array([pow(int(self.base[0]), -1, 1 << 64)], np.uint64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def reach(self, n: int):
        if len(self.powers) < n:
            n = max(n, SLICE_BYTES + 4096)
            self.powers, self.inverses = (np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.repeat(b, n - 1))) for b in (self.base, self.inverse))


_HASHES = [_Hash(s) for s in (11, 12)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every word's bytes; ``which`` picks one of two independent functions."""
    out, own, first = np.zeros(len(starts), np.uint64), _HASHES[which], 0
    while first < len(starts):  # a long document goes in parts
        end = max(first + 1, int(np.searchsorted(starts, starts[first] + SLICE_BYTES)))
        lo, hi = int(starts[first]), int(ends[end - 1])
        own.reach(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(own.values[data[lo:hi]] * own.powers[: hi - lo], out=sums[1:])
        s = starts[first:end] - lo
        out[first:end] = (sums[ends[first:end] - lo] - sums[s]) * own.inverses[s]
        first = end
    return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive hashes (len(h) - k + 1 of them), by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = _HASHES[which].base
    done, total, out = 0, len(h) - k + 1, np.zeros(len(h) - k + 1, np.uint64)
    power, size, scale = h, 1, base
    while True:
        if k & size:
            out = out * scale + power[done : done + total]
            done += size
        size *= 2
        if size > k:
            return mix(out)
        half = size // 2
        power = power[:-half] * scale + power[half:]
        scale = scale * scale


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours (len(h) - w + 1 values), in three passes."""
    n = len(h)
    if n < w:
        return np.zeros(0, h.dtype)
    full = np.full(-(-n // w) * w, np.iinfo(h.dtype).max, h.dtype)
    full[:n] = h
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def inverse_of(square: np.ndarray) -> np.ndarray | None:
    """The inverse by row elimination with pivots, None where there is none.

    Element by element, without the threaded linear algebra that can hang in a driver that Spark has forked.
    """
    n = len(square)
    both = np.concatenate([np.asarray(square, float), np.eye(n)], axis=1)
    for i in range(n):
        at = i + int(np.abs(both[i:, i]).argmax())
        if abs(both[at, i]) < 1e-12:
            return None
        both[[i, at]] = both[[at, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        some = np.flatnonzero(factor)
        both[some] -= factor[some, None] * both[i]
    return both[:, n:]


# ---- joins ----------------------------------------------------------------------------------------------------

SALTS = 32


def salted_join(rows: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Joins ``small`` (one narrow row a key) to ``rows``, of which one key may have a third.

    The rows of a key go to ``salts`` tasks by the hash of column ``spread``; every row of ``small`` is sent to each.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


HOT_ROWS = 10_000


def hot_join(rows: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """The same join, but only keys of more than ``HOT_ROWS`` rows are salted, so that ``small`` is sent once elsewhere.

    ``rows`` is a stored table: its keys are counted first. If the hot keys are too many to be sent to every task, all are salted.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select(*on)
    found = small_or_none(counts)
    if found is None:
        return salted_join(rows, small, on, spread, how, salts)
    if not found:
        return rows.join(small, on, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, counts.schema).withColumn("_hot", F.lit(True)))  # its size was checked
    left = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0)).drop("_hot")
    each = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = small.join(hot, on, "left").withColumn("_salt", F.explode(each)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
