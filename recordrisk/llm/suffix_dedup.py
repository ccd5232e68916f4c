"""Removal of byte strings that occur twice, by expanding intervals of a Burrows-Wheeler transform.

In a bucket of segments (see ``repeats``) suffixes are sorted by their first ``least`` bytes. Intervals of suffixes that
share a prefix are extended backwards, one byte in front at a time, breadth first, so boundaries between suffixes with a
common prefix of 7, 8, 9, ... bytes are found in this order. At the minimum length the search stops: boundaries that are
still open divide suffixes that share at least that many bytes, and only those are wanted.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordrisk.llm.repeats import covered, keyed, repeated_windows
from recordrisk.llm.shared import raw, runs, salted_join
from recordrisk.workspace import durable

WORD = 7  # symbols of 9 bits in a 64-bit integer


def sorted_suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols, and the rank of every suffix by its first WORD ones."""
    n = len(symbols)
    packed = np.zeros(n, np.int64)
    wide = np.concatenate([symbols.astype(np.int64), np.zeros(depth, np.int64)])
    for i in range(WORD):
        packed = packed << 9 | wide[i : n + i]
    ranks, size = np.unique(packed, return_inverse=True)[1], WORD
    first = ranks
    while size < depth:
        step = min(size, depth - size)
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = ranks[step:] + 1 if n > step else 0
        ranks = np.unique(ranks * (n + 1) + ahead, return_inverse=True)[1]
        size += step
    return np.argsort(ranks, kind="stable").astype(np.int32), first


def long_prefixes(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each entry whether it shares at least ``least`` symbols with the entry before.

    Symbol 0 ends a segment; entries whose first ``least`` symbols hold one mean nothing.
    """
    n = len(symbols)
    order, first = sorted_suffixes(symbols, least)
    transform = symbols[order - 1]  # the symbol in front; the one before the first suffix is the last, a 0
    # the place of the suffix one symbol longer: stable sort of the transform
    longer = np.empty(n, np.int32)
    longer[np.argsort(transform.astype(np.int16), kind="stable")] = np.arange(n, dtype=np.int32)
    closed = np.zeros(n + 1, bool)
    closed[0] = closed[n] = True
    ranked = first[order]
    closed[1:n] = ranked[1:] != ranked[:-1]
    low = np.flatnonzero(closed[:-1])
    high = np.append(low[1:], n)
    for _ in range(WORD, least):
        if not len(low):
            break
        size = high - low
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(low)), size)
        front = transform[at]
        real = front > 0
        at, owner, front = longer[at[real]], owner[real], front[real]
        by_place = np.argsort(at, kind="stable")
        at, owner, front = at[by_place], owner[by_place], front[by_place]
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (front[1:] != front[:-1])
        begin = at[new]
        end = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + 1 if len(at) else at
        fresh = ~closed[end]
        closed[end[fresh]] = True
        low, high = begin[fresh], end[fresh]
    return order, ~closed[:-1]


def duplicated_starts(segments: list[bytes], least: int) -> list[np.ndarray]:
    """For each segment which of its windows of ``least`` bytes occur in another place of any segment."""
    distinct: dict[bytes, int] = {}
    of = [distinct.setdefault(s, len(distinct)) for s in segments]
    often = np.bincount(of, minlength=len(distinct)) > 1
    body = list(distinct)
    sizes = np.array([len(s) + 1 for s in body], np.int64)
    symbols = np.zeros(int(sizes.sum()), np.int16)
    at = np.cumsum(sizes) - sizes
    for s, a in zip(body, at.tolist()):
        symbols[a : a + len(s)] = np.frombuffer(s, np.uint8).astype(np.int16) + 1
    marked = np.zeros(len(symbols), bool)
    if len(body) > 1 or any(len(s) > least for s in body):
        order, same = long_prefixes(symbols, least)
        hit = np.flatnonzero(same)
        marked[order[hit]] = True
        marked[order[hit - 1]] = True
    out = []
    for d in of:
        windows = max(len(body[d]) - least + 1, 0)
        out.append(np.ones(windows, bool) if often[d] else marked[at[d] : at[d] + windows])
    return out


def _find(least: int):
    def find(table: pa.Table):
        segments = table.column("units").to_pylist()
        start = np.asarray(table.column("start"))
        row, first, end = [], [], []
        for i, flags in enumerate(duplicated_starts(segments, least)):
            for a, b in zip(*runs(flags)):
                row.append(i)
                first.append(int(start[i] + a))
                end.append(int(start[i] + b))
        return row, first, end

    return find


def _hot(hashed: DataFrame) -> DataFrame:
    twice = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return salted_join(hashed, twice, ["h1", "h2"], "start", salts=8)


def _strip(least: int, with_text: bool):
    def work(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            copies, marks = batch.column("copies"), batch.column("marks")
            rows = []
            for i in range(batch.num_rows):
                body = data[offsets[i] : offsets[i + 1]]
                gone = np.full(len(body), len(body) >= least) if copies[i].as_py() else covered(marks[i].as_py(), len(body), least)
                left = body[~gone].tobytes()
                rows.append((len(body), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(left).hexdigest(), left))
            n, removed, spans, sha, left = (list(x) for x in zip(*rows)) if rows else ([],) * 5
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(left, pa.binary())] if with_text else []), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return work


def remove_repeated_bytes(docs: DataFrame, least: int = 200, gram: int = 50, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes ``kept`` if asked for) of every input row.

    Each byte covered by a string of ``least`` bytes that also starts anywhere else, in the same or another text, goes; strings
    are judged on the input and never cross rows. Null texts count as empty. Repeated rows are documents of their own,
    copies of each other whatever their ids, nulls too. An empty table gives an empty one; other columns are left behind.
    """
    rows = keyed(docs).withColumn("rank", F.coalesce("doc_id", F.lit(2**63 - 1)))
    groups = rows.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    found = repeated_windows(rows, "bytes", least, gram, _find(least), _hot, within=True)
    known = salted_join(rows.select("key", "t1", "t2"), groups, ["t1", "t2"], "key").groupBy("key").agg((F.max("n") > 1).alias("copies"))
    known = durable(known.join(found, "key", "left"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return rows.join(known, "key").select("doc_id", "text", "copies", "marks").mapInArrow(_strip(least, with_text), schema)
