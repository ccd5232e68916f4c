"""Removal of word sequences that an earlier document has, by fixed-block anchors.

Segments of documents that may repeat meet in buckets (see ``repeats``). There, the non-overlapping blocks of half a
window of every document are indexed with the least document that has them; a window always holds one whole block of
any document it also occurs in. Every rolling half-window probes the index, and where it hits a block of an earlier
document, the windows around the hit are extended: those whose whole sequence an earlier document has are marked.
Marked windows that follow each other are the maximal exact repeats.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordrisk.llm.repeats import covered, keyed, repeated_windows
from recordrisk.llm.shared import gram_hashes, raw, runs, salted_join, words
from recordrisk.workspace import durable


def earlier_windows(segments: list[np.ndarray], start: np.ndarray, rank: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment (word hashes from word ``start`` of document ``rank``) which windows a smaller document has."""
    half = window // 2
    sizes = np.array([len(s) for s in segments], np.int64)
    flat = np.concatenate(segments) if segments else np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(segments)), sizes)
    place = np.arange(len(flat)) - begin[owner] + start[owner]
    probes = gram_hashes(flat, half)
    inside = owner[: len(probes)] == owner[half - 1 :] if len(probes) else np.zeros(0, bool)
    # the index: blocks at multiples of half a window, with the least document of each
    block = np.flatnonzero(inside & (place[: len(probes)] % half == 0))
    if not len(block):
        return [np.zeros(max(n - window + 1, 0), bool) for n in sizes]
    keys, back = np.unique(probes[block], return_inverse=True)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, back, rank[owner[block]])
    # probes: every rolling half-window
    at = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
    hit = inside & (keys[at] == probes)
    later = hit & (least[at] < rank[owner[: len(probes)]])
    # a block that a later document hits is extended on both sides
    most = np.full(len(keys), -1, np.int64)
    np.maximum.at(most, at[hit], rank[owner[: len(probes)][hit]])
    asked = later.copy()
    asked[block] |= most[back] > rank[owner[block]]
    # extension: the windows that hold an asked half-window, compared whole
    full = gram_hashes(flat, window)
    whole = owner[: len(full)] == owner[window - 1 :] if len(full) else np.zeros(0, bool)
    sums = np.concatenate(([0], np.cumsum(asked)))
    reach = window - half + 1
    holds = sums[np.minimum(np.arange(len(full)) + reach, len(asked))] - sums[: len(full)] > 0
    some = np.flatnonzero(whole & holds)
    found, group = np.unique(full[some], return_inverse=True)
    first = np.full(len(found), np.iinfo(np.int64).max)
    np.minimum.at(first, group, rank[owner[some]])
    marked = np.zeros(len(flat) + 1, bool)
    marked[some[first[group] < rank[owner[some]]]] = True
    return [marked[b : b + max(n - window + 1, 0)] for b, n in zip(begin, sizes)]


def _find(window: int):
    def find(table: pa.Table):
        segments = [np.frombuffer(x, np.uint64) for x in table.column("units").to_pylist()]
        start, rank = np.asarray(table.column("start")), np.asarray(table.column("rank"))
        row, first, end = [], [], []
        for i, flags in enumerate(earlier_windows(segments, start, rank, window)):
            for a, b in zip(*runs(flags)):
                row.append(i)
                first.append(int(start[i] + a))
                end.append(int(start[i] + b))
        return row, first, end

    return find


def _hot(hashed: DataFrame) -> DataFrame:
    firsts = hashed.groupBy("h1", "h2").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).where("least < most").drop("most")
    return salted_join(hashed, firsts, ["h1", "h2"], "start", salts=8).where("least < rank")


def _strip(window: int, with_text: bool):
    def work(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            copies, marks = batch.column("copy"), batch.column("marks")
            starts, ends, doc = words(data, offsets)
            begin = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            body, rows = data.tobytes(), []
            for i in range(batch.num_rows):
                a, n = int(begin[i]), int(begin[i + 1] - begin[i])
                gone = np.full(n, n >= window) if copies[i].as_py() else covered(marks[i].as_py(), n, window)
                kept = np.flatnonzero(~gone) + a
                left = b" ".join([body[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())])
                rows.append((n, int(gone.sum()), hashlib.sha256(left).hexdigest(), left))
            n, removed, sha, left = (list(x) for x in zip(*rows)) if rows else ([],) * 4
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(left, pa.binary()).cast(pa.string())] if with_text else []), ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return work


def remove_repeated_words(docs: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, and the text ``kept`` if asked for) of every input row.

    Words are runs of characters other than ASCII white space. A word goes if a window of ``window`` words (an even number) that covers it also
    starts in a row with a smaller doc_id; windows are judged on the input and stay inside rows. Kept words are joined by
    single spaces. Null texts have no words. Rows repeated under one id don't empty each other; a null id counts as larger
    than all others. An empty table gives an empty one; other columns are left behind.
    """
    rows = keyed(docs).withColumn("rank", F.coalesce("doc_id", F.lit(2**63 - 1)))
    groups = rows.groupBy("t1", "t2").agg(F.min("rank").alias("least"))
    found = repeated_windows(rows, "words", window, window // 2, _find(window), _hot, within=False)
    known = salted_join(rows.select("key", "rank", "t1", "t2"), groups, ["t1", "t2"], "key").groupBy("key").agg((F.max("least") < F.max("rank")).alias("copy"))
    known = durable(known.join(found, "key", "left"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return rows.join(known, "key").select("doc_id", "text", "copy", "marks").mapInArrow(_strip(window, with_text), schema)
