"""Packing of tokenised documents into sequences, as a cutting-stock problem.

Documents are cut into full sequences and one rest. Rests are counted per length class (``width`` tokens wide); that
histogram, bounded by the capacity and not by the data, is all the driver sees. A linear program over patterns (how many
rests of each class share a sequence) is solved by column generation, where a knapsack over the dual prices finds each
new pattern. The rounded-down counts of the patterns cover all rests but a bounded remainder, which first-fit decreasing
places. Every rest then finds its sequence from its rank in its class, by arithmetic in Spark.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from recordrisk.llm.shared import inverse_of, texts
from recordrisk.llm.tokenizer import encoded
from recordrisk.workspace import durable

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, class int, place long"
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable filling of one sequence (unbounded knapsack), and its count of each size."""
    price = np.full(capacity + 1, -np.inf)
    price[sizes] = prices
    index = np.zeros(capacity + 1, np.int64)
    index[sizes] = np.arange(len(sizes))
    value, choice = np.zeros(capacity + 1), [0] * (capacity + 1)
    for c in range(1, capacity + 1):
        worth = price[1 : c + 1] + value[c - 1 :: -1]  # a size first, then the best filling of the rest
        k = int(worth.argmax())
        value[c] = value[c - 1]
        if worth[k] > value[c] + 1e-12:
            value[c], choice[c] = worth[k], k + 1
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c]:
            counts[index[choice[c]]] += 1
        c -= choice[c] or 1
    return float(value[capacity]), counts


def cutting_stock(sizes, demand, capacity: int, tolerance: float = 1e-3, rounds: int = 20_000):
    """Patterns and how often to use each, real numbers that meet the demand exactly.

    Ends when the number of sequences is within ``tolerance`` of a lower bound: all tokens over the capacity, or the
    one that the price of the best pattern gives.
    """
    sizes, demand = np.asarray(sizes), np.asarray(demand, float)
    patterns = np.diag(capacity // sizes).astype(float)  # a column is a pattern
    inverse, used = np.diag(1 / np.diag(patterns)), demand / np.diag(patterns)
    least = (sizes * demand).sum() / capacity
    prices = inverse.sum(axis=0)
    for step in range(rounds):
        if used.sum() <= least * (1 + tolerance):
            break
        value, column = best_pattern(prices, sizes, capacity)
        if value <= 1 + tolerance:
            break
        some = np.flatnonzero(column)
        change = (inverse[:, some] * column[some]).sum(axis=1)
        able = change > 1e-9
        ratio = np.full(len(used), np.inf)
        ratio[able] = np.maximum(used[able], 0) / change[able]
        out = int(ratio.argmin())
        amount = ratio[out]
        used = used - amount * change
        used[out] = amount
        patterns[:, out] = column
        row = inverse[out] / change[out]
        inverse -= change[:, None] * row
        inverse[out] = row
        prices = prices - (value - 1) * row
        if step % 256 == 255:
            fresh = inverse_of(patterns)
            if fresh is not None:  # else the running one stays
                inverse, used, prices = fresh, (fresh * demand).sum(axis=1), fresh.sum(axis=0)
    return patterns, np.maximum(used, 0)


def first_fit(sizes, counts, capacity: int) -> list[dict[int, int]]:
    """First-fit decreasing of a bounded remainder: a count by class index for each sequence."""
    room, bins = [], []
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        for _ in range(int(counts[i])):
            fits = np.flatnonzero(np.array(room) >= sizes[i]) if room else []
            at = int(fits[0]) if len(fits) else len(room)
            if at == len(room):
                room.append(capacity)
                bins.append({})
            room[at] -= sizes[i]
            bins[at][int(i)] = bins[at].get(int(i), 0) + 1
    return bins


def plan(sizes, demand, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, how many of the class in each sequence).

    Ranges of a class follow each other without gaps from 0 to its demand.
    """
    if not len(sizes):
        return []
    sizes, left = np.asarray(sizes), np.asarray(demand, np.int64).copy()
    patterns, used = cutting_stock(sizes, left, capacity)
    chosen = []
    for p in range(patterns.shape[1]):
        need = patterns[:, p].astype(np.int64)
        times = min([int(np.floor(used[p] + 1e-6)), *(left[need > 0] // need[need > 0]).tolist()])
        if times > 0:
            left -= times * need
            chosen.append((times, {int(i): int(need[i]) for i in np.flatnonzero(need)}))
    chosen += [(1, b) for b in first_fit(sizes, left, capacity)]
    at, sequence, out = dict.fromkeys(range(len(sizes)), 0), 0, []
    for times, pattern in chosen:
        for i, n in pattern.items():
            out.append((int(sizes[i]), at[i], at[i] + n * times, sequence, n))
            at[i] += n * times
        sequence += times
    return out


def _cut(tokenizer: str, capacity: int, width: int, end_id: int, with_ids: bool):
    def work(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(-(-capacity // width) + 1, np.int64)
        for batch in batches:
            for first, ids, begins in encoded(tokenizer, batch.column("text")):
                n = len(begins) - 1
                ids = np.insert(ids, begins[1:], end_id).astype("<u4")
                begins = begins + np.arange(n + 1)
                total = np.diff(begins)
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(n), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, total[doc] - start)
                lo = begins[doc] + start
                body = memoryview(ids.tobytes())
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist())]
                kind = -(-length // width)
                order = np.argsort(kind, kind="stable")
                sorted_kind = kind[order]
                group = np.searchsorted(sorted_kind, sorted_kind, "left")
                place = np.empty(len(kind), np.int64)
                place[order] = np.arange(len(kind)) - group
                place += seen[kind]
                seen += np.bincount(kind, minlength=len(seen))
                columns = [batch.column("doc_id").slice(first, n).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                           pa.array(total[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(kind.astype(np.int32)), pa.array(place)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "class", "place"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.append(lo, lo[-1] + length[-1] if len(lo) else 0).astype(np.int32), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return work


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, width: int = 8, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its ids and one ``end_id``; null and empty texts are that id alone. Each id lies in one piece, pieces of
    a sequence follow each other from offset 0 without gaps, and no sequence is longer than ``capacity``. Rows with null
    or repeated ids are documents of their own. An empty table gives an empty one; other columns are left behind.
    ``with_ids`` carries the ids themselves along as an array.
    """
    spark = docs.sparkSession
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    pieces = durable(texts(docs).mapInArrow(_cut(tokenizer, capacity, width, end_id, with_ids), schema))
    counts = pieces.groupBy("part", "class").agg(F.count(F.lit(1)).alias("_n"))
    demand = sorted((r["class"], r["n"]) for r in counts.groupBy("class").agg(F.sum("_n").alias("n")).collect())
    slots = plan([d[0] for d in demand], [d[1] for d in demand], capacity // width)
    slots = spark.createDataFrame(slots, "class int, low long, high long, first_sequence long, each long")
    earlier = W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("part", "class", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    ranked = pieces.join(bases, ["part", "class"]).withColumn("_rank", F.col("_base") + F.col("place"))
    # the plan is bounded by the number of classes and patterns (capacity / width), whatever the data
    placed = ranked.join(F.broadcast(slots), (ranked["class"] == slots["class"]) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.expr("first_sequence + (_rank - low) div each"))
    before = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), "_rank").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select(*RESULT, *(["ids"] if with_ids else []))
