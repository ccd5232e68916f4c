"""Where windows of documents repeat, found without comparing all windows.

A window of W units (bytes or words) is known by its anchor: the least hash of the m-grams in it. Equal windows have equal
anchors, neighbours mostly share one, so a document has about 2 / (W - m + 2) anchors a unit. Only windows whose anchor
occurs in two places (the live ones) can repeat; they are cut out as segments, one for each run of windows with one anchor,
and all segments of an anchor meet in one bucket, where an operator's own method finds the repeats. Anchors in very many
places would make uneven buckets: their windows are compared by a 128-bit hash of each in Spark's aggregation instead, which
sums up hot keys before the shuffle. Copies of a whole text are settled by their digest, and one of them stands for all.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordrisk.llm.shared import _HASHES, gram_hashes, mix, pieces_for, raw, salted_join, slices, sliding_min, texts, word_hashes, words
from recordrisk.workspace import durable

# A bucket's segments fit a task many times over; an anchor whose own segments would outgrow a bucket is hot.
BUCKET_BYTES = 1 << 19
HOT_PLACES = 5000


class Units:
    """The units of a slice: a hash of each, where each document's begin, and what a segment carries."""

    def __init__(self, kind: str, data: np.ndarray, offsets: np.ndarray):
        self.kind, self.data = kind, data
        if kind == "bytes":
            self.hashes, self.begins = mix(_HASHES[0].values)[data], offsets
        else:
            self.starts, self.ends, doc = words(data, offsets)
            self.hashes = word_hashes(data, self.starts, self.ends)
            self.begins = np.searchsorted(doc, np.arange(len(offsets)))
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.begins))

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram hashes, the anchor of the window that starts at each unit, and whether that window is inside its document."""
        grams = gram_hashes(self.hashes, gram)
        least = sliding_min(grams, window - gram + 1)
        inside = self.doc[: len(least)] == self.doc[window - 1 :] if len(least) else np.zeros(0, bool)
        return grams, least, inside

    def payload(self, a: int, b: int) -> bytes:
        return (self.data if self.kind == "bytes" else self.hashes)[a:b].tobytes()

    def second(self) -> np.ndarray:
        """Hashes independent of the first ones."""
        if self.kind == "bytes":
            return mix(_HASHES[1].values)[self.data]
        return word_hashes(self.data, self.starts, self.ends, 1)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key each (the same for repeated rows) and two hashes of the text."""
    rows = texts(docs)
    return rows.select("doc_id", "text", F.xxhash64(F.lit(1), "doc_id", "text").alias("key"), F.xxhash64(F.lit(2), "text").alias("t1"), F.xxhash64(F.lit(3), "text").alias("t2"))


def _anchor_rows(kind: str, window: int, gram: int, within: bool):
    def work(batches):
        for batch in batches:
            for first, _, data, offsets in slices(*raw(batch.column("text"))):
                units = Units(kind, data, offsets)
                grams, least, inside = units.anchors(window, gram)
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (units.doc[1 : len(least)] != units.doc[: len(least) - 1])
                at = np.flatnonzero(new & inside | inside & ~np.append(False, inside[:-1]))
                doc, value, often = units.doc[at], least[at], np.zeros(len(at), bool)
                if within and len(at):
                    # grams that are the least of some window: an anchor in two places of one document is live
                    wide = window - gram + 1
                    hidden = np.where(inside, least, 0)
                    padded = np.concatenate([np.zeros(wide - 1, np.uint64), hidden, np.zeros(wide - 1, np.uint64)])
                    most = ~sliding_min(~padded, wide)
                    chosen = np.flatnonzero(most == grams)
                    doc, value = units.doc[chosen], grams[chosen]
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                lead = np.ones(len(doc), bool)
                lead[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
                begin = np.flatnonzero(lead)
                count = np.diff(np.append(begin, len(doc)))
                pick = pa.array(doc[begin] + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pick), batch.column("t1").take(pick), pa.array(value[begin].view(np.int64)), pa.array(count > 1 if within else np.zeros(len(begin), bool))],
                    ["key", "t1", "anchor", "twice"])

    return work


def _segments(kind: str, window: int, gram: int):
    def work(batches):
        for batch in batches:
            keys, order = np.asarray(batch.column("key")), np.asarray(batch.column("rank"))
            cold, hot = batch.column("cold"), batch.column("hot")
            for first, end, data, offsets in slices(*raw(batch.column("text"))):
                units = Units(kind, data, offsets)
                _, least, inside = units.anchors(window, gram)
                rows = {name: [] for name in ("key", "rank", "anchor", "start", "units", "h1", "h2")}
                hot_rows = [[], [], [], [], []]
                h1 = h2 = None
                for i in range(first, end):
                    a, b = units.begins[i - first], units.begins[i - first + 1] - window + 1
                    if b <= a:
                        continue
                    own = least[a:b]
                    if cold[i].is_valid and len(cold[i]):
                        live = np.isin(own, np.asarray(cold[i].values).view(np.uint64))
                        change = np.ones(len(own), bool)
                        change[1:] = own[1:] != own[:-1]
                        begin = np.flatnonzero(change)
                        stop = np.append(begin[1:], len(own))
                        for s, e in zip(begin[live[begin]].tolist(), stop[live[begin]].tolist()):
                            rows["key"].append(keys[i])
                            rows["rank"].append(order[i])
                            rows["anchor"].append(own[s].view(np.int64))
                            rows["start"].append(s)
                            rows["units"].append(units.payload(a + s, a + e + window - 1))
                    if hot[i].is_valid and len(hot[i]):
                        if h1 is None:
                            h1, h2 = gram_hashes(units.hashes, window), gram_hashes(units.second(), window, 1)
                        s = np.flatnonzero(np.isin(own, np.asarray(hot[i].values).view(np.uint64)))
                        for column, x in zip(hot_rows, (np.full(len(s), keys[i]), np.full(len(s), order[i]), s, h1[a + s].view(np.int64), h2[a + s].view(np.int64))):
                            column.append(x)
                n = len(rows["key"])
                join = [np.concatenate([np.array(c, np.int64), *x]) for c, x in zip((rows["key"], rows["rank"], rows["start"]), hot_rows[:3])]
                m = len(join[0]) - n
                none = lambda k: pa.nulls(k, pa.int64())
                both = [pa.concat_arrays([none(n), pa.array(np.concatenate(x or [np.zeros(0, np.int64)]), pa.int64())]) for x in hot_rows[3:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(join[0]), pa.array(join[1]), pa.array(join[2]), pa.concat_arrays([pa.array(rows["anchor"], pa.int64()), none(m)]),
                     pa.concat_arrays([pa.array(rows["units"], pa.binary()), pa.nulls(m, pa.binary())]), *both],
                    ["key", "rank", "start", "anchor", "units", "h1", "h2"])

    return work


SEGMENT = "key long, rank long, start long, anchor long, units binary, h1 long, h2 long"


def repeated_windows(rows: DataFrame, kind: str, window: int, gram: int, find, hot_rule, within: bool) -> DataFrame:
    """(key, marks): for every row of ``keyed`` rows that stands for its text, which windows repeat.

    ``find(table) -> (row numbers, first windows, end windows)`` is run on each bucket's segments; ``hot_rule(hashed)`` marks windows known by hash
    (columns h1, h2, key, rank, start). ``within``: places of one document count too. ``marks`` is a list of
    structs (first, end) of window starts.
    """
    anchors = rows.select("key", "t1", "text").mapInArrow(_anchor_rows(kind, window, gram, within), "key long, t1 long, anchor long, twice boolean")
    anchors = durable(anchors)
    live = anchors.groupBy("anchor").agg(F.min("t1").alias("a"), F.max("t1").alias("b"), F.max("twice").alias("twice"), F.count(F.lit(1)).alias("places"))
    live = live.where("a <> b OR twice").select("anchor", (F.col("places") > HOT_PLACES).alias("hot"))
    marked = salted_join(anchors.select("key", "anchor"), live, ["anchor"], "key")
    marked = marked.groupBy("key").agg(F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    heads = rows.groupBy("t1", "t2").agg(F.min(F.struct("rank", "key")).alias("h")).select(F.col("h.key").alias("key")).distinct()
    once = rows.join(marked.join(heads, "key"), "key").select("key", "rank", "text", "cold", "hot")
    segments = durable(once.mapInArrow(_segments(kind, window, gram), SEGMENT))
    size = segments.where("units IS NOT NULL").agg(F.sum(F.octet_length("units"))).first()[0] or 0
    n = pieces_for(size, BUCKET_BYTES)

    def bucket(table: pa.Table) -> pa.Table:
        row, first, end = find(table)
        return pa.table({"key": table.column("key").take(pa.array(row, pa.int64())), "first": pa.array(first, pa.int64()), "end": pa.array(end, pa.int64())})

    def each(table: pa.Table) -> pa.Table:
        return bucket(table.combine_chunks())

    each.__annotations__ = {"table": pa.Table, "return": pa.Table}
    cold = segments.where("units IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(n))).groupBy("bucket").applyInArrow(each, "key long, first long, end long")
    hot = hot_rule(segments.where("units IS NULL").select("key", "rank", "start", "h1", "h2")).select("key", F.col("start").alias("first"), (F.col("start") + 1).alias("end"))
    return cold.unionAll(hot).groupBy("key").agg(F.collect_list(F.struct("first", "end")).alias("marks"))


def covered(marks, n: int, window: int) -> np.ndarray:
    """Which of ``n`` units lie in a marked window."""
    out = np.zeros(n + 1, np.int64)
    if marks:
        first, end = np.array([m["first"] for m in marks]), np.array([m["end"] for m in marks])
        np.add.at(out, first, 1)
        np.add.at(out, np.minimum(end + window - 1, n), -1)
    return np.cumsum(out[:-1]) > 0
