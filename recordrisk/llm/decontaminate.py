"""Benchmark passages in documents, by the q-gram lemma.

A passage of m characters that occurs with at most k edits shares at least m - q + 1 - k q of its q-grams with the
document, on diagonals (place in the document less place in the passage) that lie within k of each other. Shared q-grams
are counted in overlapping bands of diagonals; a band that reaches the bound becomes a region, and the region is verified
by aligning the passage with it, edits counted exactly. Short passages count without an edit only; those of fewer than q
characters are looked up by a hash of the whole and compared.

The passages are a stated query set: they go to the tasks in blocks of bounded size, a pass over the documents each.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordrisk.llm.shared import gram_hashes, mix, raw, runs, slices, texts

Q = 10
EDITS = 0.08  # of a passage's characters; 1 - q * EDITS must stay positive
SHORTEST = 30  # characters from which a passage may be edited
BLOCK_CHARS = 2_000_000
_TABLE_BITS = 22
DIAGONALS = 1 << 20  # shared diagonals looked at together, about
_BMP = 0x10000


def _lower() -> np.ndarray:
    """Lower case of the characters for which it is one character; white space becomes a space."""
    out = np.arange(_BMP, dtype=np.uint32)
    for c in range(_BMP):
        s = chr(c)
        if s.isspace():
            out[c] = 0x20
        elif len(t := s.lower()) == 1:
            out[c] = ord(t)
    return out


_LOWER = None


def normalised(data: np.ndarray, offsets: np.ndarray):
    """Characters in lower case with single spaces: (characters, offsets, place of each in its original text)."""
    global _LOWER
    if _LOWER is None:
        _LOWER = _lower()
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    except UnicodeDecodeError:
        each = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
        points = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32)
        at = np.cumsum([0, *map(len, each)])
    low = _LOWER[np.minimum(points, _BMP - 1)]
    if len(points) and points.max() >= _BMP:
        low = np.where(points < _BMP, low, points)
    space = low == 0x20
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    first = at[:-1][at[:-1] < len(low)]
    keep[first] = ~space[first]
    kept = np.flatnonzero(keep)
    begins = np.searchsorted(kept, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(begins))
    return low[kept], begins, kept - at[doc]


class Passages:
    """Index of a block of passages: their q-grams, and for each passage its bound."""

    def __init__(self, ids, passages, q: int, edits: float, shortest: int = 0):
        body = [p.encode() for p in passages]
        chars, begins, _ = normalised(np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)]))
        ends = begins[1:].copy()
        for i, (a, b) in enumerate(zip(begins[:-1], ends)):  # a space at the end isn't part of the passage
            ends[i] = b - (b > a and chars[b - 1] == 0x20)
        self.ids, self.q, self.edits = list(ids), q, edits
        self.items = [chars[a:b] for a, b in zip(begins[:-1], ends)]
        size = np.array([len(x) for x in self.items], np.int64)
        self.size, self.budget = size, np.where(size < shortest, 0, np.floor(edits * size)).astype(np.int64)
        self.bound = np.maximum(size - q + 1 - self.budget * q, 1)
        grams = [gram_hashes(mix(x.astype(np.uint64)), q) for x in self.items]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
        flat = np.concatenate(grams or [np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        flat, item, place = flat[order], item[order], place[order]
        # places of a q-gram that follow each other, as in a line of one character, are one run
        begin = _run_starts(flat, item, place)
        self.item, self.place, self.length = item[begin], place[begin], np.diff(np.append(begin, len(flat)))
        self.grams, first = np.unique(flat[begin], return_index=True)
        self.first = np.append(first, len(begin))
        self.tiny: dict[int, dict[int, list[int]]] = {}  # by size, then by hash
        for i in np.flatnonzero((size > 0) & (size < q)).tolist():
            whole = int(gram_hashes(mix(self.items[i].astype(np.uint64)), int(size[i]))[0])
            self.tiny.setdefault(int(size[i]), {}).setdefault(whole, []).append(i)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, passage, start, end, edits) of every region that holds, in characters of the original text."""
        chars, begins, origin = normalised(data, offsets)
        mixed = mix(chars.astype(np.uint64))
        return self._short(chars, mixed, begins, origin) + self._long(chars, mixed, begins, origin)

    def _short(self, chars, mixed, begins, origin):
        """Places of passages of fewer than q characters; of places that overlap the first."""
        found = []
        for size, wanted in self.tiny.items():
            h = gram_hashes(mixed, size)
            at = np.flatnonzero(np.isin(h, np.array(list(wanted), np.uint64)))
            doc = np.searchsorted(begins, at, "right") - 1
            inside = at + size <= begins[doc + 1]
            free: dict[tuple[int, int], int] = {}
            for p, d in zip(at[inside].tolist(), doc[inside].tolist()):
                for i in wanted[int(h[p])]:
                    if p >= free.get((d, i), 0) and np.array_equal(chars[p : p + size], self.items[i]):
                        free[d, i] = p + size
                        found.append((d, i, int(origin[p]), int(origin[p + size - 1]) + 1, 0))
        return found

    def _long(self, chars, mixed, begins, origin):
        h = gram_hashes(mixed, self.q)
        if not len(h) or not len(self.grams):
            return []
        maybe = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, h[maybe]), len(self.grams) - 1)
        real = self.grams[at] == h[maybe]
        pos, at = maybe[real], at[real]
        doc = np.searchsorted(begins, pos, "right") - 1
        inside = pos + self.q <= begins[doc + 1]
        pos, at, doc = pos[inside], at[inside], doc[inside]
        begin = _run_starts(doc, at, pos)
        length = np.diff(np.append(begin, len(pos)))
        doc, item, band = self._bands(pos[begin], length, at[begin], doc[begin], len(chars))
        # neighbouring bands of a document and passage are one region
        joined = np.ones(len(doc), bool)
        joined[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] > band[:-1] + 2)
        found, starts = [], np.flatnonzero(joined)
        for a, b in zip(starts, np.append(starts[1:], len(doc))):
            d, i, k = int(doc[a]), int(item[a]), int(self.budget[item[a]])
            low, high = int(band[a]) * (k + 1) - k, (int(band[b - 1]) + 2) * (k + 1) + k
            lo, hi = max(low, int(begins[d])), min(high + int(self.size[i]), int(begins[d + 1]))
            for start, end, edits in aligned(self.items[i], chars[lo:hi], k):
                found.append((d, i, int(origin[lo + start]), int(origin[lo + end - 1]) + 1, edits))
        return found


    def _bands(self, pos, length, at, doc, n_chars):
        """(document, passage, band of diagonals), in order, of all that reach their bound.

        A run of n places of a q-gram in a document and one of m in a passage share at most n + m - 1 diagonals, counted
        together. Diagonals are made a few at a time and summed up per band, so that memory follows the bands.
        """
        runs_of = self.first[at + 1] - self.first[at]
        lengths = np.concatenate(([0], np.cumsum(self.length)))
        steps = np.cumsum(lengths[self.first[at + 1]] - lengths[self.first[at]] + runs_of * (length - 1))  # diagonals up to each run
        low, n_bands = int(self.size.max()) + 1, n_chars + 2 * int(self.size.max()) + 4
        keys, counts, waiting, lo = [], [], 0, 0
        while lo < len(pos):
            hi = max(lo + 1, int(np.searchsorted(steps, (steps[lo - 1] if lo else 0) + DIAGONALS, "right")))
            n = runs_of[lo:hi]
            one = np.repeat(np.arange(lo, hi), n)
            two = np.repeat(self.first[at[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a, b = length[one], self.length[two]
            wide = a + b - 1
            pair = np.repeat(np.arange(len(one)), wide)
            step = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            times = np.minimum.reduce([step + 1, wide[pair] - step, a[pair], b[pair]])
            item = self.item[two][pair]
            band = (pos[one] - self.place[two] - b + 1)[pair] + step
            band = band // (self.budget[item] + 1) + low
            key = (doc[one][pair] * len(self.items) + item) * n_bands + band
            found = _summed(np.concatenate([key, key - 1]), np.concatenate([times, times]))
            keys.append(found[0])
            counts.append(found[1])
            waiting += len(found[0])
            if waiting > 4 * DIAGONALS:
                keys, counts = ([x] for x in _summed(np.concatenate(keys), np.concatenate(counts)))
                waiting = len(keys[0])
            lo = hi
        if not keys:
            return (np.zeros(0, np.int64),) * 3
        key, count = _summed(np.concatenate(keys), np.concatenate(counts))
        item = key // n_bands % len(self.items)
        key, item = key[count >= self.bound[item]], item[count >= self.bound[item]]
        return key // n_bands // len(self.items), item, key % n_bands - low


def _run_starts(*columns: np.ndarray) -> np.ndarray:
    """First places of runs in which the last column rises by one and the others stay the same."""
    *same, rising = columns
    new = np.ones(len(rising), bool)
    new[1:] = rising[1:] != rising[:-1] + 1
    for c in same:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count[order], first) if len(first) else count[:0]


def aligned(item: np.ndarray, region: np.ndarray, budget: int) -> list[tuple[int, int, int]]:
    """Places (start, end, edits) where the passage lies in the region with at most ``budget`` edits, best of each run.

    The table of edit distances goes row by row over the passage; within a row, insertions are a running minimum. Places that
    overlap are one match, the one with the fewest edits.
    """
    m, n = len(item), len(region)
    step = np.arange(n + 1)
    cost, source = np.zeros(n + 1, np.int64), step.copy()
    for c in range(m):
        keep = cost[:-1] + (region != item[c])
        drop = cost + 1
        new, src = drop.copy(), source.copy()
        better = keep <= drop[1:]
        new[1:][better], src[1:][better] = keep[better], source[:-1][better]
        run = np.minimum.accumulate(new - step) + step
        back = np.maximum.accumulate(np.where(new - step == run - step, step, 0))
        cost, source = run, src[back]
    ok = cost <= budget
    out = []
    for a, b in zip(*runs(ok)):
        end = a + int(cost[a:b].argmin())
        out.append((int(source[end]), int(end), int(cost[end])))
    best = []
    for start, end, edits in out:
        if end <= start:
            continue
        if best and start < best[-1][1]:
            if edits < best[-1][2]:
                best[-1] = (start, end, edits)
        else:
            best.append((start, end, edits))
    return best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, q: int, edits: float, shortest: int):
    """Passages in blocks of bounded size, read one at a time."""
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).distinct()
    ids, passages, size = [], [], 0
    for item, passage in rows.orderBy(id_col, text_col).toLocalIterator():
        if not passage.split():
            continue
        if ids and size + len(passage) > BLOCK_CHARS:
            yield Passages(ids, passages, q, edits, shortest)
            ids, passages, size = [], [], 0
        ids.append(item)
        passages.append(passage)
        size += len(passage)
    if ids:
        yield Passages(ids, passages, q, edits, shortest)


def _hits(index: Passages, column):
    for first, _, data, offsets in slices(*raw(column)):
        for d, i, start, end, edits in index.find(data, offsets):
            yield first + d, i, start, end, edits


HIT_SCHEMA = "doc_id long, item_id long, start long, end long, edits long"


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", q: int = Q, edits: float = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, start, end, edits): where documents hold passages of a benchmark, in characters of their text.

    Texts are compared in lower case with runs of white space as one space. A passage counts if it occurs whole, with at most
    ``edits`` of its characters edited; overlapping places of one passage are reported once, the best. Passages under
    ``shortest`` characters must occur without an edit; blank and null ones are left out. Null texts count as empty; repeated rows are
    reported each; empty tables give an empty one; other columns are left behind.
    """
    spark, found = docs.sparkSession, None
    for index in _blocks(benchmark, id_col, text_col, q, edits, shortest):
        shared = spark.sparkContext.broadcast(index)

        def work(batches, shared=shared):
            for batch in batches:
                rows = list(_hits(shared.value, batch.column("text")))
                row, item, *rest = (list(x) for x in zip(*rows)) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array([shared.value.ids[i] for i in item], pa.int64()), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "start", "end", "edits"])

        part = texts(docs).mapInArrow(work, HIT_SCHEMA)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else spark.createDataFrame([], HIT_SCHEMA)


def without_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of the benchmark (see ``find_passages``)."""
    spark = docs.sparkSession
    settings = {"id_col": "item_id", "text_col": "text", "q": Q, "edits": EDITS, "shortest": SHORTEST} | options
    for index in _blocks(benchmark, **settings):
        shared = spark.sparkContext.broadcast(index)

        def work(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in _hits(shared.value, batch.column(batch.schema.get_field_index(text_col)))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
