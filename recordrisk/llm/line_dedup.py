"""Removal of lines that an earlier document has in the same order, by pairwise alignment.

Documents overlap if they share a line, or, where every earlier holder counts, a shortest run of lines that has enough
characters to go: no block that goes is without one around each of its lines. A rare one links all its holders; a frequent
one links each holder with the first, so links grow with the lines and not with the square of a group. Every linked pair is
aligned by patience diff on line hashes: lines that are unique in both are matched along the longest common order, and
matches grow over the lines around them. Aligned common blocks go from the later document. Holders whose frequent run is
left are then tried with its next holders, and who is left after that with all earlier ones, in blocks, until its lines are gone
or no holder is left. Of rows with the same lines only the first takes part; the others' lines go.
"""

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from recordrisk.llm.repeats import keyed
from recordrisk.llm.shared import _HASHES, mix, raw, salted_join
from recordrisk.workspace import durable

RARE = 6  # holders of a line that are all linked with each other
BLOCK_ROWS = 512
FIRST = 64  # holders of a frequent run that all meet before the others
_OTHER = 2  # stands for lines that the later document lacks; hashes of lines are odd or 0


def line_hash(line: bytes) -> int:
    """Hash of a line without the white space around it; 0 for a blank one."""
    line = line.strip()
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True) | 1 if line else 0


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned common blocks (place in a, place in b, length) of two lists of line hashes; blank lines match nothing alone."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        n = 0
        while a0 + n < a1 and b0 + n < b1 and a[a0 + n] == b[b0 + n]:
            n += 1
        if n:
            found.append((a0, b0, n))
            a0, b0 = a0 + n, b0 + n
        n = 0
        while a1 - n > a0 and b1 - n > b0 and a[a1 - n - 1] == b[b1 - n - 1]:
            n += 1
        if n:
            found.append((a1 - n, b1 - n, n))
            a1, b1 = a1 - n, b1 - n
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = _once(a, a0, a1), _once(b, b0, b1)
        both = [(in_a[x], at) for x, at in in_b.items() if x in in_a]  # in order of b
        chain = _longest(both)
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        found.extend((i, j, 1) for i, j in chain)
        if chain:
            todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m)
    found.sort()
    blocks: list[list[int]] = []
    for i, j, n in found:
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += n
        else:
            blocks.append([i, j, n])
    return [(i, j, n) for i, j, n in blocks if any(a[i : i + n])]


def _once(lines, lo, hi):
    seen, twice = {}, set()
    for i in range(lo, hi):
        if lines[i] in seen or lines[i] == 0:
            twice.add(lines[i])
        seen[lines[i]] = i
    return {x: i for x, i in seen.items() if x not in twice}


def _longest(pairs):
    """Longest chain that rises in both places, of pairs in order of the second."""
    tops, ends, before = [], [], []
    for k, (i, _) in enumerate(pairs):
        at = bisect.bisect_left(tops, i)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(i)
            ends.append(k)
        else:
            tops[at], ends[at] = i, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _runs(lines: np.ndarray, chars: np.ndarray, begins: np.ndarray, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, end and hash of the shortest runs of lines with ``least_chars`` characters around each line.

    A run around a line is shortest if it can't lose its first or last line without losing the characters or that line. Runs end
    at document borders. So every common block with enough characters has, around each of its lines, a run that both texts have.
    """
    n = len(lines)
    weight, need = (chars, least_chars) if least_chars > 0 else ((lines != 0).astype(np.int64), 1)
    lo, hi = (np.repeat(x, np.diff(begins)) for x in (begins[:-1], begins[1:]))
    total = np.concatenate(([0], np.cumsum(weight)))
    ahead = np.maximum.accumulate(np.where(weight > 0, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    before = np.concatenate(([-1], ahead[:-1]))  # the last line with characters before each
    at, start, last, spans = np.arange(n), np.arange(n), np.full(n, n + 2), []
    while len(at):
        end = np.maximum(np.searchsorted(total, total[start] + need), at + 1)
        shortest = (end < last) & (end <= hi[at])
        spans.append(start[shortest] * (n + 2) + end[shortest])
        left = before[start]
        on = (end > at + 1) & (left >= lo[at])
        at, start, last = at[on], left[on], end[on]
    span = np.unique(np.concatenate(spans)) if spans else np.zeros(0, np.int64)
    first, end = span // (n + 2), span % (n + 2)
    hashes = _HASHES[0]
    hashes.reach(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(lines.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * hashes.powers[:n], out=sums[1:])
    return first, end, mix((sums[end] - sums[first]) * hashes.inverses[first] ^ (end - first).astype(np.uint64)).view(np.int64)


def _lines(least_chars: int, every: bool):
    def work(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            body = data.tobytes()
            split = [body[a:b].split(b"\n") for a, b in zip(offsets[:-1], offsets[1:])]
            rows = [np.array([line_hash(x) for x in ls], np.int64) for ls in split]
            chars = [np.array([len(x.decode(errors="replace").strip()) for x in ls], np.int64) for ls in split]
            if every and rows:
                begins = np.cumsum([0, *map(len, rows)])
                first, _, run = _runs(np.concatenate(rows), np.concatenate(chars), begins, least_chars)
                cut = np.searchsorted(first, begins)
                distinct = [np.unique(run[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            else:
                distinct = [np.unique(r[r != 0]) for r in rows]
            both = [pa.array([x.tobytes() for x in r], pa.binary()) for r in (rows, chars)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("rank"), *both, pa.array(distinct, pa.list_(pa.int64()))], ["key", "rank", "lines", "chars", "distinct"])

    return work


def _long_blocks(a: list[int], b: list[int], chars: np.ndarray, least_chars: int) -> list[tuple[int, int]]:
    return [(j, j + n) for _, j, n in patience(a, b) if chars[j : j + n].sum() >= least_chars]


def _marks(rows: list[tuple[int, int, int]]) -> dict:
    key, first, end = zip(*rows) if rows else ((),) * 3
    return {"key": pa.array(key, pa.int64()), "first": pa.array(first, pa.int64()), "end": pa.array(end, pa.int64())}


def _align(least_chars: int):
    def work(batches):
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("v", "early", "late", "chars"))
            for k, a, b, c in zip(*columns):
                a, b = (np.frombuffer(x, np.int64).tolist() for x in (a, b))
                out.extend((k, *m) for m in _long_blocks(a, b, np.frombuffer(c, np.int64), least_chars))
            yield pa.RecordBatch.from_pydict(_marks(out))

    return work


def _left(least_chars: int):
    """Frequent runs of a document of which a line is left, and the places of such lines."""

    def work(batches):
        for batch in batches:
            out = []
            for key, rank, lines, chars, many, marks in zip(*(batch.column(c).to_pylist() for c in ("key", "rank", "lines", "chars", "many", "marks"))):
                lines, chars = np.frombuffer(lines, np.int64), np.frombuffer(chars, np.int64)
                here = np.ones(len(lines), bool)
                for m in marks or []:
                    here[m["first"] : m["end"]] = False
                if not here.any():
                    continue
                first, end, run = _runs(lines, chars, np.array([0, len(lines)]), least_chars)
                count = np.concatenate(([0], np.cumsum(here)))
                places: dict[int, set[int]] = {}
                for i in np.flatnonzero((count[end] > count[first]) & np.isin(run, np.array(many, np.int64))).tolist():
                    places.setdefault(int(run[i]), set()).update((first[i] + np.flatnonzero(here[first[i] : end[i]])).tolist())
                out.extend((key, rank, line, sorted(x)) for line, x in places.items())
            key, rank, line, places = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(rank, pa.int64()), pa.array(line, pa.int64()), pa.array(places, pa.list_(pa.int64()))], ["key", "rank", "line", "places"])

    return work


def _try(least_chars: int):
    """Marks of one block: rows asked for, aligned with the block's earlier rows until their places are marked.

    Lines of the earlier row that the later one lacks are the same to the alignment, a run of them as one, so rows that differ in
    nothing else are aligned once.
    """

    def work(key, table):
        asked = np.asarray(table.column("asked"))
        keys, ranks, lines, chars, places = (table.column(c).to_pylist() for c in ("key", "rank", "lines", "chars", "places"))
        home = sorted(np.flatnonzero(~asked).tolist(), key=lambda i: (ranks[i], keys[i]))
        order = [(ranks[i], keys[i]) for i in home]
        flat = np.frombuffer(b"".join(lines[i] for i in home), np.int64)
        at = np.cumsum([0, *(len(lines[i]) // 8 for i in home)])
        out = set()
        for i in np.flatnonzero(asked).tolist():
            own, size, left, seen = np.frombuffer(lines[i], np.int64), np.frombuffer(chars[i], np.int64), set(places[i]), set()
            known, listed = np.unique(own), own.tolist()
            earlier = bisect.bisect_left(order, (ranks[i], keys[i]))
            for lo, hi in ((0, min(8, earlier)), (8, earlier)):  # most need few
                if lo >= hi or not left:
                    continue
                part = flat[at[lo] : at[hi]]
                shared = known[np.minimum(np.searchsorted(known, part), len(known) - 1)] == part
                keep = shared.copy()
                keep[1:] |= shared[:-1]
                keep[at[lo:hi] - at[lo]] = True
                cut = np.concatenate(([0], np.cumsum(keep)))[at[lo : hi + 1] - at[lo]] * 8
                body = np.where(shared, part, _OTHER)[keep].tobytes()
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    if body[a:b] in seen:
                        continue
                    seen.add(body[a:b])
                    for first, end in _long_blocks(np.frombuffer(body[a:b], np.int64).tolist(), listed, size, least_chars):
                        out.add((keys[i], first, end))
                        left.difference_update(range(first, end))
                    if not left:
                        break
        return pa.table(_marks(list(out)))

    work.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": pa.Table, "return": pa.Table}
    return work


def _asking(arrays: DataFrame, many: DataFrame, marks: DataFrame, least_chars: int) -> DataFrame:
    """(key, rank, line, places) of frequent runs of which, given the marks so far, a line is left."""
    marks = marks.distinct().groupBy("key").agg(F.collect_list(F.struct("first", "end")).alias("marks"))
    holding = many.where(F.col("key") != F.col("head")).groupBy("key").agg(F.collect_list("line").alias("many"))
    asking = arrays.join(holding, "key").join(marks, "key", "left")
    return durable(asking.mapInArrow(_left(least_chars), "key long, rank long, line long, places array<long>"))


def _meet(arrays: DataFrame, asking: DataFrame, earlier: DataFrame, least_chars: int) -> DataFrame:
    """Marks of those who ask, by the earlier holders (line, key) of their runs.

    Holders and those who ask are both dealt into blocks, so a task holds two blocks however many holders a run has.
    """
    sizes = asking.groupBy("line").agg(F.count(F.lit(1)).alias("asking")).join(earlier.groupBy("line").agg(F.count(F.lit(1)).alias("holding")), "line")
    sizes = durable(sizes.select("line", F.ceil(F.col("holding") / BLOCK_ROWS).cast("long").alias("home_blocks"), F.ceil(F.col("asking") / BLOCK_ROWS).cast("long").alias("ask_blocks")))

    def numbers(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    home = salted_join(earlier, sizes, ["line"], "key").select("line", F.pmod(F.xxhash64("key"), F.col("home_blocks")).alias("home"), numbers("ask_blocks").alias("ask"), "key", F.lit(None).cast("array<long>").alias("places"), F.lit(False).alias("asked"))
    ask = salted_join(asking, sizes, ["line"], "key").select("line", numbers("home_blocks").alias("home"), F.pmod(F.xxhash64("key"), F.col("ask_blocks")).alias("ask"), "key", "places", F.lit(True).alias("asked"))
    rows = home.unionAll(ask).join(arrays, "key")
    return durable(rows.groupBy("line", "home", "ask").applyInArrow(_try(least_chars), "key long, first long, end long"))


def _tried(arrays: DataFrame, held: DataFrame, found: DataFrame, rare: int, least_chars: int) -> DataFrame:
    """Marks by the other earlier holders of frequent runs that the first holder left.

    All who ask first meet the ``FIRST`` holders of each run, which settles nearly all of them, so that a round has rows in
    proportion to those who ask. Who is left meets all earlier holders.
    """
    many = durable(held.where(F.col("n") > rare))
    place = F.row_number().over(W.partitionBy("line").orderBy("rank", "key"))
    first = many.withColumn("place", place).where(F.col("place") <= FIRST).select("line", "key")  # cut on the map side
    asking = _asking(arrays, many, found, least_chars)
    found = found.unionAll(_meet(arrays, asking, first, least_chars))
    asking = _asking(arrays, many, found, least_chars)
    last = asking.groupBy("line").agg(F.max(F.struct("rank", "key")).alias("last"))
    earlier = durable(salted_join(many, last, ["line"], "key").where(F.struct("rank", "key") < F.col("last")).select("line", "key"))
    return found.unionAll(_meet(arrays, asking, earlier, least_chars))


def _strip(least_chars: int, with_text: bool):
    def work(batches):
        for batch in batches:
            out = []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
                lines = text.split("\n") if text else []
                gone = np.zeros(len(lines), bool)
                for m in marks or []:
                    if sum(len(x.strip()) for x in lines[m["first"] : m["end"]]) >= least_chars:
                        gone[m["first"] : m["end"]] = True
                left = "\n".join(x for x, g in zip(lines, gone) if not g)
                out.append((len(lines), int(gone.sum()), hashlib.sha256(left.encode()).hexdigest(), left))
            n, removed, sha, left = (list(x) for x in zip(*out)) if out else ([],) * 4
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(left, pa.string())] if with_text else []), ["doc_id", "n_lines", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return work


def remove_repeated_lines(docs: DataFrame, rare: int = RARE, least_chars: int = 20, with_text: bool = False, every: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256, and the text ``kept`` if asked for) of every input row.

    Lines end at line feeds and are equal up to the white space around them. A row is compared with every row of smaller
    doc_id that shares a line with it which at most ``rare`` rows of different lines have, and for each more frequent line with the first
    row that has it; with ``every`` (as the registered query has it) what goes is what alignment with every row of smaller doc_id
    tells, and ``rare`` only decides which pairs are aligned first. Lines in a block aligned with such a row go if the block has ``least_chars`` characters. Rows are judged on the
    input. Null and empty texts have no lines; a null id counts as larger than all others; rows repeated under one id with
    one text are one row here and all get its result; different texts of one id are ordered by a hash. An empty table gives
    an empty one; other columns are left behind.
    """
    rows = keyed(docs).withColumn("rank", F.coalesce("doc_id", F.lit(2**63 - 1)))
    described = rows.select("key", "rank", "text").mapInArrow(_lines(least_chars, every), "key long, rank long, lines binary, chars binary, distinct array<long>")
    described = durable(described.withColumn("seq", F.sha1("lines")))
    # rows of the same lines: the first stands for all, and all lines of the others go
    heads = described.groupBy("seq").agg(F.min(F.struct("rank", "key")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = salted_join(described.select("key", "seq", "lines"), heads.select("seq", F.col("first.key").alias("head")), ["seq"], "key").where("key <> head")
    copies = durable(copies.select("key", (F.octet_length("lines") / 8).cast("long").alias("end")).distinct())
    described = durable(described.drop("seq").join(copies, "key", "left_anti"))
    holders = described.select("key", "rank", F.explode("distinct").alias("line")).distinct()
    # the first holders, summed up on the map side, so a line that a third of the rows have is one row a task
    lines = durable(holders.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "key")).alias("head")).where("n > 1"))
    held = durable(salted_join(holders, lines.select("line", "n", F.col("head.key").alias("head")), ["line"], "key"))
    few = held.where(F.col("n") <= rare).groupBy("line").agg(F.sort_array(F.collect_list(F.struct("rank", "key"))).alias("all"))
    few = few.select("all", F.posexplode("all").alias("at", "late")).select(F.explode(F.slice("all", 1, F.col("at"))).alias("early"), "late").select(F.col("early.key").alias("u"), F.col("late.key").alias("v"))
    many = held.where((F.col("n") > rare) & (F.col("key") != F.col("head"))).select(F.col("head").alias("u"), F.col("key").alias("v"))
    pairs = few.unionAll(many).distinct()
    arrays = durable(described.groupBy("key").agg(F.first("rank").alias("rank"), F.first("lines").alias("lines"), F.first("chars").alias("chars")))
    pairs = pairs.join(arrays.select(F.col("key").alias("v"), F.col("lines").alias("late"), "chars"), "v")
    pairs = pairs.join(arrays.select(F.col("key").alias("u"), F.col("lines").alias("early")), "u")
    found = pairs.select("v", "early", "late", "chars").mapInArrow(_align(least_chars), "key long, first long, end long")
    if every:
        found = _tried(arrays, held, durable(found), rare, least_chars)
    found = found.unionAll(copies.select("key", F.lit(0).cast("long").alias("first"), "end"))
    marks = durable(found.distinct().groupBy("key").agg(F.collect_list(F.struct("first", "end")).alias("marks")))
    schema = "doc_id long, n_lines long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return rows.select("key", "doc_id", "text").join(marks, "key", "left").mapInArrow(_strip(least_chars, with_text), schema)
