"""How far the word use of the sources of a language lies apart.

Counts of terms are a matrix, groups by kept terms, per language. Its cells are shared out by blocks of terms (and pairs of
blocks of groups, where a language has many). A task builds a k2-tree of its part of the matrix: a quadrant without a
cell is one 0 bit, whatever its size. Pairs of groups descend their trees together. Where both quadrants are empty, every
term of them adds the same, which is priced at once; what remains ends in leaves of which at least one is a count.

Probabilities and their distances are whole numbers, so sums are exact whatever their order.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordrisk.llm.shared import raw, slices, words
from recordrisk.workspace import durable, lookup

# Bytes that make terms: letters of ASCII, and all of which characters beyond ASCII consist. Capitals of ASCII become small.
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[0x41:0x5B] += 32
COUNT_BYTES = 4 << 20  # texts counted together
SCALE = 1_000_000_000
BLOCK_TERMS = 4096  # terms of a block, about
BLOCK_GROUPS = 64  # groups of a block, at most
FRONTIER = 1 << 18  # quadrant pairs looked at together, about


# ---- inside tasks -----------------------------------------------------------------------------------------------


def distance(p, q):
    """floor((p - q)**2 / (p + q)), whole numbers of at most 1 + SCALE."""
    return (p - q) * (p - q) // (p + q)


class QuadTree:
    """A k2-tree (k = 2) over a matrix of ``tiles`` squares side by side, each of ``1 << height`` rows and columns.

    ``bits[l]`` holds four bits for every nonempty quadrant of level l (the first: one for every tile), ``rank[l]`` the
    number of ones before each. The quadrant behind the m-th one of a level has its children at bits 4m to 4m + 3 of the next.
    Values of the nonempty cells follow in the order of the last level.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, tiles: int, height: int):
        tile, column = columns >> height, columns & ((1 << height) - 1)
        code = tile.astype(np.int64)
        for bit in range(height - 1, -1, -1):
            code = code << 2 | ((rows >> bit) & 1) << 1 | (column >> bit) & 1
        order = np.argsort(code, kind="stable")
        code = code[order]
        self.values, self.bits, self.rank = values[order], [], []
        parents = None
        for level in range(height + 1):
            nodes = np.unique(code >> 2 * (height - level))
            if parents is None:
                bits, at = np.zeros(tiles, bool), nodes
            else:
                bits, at = np.zeros(4 * len(parents), bool), 4 * np.searchsorted(parents, nodes >> 2) + (nodes & 3)
            bits[at] = True
            self.bits.append(bits)
            self.rank.append(np.cumsum(bits) - bits)
            parents = nodes

    def root(self, tiles: np.ndarray) -> np.ndarray:
        """The numbers of the tiles' quadrants, -1 for empty ones."""
        return np.where(self.bits[0][tiles], self.rank[0][tiles], -1)

    def child(self, level: int, nodes: np.ndarray, which: np.ndarray) -> np.ndarray:
        """A child of each quadrant of level ``level - 1``; children of empty ones are empty."""
        if not len(self.bits[level]):
            return np.full(len(nodes), -1)
        at = np.where(nodes >= 0, 4 * nodes + which, 0)
        return np.where((nodes >= 0) & self.bits[level][at], self.rank[level][at], -1)


def pair_sums(one: QuadTree, two: QuadTree, p0: np.ndarray, q0: np.ndarray, width: int, height: int, same: bool) -> np.ndarray:
    """Sums over ``width`` terms of the distance of every row of ``one`` from every row of ``two``.

    ``p0`` and ``q0`` are the values of empty cells. With ``same`` both are one tree, and only rows i < j are summed.
    """
    n, m = len(p0), len(q0)
    sums, side = np.zeros((n, m), np.int64), 1 << height
    empty = [np.zeros((-(-n // (side >> level)), -(-m // (side >> level))), np.int64) for level in range(height + 1)]
    tiles = -(-width // side)
    step = max(1, FRONTIER // (side * side * side))
    kids = np.array([(i, j, c) for i in (0, 1) for j in (0, 1) for c in (0, 1)])
    for first in range(0, tiles, step):
        tile = np.arange(first, min(tiles, first + step))
        i = j = np.zeros(len(tile), np.int64)
        column, a, b = tile * side, one.root(tile), two.root(tile)
        for level in range(height + 1):
            size = side >> level
            none = (a < 0) & (b < 0)
            np.add.at(empty[level], (i[none], j[none]), np.minimum(size, width - column[none]))
            some = ~none
            i, j, column, a, b = i[some], j[some], column[some], a[some], b[some]
            if level == height:
                break
            half = size >> 1
            di, dj, dc = (np.tile(k, len(i)) for k in kids.T)
            a, b = np.repeat(a, 8), np.repeat(b, 8)
            i, j, column = 2 * np.repeat(i, 8) + di, 2 * np.repeat(j, 8) + dj, np.repeat(column, 8) + half * dc
            real = (i * half < n) & (j * half < m) & (column < width)
            if same:
                real &= i <= j if half > 1 else i < j
            i, j, column, a, b, di, dj, dc = (x[real] for x in (i, j, column, a, b, di, dj, dc))
            a, b = one.child(level + 1, a, 2 * di + dc), two.child(level + 1, b, 2 * dj + dc)
        p = np.where(a >= 0, one.values[np.maximum(a, 0)], p0[i]) if len(one.values) else p0[i]
        q = np.where(b >= 0, two.values[np.maximum(b, 0)], q0[j]) if len(two.values) else q0[j]
        np.add.at(sums, (i, j), distance(p, q))
    zeros = np.zeros((n, m), np.int64)
    for level, counts in enumerate(empty):
        size = side >> level
        zeros += np.repeat(np.repeat(counts, size, axis=0), size, axis=1)[:n, :m]
    return sums + zeros * distance(p0[:, None], q0[None, :])


def _traverse(table: pa.Table) -> pa.Table:
    """Pair sums of one block of terms: rows with a place are cells, those without one their groups."""
    width, lang = table.column("width")[0].as_py(), table.column("lang")[0]
    left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    block, row, place, p = (table.column(c).to_numpy() for c in ("home", "row", "place", "p"))
    sides = []
    for home in (left, right):
        mine = block == home
        heads = mine & (place < 0)
        order = np.argsort(row[heads], kind="stable")
        sides.append((row[heads][order], p[heads][order], mine & (place >= 0)))
    height = max(1, int(max(len(s[0]) for s in sides) - 1).bit_length())
    tiles = -(-width // (1 << height))
    trees = [QuadTree(np.searchsorted(rows, row[cells]), place[cells], p[cells], tiles, height) for rows, _, cells in sides]
    sums = pair_sums(*trees, sides[0][1], sides[1][1], width, height, left == right)
    i, j = (x.ravel() for x in np.indices(sums.shape))
    keep = i < j if left == right else np.ones(len(i), bool)
    i, j = i[keep], j[keep]
    return pa.table({"lang": pa.array([lang.as_py()] * len(i), pa.string()), "one": pa.array(sides[0][0][i]), "two": pa.array(sides[1][0][j]),
                     "value": pa.array(sums.ravel()[keep])})


def _slice_counts(batches):
    """Counts per group and term of a few megabytes of texts at a time; equal terms are found by their bytes."""
    for batch in batches:
        data, offsets = raw(batch.column("text"))
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
        for first, _, body, at in slices(data, offsets, COUNT_BYTES):
            starts, ends, doc = words(body, at, TERM)
            kept = SMALL[body[TERM[body]]]  # nothing but terms, one after the other
            places = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
            terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(kept)]).dictionary_encode()
            size = max(1, len(terms.dictionary))
            own, times = np.unique(doc * size + terms.indices.to_numpy(), return_counts=True)
            cell, back = np.unique(group[first + own // size] * size + own % size, return_inverse=True)
            n = np.bincount(back, times, len(cell)).astype(np.int64)  # exact: below 2**53
            of, code = cell // size, cell % size
            per = max(1, len(sources.dictionary))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(of // per)), sources.dictionary.take(pa.array(of % per)), terms.dictionary.take(pa.array(code)).cast(pa.string()),
                 pa.array(n), pa.array(np.bincount(back, minlength=len(cell)).astype(np.int64))], ["lang", "source", "term", "n", "docs"])


# ---- Spark ----------------------------------------------------------------------------------------------------------


def share(count, total, terms) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact for counts of any size."""
    over = (count.cast("decimal(20,0)") + F.lit(2)) * F.lit(SCALE).cast("decimal(10,0)")
    under = total.cast("decimal(20,0)") + terms.cast("decimal(20,0)") * F.lit(2)
    return 1 + F.call_function("div", over.cast("decimal(34,0)"), under.cast("decimal(34,0)")).cast("long")


def groups_of(docs: DataFrame, text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term. Tasks count slices of their rows first."""
    rows = docs.mapInArrow(_slice_counts, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, block_terms: int = BLOCK_TERMS, block_groups: int = BLOCK_GROUPS,
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: distances of sources, and the terms that mark a source.

    Null text, lang and source count as empty; every row is a document, repeated ones too. Part ``pair`` has, for every
    (lang, source) that occurs, all other sources of the lang with the distance summed over the terms kept (those in
    ``least_docs`` documents of the lang); part ``term`` the ``top`` terms that the source uses more than the lang does.
    A source without terms has pairs but no terms; a lang with one source has no pairs. Ties go by the item. An empty table gives
    an empty one, and other columns, whatever their names, are left behind.
    """
    docs = groups_of(docs, text_col, lang_col, source_col)
    counts = durable(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs)
    kept = durable(kept.drop("docs"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    langs = langs.withColumn("blocks", F.ceil(F.col("terms") / F.lit(block_terms)).cast("long"))
    numbered = lookup(kept, langs, "lang").withColumn("block", F.expr("pmod(xxhash64(term), blocks)"))
    numbered = durable(numbered.withColumn("place", F.row_number().over(W.partitionBy("lang", "block").orderBy("term")) - 1))
    cells = durable(counts.drop("docs").join(numbered, ["lang", "term"]))

    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total", "blocks"])
    groups = groups.withColumn("row", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = groups.withColumn("home", F.expr(f"row div {block_groups}"))
    groups = groups.withColumn("homes", F.expr(f"(count(*) over (partition by lang) - 1) div {block_groups} + 1"))
    groups = groups.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(1).cast("long")))
    groups = durable(groups)

    own = groups.select("lang", "source", "row", "home", "homes", "total")
    cells = lookup(cells, own, ["lang", "source"], "inner").withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    pairs = _pairs(cells, groups, numbered)
    q = share(F.col("all"), F.col("lang_total"), F.col("terms"))
    marks = cells.withColumn("q", q).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    marks = marks.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(marks)


def _pairs(cells, groups, numbered):
    """Every group with every other one of its lang: sums of the tasks, both ways."""
    widths = numbered.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("width"))
    heads = groups.join(widths, "lang", "left").select(
        "lang", "row", "home", "homes", F.coalesce("block", F.lit(0).cast("long")).alias("block"), F.coalesce("width", F.lit(0).cast("long")).alias("width"),
        F.lit(-1).alias("place"), F.col("p0").alias("p"))
    body = cells.select("lang", "row", "home", "homes", "block", F.lit(None).cast("long").alias("width"), "place", "p")
    # a block of groups meets every block of its lang, itself too
    sent = heads.unionByName(body).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1)))
    sent = sent.select("lang", "block", F.least("home", "_other").alias("left"), F.greatest("home", "_other").alias("right"), "home", "row", "place", "p", "width")
    sums = sent.groupBy("lang", "block", "left", "right").applyInArrow(_with_width, "lang string, one long, two long, value long")
    sums = sums.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("one").alias("row"), F.col("two").alias("other")),
                                                          F.struct(F.col("two").alias("row"), F.col("one").alias("other")))).alias("x"))
    names = groups.select("lang", "row", "source")
    named = lookup(both.select("lang", "value", "x.row", "x.other"), names, ["lang", "row"], "inner")
    others = groups.select("lang", F.col("row").alias("other"), F.col("source").alias("item"))
    return lookup(named, others, ["lang", "other"], "inner").select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def _with_width(table: pa.Table) -> pa.Table:
    """The rows of one task; the width stands in the rows of the groups."""
    order = table.column("place").to_numpy().argsort(kind="stable")
    return _traverse(table.take(pa.array(order)))
