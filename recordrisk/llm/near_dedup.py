"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles. Every shingle owns Poisson processes over a hierarchy of weight
intervals [0, 1), [1, 2), [2, 4), [4, 8), ...; a point of a process has a time, a place in the signature and a weight
level, and counts if the level is below the shingle's weight. The signature keeps the earliest point of each place, so
two signatures agree at a place with the probability of the weighted Jaccard similarity. Points are made in order of time
and only until every place of a document is filled.

Documents whose signatures agree in a whole band are candidates. Each band's bucket compares its members with its least
one; those who remain in another component are compared with the others, in blocks. Candidates whose signatures agree
enough are verified by the overlap of their multisets, and linked documents form classes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordrisk.llm.components import components
from recordrisk.llm.shared import gram_hashes, mix, raw, salted_join, slices, texts, word_hashes, words
from recordrisk.workspace import durable

WORDS = 5
PLACES, BANDS = 160, 32  # at similarity 0.8 a pair misses all bands 3.0 times in a million
DEPTH = PLACES // BANDS
AGREE = 0.64  # share of equal places below which a pair isn't verified: 1.4 in a million at 0.8, so at most 4.4 are missed in all
BLOCK_ROWS = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)


def multisets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, sorted within each document, and where each document's begin.

    A document of one to k - 1 words has one shingle, all of them; one without words has none.
    """
    n = len(offsets) - 1
    starts, ends, doc = words(data, offsets)
    h = word_hashes(data, starts, ends)
    per = np.bincount(doc, minlength=n)
    grams = gram_hashes(h, k) if len(h) >= k else np.zeros(0, np.uint64)
    own = doc[: len(grams)] == doc[k - 1 :] if len(grams) else np.zeros(0, bool)
    out, of = grams[own], doc[: len(grams)][own]
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        first = np.cumsum(per) - per
        extra = np.array([gram_hashes(h[first[d] : first[d] + per[d]], int(per[d]))[0] for d in short], np.uint64)
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
    order = np.lexsort((out, of))
    return out[order], np.searchsorted(of[order], np.arange(n + 1))


def occurrences(sorted_hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many equal shingles of the document come before each."""
    n = len(sorted_hashes)
    new = np.ones(n, bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    new[begins[:-1][begins[:-1] < n]] = True
    first = np.flatnonzero(new)
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


def signatures(hashes: np.ndarray, begins: np.ndarray, places: int = PLACES) -> np.ndarray:
    """BagMinHash signatures, a row of 16-bit values a document (arbitrary for those without shingles)."""
    n = len(begins) - 1
    rank = occurrences(hashes, begins) if len(hashes) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), np.diff(begins))
    total = np.diff(begins)
    # a process for every interval of the hierarchy that the weight reaches: those of ranks 0, 1, 2, 4, 8, ...
    root = (rank & (rank - 1)) == 0
    last = np.ones(len(rank), bool)
    last[:-1] = rank[1:] == 0
    weight = np.repeat(rank[last] + 1, np.diff(np.concatenate(([-1], np.flatnonzero(last)))))[root] if len(rank) else rank
    low = rank[root]
    rate = np.maximum(low, 1)
    seed = mix(hashes[root] + low.astype(np.uint64) * _STEP)
    owner, turn, clock = doc[root], np.zeros(len(low), np.uint64), np.zeros(len(low))
    best = np.full(n * places, np.iinfo(np.uint64).max, np.uint64)
    until = (np.log(places) + 3) / np.maximum(total, 1)
    active = np.arange(len(low))
    bits = _points(seed, turn)
    clock = -np.log1p(-_unit(bits)) / (rate * places)
    waiting = np.zeros(0, np.int64)
    while True:
        go = clock[active] <= until[owner[active]]
        waiting = np.concatenate([waiting, active[~go]])
        active = active[go]
        if len(active):
            more = mix(seed[active] ^ (turn[active] * _STEP + np.uint64(77)))
            level = low[active] + ((more >> np.uint64(40)).astype(np.int64) % rate[active])
            place = (more & np.uint64(0xFFFF)).astype(np.int64) % places
            counts = level < weight[active]
            value = clock[active].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (more >> np.uint64(8)) & np.uint64(0xFFFFFFFF)
            np.minimum.at(best, (owner[active] * places + place)[counts], value[counts])
            turn[active] += np.uint64(1)
            clock[active] += -np.log1p(-_unit(_points(seed[active], turn[active]))) / (rate[active] * places)
            continue
        open_docs = (best.reshape(n, places) == np.iinfo(np.uint64).max).any(axis=1) & (total > 0)
        if not open_docs.any():
            break
        until[open_docs] *= 1.5
        back = open_docs[owner[waiting]]
        active, waiting = waiting[back], waiting[~back]
    return (mix(best) >> np.uint64(48)).astype(np.uint16).reshape(n, places)


def _points(seed, turn):
    return mix(seed + (turn + np.uint64(1)) * _STEP)


def _unit(bits):
    return (bits >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _describe(batches):
    """A row a document: its digest, number of shingles and signature."""
    for batch in batches:
        for first, end, data, offsets in slices(*raw(batch.column("text"))):
            hashes, begins = multisets(data, offsets)
            sign = signatures(hashes, begins)
            each = [hashes[a:b] for a, b in zip(begins[:-1], begins[1:])]
            digest = [_digest(x) for x in each]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(digest, pa.binary()), pa.array(np.diff(begins)), pa.array([s.tobytes() for s in sign], pa.binary())], ["doc_id", "digest", "shingles", "sign"])


def _digest(x: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _sets(batches):
    """A row a document: its shingle occurrences as a set of 64-bit keys, sorted, and their upper halves."""
    for batch in batches:
        for first, end, data, offsets in slices(*raw(batch.column("text"))):
            hashes, begins = multisets(data, offsets)
            keys = mix(hashes + occurrences(hashes, begins).astype(np.uint64) * _STEP) if len(hashes) else hashes
            span = list(zip(begins[:-1], begins[1:]))
            wanted = batch.column("wanted").slice(first, end - first).to_pylist()
            mine = [i for i, (a, b) in enumerate(span) if _digest(hashes[a:b]) == wanted[i]]
            body = [np.sort(keys[span[i][0] : span[i][1]]).tobytes() for i in mine]
            short = [(np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in body]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(first, end - first).take(pa.array(mine, pa.int64())), pa.array(body, pa.binary()), pa.array(short, pa.binary())], ["node", "keys", "short"])


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets reach the Jaccard threshold."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def _overlap(threshold: float):
    def work(batches):
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("left", "right"))
            keep = [i for i, (a, b) in enumerate(zip(left, right)) if _alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), threshold)]
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return work


def _agreeing(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, PLACES) for c in ("left", "right"))
        keep = np.flatnonzero((a == b).mean(axis=1) >= AGREE)
        yield batch.select(["u", "v"]).take(pa.array(keep))


def _cross(threshold: float):
    """Links of one block: the rows asked for against the block's rows of other components.

    Signatures that agree enough are followed by a comparison of the 32-bit halves of the sets, which those of every linked pair
    pass. A row needs one link to each other component, so what leaves the task grows with components, not with pairs.
    """
    def work(key, table):
        asked = np.asarray(table.column("asked"))
        node, group = np.asarray(table.column("node")), np.asarray(table.column("component"))
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint16).reshape(-1, PLACES)
        short = table.column("short").to_pylist()
        home, us, vs = np.flatnonzero(~asked), [], []
        for i in np.flatnonzero(asked):
            other = home[group[home] != group[i]]
            share = (sign[other] == sign[i]).mean(axis=1)
            near = np.flatnonzero(share >= AGREE)
            own, linked = np.frombuffer(short[i], np.uint32), set()
            for j in other[near[np.argsort(-share[near], kind="stable")]].tolist():  # the most alike first
                if group[j] not in linked and _alike(own, np.frombuffer(short[j], np.uint32), threshold):
                    linked.add(group[j])
                    us.append(node[i])
                    vs.append(node[j])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    work.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": pa.Table, "return": pa.Table}
    return work


def _crossing(banded: DataFrame, nodes: DataFrame, sets: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Candidates (u > v) between components that share a bucket.

    Everyone outside a bucket's largest component is compared with all of the bucket. Both sides are dealt into blocks, so
    a task holds two blocks however many members a bucket has.
    """
    located = banded.join(found, "node", "left").select("node", "band", "bucket", F.coalesce("component", "node").alias("component"))
    sizes = located.groupBy("band", "bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band", "bucket").agg(
        F.sum("n").alias("members"), F.max(F.struct("n", F.col("component").alias("main"))).alias("top"), F.count(F.lit(1)).alias("kinds")
    ).where("kinds > 1").select("band", "bucket", "top.main", F.ceil(F.col("members") / BLOCK_ROWS).cast("long").alias("home_blocks"), F.ceil((F.col("members") - F.col("top.n")) / BLOCK_ROWS).cast("long").alias("ask_blocks"))
    split = durable(salted_join(located, mixed, ["band", "bucket"], "node"))

    def numbers(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    home = split.select("band", "bucket", F.pmod(F.xxhash64("node"), F.col("home_blocks")).alias("home"), numbers("ask_blocks").alias("ask"), "node", "component", F.lit(False).alias("asked"))
    ask = split.where("component <> main").select("band", "bucket", numbers("home_blocks").alias("home"), F.pmod(F.xxhash64("node"), F.col("ask_blocks")).alias("ask"), "node", "component", F.lit(True).alias("asked"))
    rows = home.unionAll(ask).join(nodes.select("node", "sign"), "node").join(sets.select("node", "short"), "node")
    pairs = rows.groupBy("band", "bucket", "home", "ask").applyInArrow(_cross(threshold), "u long, v long")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _with(rows: DataFrame, table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``value`` of the node in column ``key``. Hot keys are split by Spark's skew join."""
    return rows.join(table.select(F.col("node").alias(key), F.col(value).alias(name)), key)


def _verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (u, v) those whose multisets overlap enough."""
    both = _with(_with(pairs, sets, "u", "keys", "left"), sets, "v", "keys", "right")
    return durable(both.mapInArrow(_overlap(threshold), "u long, v long"))


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, class_size, kept) of every input row.

    Documents are linked if the weighted Jaccard similarity of their multisets of five-word shingles (of fewer words: all
    of them at once) is at least ``threshold``; a class is a connected set of links, named by its least doc_id, and that
    document is the one kept. Null texts count as empty; texts without words are copies of each other. Rows repeated
    under one id share its class; if their texts differ, the one of the least digest stands for the id. Rows with a null
    id are kept, in classes of their own (class_id null, class_size 1). Other columns are left behind.
    """
    base = texts(docs)
    described = base.where("doc_id IS NOT NULL").mapInArrow(_describe, "doc_id long, digest binary, shingles long, sign binary")
    described = described.groupBy("doc_id").agg(F.min(F.struct("digest", "shingles", "sign")).alias("_d")).select("doc_id", "_d.*")
    described = durable(described)
    # equal multisets collapse to their least id; from here on a node is such a representative
    firsts = described.groupBy("digest").agg(F.min("doc_id").alias("node"))
    member = durable(salted_join(described.select("doc_id", "digest"), firsts, ["digest"], "doc_id").select("doc_id", "node"))
    nodes = described.join(member.where("doc_id = node").select("doc_id"), "doc_id").withColumnRenamed("doc_id", "node")
    nodes = durable(nodes.where("shingles > 0"))
    buckets = F.array(*[F.xxhash64(F.substring("sign", 2 * DEPTH * b + 1, 2 * DEPTH)) for b in range(BANDS)])
    banded = nodes.select("node", F.posexplode(buckets).alias("band", "bucket"))
    leaders = banded.groupBy("band", "bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    banded = durable(salted_join(banded, leaders.select("band", "bucket", "leader"), ["band", "bucket"], "node"))
    stars = banded.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    pairs = durable(_with(_with(stars, nodes, "u", "sign", "left"), nodes, "v", "sign", "right").mapInArrow(_agreeing, "u long, v long"))
    # the multisets of documents that share a bucket with another; only their texts are read again
    holders = banded.select("node").distinct().join(nodes.select("node", F.col("digest").alias("wanted")), "node")
    sets = durable(base.join(holders, base["doc_id"] == holders["node"]).select("node", "text", "wanted").mapInArrow(_sets, "node long, keys binary, short binary"))
    links = _verified(sets, pairs, threshold)
    # those outside a bucket's main component against all of the bucket
    rest = durable(_crossing(banded, nodes, sets, components(links), threshold))
    found = components(links.unionAll(_verified(sets, rest, threshold)))
    classes = member.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("class_id"))
    classes = durable(classes)
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    classes = salted_join(classes, sizes, ["class_id"], "doc_id")
    return (
        base.select("doc_id").join(classes, "doc_id", "left")
        .select("doc_id", "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))
    )
