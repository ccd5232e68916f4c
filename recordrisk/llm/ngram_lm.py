"""Scores of texts by an interpolated bigram model.

The model mixes three maximum-likelihood estimates of a token: after its predecessor, by itself, and uniform. The weights
depend on how often the predecessor was seen (a bucket for each power of two) and are learned by expectation-maximisation
on counts that were held out of the estimates; then these counts are put back (deleted interpolation).

Texts go in chunks. A chunk sends each of its distinct n-grams once, with its counts, to the part of the key space that
owns it; a part adds up all counts and answers every chunk for just the n-grams it asked for. So no task or driver holds
the model, and a word pair that is everywhere costs one entry a chunk.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordrisk.llm.shared import input_bytes, mix, pieces_for, raw, texts, word_hashes, words
from recordrisk.workspace import durable

CHUNK_BYTES = 4 << 20
PART_BYTES = 8 << 20
TRAIN, DELETED, HELD_OUT = 0, 1, 2  # kinds of documents
BUCKETS = 24
BINS = 4  # of a doubling of the ratio of two estimates
NEVER = -9999  # bin of a ratio to an estimate of zero
_END = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(1 << 63)  # the bit of a key that tells pairs from single tokens
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Chunk:
    """The n-grams of some documents: distinct keys, and which of them each token has."""

    doc: np.ndarray  # of each token
    single: np.ndarray  # place in keys of each token itself
    pair: np.ndarray  # ... of the token with its predecessor
    keys: np.ndarray
    counts: np.ndarray  # of each key, in training documents and in those of the deleted part
    n_docs: int

    def context(self) -> np.ndarray:
        """Place of each token's predecessor, an end before the first."""
        before = np.empty_like(self.single)
        before[1:] = self.single[:-1]
        if len(before):
            before[0] = self.single[-1]  # the last token is an end
        return before


def read_chunk(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> Chunk:
    data = _LOWER[data]
    starts, ends, doc = words(data, offsets)
    n = len(offsets) - 1
    per = np.bincount(doc, minlength=n)
    hashes = np.insert(word_hashes(data, starts, ends), np.cumsum(per), _END)
    doc = np.repeat(np.arange(n), per + 1)
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[:1] = _END
    singles, single = np.unique(mix(hashes) & ~_PAIR, return_inverse=True)
    pairs, pair = np.unique(mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(hashes)) | _PAIR, return_inverse=True)
    pair = pair + len(singles)
    kind = kinds[doc]
    total = len(singles) + len(pairs)
    counts = np.stack([np.bincount(single[kind == k], minlength=total) + np.bincount(pair[kind == k], minlength=total) for k in (TRAIN, DELETED)])
    return Chunk(doc, single, pair, np.concatenate([singles, pairs]), counts, n)


def _chunks(batches):
    """Documents packed into compressed chunks, those of the deleted part into chunks of their own."""
    import zstandard
    from pyspark import TaskContext

    part, number, press = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
    held, size = {True: [], False: []}, {True: 0, False: 0}

    def row(rows):
        nonlocal number
        number += 1
        ids = np.array([0 if r[0] is None else r[0] for r in rows], np.int64)
        null = np.array([r[0] is None for r in rows])
        body = [r[2] for r in rows]
        offsets = np.cumsum([0, *map(len, body)]).astype(np.int64)
        values = [[(part << 32) + number], [bool(rows[0][1] == DELETED)], [ids.tobytes()], [null.tobytes()], [np.array([r[1] for r in rows], np.int8).tobytes()], [offsets.tobytes()], [press.compress(b"".join(body))]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.bool_(), *[pa.binary()] * 5))], _CHUNK_NAMES)

    for batch in batches:
        data, offsets = raw(batch.column("text"))
        ids, kinds = batch.column("doc_id").to_pylist(), batch.column("kind").to_pylist()
        for i in range(batch.num_rows):
            mine = kinds[i] == DELETED
            held[mine].append((ids[i], kinds[i], data[offsets[i] : offsets[i + 1]].tobytes()))
            size[mine] += int(offsets[i + 1] - offsets[i])
            if size[mine] >= CHUNK_BYTES:
                yield row(held[mine])
                held[mine], size[mine] = [], 0
    for rows in held.values():
        if rows:
            yield row(rows)


_CHUNK_NAMES = ["chunk", "deleted", "ids", "nulls", "kinds", "offsets", "body"]
_CHUNK_SCHEMA = "chunk long, deleted boolean, ids binary, nulls binary, kinds binary, offsets binary, body binary"


def _open(row: dict) -> tuple[Chunk, np.ndarray]:
    import zstandard

    kinds = np.frombuffer(row["kinds"], np.int8)
    body = zstandard.ZstdDecompressor().decompress(row["body"]) if row["body"] else b""
    return read_chunk(np.frombuffer(body, np.uint8), np.frombuffer(row["offsets"], np.int64), kinds), kinds


def _parts(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by the part that owns them, and where each part begins."""
    owner = ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return order, np.searchsorted(owner[order], np.arange(n + 1))


def _packed_keys(keys: np.ndarray) -> bytes:
    """The upper 48 bits of each key. A part owns keys by the lower ones, so within it few keys can coincide at any size."""
    return (keys >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked_keys(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _packed_counts(counts: np.ndarray) -> bytes:
    """Counts by bytes of equal weight, compressed: nearly all are small."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(counts.astype("<u8").reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked_counts(body: bytes) -> np.ndarray:
    """Two rows of counts: of the training part and of the deleted part."""
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.int64).reshape(2, -1)


def _ask(n_parts: int):
    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk, _ = _open(row)
                order, begin = _parts(chunk.keys, n_parts)
                keys, counts = chunk.keys[order], chunk.counts[:, order]
                some = np.flatnonzero(np.diff(begin))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(np.full(len(some), row["chunk"])), pa.array([_packed_keys(keys[begin[p] : begin[p + 1]]) for p in some], pa.binary()), pa.array([_packed_counts(counts[:, begin[p] : begin[p + 1]]) for p in some], pa.binary())],
                    ["part", "chunk", "keys", "counts"])

    return work


def _answer(table: pa.Table) -> pa.Table:
    """Total counts of the keys of one part, for each chunk the ones it asked for; and totals of the part (chunk null)."""
    keys = [_unpacked_keys(k) for k in table.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_unpacked_counts(c) for c in table.column("counts").to_pylist()], axis=1)
    total = np.stack([np.bincount(back, counts[k], len(found)) for k in range(2)]).astype(np.int64)
    at = np.cumsum([0, *sizes])
    answers = [_packed_counts(total[:, back[a:b]]) for a, b in zip(at[:-1], at[1:])]
    single = (found >> np.uint64(47)) == 0
    train, both = total[0, single], total[:, single].sum(axis=0)
    part = table.column("part")[0].as_py()
    n = len(answers)
    names = ["part", "chunk", "counts", "train_tokens", "train_types", "tokens", "types"]
    return pa.table([
        pa.array([part] * (n + 1), pa.int64()), pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
        pa.array([*answers, b""], pa.binary()), *(pa.array([0] * n + [int(x)], pa.int64()) for x in (train.sum(), (train > 0).sum(), both.sum(), (both > 0).sum()))], names)


_ANSWER_SCHEMA = "part long, chunk long, counts binary, train_tokens long, train_types long, tokens long, types long"


def _answered(chunk: Chunk, rows: pa.Table, n_parts: int) -> np.ndarray:
    """Counts of the chunk's keys in the whole corpus: a row for the training part, one for the deleted part."""
    order, begin = _parts(chunk.keys, n_parts)
    out = np.zeros((2, len(chunk.keys)), np.int64)
    for part, body in zip(rows.column("part").to_pylist(), rows.column("counts").to_pylist()):
        a, b = begin[part], begin[part + 1]
        out[:, order[a:b]] = _unpacked_counts(body)
    return out


def estimates(chunk: Chunk, counts: np.ndarray, tokens: int, types: int):
    """Bucket of each token's context and its three estimates."""
    context = counts[chunk.context()]
    bucket = np.minimum(np.ceil(np.log2(context + 1)).astype(np.int64), BUCKETS - 1)
    after = np.where(context > 0, counts[chunk.pair] / np.maximum(context, 1), 0.0)
    alone = counts[chunk.single] / max(tokens, 1)
    return bucket, np.stack([after, alone, np.full(len(alone), 1 / (types + 1))])


def learn_weights(bucket, ratios, amount, rounds: int = 60) -> np.ndarray:
    """Weights of the three estimates in each bucket by expectation-maximisation on binned ratios to the uniform one.

    Buckets without held-out tokens take the weights of the nearest one that has some, or equal ones.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    seen = []
    for b in range(BUCKETS):
        of = bucket == b
        if not of.any():
            continue
        seen.append(b)
        p, n, w = ratios[:, of], amount[of], weights[b]
        for _ in range(rounds):
            share = w[:, None] * p
            w = (share / share.sum(axis=0) * n).sum(axis=1) / n.sum()
        weights[b] = w * (1 - 1e-6) + 1e-6 / 3  # every token keeps some probability
    for b in range(BUCKETS):
        if seen and b not in seen:
            weights[b] = weights[min(seen, key=lambda x: abs(x - b))]
    return weights


def _cells(n_parts: int, tokens: int, types: int):
    """How often each combination of bucket and binned estimates occurs in deleted documents."""
    def work(key, left, right):
        rows = left.to_pylist()
        names = ["bucket", "after", "alone", "n"]
        if not rows:
            return pa.table([pa.nulls(0, pa.int64())] * 4, names)
        chunk, _ = _open(rows[0])
        bucket, p = estimates(chunk, _answered(chunk, right, n_parts)[0], tokens, types)
        with np.errstate(divide="ignore"):
            bins = np.where(p[:2] > 0, np.round(np.log2(p[:2] / p[2]) * BINS), NEVER).astype(np.int64)
        found, n = np.unique(np.stack([bucket, *bins]), axis=1, return_counts=True)
        return pa.table([*(pa.array(x) for x in found), pa.array(n)], names)

    work.__annotations__ = {"key": tuple[pa.Scalar, ...], "left": pa.Table, "right": pa.Table, "return": pa.Table}
    return work


def _scores(n_parts: int, tokens: int, types: int, weights: np.ndarray):
    def work(key, left, right):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        kinds_of = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        rows = left.to_pylist()
        if not rows:
            return pa.table([pa.nulls(0, t) for t in kinds_of], names)
        row = rows[0]
        chunk, kinds = _open(row)
        counts = _answered(chunk, right, n_parts).sum(axis=0)
        bucket, p = estimates(chunk, counts, tokens, types)
        own = counts[chunk.single]
        add = lambda x: np.bincount(chunk.doc, x, chunk.n_docs)
        values = [np.frombuffer(row["ids"], np.int64), kinds == HELD_OUT, add(np.ones(len(own))).astype(np.int64), add(own > 0).astype(np.int64), add(np.log10((own + 1) / (tokens + types + 1))), add(np.log10((weights[bucket].T * p).sum(axis=0)))]
        null = np.frombuffer(row["nulls"], bool)
        return pa.table([pa.array(v, t, mask=null if i == 0 else None) for i, (v, t) in enumerate(zip(values, kinds_of))], names)

    work.__annotations__ = {"key": tuple[pa.Scalar, ...], "left": pa.Table, "right": pa.Table, "return": pa.Table}
    return work


def score_texts(docs: DataFrame, folds: int = 7, held_out: int = 2, deleted: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every input row.

    Rows whose crc32(doc_id as text) modulo ``folds`` is ``held_out`` teach nothing; those of remainder ``deleted`` teach the
    weights first and then join the counts. A text is its words (ASCII letters in lower case, split at ASCII white space)
    and an end token; ``base_score`` is the sum of log10((c + 1) / (N + V + 1)) over its tokens, ``score`` the model's log10 probability.
    Null texts count as empty; a null id counts as the empty text for the remainder; repeated rows each count. An empty
    table gives an empty one; other columns are left behind.
    """
    spark, base = docs.sparkSession, texts(docs)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    kind = F.when(fold == held_out, HELD_OUT).when(fold == deleted, DELETED).otherwise(TRAIN).cast("int")
    n_parts = pieces_for(input_bytes(base), PART_BYTES)
    chunks = durable(base.select("doc_id", "text", kind.alias("kind")).mapInArrow(_chunks, _CHUNK_SCHEMA))
    asked = chunks.mapInArrow(_ask(n_parts), "part long, chunk long, keys binary, counts binary")
    answers = durable(asked.groupBy("part").applyInArrow(_answer, _ANSWER_SCHEMA))
    sums = answers.where("chunk IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("train_tokens", "train_types", "tokens", "types")]).first()
    answers = answers.where("chunk IS NOT NULL").select("part", "chunk", "counts")

    known = answers.join(chunks.where("deleted").select("chunk"), "chunk", "left_semi")
    cells = chunks.where("deleted").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_cells(n_parts, sums["train_tokens"], sums["train_types"]), "bucket long, after long, alone long, n long")
    # bounded: buckets times bins of either ratio
    cells = cells.groupBy("bucket", "after", "alone").agg(F.sum("n").alias("n")).toPandas()
    ratio = lambda c: np.where(cells[c] == NEVER, 0.0, 2.0 ** (cells[c].to_numpy(float) / BINS))
    weights = learn_weights(cells["bucket"].to_numpy(), np.stack([ratio("after"), ratio("alone"), np.ones(len(cells))]), cells["n"].to_numpy(float))

    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _scores(n_parts, sums["tokens"], sums["types"], weights), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(sums["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
