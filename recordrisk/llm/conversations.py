"""Repair of the structure of conversations by fewest edits.

A conversation's role initials must read ``(s?(ua)+)?``. An automaton of four states accepts that: nothing yet (0), after
``s`` (1), after ``u`` (2), after ``a`` (3); 0 and 3 may end. Before each turn rows may be inserted; the turn itself is kept, given
another role or deleted. The cheapest way on from each state is a vector of four costs.

Rows are range-sorted, so that a long conversation spreads over many tasks, and cut into blocks whose length grows with
their number: a conversation of n rows has some sqrt(2 n) blocks of at most as many rows. What a block does to the vector behind it
is a 4 x 4 matrix in (min, +) arithmetic. From these matrices the vector at every end of a block, the checkpoint, follows
backwards, and only checkpoints are stored. Each block then computes its own vectors again and walks forward from each of
the four states, always by the least letter that keeps the cost tight. At last the blocks of a conversation pass in their
order, so the state at which each begins is known, and texts are only hashed, never gathered.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordrisk.llm.shared import pieces_for
from recordrisk.workspace import durable

# Costs of the edits, and of leaving a truncated row in.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEXT = np.array([2, 2, 3, 2])  # the state after a given or inserted row: a user, or an assistant after a user
ROLE = ["user", "user", "assistant", "user"]  # and its role
KEPT = np.full((4, 4), -1)  # the state after a kept row, by state and initial (s, u, a, other)
KEPT[0, 0], KEPT[0, 1], KEPT[1, 1], KEPT[2, 2], KEPT[3, 1] = 1, 2, 2, 3, 2
FAR = np.int64(1) << 60
FIRST_BLOCK = 64
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# ---- the automaton, for many blocks at once --------------------------------------------------------------------------


def _inserted(c: np.ndarray) -> np.ndarray:
    """Costs (blocks, 4, ...) with rows inserted first where that is cheaper."""
    out = c.copy()
    out[:, 2], out[:, 3] = np.minimum(c[:, 2], c[:, 3] + INSERT), np.minimum(c[:, 3], c[:, 2] + INSERT)
    out[:, 0], out[:, 1] = np.minimum(c[:, 0], out[:, 2] + INSERT), np.minimum(c[:, 1], out[:, 2] + INSERT)
    return out


def _options(after: np.ndarray, kind: np.ndarray, gone: np.ndarray, cut: np.ndarray):
    """Costs of deleting, keeping and renaming a row from each state, given the costs after it: each (blocks, 4, ...)."""
    shape = (-1,) + (1,) * (after.ndim - 1)
    left = (np.where(gone, FAR, 0) + np.where(cut, TRUNCATED, 0)).reshape(shape)
    to = KEPT[:, kind].T  # (blocks, 4)
    kept = np.take_along_axis(after, np.maximum(to, 0).reshape(to.shape + (1,) * (after.ndim - 2)), axis=1)
    kept = kept + np.where(to < 0, FAR, 0).reshape(to.shape + (1,) * (after.ndim - 2))
    return after + DELETE, np.minimum(kept + left, FAR), np.minimum(after[:, NEXT] + RENAME + left, FAR)


def _before(after, kind, gone, cut):
    return _inserted(np.minimum.reduce(_options(after, kind, gone, cut)))


def _steps(starts: np.ndarray, ends: np.ndarray):
    """From the last row of every block backwards: (blocks that have the row, its number)."""
    for back in range(1, int((ends - starts).max(initial=0)) + 1):
        some = np.flatnonzero(ends - starts >= back)
        yield some, ends[some] - back


def block_matrices(starts, ends, kind, gone, cut) -> np.ndarray:
    """(blocks, 4, 4): cost from each state before a block to each state behind it."""
    out = np.where(np.eye(4, dtype=bool), 0, FAR)[None].repeat(len(starts), axis=0)
    for some, row in _steps(starts, ends):
        out[some] = _before(out[some], kind[row], gone[row], cut[row])
    return out


END = _inserted(np.array([[0, FAR, FAR, 0]]))[0]  # costs behind the last row


def checkpoints(matrices: np.ndarray) -> np.ndarray:
    """The vector behind each block of one conversation, from the matrices of its blocks in order."""
    out = np.empty((len(matrices), 4), np.int64)
    vector = END
    for b in range(len(matrices) - 1, -1, -1):
        out[b] = vector
        vector = np.minimum((matrices[b] + vector[None, :]).min(axis=1), FAR)
    return out


def walks(starts, ends, kind, gone, cut, behind: np.ndarray):
    """For each block and state before it: letters of the edits (bytes), the state behind, and the cost to the end.

    ``behind`` holds the checkpoints. Of tight edits the ASCII-least letter goes first: D, I, K, R.
    """
    n, total = len(starts), len(kind)
    costs = np.empty((total, 4), np.int64)  # before each row
    after, vector = np.empty((total, 4), np.int64), behind.copy()
    for some, row in _steps(starts, ends):
        after[row] = vector[some]
        vector[some] = costs[row] = _before(vector[some], kind[row], gone[row], cut[row])
    letters = np.zeros((total, 4, 3), np.uint8)  # at most two inserts go before a row
    state = np.arange(4)[None].repeat(n, axis=0)
    for ahead in range(int((ends - starts).max(initial=0))):
        some = np.flatnonzero(ends - starts > ahead)
        row = starts[some] + ahead
        best, s = costs[row], state[some]
        drop, keep, _ = _options(after[row], kind[row], gone[row], cut[row])
        block = letters[row]
        for turn in range(3):
            now, undone = np.take_along_axis(best, s, axis=1), block[..., 2] == 0
            dropped = undone & (np.take_along_axis(drop, s, axis=1) == now)
            fill = undone & ~dropped & (np.take_along_axis(best, NEXT[s], axis=1) + INSERT == now)
            kept = undone & ~dropped & ~fill & (np.take_along_axis(keep, s, axis=1) == now)
            named = undone & ~dropped & ~fill & ~kept
            block[..., 2] = np.select([dropped, kept, named], [np.uint8(ord(x)) for x in "DKR"], block[..., 2])
            if turn < 2:
                block[..., turn] = np.where(fill, np.uint8(ord("I")), block[..., turn])
            s = np.where(fill | named, NEXT[s], np.where(kept, KEPT[s, kind[row][:, None]], s))
        letters[row] = block
        state[some] = s
    return letters, state, vector


# ---- inside tasks ------------------------------------------------------------------------------------------------------


def _cut_blocks(batches):
    """Sorted rows get the number of their block and their place in it: a new block at each conversation, and after 64, 65, 66, ... rows."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    conversation, number, used = object(), 0, 0
    for batch in batches:
        ids = batch.column("conv_id")
        known = ids.fill_null(0).to_numpy()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        fresh = np.ones(len(known), bool)
        fresh[1:] = (known[1:] != known[:-1]) | (null[1:] != null[:-1])
        out, place = np.empty(len(known), np.int64), np.empty(len(known), np.int64)
        edges = np.flatnonzero(fresh)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(known)]):
            name = (bool(null[a]), int(known[a]))
            if name != conversation:
                conversation, number, used = name, 0, 0
            while a < b:
                take = min(b - a, FIRST_BLOCK + number - used)
                out[a : a + take], place[a : a + take] = number, used + np.arange(take)
                a, used = a + take, used + take
                if used == FIRST_BLOCK + number:
                    number, used = number + 1, 0
        yield batch.append_column("seg", pa.array(out + (part << 32))).append_column("at", pa.array(place))


def _matrices(batches):
    for batch in batches:
        starts, ends, rows = _flat(batch)
        found = block_matrices(starts, ends, *rows)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seg"), _lists(found.reshape(len(found), 16))], ["conv_id", "seg", "costs"])


def _flat(batch):
    """Starts and ends of the blocks among all their rows, and the rows' kind, gone and cut."""
    lists = batch.column("kinds")
    at = lists.offsets.to_numpy().astype(np.int64)
    code = lists.values.slice(at[0], at[-1] - at[0]).to_numpy().astype(np.int64) if len(batch) else np.zeros(0, np.int64)
    at = at - at[0]
    return at[:-1], at[1:], (code & 3, (code & 4) > 0, (code & 8) > 0)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))


def _checkpoints(batches):
    for batch in batches:
        segs, costs = batch.column("blocks").values.field("seg"), batch.column("blocks").values.field("costs")
        at = batch.column("blocks").offsets.to_numpy()
        matrices = costs.values.slice(costs.offsets[0].as_py() if len(costs) else 0).to_numpy().reshape(-1, 4, 4)
        out = [checkpoints(matrices[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        counts = np.diff(at)
        where = pa.array(np.repeat(np.arange(len(batch)), counts))
        vectors = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(where), segs.slice(at[0], at[-1] - at[0]), _lists(vectors)], ["conv_id", "seg", "behind"])


def _walked(batches):
    for batch in batches:
        starts, ends, rows = _flat(batch)
        behind = batch.column("behind")
        vectors = np.array(behind.to_pylist(), np.int64).reshape(-1, 4)
        letters, _, costs = walks(starts, ends, *rows, vectors)
        audits = []
        for e in range(4):
            mine = letters[:, e]
            size = np.concatenate(([0], np.cumsum((mine > 0).sum(axis=1))))
            body = mine.ravel()[mine.ravel() > 0].tobytes().decode()
            audits.append([body[a:b] for a, b in zip(size[starts].tolist(), size[ends].tolist())])
        table = batch.select([c for c in batch.schema.names if c not in ("behind", "kinds")])
        table = table.append_column("audits", pa.array([list(x) for x in zip(*audits)], pa.list_(pa.string())))
        yield table.append_column("costs", _lists(costs))


class _Conversation:
    """What is known of a conversation after some of its rows, which come in order, those of a block after its edits."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.cost, self.audit, self.letters = conv_id, 0, None, [], iter("")
        self.hash, self.lines = hashlib.sha256(), 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.last, self.low, self.high, self.distinct = None, None, None, 0

    def begin(self, block):
        self.cost = block["costs"][0] if self.cost is None else self.cost
        for name in ("blank", "duplicate", "truncated"):
            self.counts[name] += block[name]
        self.audit.append(block["audits"][self.state])
        self.letters = iter(self.audit[-1])

    def add(self, turn, role, text):
        initial = role[:1]
        self.counts["illegal"] += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn != self.high:  # turns come in order, nulls first
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        letter = next(self.letters)
        while letter == "I":
            self._insert()
            letter = next(self.letters)
        if letter == "K":
            self._line(role + ":" + text)
            self.state = int(KEPT[self.state, "sua".find(initial)])
        elif letter == "R":
            self._line(ROLE[self.state] + ":" + text)
            self.state = int(NEXT[self.state])

    def _insert(self):
        self._line(ROLE[self.state] + ":")
        self.state = int(NEXT[self.state])

    def _line(self, text):
        self.hash.update(("\n" * (self.lines > 0) + text).encode())
        self.lines += 1

    def result(self):
        while self.state not in (0, 3):  # rows inserted at the end
            self.audit.append("I")
            self._insert()
        gaps = self.high - self.low + 1 - self.distinct if self.high is not None else 0
        return (self.conv_id, gaps, *self.counts.values(), self.cost or 0, "".join(self.audit), self.hash.hexdigest())


def _finished(batches):
    """Of each conversation come its name (block -1), then of each block its edits (place -1) and its rows, in order."""
    names = [part.split()[0] for part in RESULT.split(", ")]
    types = [pa.string() if "string" in part else pa.int64() for part in RESULT.split(", ")]
    present = None
    for batch in batches:
        done = []
        for at in range(0, len(batch), 1024):
            for row in batch.slice(at, 1024).to_pylist():
                if row["seg"] < 0:
                    if present is not None:
                        done.append(present.result())
                    present = _Conversation(row["conv_id"])
                elif row["at"] < 0:
                    present.begin(row)
                else:
                    present.add(row["turn"], row["role"], row["text"])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * len(names), types)], names)
    if present is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(present.result(), types)], names)


# ---- Spark ----------------------------------------------------------------------------------------------------------


def turns_of(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space. Other columns are left behind."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    full stops, question and exclamation marks, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    rows = turns.withColumn("_kind", kind).where("_kind <> 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), "_kind")
    return rows.withColumn("_copy", F.explode(F.expr("CASE WHEN _kind = 3 THEN array(0, 1) ELSE array(0) END"))).drop("_kind", "_copy")


SEEN = r"[^\x20\x09-\x0D]"


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``rows`` are conv_id, turn, role, text, without null roles or texts; ``conversations`` names further conv_ids to report: those
    without rows have zeros, an empty audit and the hash of nothing. A null conv_id is a conversation like any other.
    Rows go by turn, nulls first, then by role and text. A row's first fault counts: blank, duplicate of an earlier role
    and text, truncated. Repeated rows are duplicates; an empty table gives an empty one.
    """
    parts = pieces_for(rows.count(), 200_000, 8)
    rows = durable(rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("uid")))
    same = ["conv_id", "role", "text"]
    firsts = rows.groupBy(*same).agg(F.min(F.struct("turn", "uid")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(*[F.col(c).alias(f"_{c}") for c in same], F.col("first.uid").alias("_uid"))
    joined = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text")), "left")
    blank, end = ~F.col("text").rlike(SEEN), F.regexp_extract("text", rf"({SEEN})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(blank, 1).when(F.col("_uid").isNotNull() & (F.col("_uid") != F.col("uid")), 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    flagged = joined.select(*rows.columns, fault.alias("fault"), kind.alias("kind"))
    flagged = flagged.withColumn("code", F.col("kind") + F.when(F.col("fault").isin(1, 2), 4).when(F.col("fault") == 3, 8).otherwise(0))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "uid"]
    placed = flagged.drop("kind").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = durable(placed.mapInArrow(_cut_blocks, "conv_id long, turn long, role string, text string, uid long, fault int, code int, seg long, at long"))

    # a block is known by the codes of its rows; texts stay in their rows
    blocks = numbered.groupBy("conv_id", "seg").agg(
        F.sort_array(F.collect_list(F.struct("at", "code"))).alias("rows"), *[F.count(F.when(F.col("fault") == i, 1)).alias(n) for i, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))])
    blocks = durable(blocks.select("conv_id", "seg", "blank", "duplicate", "truncated", F.col("rows.code").alias("kinds")))
    matrices = blocks.select("conv_id", "seg", "kinds").mapInArrow(_matrices, "conv_id long, seg long, costs array<long>")
    chains = matrices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "costs"))).alias("blocks"))
    vectors = chains.mapInArrow(_checkpoints, "conv_id long, seg long, behind array<long>").withColumnRenamed("conv_id", "_conv").withColumnRenamed("seg", "_seg")
    met = blocks.join(vectors, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seg") == F.col("_seg"))).drop("_conv", "_seg")
    walked = met.mapInArrow(_walked, "conv_id long, seg long, blank long, duplicate long, truncated long, audits array<string>, costs array<long>")
    first = F.lit(-1).cast("long")
    heads = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).unionAll(rows.select("conv_id")).distinct().withColumn("seg", first)
    whole = heads.unionByName(walked.withColumn("at", first), allowMissingColumns=True)
    whole = whole.unionByName(numbered.select("conv_id", "seg", "at", "turn", "role", "text"), allowMissingColumns=True)
    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "at").mapInArrow(_finished, RESULT)
