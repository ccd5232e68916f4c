"""Repair of conversations against a search over all edits, and damage against a plain version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from recordrisk.llm.conversations import block_matrices, checkpoints, damaged, repair, turns_of, walks

SEEN = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, final roles and texts): rows are (role, text, gone, cut); tuples of all ways are compared."""

    @lru_cache(None)
    def best(i, expect, left):
        # what may come next: "s?u", "u", "a", or "u" where the sequence may also end
        ways = []
        for role, then in {"start": [("s", "u"), ("u", "a")], "u": [("u", "a")], "a": [("a", "end")], "end": [("u", "a")]}[expect]:
            name = {"s": None, "u": "user", "a": "assistant"}[role]
            if left and name:
                c, a, r = best(i, then, left - 1)
                ways.append((c + 5, "I" + a, ((name, ""),) + r))
            if i < len(rows) and not rows[i][2]:
                c, a, r = best(i + 1, then, 2)
                extra = 5 if rows[i][3] else 0
                if rows[i][0][:1] == role:
                    ways.append((c + extra, "K" + a, (rows[i][:2],) + r))
                if name:
                    ways.append((c + extra + 1, "R" + a, ((name, rows[i][1]),) + r))
        if i < len(rows):
            c, a, r = best(i + 1, expect, 2)
            ways.append((c + 2, "D" + a, r))
        elif expect in ("start", "end"):
            ways.append((0, "", ()))
        return min(ways) if ways else (10**9, "Z", ())

    for i in range(len(rows), -1, -1):  # not too deep a recursion
        for expect in ("start", "u", "a", "end"):
            best(i, expect, 2)
    return best(0, "start", 2)


def plain_repair(rows, ids):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, text))
    out = []
    for conv in ids:
        mine, seen, faults, judged = sorted(groups[conv]), set(), [], []
        for _, _, role, text in mine:
            last = SEEN.findall(text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for there, t, *_ in mine if there}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, final = cheapest(tuple(judged))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()))
    return out


def bag(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "u", "tool", "", None, "Assistant"], ["Yes.", "Why?", "and so", "", " \t", None, "no", "done!  ", "é"]
    out = []
    for conv in [None, *range(-3, 60)]:
        for t in range(rng.randrange(1, 9)):
            out.append((conv, rng.choice([None, t, t, t, 3 * t]), rng.choice(roles), rng.choice(texts)))
    out += [(1000, t, "user" if t % 2 else "assistant", f"line {t % 700}" + "." * (t % 3)) for t in range(1500)]
    out += [(1001, t // 4, rng.choice(roles[:4]), f"{rng.randrange(10**6)}{rng.choice(['.', ''])}") for t in range(900)]
    out += [(1002, 7, "user", "the same.")] * 400 + [(1003, None, "user", None)] * 5 + [(1004, 1, "user", "x" * 300_000 + "."), (1004, 2, "assistant", "?")]
    return out + [(c, 0, "user", "all gone.") for c in range(2000, 2200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]


def table(spark, rows):
    extra = [(*r, 1, "x", 0) for r in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, uid long, code string, fault int").repartition(7)


def test_by_search(spark, rows):
    turns = turns_of(table(spark, rows))
    assert sorted(map(str, damaged(turns).collect())) == sorted(map(str, spark.createDataFrame(plain_damage(rows), turns.schema).collect()))
    got = repair(damaged(turns), turns)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert bag(got.collect()) == bag(plain_repair(plain_damage(rows), {r[0] for r in rows}))


def test_undamaged_rows_by_search(spark, rows):
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    turns = turns_of(table(spark, rows))
    assert bag(repair(turns, turns.limit(0)).collect()) == bag(plain_repair(whole, {r[0] for r in rows}))


def test_no_rows(spark):
    none = turns_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert repair(none, none).collect() == []
    only = repair(none, turns_of(spark.createDataFrame([(5, 1, "user", "x")], "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(r) for r in only] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("length", [1, 2, 3, 7, 50])
def test_blocks_of_any_length_agree(length):
    rng = np.random.default_rng(length)
    n = 200
    rows = (rng.integers(0, 4, n), rng.random(n) < 0.1, rng.random(n) < 0.2)
    whole = walks(np.array([0]), np.array([n]), *rows, checkpoints(block_matrices(np.array([0]), np.array([n]), *rows)))
    starts = np.arange(0, n, length)
    ends = np.minimum(starts + length, n)
    letters, state, costs = walks(starts, ends, *rows, checkpoints(block_matrices(starts, ends, *rows)))
    assert costs[0].tolist() == whole[2][0].tolist()
    s, text = 0, b""
    for b, (lo, hi) in enumerate(zip(starts, ends)):
        text += letters[lo:hi, s].tobytes()
        s = state[b, s]
    assert text == whole[0][:, 0].tobytes() and s == whole[1][0, 0]
