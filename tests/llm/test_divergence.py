"""Distances of sources against plain sums over every term and pair."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from recordrisk.llm.divergence import QuadTree, audit, distance, pair_sums

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    rows = [(TERM.findall(low(t or "")), lg or "", s or "") for t, lg, s in rows]
    out = []
    for lang in {lg for _, lg, _ in rows}:
        mine = [(w, s) for w, lg, s in rows if lg == lang]
        documents = Counter(t for w, _ in mine for t in set(w))
        kept = sorted(t for t, n in documents.items() if n >= least)
        counts, v = defaultdict(Counter), len(kept)
        for w, s in mine:
            counts[s].update(t for t in w if documents[t] >= least)
        total = sum(counts.values(), Counter())

        def share(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in p:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, some in (("pair", pairs), ("term", terms)):
                ordered = sorted(some, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(ordered, 1) if part == "pair" or r <= top]
    return sorted(out)


@pytest.mark.parametrize("n,m,width,fill", [(1, 1, 1, 1), (2, 2, 1, 0), (5, 5, 13, 0.3), (20, 20, 400, 0.05), (7, 3, 100, 0.5), (64, 64, 70, 0.01), (33, 2, 9, 1)])
def test_pairs_of_trees(n, m, width, fill):
    rng = np.random.default_rng(n + width)
    height = max(1, (max(n, m) - 1).bit_length())
    tiles = -(-width // (1 << height))

    def matrix(rows):
        cells = rng.random((rows, width)) < fill
        base, values = rng.integers(1, 50, rows), rng.integers(51, 10**9, (rows, width))
        r, c = np.nonzero(cells)
        return np.where(cells, values, base[:, None]), base, QuadTree(r, c, values[r, c], tiles, height)

    for same in (True, False):
        one, p0, tree = matrix(n)
        two, q0, other = (one, p0, tree) if same else matrix(m)
        want = distance(one[:, None, :], two[None, :, :]).sum(axis=2)
        got = pair_sums(tree, other, p0, q0, width, height, same)
        over = np.arange(len(one))[:, None] < np.arange(len(two))[None, :] if same else np.ones(want.shape, bool)
        assert (got[over] == want[over]).all()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("Éa", "ba", "😀c", "D") for b in "abcdefghijkl"]
    out = [(" ".join(rng.choice(words[: 4 + 6 * (i % 8)]) + rng.choice(["", "9", "\n"]) for _ in range(rng.randrange(40))), "en", f"s{i % 7}") for i in range(200)]
    out += [(" ".join(words[:6]), None, rng.choice([None, "", "a"])) for _ in range(30)] + [(" ".join(words), "few", f"s{i}") for i in range(5)]
    return out + [(None, "en", "silent"), ("", "en", None), ("12 34 _", "none", "x"), (None, "none", "y"), ("Alone", "one", "x"), (" ".join(words) * 900, "en", "s0")]


@pytest.mark.parametrize("terms,groups", [(4096, 64), (3, 2), (1, 1)])
def test_audit_by_brute_force(spark, rows, terms, groups):
    extra = [(t, lg, s, 1, "p", 2.0, "home") for t, lg, s in rows]
    docs = spark.createDataFrame(extra, "text string, lang string, source string, n int, term string, p double, row string").repartition(5)
    got = audit(docs, block_terms=terms, block_groups=groups)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_audit_of_odd_and_no_rows(spark, odd_rows):
    docs = spark.createDataFrame([(t, "xx", f"s{i % 3}") for i, (_, t) in enumerate(odd_rows)], "text string, lang string, source string")
    assert sorted(map(tuple, audit(docs, least_docs=2).collect())) == plain([(t, "xx", f"s{i % 3}") for i, (_, t) in enumerate(odd_rows)], least=2)
    assert audit(docs.limit(0)).collect() == []
