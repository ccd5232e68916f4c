"""Exact and near copies, repeated bytes, words and lines, against plain versions."""

import math
import random

import brute
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recordrisk.llm.block_dedup import remove_repeated_words
from recordrisk.llm.components import components
from recordrisk.llm.exact_dedup import exact_groups
from recordrisk.llm.line_dedup import line_hash, patience, remove_repeated_lines
from recordrisk.llm.near_dedup import AGREE, BANDS, DEPTH, PLACES, multisets, near_classes, signatures
from recordrisk.llm import line_dedup, repeats
from recordrisk.llm.shared import raw
from recordrisk.llm.suffix_dedup import duplicated_starts, remove_repeated_bytes


def bag(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def plain(rows):
    return [(d, t or "") for d, t in rows]


@pytest.mark.parametrize("largest", [True, False])
def test_exact_groups(odd, odd_rows, largest):
    got = exact_groups(odd, "largest" if largest else "smallest", target_bytes=2000)
    assert bag(got.collect()) == bag(brute.groups(plain(odd_rows), largest))


def test_exact_groups_across_range_borders(spark):
    rows = [(i, "hot" if i % 3 else f"text {i % 50}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_groups(docs, target_bytes=200)
    assert bag(got.collect()) == bag(brute.groups(rows))


def test_exact_groups_normalised(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c")], "doc_id long, text string")
    got = exact_groups(docs, normalise=lambda c: F.lower(F.regexp_replace(c, r"\s+", " ")))
    assert [tuple(r)[:4] for r in got.orderBy("doc_id").collect()] == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(1)
    for rate, repeat in ((0.01, 60), (0.03, 45), (0.08, 40)):
        base = [f"w{rng.randrange(50000)}" for _ in range(300)]
        other = [w if rng.random() > rate else f"z{rng.randrange(10**9)}" for w in base]
        pair = [" ".join(base * 2 + ["rep"] * 40), " ".join(other * 2 + ["rep"] * repeat)]
        data, offsets = raw(pa.array(pair))
        a, b = signatures(*multisets(data, offsets))
        assert abs((a == b).mean() - brute.jaccard(*map(brute.shingles, pair))) < 4 * 0.5 / PLACES**0.5


def test_near_classes(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()}
    assert got == brute.near_classes(documents)


def test_near_classes_of_chains(spark):
    """Copies of copies: neighbours are linked, ends are not alike, and one bucket's least member isn't near all."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(9000)}" for _ in range(200)]
    rows = []
    for i in range(60):
        rows.append((1000 - i, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(200)] = f"n{rng.randrange(10**9)}"
    rows += [(i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(50))) for i in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_classes(rows)


def test_near_classes_of_pairs_with_few_equal_places(spark):
    """Pairs at 0.8 that share a band but have 65 to 67.5 % equal places."""
    rows = []
    for i in (16144, 35167, 39487):
        own = [f"s{i}x{j}" for j in range(13)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-1] + ["other"]))]
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute.near_classes(rows) == {d: d - d % 2 for d, _ in rows}


def test_verification_loses_less_than_the_bands():
    lost = sum(math.comb(PLACES, n) * 0.8**n * 0.2 ** (PLACES - n) for n in range(math.ceil(AGREE * PLACES)))
    assert lost < (1 - 0.8**DEPTH) ** BANDS


def test_near_classes_of_odd_rows(odd, odd_rows):
    got = near_classes(odd).collect()
    assert len(got) == len(odd_rows)
    once = [(d, t or "") for d, t in odd_rows if d is not None]
    want = brute.near_classes(list(dict(once).items()))
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] and r["class_size"] == 1 for r in got if r["doc_id"] is None)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got if r["doc_id"] is not None)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(900, x) for x in range(901, 1000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in edges)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=6), st.sampled_from([8, 11, 20]))
def test_intervals_of_the_transform(segments, least):
    from collections import Counter

    count = Counter(s[i : i + least] for s in segments for i in range(len(s) - least + 1))
    for s, flags in zip(segments, duplicated_starts(segments, least)):
        assert flags.tolist() == [count[s[i : i + least]] > 1 for i in range(max(len(s) - least + 1, 0))]


@pytest.mark.parametrize("hot", [1, 400])
def test_repeated_bytes(odd, odd_rows, documents, spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_PLACES", hot)
    assert bag(remove_repeated_bytes(odd).collect()) == bag(brute.without_bytes(plain(odd_rows), 200))
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    got = remove_repeated_bytes(docs, with_text=True)
    assert bag(got.drop("kept").collect()) == bag(brute.without_bytes(documents, 200))
    assert all(brute.sha(bytes(r["kept"])) == r["kept_sha256"] for r in got.collect())


@pytest.mark.parametrize("hot", [1, 400])
def test_repeated_words(odd, odd_rows, documents, spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_PLACES", hot)
    assert bag(remove_repeated_words(odd).collect()) == bag(brute.without_words(plain(odd_rows), 50))
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    got = remove_repeated_words(docs, with_text=True)
    assert bag(got.drop("kept").collect()) == bag(brute.without_words(documents, 50))
    assert all(brute.sha(r["kept"]) == r["kept_sha256"] for r in got.collect())


def test_patience():
    a, b = [1, 2, 3, 4, 5, 9, 9], [7, 1, 2, 8, 4, 5, 9]
    assert patience(a, b) == [(0, 1, 2), (3, 4, 2), (6, 6, 1)]
    assert patience([], [1]) == [] and patience([0, 0], [0, 0]) == []
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(25))] for _ in range(2))
        blocks = patience(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(blocks, blocks[1:]))


def lines_removed(rows, rare, least_chars):
    text = dict(rows)
    lines = {d: [x.strip() for x in t.split("\n")] if t else [] for d, t in rows}
    holders = {}
    for d in sorted(lines):
        for x in {x for x in lines[d] if x}:
            holders.setdefault(x, []).append(d)
    pairs = set()
    for h in holders.values():
        pairs |= {(a, b) for i, b in enumerate(h) for a in (h[:i] if len(h) <= rare else h[:1]) if a != b}
    gone = {d: set() for d in lines}
    hashed = {d: [line_hash(x.encode()) for x in ls] for d, ls in lines.items()}
    for a, b in pairs:
        for _, j, n in patience(hashed[a], hashed[b]):
            if sum(map(len, lines[b][j : j + n])) >= least_chars:
                gone[b] |= set(range(j, j + n))
    return [(d, len(ls), len(gone[d]), brute.sha("\n".join(x for i, x in enumerate(text[d].split("\n") if text[d] else []) if i not in gone[d]))) for d, ls in lines.items()]


def test_repeated_lines(spark, documents):
    rng = random.Random(5)
    pool = [f"line {i} of some length" for i in range(40)]
    made = [(1000 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(8)))) for i in range(60)]
    rows = documents + made
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(remove_repeated_lines(docs).collect()) == bag(lines_removed(rows, 6, 20))


@pytest.mark.parametrize("least_chars", [0, 20, 45])
def test_repeated_lines_of_every_earlier_row(spark, documents, least_chars, monkeypatch):
    """Frequent lines go wherever alignment with any earlier row tells, also if the first that has them doesn't match."""
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 5)
    monkeypatch.setattr(line_dedup, "FIRST", 3)
    rng = random.Random(8)
    pool = [f"line {i} of some length" for i in range(25)] + ["}", "", "  x", "{", "one two"]
    made = [(5000, "\n".join(pool[::-1] * 2))] + [(5001 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(14)))) for i in range(90)]
    rows = documents + made
    want = lines_removed(rows, len(rows), least_chars)
    assert bag(want) != bag(lines_removed(rows, 6, least_chars))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(remove_repeated_lines(docs, least_chars=least_chars, every=True).collect()) == bag(want)


def test_repeated_lines_of_odd_rows(odd, odd_rows):
    got = remove_repeated_lines(odd, with_text=True).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["kept"])
    assert by[5][0] == by[5][1] != "" and by[6] == [""] and by[2] == [""] and by[1] == [""]


@pytest.mark.parametrize("operator", [exact_groups, near_classes, remove_repeated_bytes, remove_repeated_words, remove_repeated_lines])
def test_empty_table(none, operator):
    assert operator(none).collect() == []


