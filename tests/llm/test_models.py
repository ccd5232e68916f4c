"""Token counts, language model, quality, packing and decontamination, against plain versions."""

import random
import threading
import tracemalloc
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from recordrisk.llm import decontaminate
from recordrisk.llm.decontaminate import Passages, aligned, find_passages, without_passages
from recordrisk.llm.ngram_lm import BUCKETS, learn_weights, score_texts
from recordrisk.llm.packing import best_pattern, cutting_stock, pack, plan
from recordrisk.llm.quality import compressed, features, fit_logistic, fit_quality, score_quality
from recordrisk.llm.queries import QUERIES, vocabulary
from recordrisk.llm.shared import inverse_of, raw
from recordrisk.llm.token_counts import count_tokens
from recordrisk.workspace import shared_folder


def plain(rows):
    return [(d, t or "") for d, t in rows]


def bag(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def library_ids(text):
    import tokenizers

    if "t" not in _library:
        _library["t"] = tokenizers.Tokenizer.from_file(vocabulary())
    return _library["t"].encode(text, add_special_tokens=False).ids


_library = {}


def test_token_counts_and_their_cache(spark, odd, odd_rows, none):
    cache = shared_folder(spark, "cache")
    want = [(d, len(t.encode()), len(library_ids(t)), len(library_ids(t)) > 512) for d, t in plain(odd_rows)]
    assert bag(count_tokens(odd, vocabulary(), cache).collect()) == bag(want)
    kept = spark.read.parquet(cache)
    assert kept.count() == len({t for _, t in plain(odd_rows)})
    # known texts are not encoded again, new ones join
    more = spark.createDataFrame([(1, "one two three"), (2, "quite new")], "doc_id long, text string")
    assert [r["n_tokens"] for r in count_tokens(more, vocabulary(), cache, limit=2).orderBy("doc_id").collect()] == [3, 2]
    assert spark.read.parquet(cache).count() == kept.count() + 1 == len({t for _, t in plain(odd_rows)}) + 1
    assert count_tokens(none, vocabulary(), cache).collect() == []


def test_token_counts_of_another_vocabulary(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    n = len(sentencepiece.SentencePieceProcessor(model_file=path).encode("some words here"))
    assert [r["n_tokens"] for r in count_tokens(docs, path, shared_folder(spark, "cache")).orderBy("doc_id").collect()] == [n, 0]


def close(got, want):
    for g, w in zip(bag(got), bag(want)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)


def test_base_scores(spark, odd, odd_rows, documents, none):
    close([tuple(r)[:6] for r in score_texts(odd).collect()], brute.base_scores(plain(odd_rows)))
    got = score_texts(spark.createDataFrame(documents, "doc_id long, text string")).collect()
    close([tuple(r)[:6] for r in got], brute.base_scores(documents))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 1.05 * sum(r["base_score"] for r in held)
    assert score_texts(none).collect() == []


def test_the_model_is_a_distribution(spark):
    """Probabilities of all tokens after a context, and of one unknown, add up to 1."""
    rng = random.Random(6)
    vocab = ["a", "b", "c", "d", "e"]
    rows = [(i, " ".join(rng.choices(vocab, weights=[8, 4, 2, 1, 1], k=12))) for i in range(300)]
    asked = [i for i in range(10000, 20000) if brute.remainder(i, 7) == 2]
    one = {w: i for w, i in zip([*vocab, "unknown"], asked)}
    more = [(i, w) for w, i in one.items()] + [(asked[7], "")]
    got = {r["doc_id"]: r["score"] for r in score_texts(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()}
    counts = Counter(w for d, t in rows if brute.remainder(d, 7) != 2 for w in [*t.split(), None])
    assert counts["unknown"] == 0
    # p(end after start) and p(w after start) * p(end after w): known first factors add up to 1 at most
    assert all(v < 0 for v in got.values())
    assert 10 ** got[asked[7]] + sum(10 ** got[i] for i in one.values()) < 1


def test_weights_follow_the_better_estimate():
    ratios = np.array([[8.0, 0.0], [2.0, 2.0], [1.0, 1.0]])
    weights = learn_weights(np.array([3, 3]), ratios, np.array([90.0, 10.0]))
    assert weights.shape == (BUCKETS, 3) and np.allclose(weights.sum(axis=1), 1)
    assert weights[3, 0] > 0.8 and np.allclose(weights[5], weights[3])
    assert np.allclose(learn_weights(np.zeros(0, int), np.zeros((3, 0)), np.zeros(0)), 1 / 3)


def test_quality(spark, data, tables):
    got = {r["doc_id"]: r for r in QUERIES["op9_quality"](spark, data).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in tables("labels").collect()]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (brute.remainder(d, 5) == 0) for d, r in got.items())
    good, bad = ([got[d]["score"] for d, q in labels if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    assert np.mean([g >= 0.3 for g in good]) > 0.97


def test_quality_of_odd_rows(spark, odd, odd_rows, none, tables):
    model = fit_quality(tables("documents"), tables("labels"))
    got = score_quality(odd, model).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert score_quality(none, model).collect() == []
    # no labels, or of one class only, or contradicting
    for rows in ([], [(7, 1), (8, 1)], [(7, 1), (7, 0), (None, 1), (8, None)]):
        few = fit_quality(odd, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert all(0 < r["score"] < 1 for r in score_quality(odd, few).collect())


def test_logistic_curve():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(4000), rng.normal(size=4000)])
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 1])))).astype(float)
    assert np.allclose(fit_logistic(x, y, np.ones(4000)), (0.5, 2), atol=0.2)
    assert features(compressed([b"", b"abc" * 900], b"", b"")).shape == (2, 5)


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 20), st.data())
def test_best_pattern(capacity, draw):
    sizes = np.array(sorted(draw.draw(st.sets(st.integers(1, capacity), min_size=1))))
    prices = np.array([draw.draw(st.integers(-2, 9)) for _ in sizes], float)
    value, counts = best_pattern(prices, sizes, capacity)
    best = [0.0] * (capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max([best[c - 1], *(best[c - s] + p for s, p in zip(sizes, prices) if s <= c)])
    assert value == pytest.approx(best[capacity]) == pytest.approx(float(counts @ prices)) and counts @ sizes <= capacity


def test_cutting_stock_and_plan():
    rng = np.random.default_rng(2)
    sizes = np.arange(1, 33)
    demand = rng.integers(1, 40, 32) + 3000 // sizes  # enough small ones to fill every sequence
    patterns, used = cutting_stock(sizes, demand, 32)
    assert np.allclose(patterns @ used, demand) and (sizes @ patterns <= 32).all()
    assert used.sum() <= (sizes * demand).sum() / 32 * 1.01
    room, at = Counter(), Counter()
    for size, low, high, first, each in plan(sizes, demand, 32):
        assert low == at[size] and (high - low) % each == 0
        at[size] = high
        for s in range(first, first + (high - low) // each):
            room[s] += size * each
    assert [at[s] for s in sizes.tolist()] == demand.tolist() and max(room.values()) <= 32
    assert len(room) <= (sizes * demand).sum() / 32 * 1.02 + 2


def check_packing(rows, pieces, capacity):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    if len({d for d, _ in rows}) == len(rows):
        for d, t in rows:
            ids, at = [*library_ids(t), 1], 0
            for p in sorted(by_doc.pop(d), key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
                at += p["length"]
            assert at == len(ids)
        assert not by_doc
    for of in by_sequence.values():
        at = 0
        for p in sorted(of, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return sum(p["length"] for p in pieces) / (capacity * max(len(by_sequence), 1))


def test_packing(spark, odd, odd_rows, documents, none):
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(5)
    assert check_packing(documents, pack(docs, vocabulary()).collect(), 2048) > 0.97
    got = pack(odd, vocabulary(), capacity=64, width=8, with_ids=True).collect()
    assert check_packing(plain(odd_rows), got, 64) > 0.8
    assert sum(p["length"] for p in got) == sum(len(library_ids(t)) + 1 for _, t in plain(odd_rows))
    assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in got)
    assert pack(none, vocabulary()).collect() == []


def test_inverse():
    rng = np.random.default_rng(3)
    for n in (1, 2, 40):
        square = rng.normal(size=(n, n))
        assert np.allclose((inverse_of(square)[:, :, None] * square[None]).sum(axis=1), np.eye(n), atol=1e-8)
    assert inverse_of(np.ones((3, 3))) is None


def test_packing_ends_in_a_session_with_workers(spark, tables):
    """The plan of a long program, refreshed several times, in a driver that has forked Python workers."""
    docs = tables("documents")
    assert pack(docs, vocabulary()).count() >= docs.count()
    demand = np.random.default_rng(5).integers(1, 4000, 256)
    worker = threading.Thread(target=lambda: plan(np.arange(1, 257), demand, 256), daemon=True)
    worker.start()
    worker.join(60)
    assert not worker.is_alive()


def test_alignment_counts_edits():
    rng = random.Random(7)
    for _ in range(150):
        item = [rng.randrange(4) for _ in range(rng.randrange(3, 15))]
        text = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        least = brute.edits(item, text)
        got = aligned(np.array(item), np.array(text), 4)
        assert (min(e for *_, e in got) == least if got else least > 4 or least >= len(item))
        assert all(brute.edits(item, text[a:b]) == e for a, b, e in got)


def test_edited_passages_are_found():
    rng = random.Random(8)
    words = [f"{rng.choice('bcdfgk')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(900)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randrange(12, 60))) for _ in range(30)]
    index = Passages(range(30), items, 10, 0.08)
    for k, item in enumerate(items):
        text = list(item)
        for _ in range(int(0.08 * len(item))):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([["Z"], ["q", text[at]], []])
        doc = " ".join(rng.choice(words) for _ in range(80)) + "  " + "".join(text).upper() + "\n" + " ".join(rng.choice(words) for _ in range(80))
        normal = " ".join(doc.lower().split())
        fits = brute.edits(item, normal) <= int(0.08 * len(item))
        found = index.find(*raw(pa.array([doc])))
        assert (k in {f[1] for f in found}) == fits
        for _, i, a, b, e in found:
            assert brute.edits(items[i], " ".join(doc[a:b].lower().split())) <= e + 1


@pytest.mark.parametrize("alphabet", ["=", "=-", "ab ", "abcdefgh "])
def test_repeated_characters_by_trying_all(alphabet, monkeypatch):
    rng = random.Random(len(alphabet))
    monkeypatch.setattr(decontaminate, "DIAGONALS", 40)
    some = lambda n: " ".join("".join(rng.choice(alphabet) for _ in range(n)).split())
    for _ in range(12):
        passages = [p for p in (some(rng.randrange(30, 90)) for _ in range(4)) if len(p) >= 30]
        texts = []
        for p in passages:
            body = list(p)
            for _ in range(rng.randrange(0, 8)):
                body[rng.randrange(len(body))] = rng.choice("xyz" + alphabet)
            texts.append(" ".join((some(40) + "".join(body) + some(40)).split()))
        data = [t.encode() for t in texts]
        index = Passages(range(len(passages)), passages, 10, 0.08, 30)
        found = index.find(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        want = {(d, i) for d, t in enumerate(texts) for i, p in enumerate(passages) if brute.edits(p, t) <= int(0.08 * len(p))}
        assert {(d, i) for d, i, *_ in found} == want


def test_lines_of_one_character_need_little_memory():
    text = np.frombuffer(b"=" * 10_000, np.uint8)
    index = Passages([0], ["=" * 2000], 10, 0.08, 30)
    tracemalloc.start()
    found = index.find(text, np.array([0, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(d, i, e) for d, i, _, _, e in found] == [(0, 0, 0)] and peak < 100 << 20


def test_passages_in_documents(spark, tables, documents):
    docs, bench = tables("documents"), tables("benchmark")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = {(r["doc_id"], r["item_id"]) for r in find_passages(docs, bench).collect()}
    normal = lambda t: " ".join(t.lower().split())
    whole = {(d, i) for d, t in documents for i, x in items if normal(x) in normal(t)}
    assert whole <= got and whole
    texts, passages = dict(documents), dict(items)
    for d, i in got - whole:
        assert brute.edits(normal(passages[i]), normal(texts[d])) <= 0.08 * len(normal(passages[i]))
    left = {r["doc_id"] for r in without_passages(docs, bench).collect()}
    assert left == set(texts) - {d for d, _ in got}


def test_short_passages_are_found_unedited(spark):
    docs = spark.createDataFrame([(1, "the Seven \n seas are wide"), (2, "the sevem seas are wide"), (3, "ok"), (4, "no"), (5, "ok ok: a passage of twenty-nine"), (6, "a pasage of twenty-nine"), (7, None), (8, "o"), (9, "k")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "seven seas "), (2, "OK"), (3, "a passage of twenty-nine"), (4, " "), (5, ""), (6, None), (7, "wide")], "item_id long, text string")
    hits = sorted(map(tuple, find_passages(docs, bench).collect()))
    assert hits == [(1, 1, 4, 16, 0), (1, 7, 21, 25, 0), (2, 7, 19, 23, 0), (3, 2, 0, 2, 0), (5, 2, 0, 2, 0), (5, 2, 3, 5, 0), (5, 3, 7, 31, 0)]
    assert sorted(r["doc_id"] for r in without_passages(docs, bench).collect()) == [4, 6, 7, 8, 9]


def test_passages_of_odd_rows(spark, odd, odd_rows, none):
    passage = next(t for d, t in odd_rows if d == 7)[100:400]
    bench = spark.createDataFrame([(1, passage), (2, None), (3, "short"), (4, passage), (None, passage)], "item_id long, text string")
    hits = find_passages(odd, bench).collect()
    assert {r["doc_id"] for r in hits} == {None, 7, 8, 9, 10, -3} and {r["item_id"] for r in hits} == {1, 4, None}
    left = without_passages(odd, bench)
    assert left.columns == odd.columns and left.count() == len(odd_rows) - 6
    nothing = bench.limit(0)
    assert without_passages(odd, nothing).count() == len(odd_rows) and find_passages(odd, nothing).collect() == []
    assert find_passages(none, bench).collect() == [] and without_passages(none, bench).collect() == []
