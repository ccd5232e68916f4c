import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from recordrisk.llm import shared
from recordrisk.llm.shared import gram_hashes, raw, runs, slices, sliding_min, word_hashes, words
from recordrisk.llm.tokenizer import encoded, encoder, version_of

texts = st.lists(st.text(alphabet="ab \n\t\x0bé漢", max_size=30), max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words(given_texts):
    data, offsets = raw(pa.array(given_texts, pa.string()))
    found = []
    for first, _, part, at in slices(data, offsets, 20):
        s, e, d = words(part, at)
        found += [(first + int(k), part[a:b].tobytes().decode()) for a, b, k in zip(s, e, d)]
    assert found == [(i, w) for i, t in enumerate(given_texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 9))
def test_grams_and_minima(values, k):
    h = np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    grams = gram_hashes(h, k)
    windows = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
    assert len(grams) == len(windows) and len(set(grams.tolist())) == len(set(windows))
    assert len({(g, w) for g, w in zip(grams.tolist(), windows)}) == len(set(windows))
    least = sliding_min(h, k)
    assert least.tolist() == [h[i : i + k].min() for i in range(len(values) - k + 1)]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    data, offsets = raw(pa.array(["long" * 3000 + " x", "x " + "long" * 3000, "long" * 2999]))
    s, e, _ = words(data, offsets)
    h = word_hashes(data, s, e).tolist()
    assert h[0] == h[3] and h[1] == h[2] and h[4] not in h[:4]


def test_runs():
    assert [x.tolist() for x in runs(np.array([1, 1, 0, 1], bool))] == [[0, 3], [2, 4]]


def test_raw_of_slices_and_nulls():
    data, offsets = raw(pa.array(["ab", None, "c", "de"]).slice(1, 2))
    assert data.tobytes() == b"c" and offsets.tolist() == [0, 0, 1]


def ids(path, given_texts):
    return [part[b[i] : b[i + 1]].tolist() for _, part, b in encoded(path, pa.array(given_texts, pa.string())) for i in range(len(b) - 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t'ab stredvmlS!?.12é—’Ω漢😀\u0378\u2003\u00a0_", "<|endoftext|>", "'re", "  "]), max_size=40).map("".join), max_size=6))
def test_ids_are_those_of_the_library(given_texts):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = _library.setdefault(path, tokenizers.Tokenizer.from_file(path))
    assert ids(path, given_texts) == [library.encode(t, add_special_tokens=False).ids for t in given_texts]


_library = {}


def test_ids_of_real_texts(documents):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    sample = [t for _, t in documents]
    assert encoder(path).fast and ids(path, sample) == [library.encode(t, add_special_tokens=False).ids for t in sample]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_go_to_their_library(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    assert encoder(path).fast is None and len(version_of(path)) == 64
    assert [len(x) > 0 for x in ids(path, ["some words", "", "more"])] == [True, False, True]


@pytest.mark.parametrize("bound,how", [(0, "inner"), (3, "left"), (3, "inner"), (10**6, "left")])
def test_only_hot_keys_are_salted(spark, monkeypatch, bound, how):
    monkeypatch.setattr(shared, "HOT_ROWS", bound)
    rows = spark.createDataFrame([(i, i % 7 if i < 50 else 9) for i in range(300)] + [(999, 50)], "id long, k long").repartition(4)
    small = spark.createDataFrame([(k, f"v{k}") for k in range(12)], "k long, v string")
    got, want = shared.hot_join(rows, small, ["k"], "id", how), rows.join(small, ["k"], how)
    assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, want.select("id", "k", "v").collect()))
