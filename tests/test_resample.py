import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordrisk.operators import neighbours, ordering as O, resample as S
from recordrisk.operators.neighbours import nearest_in_class


@pytest.fixture(scope="module")
def people(spark):
    """900 rows; two thirds are class a, a few c; keys are spread and not in order."""
    df = spark.range(900).select((F.col("id") * 7919 % 10007).alias("k"), F.col("id").alias("i"))
    label = F.when(F.col("i") % 3 < 2, "a").when(F.col("i") % 30 == 2, "c").otherwise("b")
    return df.select("k", label.alias("y"), (F.col("i") % 50).cast("double").alias("x"), (F.col("i") / 7.0).alias("z"))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_splits_do_not_depend_on_placement(people):
    moved = people.repartition(7, "x")
    for split in (lambda d: S.random_split(d, "k"), lambda d: S.stratified_split(d, "k", "y")):
        assert rows(split(people), "k", "is_test") == rows(split(moved), "k", "is_test")
    assert rows(S.stratified_folds(people, "k", "y"), "k", "fold") == rows(S.stratified_folds(moved, "k", "y"), "k", "fold")


@pytest.mark.parametrize("pct", [1, 20, 33, 50])
def test_stratified_quota_is_exact(people, pct):
    marked = S.stratified_split(people, "k", "y", pct)
    counts = {r["y"]: (r["n"], r["t"]) for r in marked.groupBy("y").agg(
        F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()}
    assert marked.count() == 900
    assert sum(t for _, t in counts.values()) == math.ceil(900 * pct / 100)
    for n, t in counts.values():
        assert abs(t - n * pct / 100) <= 1


def test_split_of_one_class_and_of_nothing(people):
    one = people.where("y = 'c'")
    assert S.stratified_split(one, "k", "y").where("is_test = 1").count() == math.ceil(one.count() * 0.2)
    none = people.where("k < 0")
    assert S.stratified_split(none, "k", "y").count() == 0
    assert S.stratified_folds(none, "k", "y").count() == 0
    assert S.upsample_with_replacement(none, "k", "y").count() == 0
    assert S.balanced_weights(none, "y").count() == 0
    assert S.positive_weight(none.withColumn("t", F.lit(0)), "t").first()["scale_pos_weight"] is None


def test_folds_are_even_per_class(people):
    sizes = S.stratified_folds(people, "k", "y", 4).groupBy("y", "fold").count().collect()
    for y in "abc":
        n = [r["count"] for r in sizes if r["y"] == y]
        assert len(n) == 4 and max(n) - min(n) <= 1


def test_class_index_is_a_numbering(people):
    indexed = O.class_index(people, "k", "y", 1)
    for y in "abc":
        found = sorted(r["idx"] for r in indexed.where(F.col("y") == y).collect())
        assert found == list(range(len(found)))


def test_running_totals_equal_a_plain_sum(spark):
    values = [((i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(6)
    got = {r["i"]: r["run"] for r in O.running_totals(df, ["v", "i"], {"run": "v"}).collect()}
    total = 0
    for i in sorted(range(500), key=lambda i: (values[i], i)):
        total += values[i]
        assert got[i] == total


def test_counter_rows_in_chunks(spark):
    df = spark.createDataFrame([("a", 10), ("b", 3), ("c", 0)], "y string, n long")
    got = sorted((r["y"], r["j"]) for r in O.counter_rows(df, "n", "j", chunk=4).collect())
    assert got == [("a", j) for j in range(10)] + [("b", j) for j in range(3)]


def test_upsample(people):
    up = S.upsample_with_replacement(people, "k", "y")
    counts = {r["y"]: r["count"] for r in up.groupBy("y").count().collect()}
    largest = people.groupBy("y").count().agg(F.max("count")).first()[0]
    assert set(counts.values()) == {largest}
    assert up.join(people, ["k", "y", "x", "z"], "left_anti").count() == 0
    smaller = S.upsample_with_replacement(people, "k", "y", majority="b")
    b = people.where("y = 'b'").count()
    assert {r["count"] for r in smaller.groupBy("y").count().collect()} == {b}


def brute(points, k):
    """Nearest same-class rows of every row: (class, key, rank) to neighbour key."""
    out = {}
    for y, key, v in points:
        others = sorted((sum((p - q) ** 2 for p, q in zip(v, w)), other) for z, other, w in points if z == y and other != key)
        for rank, (_, other) in enumerate(others[:k], 1):
            out[(y, key, rank)] = other
    return out


def _neighbours(spark, points, k, block):
    dims = len(points[0][2])
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame([(y, key, *map(float, v)) for y, key, v in points],
                               "y string, k long, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    found = nearest_in_class(df, df.select("y", "k"), "k", "y", names, k, block_points=block)
    return {(r["y"], r["k"], r["rank"]): r["neighbour"] for r in found.collect()}


@pytest.mark.parametrize("block", [3, 1024])
def test_neighbours_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    points = [("a" if i % 3 else "b", i * 5 % 301, rng.normal(size=3) * [10, 1, 1]) for i in range(150)]
    assert _neighbours(spark, points, 4, block) == brute(points, 4)


def test_neighbours_with_hot_duplicates_and_ties(spark):
    """A third of the rows are equal, the rest lie on a small grid full of equal distances."""
    rng = np.random.default_rng(4)
    points = [("a", i * 11 % 401, (5.0, 5.0) if i % 3 == 0 else tuple(rng.integers(0, 6, 2))) for i in range(180)]
    for block in (2, 1024):
        assert _neighbours(spark, points, 5, block) == brute(points, 5)


def test_neighbours_where_half_the_points_share_the_widest_value(spark):
    rng = np.random.default_rng(6)
    points = [("a", i * 13 % 503, (0.0 if i % 2 else rng.random() * 100, rng.random() * 20, rng.random())) for i in range(200)]
    assert _neighbours(spark, points, 3, 4) == brute(points, 3)


def _search_blocks(monkeypatch):
    """The blocks that the search is given, as they come."""
    kept, search = [], neighbours._search

    def noted(points, blocks, *rest):
        kept.append(blocks)
        return search(points, blocks, *rest)

    monkeypatch.setattr(neighbours, "_search", noted)
    return kept


def test_classes_of_equally_wide_features_are_few_large_blocks(spark, monkeypatch):
    """What is shuffled is the square of a class divided by the size of a block."""
    rng, kept = np.random.default_rng(8), _search_blocks(monkeypatch)
    points = [("abc"[i % 3], i * 7 % 4001, rng.normal(size=8)) for i in range(4000)]
    names = [f"f{i}" for i in range(8)]
    df = spark.createDataFrame([(y, key, *map(float, v)) for y, key, v in points], "y string, k long, " + ", ".join(f"{n} double" for n in names))
    few = df.where("k < 60")
    found = {(r["y"], r["k"], r["rank"]): r["neighbour"] for r in nearest_in_class(df, few.select("y", "k"), "k", "y", names, 3).collect()}
    assert sorted(r["_label"] for r in kept[0].collect()) == ["a", "b", "c"]
    assert found == {at: other for at, other in brute_of([p for p in points if p[1] < 60], points, 3).items()}


def brute_of(asked, points, k):
    """As ``brute``, for some of the rows."""
    out = {}
    for y, key, v in asked:
        others = sorted((float(((v - w) ** 2).sum()), other) for z, other, w in points if z == y and other != key)
        for rank, (_, other) in enumerate(others[:k], 1):
            out[(y, key, rank)] = other
    return out


def test_only_classes_with_wanted_rows_are_laid_out(spark, people, monkeypatch):
    kept = _search_blocks(monkeypatch)
    found = nearest_in_class(people, people.where("y = 'c'").select("y", "k"), "k", "y", ["x", "z"], 2)
    assert {r["y"] for r in found.collect()} == {"c"}
    assert {r["_label"] for r in kept[0].select("_label").collect()} == {"c"}


def test_neighbours_of_tiny_classes(spark):
    points = [("a", 1, (0.0, 0.0)), ("a", 2, (1.0, 1.0)), ("b", 3, (0.0, 0.0))]
    assert _neighbours(spark, points, 5, 16) == {("a", 1, 1): 2, ("a", 2, 1): 1}


def test_smote_rows_lie_between_their_parents(people):
    made = S.smote_rows(people, "k", "y", ["x", "z"], 5, 42, integer_cols=["x"])
    at = {r["k"]: r for r in people.collect()}
    for r in made.collect():
        a, b = at[r["base"]], at[r["neighbour"]]
        assert a["y"] == b["y"] == r["y"] and r["base"] != r["neighbour"] and 0 <= r["u"] < 1
        assert min(a["z"], b["z"]) - 1e-9 <= r["z"] <= max(a["z"], b["z"]) + 1e-9
        assert r["x"] == math.floor(r["x"]) and min(a["x"], b["x"]) <= r["x"] <= max(a["x"], b["x"])


def test_smote_balances_and_does_not_depend_on_placement(people):
    one = S.smote(people, "k", "y", ["x", "z"])
    largest = people.groupBy("y").count().agg(F.max("count")).first()[0]
    assert {r["count"] for r in one.groupBy("y").count().collect()} == {largest}
    two = S.smote(people.repartition(7, "x"), "k", "y", ["x", "z"])
    key = lambda df: sorted((r["y"], -1 if r["draw"] is None else r["draw"], r["x"], r["z"]) for r in df.collect())
    assert key(one) == key(two)


def test_smote_scaled_and_with_missing(spark, people):
    holes = people.withColumn("z", F.when(F.col("k") % 5 != 0, F.col("z")))
    made = S.smote(holes, "k", "y", ["x", "z"], scale=True)
    assert made.where("z IS NULL OR isnan(z)").count() == 0
    lone = spark.createDataFrame([(1, "a", 0.0), (2, "a", 1.0), (3, "b", 5.0)], "k long, y string, x double")
    with pytest.raises(ValueError, match="class"):  # one row has no neighbour to mix with
        S.smote(lone, "k", "y", ["x"], shrink_k=True)


def test_smote_of_small_classes_is_a_choice(spark):
    rows = [(i, 0, float(i)) for i in range(12)] + [(100 + i, 1, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "k long, y int, x double")
    with pytest.raises(ValueError, match="class 1 has 3 rows"):
        S.smote(df, "k", "y", ["x"])
    made = S.smote(df, "k", "y", ["x"], shrink_k=True)
    assert [r["count"] for r in made.groupBy("y").count().collect()] == [12, 12]


def test_split_with_repeated_and_missing_keys(spark):
    hot = [(7, 1)] * 50 + [(100 + i, 1) for i in range(50)]
    df = spark.createDataFrame(hot, "k long, y int")
    sizes = set()
    for seed in range(12):
        try:
            got = S.stratified_split(df, "k", "y", 60, seed)
            assert got.where("is_test = 1").count() == 60
            sizes.add(got.where("k = 7").select("is_test").distinct().count())
        except ValueError as e:
            assert "repeated" in str(e)
    assert sizes <= {1}
    one = spark.createDataFrame([(None, 1), (2, 1)], "k long, y int")
    assert {S.stratified_split(one, "k", "y", 50, seed).where("is_test = 1").first()["k"] for seed in range(8)} == {None, 2}


def block_pairs(pairs, n, seed=3):
    """Pairs of blocks of ``n`` points in four dimensions, as the search hands them to a task."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(pairs):
        a, b = rng.normal(size=(n, 4)).tolist(), rng.normal(size=(n, 4)).tolist()
        rows.append({"_asking": [{"point": i, "vec": v, "at": v[:2], "limit2": float("inf")} for i, v in enumerate(a)], "_low": [-9.0, -9.0], "_high": [9.0, 9.0],
                     "_points": [{"first": 2 * i, "keys": [2 * i, 2 * i + 1], "vec": v, "raw": v} for i, v in enumerate(b)]})
    return pa.RecordBatch.from_pylist(rows)


def test_block_pairs_stay_arrays_in_a_task():
    one = block_pairs(1, 50)
    row = one.to_pylist()[0]
    found = [r for batch in neighbours._block_distances(3)([one.slice(0, 1)]) for r in batch.to_pylist()]
    for q in row["_asking"]:
        best = sorted((sum((x - y) ** 2 for x, y in zip(q["vec"], p["vec"])), k, tuple(p["raw"])) for p in row["_points"] for k in p["keys"])[:3]
        got = [(r["_b"]["d2"], r["_b"]["key"], tuple(r["_b"]["raw"])) for r in found if r["_point"] == q["point"]]
        assert [g[1:] for g in got] == [b[1:] for b in best] and np.allclose([g[0] for g in got], [b[0] for b in best])
    batch = block_pairs(20, 400)
    tracemalloc.start()
    assert sum(b.num_rows for b in neighbours._block_distances(3)([batch])) == 20 * 400 * 3
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20  # one pair at a time, whatever the batch holds
