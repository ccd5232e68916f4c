import numpy as np
import pytest
from pyspark.sql import functions as F

from recordrisk.operators import features as D
from recordrisk.schemas import FEATURES
from recordrisk.sources import views as V
from tests.conftest import by_id, column

SHAPES = {
    "normal": lambda rng: rng.normal(size=5000),
    "one hot value": lambda rng: np.where(rng.random(5000) < 0.4, 7.0, rng.random(5000) * 100),
    "two hot values": lambda rng: np.where(rng.random(5000) < 0.5, 1.0, 2.0),
    "hot ends": lambda rng: np.where(rng.random(5000) < 0.45, 0.0, np.where(rng.random(5000) < 0.9, 9.0, rng.random(5000) * 9)),
    "constant": lambda rng: np.full(500, 3.0),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_quantile_by_brackets_is_exact(spark, monkeypatch, shape):
    """The path for columns too large to rank in one task, forced on small ones."""
    monkeypatch.setattr(D, "RANKED_ROWS", 20)
    values = SHAPES[shape](np.random.default_rng(5))
    df = by_id(spark, [float(v) for v in values] + [None, float("nan")], "double")
    for q in (0.0, 0.01, 0.5, 0.99, 1.0):
        assert D.quantile_value(df, "v", q) == pytest.approx(float(np.quantile(values, q)), rel=1e-12)


def test_quantile_small_and_empty(spark):
    df = by_id(spark, [1.0, 2.0, 4.0, None], "double")
    assert D.quantile_value(df, "v", 0.25) == 1.5
    assert D.quantile_value(df.where("v > 9"), "v", 0.5) is None
    capped = D.winsorize_upper(df, "v", 0.5)
    assert column(capped, "v") == [1.0, 2.0, 2.0, None]


def test_standardize_uses_population_deviation_of_the_training_rows(spark):
    train, other = by_id(spark, [1.0, 3.0], "double"), by_id(spark, [5.0], "double")
    a, b = D.standardize(train, ["v"], other)
    assert column(a, "v") == [-1.0, 1.0] and column(b, "v") == [3.0]
    flat = D.standardize(by_id(spark, [2.0, 2.0], "double"), ["v"])
    assert column(flat, "v") == [0.0, 0.0]


def test_feature_fit_columns_and_reuse(spark, data):
    master = V.saved_master(spark, data)
    fit = D.fit_features(master)
    table = fit.transform(master, ["id"])
    assert table.columns == ["id", *FEATURES] and table.count() == master.count()
    row = spark.createDataFrame(
        [(1, "Bengaluru", "edtech", "Series A", 1e12, None), (2, "Nowhere", None, None, None, 0.0)],
        "id long, City string, Industry string, Stage string, TotalFunding double, FundingRounds double")
    one, two = fit.transform(row, ["id"]).orderBy("id").collect()
    assert one["TotalFunding"] == fit.cap and one["FundingRounds"] == 1.0
    assert (one["StageEncoded"], one["IsMajorCity"], one["IsTechIndustry"], one["FundingBand"]) == (4, 1, 1, 5)
    assert (two["TotalFunding"], two["FundingRounds"], two["StageEncoded"], two["FundingBand"]) == (None, 1.0, 2, 5)
    codes = {r["value"]: r["code"] for r in fit.encodings(spark).where("feature = 'City'").collect()}
    assert two["CityEncoded"] == codes["Other"]
    assert sorted(codes.values()) == list(range(len(codes)))


def test_assemble_fills(spark):
    df = spark.createDataFrame([(None, float("nan"), 3)], "a double, b double, c int")
    assert D.assemble(df, ["a", "b", "c"]).first()["features"].toArray().tolist() == [0.0, 0.0, 3.0]


def test_feature_plan_has_no_python(spark, data):
    master = V.master_records(spark, data)
    table = D.fit_features(master).transform(master, ["id"])
    plan = table.select(F.sum("FundingBand"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.99, 1.0])
def test_quantile_is_one_formula_at_every_size(spark, q):
    import random

    rng = random.Random(3)
    values = [rng.choice([5.0, 5.0, rng.gauss(0, 1e6), rng.random()]) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered, at = sorted(values), q * 3999
    low, high = ordered[int(at)], ordered[min(int(at) + 1, 3999)]
    want = low + (high - low) * (at - int(at))
    assert {D.quantile_value(df, "v", q, ranked_rows=n) for n in (10_000, 300, 7)} == {want}
