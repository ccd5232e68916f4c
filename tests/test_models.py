import os

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from recordrisk.operators import evaluate as H, models as G, score as I
from recordrisk.operators.features import FeatureFit, fit_features
from recordrisk.operators.resample import smote, stratified_split
from recordrisk.plans.model_data import clear_classes, fitted_table, learnable, model_table
from recordrisk.plans.training import TrainConfig, clean_raw, load_run, save_run, train_run
from recordrisk.schemas import FEATURES, FEATURES_BASIC, INTEGER_FEATURES, TARGET
from recordrisk.sources import io, views as V
from recordrisk.workspace import durable, scratch, shared_folder


@pytest.fixture(scope="module")
def table(spark, data):
    return durable(stratified_split(learnable(model_table(spark, data)), "id", "target"))


@pytest.fixture(scope="module")
def sides(table):
    return table.where("is_test = 0"), table.where("is_test = 1")


@pytest.fixture(scope="module")
def forest(sides):
    return G.train_random_forest(sides[0], FEATURES, "target", trees=10, depth=6)


def check_predictions(model, test, floor):
    scored = G.predict(model, test, ["id", "target"]).withColumnRenamed("target", "label")
    assert scored.count() == test.count()
    assert scored.where("score < 0 OR score > 1 OR confidence < 0.5").count() == 0
    cells = H.confusion_counts(scored).first()
    assert sum(cells) == test.count()
    auc = H.roc_auc(scored).first()[0]
    ours = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(scored)
    assert auc == pytest.approx(ours, abs=1e-3)
    assert auc > floor


def test_forest_learns(forest, sides):
    check_predictions(forest, sides[1], 0.9)


def test_boosted_trees_learn(sides):
    model = G.train_boosted_trees(sides[0], FEATURES, "target", rounds=5, depth=4)
    check_predictions(model, sides[1], 0.9)


def test_logistic_learns_and_ignores_units(sides):
    train, test = sides
    check_predictions(G.train_logistic(train, FEATURES, "target"), test, 0.8)
    a = G.predict(G.train_logistic(train, FEATURES_BASIC, "target"), test, ["id"])
    scale = lambda d: d.withColumn("TotalFunding", F.col("TotalFunding") * 1000)
    b = G.predict(G.train_logistic(scale(train), FEATURES_BASIC, "target"), scale(test), ["id"])
    both = a.select("id", "score").join(b.select("id", F.col("score").alias("other")), "id")
    assert both.where("abs(score - other) > 1e-6").count() == 0


def test_probabilities_sum_to_one(forest, sides):
    p = forest.transform(G.with_filled(sides[1], FEATURES)).select(vector_to_array("probability").alias("p"))
    assert p.where("abs(p[0] + p[1] - 1) > 1e-9").count() == 0


def test_importances(forest):
    rows = G.feature_importance(forest).collect()
    values = [r["importance"] for r in rows]
    assert values == sorted(values) and sum(values) == pytest.approx(1.0)
    assert all(r["above_mean"] == (r["importance"] > sum(values) / len(values)) for r in rows)


def test_saved_models_predict_the_same(spark, forest, sides):
    path = shared_folder(spark, "model")
    io.save_model(forest, path)
    again = G.predict(io.load_model(path), sides[1], ["id"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, G.predict(forest, sides[1], ["id"]).collect()))
    assert io.load_model(path + "-absent") is None


def test_three_classes(spark, data):
    rows = clear_classes(model_table(spark, data))
    for model in (G.train_random_forest(rows, FEATURES, "stage3", trees=3, depth=3),
                  G.train_boosted_multiclass(rows, FEATURES, "stage3", rounds=1, depth=2)):
        out = G.predict(model, rows, ["id"])
        assert out.count() == rows.count() and out.where("prediction NOT IN (0, 1, 2)").count() == 0


def test_load_model_forgives_only_a_missing_path(spark, tmp_path):
    (tmp_path / "metadata").mkdir()
    with pytest.raises(Exception):
        io.load_model(str(tmp_path), spark)


def test_cross_validation(table):
    small = lambda d: G.train_random_forest(d, FEATURES, "target", trees=3, depth=4)
    balance = lambda d: smote(d, "id", "target", FEATURES, integer_cols=INTEGER_FEATURES)
    for when in ("inside", "before"):
        got = {r["metric"]: r["value"] for r in G.cross_validate_f1(
            table, "id", small, 2, FEATURES, "target", balance, when).collect()}
        folds = [got["fold_0"], got["fold_1"]]
        assert got["mean_f1"] == pytest.approx(sum(folds) / 2) and got["std_f1"] == pytest.approx(abs(folds[0] - folds[1]) / 2)
        assert got["mean_f1"] > 0.7


@pytest.mark.parametrize("balance", ["smote", "positive_weight"])
def test_train_run(spark, data, balance):
    config = TrainConfig(balance=balance, forest={"trees": 2, "depth": 3}, boosted={"rounds": 1, "depth": 2},
                         logistic={"max_iter": 5}, folds=2)
    records = V.saved_master(spark, data)
    result = train_run(records, config)
    metrics = {(r["model"], r["metric"]): r["value"] for r in result.metrics.collect()}
    n = records.count()
    assert metrics[("run", "test_rows")] == -(-n // 5)
    if balance == "smote":
        train = n - metrics[("run", "test_rows")]
        assert metrics[("run", "train_rows")] > train and metrics[("run", "train_rows")] % 2 == 0
    assert result.best in config.models
    assert result.best == max(config.models, key=lambda m: metrics[(m, "f1")])
    path = shared_folder(spark, "run")
    save_run(result, path)
    assert io.load_metrics(spark, f"{path}/metrics").count() == result.metrics.count()
    model, fit, document = load_run(spark, path)
    assert document["best_model"] == result.best and document["features"] == FEATURES
    assert {"cv_mean_f1", "cv_std_f1", "train_rows", "test_rows"} == set(document["run"])
    again = fit.transform(records, ["id"]).orderBy("id").collect()
    assert again == result.fit.transform(records, ["id"]).orderBy("id").collect()
    assert I.score_batch(V.requests_from(V.history(spark, data)).limit(5), model, fit).count() == 5


def test_clean_raw(spark, data):
    raw = V.raw_records(spark, data).limit(50).unionByName(
        V.raw_records(spark, data).limit(1).withColumn("Status", F.lit("unknown")))
    rows = clean_raw(raw).collect()
    assert {r["Status"]: r[TARGET] for r in rows} | {"unknown": None} == {
        "operating": 1, "closed": 0, "acquired": 1, "ipo": 1, "unknown": None}


def test_score_batch_with_a_model(spark, data):
    fit, table = fitted_table(spark, data)
    model = G.train_random_forest(table, label="target", trees=3, depth=3)
    requests = V.requests_from(V.history(spark, data))
    for options in ({"fit": fit}, {"encodings": io.SERVICE_CODES}, {"encodings": io.DASHBOARD_CODES, "style": "dashboard"}):
        out = I.score_batch(requests, model, accuracy=0.8685, **options)
        assert out.count() == requests.count()
        assert out.where("prediction NOT IN ('Safe', 'Failed') OR reason IS NULL OR advice IS NULL").count() == 0
        assert {r[0] for r in out.select("model_accuracy").distinct().collect()} == {f"{0.8685 * 100:.1f}%"}
    with pytest.raises(ValueError):
        I.score_batch(requests, model)
    row = I.score_batch(requests.limit(1).withColumn("stage", F.lit(None).cast("string"))).first()
    assert row["stage"] == "Seed"


def test_a_fit_folds_caps_and_codes_what_it_has_not_seen(spark):
    rows = [(i, c, "saas", "Seed", float(i), 1.0) for i, c in enumerate(["Pune"] * 6 + ["Delhi"] * 4 + ["Kochi"])]
    records = spark.createDataFrame(rows, "id long, City string, Industry string, Stage string, TotalFunding double, FundingRounds double")
    fit = fit_features(records, q=0.5, top_cities=2)
    assert (fit.cap, fit.cities, fit.codes["City"]) == (5.0, ["Pune", "Delhi"], {"Delhi": 0, "Other": 1, "Pune": 2})
    path = shared_folder(spark, "fit")
    fit.save(spark, path)
    asked = spark.createDataFrame([(1, 99.0, 1, "Kochi", "saas", None), (2, 3.0, 0, "Pune", "farming", "Seed"), (3, float("nan"), 2, None, None, None)],
                                  "request_id long, total_funding double, funding_rounds int, city string, industry string, stage string")
    got = FeatureFit.load(spark, path).transform(I.request_records(asked), ["request_id"], unknown=0).orderBy("request_id").collect()
    assert [(r["TotalFunding"], r["CityEncoded"], r["FundingRounds"]) for r in got] == [(5.0, 1, 1.0), (3.0, 2, 1.0), (None, 1, 2.0)]
    assert got[1]["IndustryEncoded"] == 0  # a class the records do not have


BAD_AMOUNTS = [float("nan"), float("inf"), float("-inf"), 1e25, 1e300, -1e300, None, 0.0, -5.0]


def test_no_amount_ends_a_job(spark):
    rows = [(i, x, 1 + i % 3, "Pune", "saas", "Seed") for i, x in enumerate(BAD_AMOUNTS)]
    asked = spark.createDataFrame(rows, "request_id long, total_funding double, funding_rounds int, city string, industry string, stage string")
    for style in ("service", "dashboard"):
        out = I.score_batch(asked, style=style)
        assert out.where("reason IS NOT NULL AND advice IS NOT NULL").count() == len(BAD_AMOUNTS)
        assert I.log_of(out).count() == len(BAD_AMOUNTS)
        assert {r["request_id"]: r["prediction"] for r in out.collect()} == {
            i: "Safe" if x in (1e25, 1e300) else "Failed" for i, x in enumerate(BAD_AMOUNTS)}


def test_sentences_stay_in_generated_code(spark, data):
    from recordrisk.plans.catalog import QUERIES

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("i1_score_batch", "i2_reason_text", "i3_advice_text", "i4_confidence"):
            QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_a_scratch_leaves_nothing(spark, data):
    def folders():
        base = spark.conf.get("spark.checkpoint.dir")
        return {n for n in os.listdir(base) if n.startswith("scratch-")}

    table = durable(model_table(spark, data))
    with scratch(spark) as folder:
        made = smote(table, "id", "target", FEATURES, integer_cols=INTEGER_FEATURES)
        assert made.count() > table.count() and os.path.isdir(folder)
    assert not os.path.exists(folder)
    with pytest.raises(RuntimeError), scratch(spark) as folder:
        durable(table)
        raise RuntimeError
    assert not os.path.exists(folder)
    before = folders()
    config = TrainConfig(models=("logistic_regression",), logistic={"max_iter": 5}, folds=2)
    train_run(V.saved_master(spark, data), config)
    assert folders() == before


def test_request_features_per_style(spark):
    schema = "request_id long, total_funding double, funding_rounds int, city string, industry string, stage string"
    rows = [(1, 1e6, 0, "Mumbai", "E-Commerce", "Series A"), (2, 0.0, 3, "Nowhere", "Other", "Series F")]
    asked = spark.createDataFrame(rows, schema)
    codes = lambda style: [
        (r["CityEncoded"], r["IndustryEncoded"], r["StageEncoded"], r["IsTechIndustry"], r["FundingRounds"])
        for r in I.request_features(asked, style=style, keep=["request_id"]).orderBy("request_id").collect()]
    assert codes("service") == [(10, 1, 4, 1, 1.0), (0, 11, 2, 0, 3.0)]
    assert codes("dashboard") == [(61, 3, 4, 1, 1.0), (0, 1, 2, 0, 3.0)]
