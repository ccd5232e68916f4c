"""Queries of scoring output and of the streaming jobs."""

from pyspark.sql import functions as F

from recordrisk.functions import tables as R
from recordrisk.functions.narrative import advice_text, reason_text, with_amounts
from recordrisk.operators import models as G, score as I
from recordrisk.operators.features import FeatureFit, build_features_basic, fit_encodings_basic, fit_features
from recordrisk.plans.encode_queries import rounded
from recordrisk.plans.model_data import LATE_STAGE, fitted_table
from recordrisk.plans.evaluate_queries import AUC
from recordrisk.plans.profile_queries import KPI_SQL, OUTCOME_SQL
from recordrisk.plans.registry import query
from recordrisk.plans.sqltext import (
    CITY_FIXED, FEATURES, HISTORY, RECORDS, SCORES, advice_sql, band_case, in_list, industry_case, reason_sql, stage_case)
from recordrisk.schemas import TARGET
from recordrisk.sources import io, views as V
from recordrisk.streaming import keyed as K, streams as J
from recordrisk.workspace import durable, shared_folder

_ARGS = ("Prediction", "Funding", "Rounds", "City")


@query("i2_reason_text", f"""WITH {HISTORY} SELECT pred_id, {reason_sql('service')} AS service,
  {reason_sql('dashboard')} AS dashboard FROM history""")
def i2_reason_text(spark, sf_dir):
    return with_amounts(V.history(spark, sf_dir), "Funding").select("pred_id", *[
        reason_text(*_ARGS, "Industry", "Stage", style).alias(style) for style in ("service", "dashboard")])


@query("i3_advice_text", f"""WITH {HISTORY} SELECT pred_id, {advice_sql('service')} AS service,
  {advice_sql('dashboard')} AS dashboard FROM history""")
def i3_advice_text(spark, sf_dir):
    return V.history(spark, sf_dir).select("pred_id", *[
        advice_text(*_ARGS, style).alias(style) for style in ("service", "dashboard")])


@query("i4_confidence", f"WITH {HISTORY} SELECT pred_id, Confidence, printf('%.1f', Confidence * 100) || '%' AS confidence_pct FROM history")
def i4_confidence(spark, sf_dir):
    return I.confidence(V.history(spark, sf_dir).select("pred_id", "Confidence"), "Confidence")


@query("i5_outcome_label", """SELECT doc_id, CASE WHEN quality = 1 THEN 'Safe' ELSE 'Failed' END AS outcome,
  CASE WHEN toxic = 0 THEN 'Safe' ELSE 'Failed' END AS legacy FROM labels""")
def i5_outcome_label(spark, sf_dir):
    df = I.outcome_label(V.table(spark, sf_dir, "labels"), "quality")
    return I.outcome_label(df, "toxic", 0, "legacy").select("doc_id", "outcome", "legacy")


@query("g8_rule_classifier", f"""WITH {HISTORY} SELECT pred_id, CASE WHEN Funding > 500000 THEN 'Safe' ELSE 'Failed' END AS Prediction,
  CAST(0.72 AS DOUBLE) AS Confidence FROM history""")
def g8_rule_classifier(spark, sf_dir):
    return G.rule_classifier(V.history(spark, sf_dir)).select("pred_id", "Prediction", "Confidence")


def _scored_sql(style):
    industry = industry_case(rules="serve") if style == "service" else "Industry"
    return f"""{HISTORY}, ruled AS (SELECT pred_id, Funding, Rounds, City, Stage, {industry} AS Industry,
    CASE WHEN Funding > {R.RULE_THRESHOLD} THEN 'Safe' ELSE 'Failed' END AS Prediction FROM history)"""


@query("i1_score_batch", f"""WITH {_scored_sql('service')} SELECT pred_id AS request_id, Prediction AS prediction,
  CAST(0.72 AS DOUBLE) AS confidence, '72.0%' AS confidence_pct, {reason_sql('service')} AS reason,
  {advice_sql('service')} AS advice, printf('%.1f', CAST(0.8685 AS DOUBLE) * 100) || '%' AS model_accuracy, City AS city,
  Industry AS industry, Stage AS stage FROM ruled""")
def i1_score_batch(spark, sf_dir):
    """Responses of the service with the funding rule as its model."""
    requests = V.requests_from(V.history(spark, sf_dir))
    return I.score_batch(requests, accuracy=0.8685).select("request_id", *I.RESPONSE)


_FITTED_SQL = f"""asked AS (SELECT pred_id, Funding, Rounds, City, Stage, {industry_case()} AS Industry, {stage_case()} AS code FROM history),
said AS (SELECT pred_id, Funding, Rounds, City, Stage, Industry, CASE WHEN code >= {LATE_STAGE} THEN 'Safe' ELSE 'Failed' END AS Prediction FROM asked)"""


@query("i1_score_batch_model", f"""WITH {HISTORY}, {_FITTED_SQL} SELECT pred_id AS request_id, Prediction AS prediction,
  {reason_sql('service')} AS reason, {advice_sql('service')} AS advice, printf('%.1f', CAST(0.8685 AS DOUBLE) * 100) || '%' AS model_accuracy,
  City AS city, Industry AS industry, Stage AS stage, 1 AS sure FROM said""")
def i1_score_batch_model(spark, sf_dir):
    """Responses with a forest and the fit it was trained with, both saved and loaded again."""
    folder = shared_folder(spark, "saved")
    fit, table = fitted_table(spark, sf_dir)
    io.save_model(G.train_random_forest(table, label="target"), f"{folder}/model")
    fit.save(spark, f"{folder}/fit")
    model, fit = io.load_model(f"{folder}/model", spark), FeatureFit.load(spark, f"{folder}/fit")
    requests = V.requests_from(V.history(spark, sf_dir))
    scored = I.score_batch(requests, model, fit, accuracy=0.8685)
    shown = [c for c in I.RESPONSE if not c.startswith("confidence")]
    return scored.select("request_id", *shown, F.when(F.col("confidence") > 0.5, 1).otherwise(0).alias("sure"))


@query("i1_fitted_features", f"""WITH {HISTORY}, {FEATURES}, asked AS (SELECT pred_id AS id, CAST(Funding AS DOUBLE) AS f,
  CAST(greatest(Rounds, 1) AS DOUBLE) AS r, {CITY_FIXED} AS City, {industry_case()} AS IndustryClean, {stage_case()} AS StageEncoded FROM history),
folded_city AS (SELECT asked.* REPLACE (CASE WHEN kept IS NULL THEN 'Other' ELSE City END AS City) FROM asked LEFT JOIN frequent ON City = kept),
limited AS (SELECT *, CASE WHEN f > c THEN c ELSE f END AS m FROM folded_city, cap)
SELECT id, round(m, 4) AS TotalFunding, r AS FundingRounds, round(m / r, 7) AS FundingPerRound, round(ln(1 + m), 6) AS LogFunding,
  round(ln(1 + m / r), 6) AS LogFundingPerRound, StageEncoded, coalesce(cc.code, 0) AS CityEncoded, coalesce(ic.code, 0) AS IndustryEncoded,
  CASE WHEN City IN {in_list(R.MAJOR_CITIES)} THEN 1 ELSE 0 END AS IsMajorCity,
  CASE WHEN IndustryClean IN {in_list(R.TECH_INDUSTRIES)} THEN 1 ELSE 0 END AS IsTechIndustry, {band_case('m')} AS FundingBand
FROM limited LEFT JOIN city_codes cc ON City = cc.value LEFT JOIN industry_codes ic ON IndustryClean = ic.value""")
def i1_fitted_features(spark, sf_dir):
    """The features of score requests under a fit learned from the records, saved and loaded again."""
    folder = shared_folder(spark, "saved")
    fit_features(V.saved_master(spark, sf_dir)).save(spark, folder)
    requests = V.requests_from(V.history(spark, sf_dir))
    found = FeatureFit.load(spark, folder).transform(I.request_records(requests), ["request_id"], unknown=0)
    return rounded(found.withColumnRenamed("request_id", "id"))


@query("i6_score_basic", f"""WITH {RECORDS} SELECT id, CASE WHEN coalesce(FundingRounds, 0) >= 3 THEN 'Failed' ELSE 'Safe' END AS prediction FROM records""")
def i6_score_basic(spark, sf_dir):
    """The older four-feature model, where code 0 is safe, on a label that follows from the rounds."""
    records = V.raw_records(spark, sf_dir)
    failed = F.when(F.col("FundingRounds") >= 3, 1).otherwise(0)
    table = durable(build_features_basic(
        records.withColumn(TARGET, failed), fit_encodings_basic(records), keep=["id", TARGET]))
    model = G.train_random_forest(table, ["TotalFunding", "FundingRounds", "CityEncoded", "IndustryEncoded"], TARGET)
    return I.score_basic(table, model)


def _log_stream(spark, sf_dir):
    schema = V.table(spark, sf_dir, "events").schema
    return V.prediction_log(J.read_stream(spark, f"{sf_dir}/events.parquet*", schema))


@query("j1_score_stream", f"""WITH {_scored_sql('dashboard')} SELECT pred_id, Funding, CAST(Rounds AS BIGINT) AS Rounds, City,
  Industry, Stage, Prediction, CAST(0.72 AS DOUBLE) AS Confidence, {reason_sql('dashboard')} AS Reason,
  {advice_sql('dashboard')} AS Advice FROM ruled""")
def j1_score_stream(spark, sf_dir):
    """Requests scored as a stream and appended to a log, read back."""
    folder = shared_folder(spark, "score-stream")
    requests = V.requests_from(_log_stream(spark, sf_dir))
    J.score_stream(requests, f"{folder}/log", f"{folder}/progress", style="dashboard", once=True).awaitTermination()
    return io.read_predictions(spark, f"{folder}/log")


@query("j1_score_stream_model", f"""WITH {HISTORY}, {_FITTED_SQL} SELECT pred_id, Funding, City, Industry, Stage, Prediction,
  {reason_sql('service')} AS Reason FROM said""")
def j1_score_stream_model(spark, sf_dir):
    """Requests scored as a stream by a model and its fit."""
    folder = shared_folder(spark, "score-stream")
    fit, table = fitted_table(spark, sf_dir)
    model = G.train_random_forest(table, label="target", trees=30, depth=10)
    requests = V.requests_from(_log_stream(spark, sf_dir))
    J.score_stream(requests, f"{folder}/log", f"{folder}/progress", model, fit, once=True).awaitTermination()
    return io.read_predictions(spark, f"{folder}/log").select("pred_id", "Funding", "City", "Industry", "Stage", "Prediction", "Reason")


def _published(spark, live):
    folder = shared_folder(spark, "live")
    J.publish(live, f"{folder}/table", f"{folder}/progress", once=True).awaitTermination()
    return J.read_published(spark, f"{folder}/table", live.schema)


@query("j2_live_kpis", KPI_SQL)
def j2_live_kpis(spark, sf_dir):
    live = _published(spark, J.live_kpis(_log_stream(spark, sf_dir)))
    return live.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("j3_live_outcome_counts", OUTCOME_SQL)
def j3_live_outcome_counts(spark, sf_dir):
    return _published(spark, J.live_outcome_counts(_log_stream(spark, sf_dir), "Industry"))


@query("j3_keyed_merge", OUTCOME_SQL)
def j3_keyed_merge(spark, sf_dir):
    """The same counts, with each batch merged into the parts of the table in which its keys lie."""
    folder, live = shared_folder(spark, "merged"), J.live_outcome_counts(_log_stream(spark, sf_dir), "Industry")
    K.merge_published(live, f"{folder}/table", ["Industry"], f"{folder}/progress", once=True).awaitTermination()
    return K.read_merged(spark, f"{folder}/table", live.schema)


@query("e10_live_latest", f"""WITH {HISTORY} SELECT City, arg_max(Prediction, pred_id) AS Prediction,
  arg_max(Confidence, pred_id) AS Confidence, max(pred_id) AS pred_id FROM history GROUP BY City""")
def e10_live_latest(spark, sf_dir):
    """The newest prediction per city, kept as state of its key and merged into a table."""
    folder = shared_folder(spark, "latest")
    with K.state_store(spark):
        live = K.live_latest(_log_stream(spark, sf_dir).select("City", "Prediction", "Confidence", "pred_id"), "City", "pred_id")
        K.merge_published(live, f"{folder}/table", ["City"], f"{folder}/progress", once=True).awaitTermination()
    return K.read_merged(spark, f"{folder}/table", live.schema)


@query("h4_live_auc", f"WITH {SCORES}, {AUC} SELECT round(auc, 9) AS roc_auc, (SELECT count(DISTINCT score) FROM scores) AS thresholds FROM area")
def h4_live_auc(spark, sf_dir):
    """The area under the ROC curve of a stream of scores, from sums of the parts of its counts, and the number of scores."""
    folder, schema = shared_folder(spark, "auc"), V.table(spark, sf_dir, "orders").schema
    stream = V.scores_of(J.read_stream(spark, f"{sf_dir}/orders.parquet*", schema))
    K.publish_scores(stream, f"{folder}/table", f"{folder}/progress", once=True).awaitTermination()
    counts = K.read_merged(spark, f"{folder}/table", "score double, pos long, neg long")
    return counts.agg(F.round(F.lit(K.live_auc(spark, f"{folder}/table")), 9).alias("roc_auc"), F.count(F.lit(1)).alias("thresholds"))
