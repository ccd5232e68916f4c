"""Scoring of request tables and streams: class, confidence, reason and advice."""

from pyspark.sql import DataFrame, functions as F

from recordrisk.functions import columns as C, tables as R
from recordrisk.functions.narrative import advice_text, reason_text, with_amounts
from recordrisk.operators.features import build_features
from recordrisk.operators.encode import apply_encoding
from recordrisk.operators.models import predict
from recordrisk.schemas import FEATURES
from recordrisk.sources.io import DASHBOARD_CODES, SERVICE_CODES

RESPONSE = ["prediction", "confidence", "confidence_pct", "reason", "advice", "model_accuracy", "city",
            "industry", "stage"]


def request_records(requests: DataFrame) -> DataFrame:
    """Score requests in the columns of records; a missing stage is the seed stage."""
    return requests.withColumns({
        "TotalFunding": C.finite("total_funding"), "FundingRounds": F.col("funding_rounds"),
        "City": F.col("city"), "Industry": F.col("industry"), "Stage": F.coalesce("stage", F.lit("Seed"))})


def request_features(requests: DataFrame, encodings=None, style="service", keep=()) -> DataFrame:
    """The eleven features of score requests under frozen codes.

    The service classifies free industry and stage texts and gives unknown names code 0;
    the dashboard offers fixed names and looks them up, with its own defaults. Rounds are
    floored at one in both. For a model trained on a fit use ``FeatureFit.transform``.
    """
    records = request_records(requests)
    if style == "service":
        codes = encodings if encodings is not None else SERVICE_CODES
        return build_features(records, codes, "serve", None, 0, 0, keep)
    codes = encodings if encodings is not None else DASHBOARD_CODES
    exact = records.withColumn("_industry", F.col("Industry")).withColumn("_stage", F.col("Stage"))
    out = build_features(exact, codes, "serve", None, 0, 1, [*keep, "_industry", "_stage"])
    out = apply_encoding(out, "_industry", codes, 1, "IndustryEncoded", "Industry")
    out = apply_encoding(out, "_stage", codes, R.STAGE_DEFAULT, "StageEncoded", "Stage")
    out = out.withColumn("IsTechIndustry", C.membership_flag("_industry", R.TECH_INDUSTRIES))
    return out.select(*keep, *FEATURES)


def outcome_label(df: DataFrame, col, safe_code=1, out="outcome") -> DataFrame:
    return df.withColumn(out, C.outcome_label(col, safe_code))


def confidence(df: DataFrame, col="confidence") -> DataFrame:
    """The displayed percentage and the confidence at four decimals."""
    return df.withColumn("confidence_pct", C.percent_text(col)).withColumn(col, F.bround(col, 4))


def score_batch(requests: DataFrame, model=None, fit=None, encodings=None, style="service",
                accuracy=None, symbol="$", key="request_id") -> DataFrame:
    """One response per request; stateless, so the same call scores a stream.

    Without a model the funding rule decides. A model needs the ``fit`` it was trained with, whose cap, kept cities and
    codes make the features; ``encodings`` (such as ``SERVICE_CODES``) scores with frozen codes instead. ``accuracy`` is the
    model's accuracy as a share, repeated as text in every response.
    """
    inputs = ["total_funding", "funding_rounds", "city", "industry", "stage"]
    asked = requests.withColumn("stage", F.coalesce("stage", F.lit("Seed")))
    if model is None:
        safe = F.when(C.finite("total_funding") > R.RULE_THRESHOLD, 1).otherwise(0)
        scored = asked.select(key, *inputs, safe.alias("prediction"), F.lit(R.RULE_CONFIDENCE).alias("confidence"))
    else:
        asked = asked.withColumns({f"in_{c}": F.col(c) for c in inputs})
        keep = [key, *[f"in_{c}" for c in inputs]]
        if fit is not None:
            features = fit.transform(request_records(asked), keep, unknown=0)
        elif encodings is not None:
            features = request_features(asked, encodings, style, keep)
        else:
            raise ValueError("a model needs the fit it was trained with, or frozen encodings")
        scored = predict(model, features, [key, *[F.col(f"in_{c}").alias(c) for c in inputs]])
    rules = fit.rules if fit is not None else "serve"
    shown = C.industry_class("industry", rules) if style == "service" else F.col("industry")
    scored = scored.withColumn("industry", shown).withColumn("prediction", C.outcome_label("prediction"))
    scored = with_amounts(confidence(scored), "total_funding")
    return scored.select(
        key, "prediction", "confidence", "confidence_pct",
        reason_text("prediction", "total_funding", "funding_rounds", "city", "industry", "stage", style, symbol)
        .alias("reason"),
        advice_text("prediction", "total_funding", "funding_rounds", "city", style).alias("advice"),
        (C.percent_text(F.lit(accuracy)) if accuracy is not None else F.lit(None).cast("string"))
        .alias("model_accuracy"),
        "city", "industry", "stage", "total_funding", "funding_rounds")


def log_of(responses: DataFrame, key="request_id") -> DataFrame:
    """Responses in the columns of the prediction log."""
    return responses.select(
        F.col(key).alias("pred_id"), F.col("total_funding").try_cast("long").alias("Funding"),
        F.col("funding_rounds").cast("long").alias("Rounds"), F.col("city").alias("City"),
        F.col("industry").alias("Industry"), F.col("stage").alias("Stage"),
        F.col("prediction").alias("Prediction"), F.col("confidence").alias("Confidence"),
        F.col("reason").alias("Reason"), F.col("advice").alias("Advice"))


def score_basic(df: DataFrame, model, keep=("id",), safe_code=0) -> DataFrame:
    """Four encoded inputs to Safe or Failed, in the older polarity where 0 is safe."""
    scored = predict(model, df, list(keep))
    return scored.select(*keep, C.outcome_label("prediction", safe_code).alias("prediction"))
