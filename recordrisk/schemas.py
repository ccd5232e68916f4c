"""Declared schemas and the feature list. Nothing in the library infers a schema."""

from pyspark.sql import types as T


def _struct(spec):
    return T.StructType([T.StructField(name, kind, True) for name, kind in spec])


_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()

# Raw records as they arrive: money is text with thousands commas and "-".
RAW_RECORD = _struct([
    ("id", _L), ("Startup", _S), ("Country", _S), ("City", _S), ("Industry", _S), ("Stage", _S),
    ("TotalFunding", _S), ("FundingRounds", _L), ("FoundedAt", _S), ("FirstFundingAt", _S),
    ("LastFundingAt", _S), ("Status", _S),
])

PREDICTION_LOG = _struct([
    ("pred_id", _L), ("Funding", _L), ("Rounds", _L), ("City", _S), ("Industry", _S), ("Stage", _S),
    ("Prediction", _S), ("Confidence", _D), ("Reason", _S), ("Advice", _S),
])

# The older log kept city and industry as codes and had no stage, confidence or texts.
PREDICTION_LOG_V1 = _struct([
    ("pred_id", _L), ("Funding", _L), ("Rounds", _L), ("City", _L), ("Industry", _L), ("Prediction", _S),
])

SCORE_REQUEST = _struct([
    ("request_id", _L), ("total_funding", _D), ("funding_rounds", _I), ("city", _S), ("industry", _S),
    ("stage", _S),
])

ENCODING = _struct([("feature", _S), ("value", _S), ("code", _I)])

METRIC = _struct([("model", _S), ("metric", _S), ("value", _D)])

FEATURES = [
    "TotalFunding", "FundingRounds", "FundingPerRound", "LogFunding", "LogFundingPerRound",
    "StageEncoded", "CityEncoded", "IndustryEncoded", "IsMajorCity", "IsTechIndustry", "FundingBand",
]
FEATURES_BASIC = ["TotalFunding", "FundingRounds", "CityEncoded", "IndustryEncoded"]
INTEGER_FEATURES = [
    "StageEncoded", "CityEncoded", "IndustryEncoded", "IsMajorCity", "IsTechIndustry", "FundingBand",
]
TARGET = "StatusCode"
