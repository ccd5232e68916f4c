"""Numeric features and the feature builder shared by training and scoring."""

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window as W, functions as F

from recordrisk.functions import columns as C, tables as R
from recordrisk.operators.encode import OTHER, apply_encoding, fit_ordinal, ordinal_codes
from recordrisk.schemas import FEATURES, FEATURES_BASIC
from recordrisk.sources.io import encoding_table, load_document, save_document
from recordrisk.workspace import durable

# A bracket of at most this many rows is ranked in one task.
RANKED_ROWS = 1_000_000


def _value_at_rank(values: DataFrame, rank, size, ranked_rows):
    """The value at a zero-based rank of the non-missing column ``v``.

    A sketch brackets the rank and one exact count per round says which side of the
    bracket's ends it lies on. The ends leave the bracket with all their copies, so a value
    that a third of the rows share never reaches the last step, which ranks what is left. A bracket as wide as the column
    ends at its least and largest value, so every round leaves fewer rows.
    """
    below, margin = 0, 1e-3
    v = F.col("v")
    while size > ranked_rows:
        at, wanted = (rank - below) / size, rank - below
        ends = [max(at - margin, 0.0), min(at + margin, 1.0)]
        low, high = values.agg(F.percentile_approx("v", ends, 10_000)).first()[0] if margin < 1 else values.agg(F.min("v"), F.max("v")).first()
        under, at_low, inside, at_high = values.agg(
            F.count_if(v < low), F.count_if(v == low), F.count_if((v > low) & (v < high)),
            F.count_if((v == high) & (v > low))).first()
        if not under <= wanted < under + at_low + inside + at_high:
            margin *= 10
        elif wanted < under + at_low:
            return low
        elif wanted >= under + at_low + inside:
            return high
        else:
            values, below, size = values.where((v > low) & (v < high)), below + under + at_low, inside
    ranked = values.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "upto", F.sum("n").over(W.orderBy("v")) + below)
    return ranked.where(F.col("upto") > rank).agg(F.min("v")).first()[0]


def quantile_value(df: DataFrame, col, q, method="exact", ranked_rows=RANKED_ROWS):
    """Linearly interpolated quantile as a number, missing values skipped.

    ``"exact"`` finds the two ranks around the quantile by a few aggregates and interpolates between them, the same way at
    every size. ``"approx"`` is a single sketch pass.
    """
    values = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    if method == "approx":
        return values.agg(F.percentile_approx("v", q, 10_000)).first()[0]
    n = values.count()
    if n == 0:
        return None
    position = q * (n - 1)
    first, last = math.floor(position), math.ceil(position)
    low = _value_at_rank(values, first, n, ranked_rows)
    if first == last:
        return low
    upto, following = values.agg(
        F.count_if(F.col("v") <= low), F.min(F.when(F.col("v") > low, F.col("v")))).first()
    high = low if upto > last else following
    return low + (high - low) * (position - first)


def quantile(df: DataFrame, col, q, method="exact") -> DataFrame:
    value = quantile_value(df, col, q, method)
    return df.sparkSession.createDataFrame([(float(q), value)], "q double, value double")


def winsorize_upper(df: DataFrame, col, q=0.99, method="exact", cap=None) -> DataFrame:
    """Cap a column at its quantile; missing stays missing. ``cap`` reuses a fitted value."""
    cap = quantile_value(df, col, q, method) if cap is None else cap
    return df if cap is None else df.withColumn(col, C.cap_at(F.col(col).cast("double"), F.lit(cap)))


def numeric_features(df: DataFrame) -> DataFrame:
    """Rounds floored at one, amount per round and the two logarithms."""
    return (
        df.withColumn("FundingRounds", C.floor_fill(F.col("FundingRounds").cast("double"), 1.0))
        .withColumn("FundingPerRound", C.safe_ratio("TotalFunding", "FundingRounds"))
        .withColumn("LogFunding", C.log1p("TotalFunding"))
        .withColumn("LogFundingPerRound", C.log1p("FundingPerRound"))
    )


class FeatureFit:
    """What the feature builder learned from the training records.

    Holds the cap, the kept cities (at most ``top_cities``) and the codes per feature, and
    applies them to any records: one code path for training and scoring. ``save`` and ``load`` keep all of it, with the
    feature list and the stage codes for readers of the file.
    """

    def __init__(self, cap, cities, codes, rules):
        self.cap, self.cities, self.codes, self.rules = cap, cities, codes, rules

    def transform(self, df: DataFrame, keep=(), unknown=None) -> DataFrame:
        """The features of records. A city that was not kept is folded; ``unknown`` is the code of a value without one."""
        city = F.when(F.col("City").isin(self.cities), F.col("City")).otherwise(OTHER)
        clean = df.replace(R.CITY_FIXES, subset=["City"]).withColumn("City", city)
        return build_features(clean, self.codes, self.rules, self.cap, unknown, unknown, keep=keep)

    def encodings(self, spark) -> DataFrame:
        return encoding_table(spark, self.codes)

    def document(self) -> dict:
        return {"cap": self.cap, "cities": self.cities, "codes": self.codes, "rules": self.rules,
                "features": FEATURES, "stage_rules": [[code, list(words)] for code, words in _stage_rules(self.rules)], "stage_default": R.STAGE_DEFAULT}

    def save(self, spark, path) -> None:
        """One JSON document, whose size is bounded by the kept cities and industry classes."""
        save_document(spark, self.document(), path)

    @classmethod
    def load(cls, spark, path) -> "FeatureFit":
        doc = load_document(spark, path)
        if doc["features"] != FEATURES or doc["stage_rules"] != cls(None, [], {}, doc["rules"]).document()["stage_rules"]:
            raise ValueError(f"{path} was fitted with other features or stage rules")
        return cls(doc["cap"], doc["cities"], doc["codes"], doc["rules"])


def _stage_rules(rules):
    return R.STAGE_RULES_TRAIN if rules == "train" else R.STAGE_RULES_SERVE


def fit_features(df: DataFrame, rules="train", q=0.99, top_cities=15, method="exact") -> FeatureFit:
    """Learn cap, kept cities and codes.

    The quantile has its own passes; one aggregate over city and industry gives the row count, the kept cities and the
    classes. Its groups are few next to the rows.
    """
    cap = quantile_value(df, "TotalFunding", q, method)
    pairs = df.select("City", C.industry_class("Industry", rules).alias("c")).replace(R.CITY_FIXES, subset=["City"])
    counts = pairs.groupBy("City", "c").agg(F.count(F.lit(1)).alias("n"))
    cities = counts.groupBy("City").agg(F.sum("n").alias("n"), F.collect_set("c").alias("classes"))
    cities = durable(cities)
    kept = cities.where(F.col("City").isNotNull()).orderBy(F.desc("n"), "City").limit(top_cities)
    total = cities.agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("classes"))).alias("classes"))
    both = kept.select("City", "n", F.lit(None).cast("array<string>").alias("classes")).unionAll(total.select(F.lit(None).cast("string"), "n", "classes")).collect()
    names = [r["City"] for r in both if r["classes"] is None]
    rest = next(r for r in both if r["classes"] is not None)
    folded = {OTHER} if sum(r["n"] for r in both if r["classes"] is None) < (rest["n"] or 0) else set()
    return FeatureFit(cap, names, {
        "City": ordinal_codes(folded.union(names)), "Industry": ordinal_codes(rest["classes"])}, rules)


def build_features(df: DataFrame, encodings, rules="train", cap=None, city_default=None,
                   industry_default=None, keep=()) -> DataFrame:
    """The eleven features from cleaned records and given codes, in their fixed order.

    ``encodings`` is an encoding table or ``{feature: {value: code}}``. ``keep`` names
    further columns to carry along (a key, the label, ``IndustryClean``).
    """
    out = df.withColumns({
        "IndustryClean": C.industry_class("Industry", rules), "StageEncoded": C.stage_code("Stage", rules),
        "TotalFunding": F.col("TotalFunding").cast("double")})
    if cap is not None:
        out = out.withColumn("TotalFunding", C.cap_at("TotalFunding", F.lit(cap)))
    out = numeric_features(out)
    out = apply_encoding(out, "City", encodings, city_default)
    out = apply_encoding(out, "IndustryClean", encodings, industry_default, out="IndustryEncoded",
                         feature="Industry")
    out = out.withColumns({
        "IsMajorCity": C.membership_flag("City", R.MAJOR_CITIES),
        "IsTechIndustry": C.membership_flag("IndustryClean", R.TECH_INDUSTRIES),
        "FundingBand": C.band("TotalFunding")})
    return out.select(*keep, *FEATURES)


def build_features_basic(df: DataFrame, encodings: DataFrame, null_label="Unknown", keep=()) -> DataFrame:
    """The older four features: raw categories encoded as they are, numbers coerced."""
    out = df.withColumn("TotalFunding", C.number_or("TotalFunding", 0.0))
    out = out.withColumn("FundingRounds", C.number_or("FundingRounds", 0.0))
    out = apply_encoding(out, "City", encodings, null_label=null_label)
    out = apply_encoding(out, "Industry", encodings, null_label=null_label)
    return out.select(*keep, *FEATURES_BASIC)


def fit_encodings_basic(df: DataFrame, null_label="Unknown") -> DataFrame:
    """Codes of the raw city and industry values, however many there are."""
    return fit_ordinal(df, "City", null_label=null_label).unionByName(
        fit_ordinal(df, "Industry", null_label=null_label))


def assemble(df: DataFrame, features=FEATURES, out="features") -> DataFrame:
    """Feature columns as one vector, missing values as zero."""
    filled = df.withColumns({f"_f_{c}": C.zero_filled(c) for c in features})
    vector = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol=out)
    return vector.transform(filled).drop(*[f"_f_{c}" for c in features])


def fit_scaling(df: DataFrame, cols) -> dict:
    """Mean and population deviation per column from one pass; a zero deviation becomes one."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in cols}


def apply_scaling(df: DataFrame, scaling: dict) -> DataFrame:
    return df.withColumns({
        c: (F.col(c) - F.lit(mean)) / F.lit(dev) for c, (mean, dev) in scaling.items() if mean is not None})


def standardize(train: DataFrame, cols, *others: DataFrame):
    """Scale the training rows, and any other tables by the same numbers."""
    scaling = fit_scaling(train, cols)
    scaled = [apply_scaling(df, scaling) for df in (train, *others)]
    return scaled[0] if not others else tuple(scaled)
