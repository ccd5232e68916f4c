"""Queries of profiling and of the prediction log."""

from pyspark.sql import functions as F

from recordrisk.functions import tables as R
from recordrisk.operators import encode as C, features as D, profile as E
from recordrisk.operators.sketches import append_summary, frequent_values, merged_quantile, rank_error
from recordrisk.plans.registry import query
from recordrisk.plans.sqltext import FEATURES, HISTORY, MASTER, RECORDS, industry_case, map_case, stage_case
from recordrisk.schemas import FEATURES as FEATURE_LIST, TARGET
from recordrisk.sources import views as V
from recordrisk.workspace import shared_folder


def features(spark, sf_dir, keep):
    master = V.saved_master(spark, sf_dir)
    return D.fit_features(master).transform(master, keep)


@query("e1_value_counts", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def e1_value_counts(spark, sf_dir):
    return E.value_counts(V.table(spark, sf_dir, "documents"), "source")


@query("e1_value_counts_names", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name")
def e1_value_counts_names(spark, sf_dir):
    return E.value_counts(V.table(spark, sf_dir, "part"), "p_name")


@query("e2_top_k_values", f"""WITH {RECORDS} SELECT City, count(*) AS n FROM records WHERE City IS NOT NULL
GROUP BY City ORDER BY n DESC, City LIMIT 10""")
def e2_top_k_values(spark, sf_dir):
    return E.top_k_values(V.raw_records(spark, sf_dir), "City", 10)


@query("e2_frequent_values", f"""WITH {RECORDS} SELECT City, count(*) AS n FROM records WHERE City IS NOT NULL
GROUP BY City ORDER BY n DESC, City LIMIT 10""")
def e2_frequent_values(spark, sf_dir):
    """The same from summaries of four appends, whose candidates are counted."""
    records, path = V.raw_records(spark, sf_dir), shared_folder(spark, "summary")
    for batch in range(4):
        append_summary(records.where(F.col("id") % 4 == batch), path, batch, frequent=["City"])
    return frequent_values(records, path, "City", 10)


@query("d1_merged_quantile", """SELECT q, (SELECT count(*) FROM lineitem) AS n, 1 AS within FROM (SELECT CAST(unnest([0.01, 0.5, 0.99]) AS DOUBLE) AS q)""")
def d1_merged_quantile(spark, sf_dir):
    """Quantiles of prices from sketches of four appends: whether the exact share of rows up to each lies within the bound."""
    rows, path = V.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("double").alias("price")), shared_folder(spark, "summary")
    for batch in range(4):
        append_summary(rows.where(F.col("l_orderkey") % 4 == batch), path, batch, quantiles=["price"])
    found = merged_quantile(spark, path, "price", [0.01, 0.5, 0.99]).collect()  # three rows
    share = lambda test: F.avg(test.cast("double"))
    within = [(share(F.col("price") < r["value"]) <= r["q"] + rank_error()) & (share(F.col("price") <= r["value"]) >= r["q"] - rank_error()) for r in found]
    checked = rows.agg(F.array(*[F.struct(F.lit(r["q"]).alias("q"), F.lit(r["n"]).alias("n"), w.cast("int").alias("within")) for r, w in zip(found, within)]).alias("x"))
    return checked.select(F.inline("x"))


@query("e3_class_balance", """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)
SELECT toxic, n, round((SELECT max(n) FROM c) / CAST(n AS DOUBLE), 6) AS ratio FROM c""")
def e3_class_balance(spark, sf_dir):
    df = E.class_balance(V.table(spark, sf_dir, "labels"), "toxic")
    return df.withColumn("ratio", F.round("ratio", 6))


@query("e4_rate_by_industry", f"""WITH {MASTER} SELECT {industry_case()} AS IndustryClean,
  round(avg(StatusCode), 6) AS rate, count(*) AS n FROM master GROUP BY 1""")
def e4_rate_by_industry(spark, sf_dir):
    df = C.classify_industry(V.master_records(spark, sf_dir))
    return E.rate_by(df, "IndustryClean", TARGET).withColumn("rate", F.round("rate", 6))


@query("e4_rate_by_city", f"""WITH {FEATURES} SELECT City, round(rate, 6) AS rate, n FROM (
SELECT City, avg(StatusCode) AS rate, count(*) AS n FROM features GROUP BY City ORDER BY rate DESC, City LIMIT 12)""")
def e4_rate_by_city(spark, sf_dir):
    master = V.master_records(spark, sf_dir).replace(R.CITY_FIXES, subset=["City"])
    return E.rate_by(C.fold_rare(master, "City"), "City", TARGET, 12).withColumn("rate", F.round("rate", 6))


@query("e4_rate_by_stage", f"""WITH {MASTER} SELECT {stage_case()} AS StageEncoded, round(avg(StatusCode), 6) AS rate,
  count(*) AS n FROM master GROUP BY 1""")
def e4_rate_by_stage(spark, sf_dir):
    df = C.encode_stage(V.master_records(spark, sf_dir))
    return E.rate_by(df, "StageEncoded", TARGET, by_key=True).withColumn("rate", F.round("rate", 6))


@query("e5_crosstab", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F,
  count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P
FROM orders GROUP BY o_orderpriority""")
def e5_crosstab(spark, sf_dir):
    return E.crosstab(V.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("e5_crosstab_bands", f"""WITH {FEATURES} SELECT FundingBand, count(*) FILTER (Status = 'Failed') AS Failed,
  count(*) FILTER (Status = 'Safe') AS Safe FROM features GROUP BY FundingBand""")
def e5_crosstab_bands(spark, sf_dir):
    return E.crosstab(features(spark, sf_dir, ["Status"]), "FundingBand", "Status", ["Failed", "Safe"])


@query("e6_summary_stats", f"""WITH {FEATURES} SELECT round(avg(FundingPerRound), 2) AS avg_per_round,
  round(min(LogFunding), 6) AS min_log, round(max(LogFunding), 6) AS max_log,
  CAST(sum(IsMajorCity) AS BIGINT) AS major_city, CAST(sum(IsTechIndustry) AS BIGINT) AS tech_industry,
  min(StageEncoded) AS min_stage, max(StageEncoded) AS max_stage FROM features""")
def e6_summary_stats(spark, sf_dir):
    stats = E.summary_stats(features(spark, sf_dir, []), {
        "avg_per_round": ("mean", "FundingPerRound"), "min_log": ("min", "LogFunding"),
        "max_log": ("max", "LogFunding"), "major_city": ("sum", "IsMajorCity"),
        "tech_industry": ("sum", "IsTechIndustry"), "min_stage": ("min", "StageEncoded"),
        "max_stage": ("max", "StageEncoded")})
    return stats.withColumns({
        "avg_per_round": F.round("avg_per_round", 2), "min_log": F.round("min_log", 6), "max_log": F.round("max_log", 6)})


@query("e7_distribution_by_code", f"""WITH {MASTER}, s AS (SELECT {stage_case()} AS StageEncoded FROM master)
SELECT StageEncoded, {map_case('StageEncoded', R.STAGE_LABELS)} AS label, count(*) AS n FROM s GROUP BY StageEncoded""")
def e7_distribution_by_code(spark, sf_dir):
    return E.distribution_by_code(C.encode_stage(V.master_records(spark, sf_dir)), "StageEncoded", R.STAGE_LABELS)


@query("e8_rate_tier", f"""WITH {MASTER}, r AS (SELECT {industry_case()} AS IndustryClean, avg(StatusCode) AS rate
  FROM master GROUP BY 1)
SELECT IndustryClean, round(rate, 6) AS rate, CASE WHEN rate > 0.7 THEN 'high' WHEN rate > 0.5 THEN 'middle' ELSE 'low' END AS tier FROM r""")
def e8_rate_tier(spark, sf_dir):
    rates = E.rate_by(C.classify_industry(V.master_records(spark, sf_dir)), "IndustryClean", TARGET)
    return E.rate_tier(rates, "rate", 0.7, 0.5).select("IndustryClean", F.round("rate", 6).alias("rate"), "tier")


@query("e9_correlation", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) AS correlation FROM lineitem"
    for c in ["l_quantity", "l_discount", "l_tax", "l_linenumber"]))
def e9_correlation(spark, sf_dir):
    df = E.correlation_with_target(
        V.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice")
    return df.withColumn("correlation", F.round("correlation", 6))


@query("e9_correlation_features", f"WITH {FEATURES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, StatusCode), 6) AS correlation FROM features" for c in FEATURE_LIST))
def e9_correlation_features(spark, sf_dir):
    df = E.correlation_with_target(features(spark, sf_dir, [TARGET]), FEATURE_LIST, TARGET)
    return df.withColumn("correlation", F.round("correlation", 6))


@query("e10_latest_prediction", f"""WITH {HISTORY} SELECT City, arg_max(Prediction, pred_id) AS Prediction,
  arg_max(Confidence, pred_id) AS Confidence, max(pred_id) AS pred_id FROM history GROUP BY City""")
def e10_latest_prediction(spark, sf_dir):
    log = V.history(spark, sf_dir).select("City", "Prediction", "Confidence", "pred_id")
    return E.latest_prediction(log, "pred_id", "City")


@query("e10_last_of_log", f"""WITH {HISTORY} SELECT pred_id, Prediction, Confidence FROM history
ORDER BY pred_id DESC LIMIT 1""")
def e10_last_of_log(spark, sf_dir):
    return E.latest_prediction(V.history(spark, sf_dir).select("pred_id", "Prediction", "Confidence"), "pred_id")


KPI_SQL = f"""WITH {HISTORY}, k AS (SELECT count(*) AS total, count(*) FILTER (Prediction = 'Safe') AS safe,
  count(*) FILTER (Prediction = 'Failed') AS failed, avg(Confidence) AS c FROM history)
SELECT total, safe, failed, round(c, 6) AS avg_confidence,
  CAST(CAST(CASE WHEN abs(100.0 * safe / total - floor(100.0 * safe / total) - 0.5) < 1e-12
    THEN 2 * round(50.0 * safe / total) ELSE round(100.0 * safe / total) END AS BIGINT) AS VARCHAR) || '%' AS survival_rate,
  printf('%.1f', c * 100) || '%' AS avg_confidence_text FROM k"""


@query("e11_log_kpis", KPI_SQL)
def e11_log_kpis(spark, sf_dir):
    return E.log_kpis(V.history(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


OUTCOME_SQL = f"""WITH {HISTORY} SELECT Industry, count(*) FILTER (Prediction = 'Failed') AS Failed,
  count(*) FILTER (Prediction = 'Safe') AS Safe FROM history GROUP BY Industry"""


@query("e12_outcome_by_industry", OUTCOME_SQL)
def e12_outcome_by_industry(spark, sf_dir):
    return E.outcome_by_industry(V.history(spark, sf_dir))
