"""Queries of categorical encoding and numeric features."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from recordrisk.functions import columns as C, tables as R
from recordrisk.operators import encode as E, features as D
from recordrisk.plans.registry import query
from recordrisk.plans.sqltext import (
    CITY_FIXED, FEATURES, HISTORY, MASTER, RECORDS, ROUNDED_FEATURES, band_case, in_list, industry_case,
    map_case, rules_case, stage_case)
from recordrisk.schemas import FEATURES as FEATURE_LIST, FEATURES_BASIC
from recordrisk.sources import io, views as V


@query("c1_encode_stage", f"""WITH {RECORDS} SELECT id, {stage_case()} AS StageTrain,
  {stage_case(rules='serve')} AS StageServe FROM records""")
def c1_encode_stage(spark, sf_dir):
    df = E.encode_stage(V.raw_records(spark, sf_dir), out="StageTrain")
    return E.encode_stage(df, rules="serve", out="StageServe").select("id", "StageTrain", "StageServe")


@query("c2_classify_industry", f"""WITH {RECORDS} SELECT id, {industry_case()} AS IndustryTrain,
  {industry_case(rules='serve')} AS IndustryServe FROM records""")
def c2_classify_industry(spark, sf_dir):
    df = E.classify_industry(V.raw_records(spark, sf_dir), out="IndustryTrain")
    return E.classify_industry(df, rules="serve", out="IndustryServe").select("id", "IndustryTrain", "IndustryServe")


@query("c2_classify_documents", f"""SELECT doc_id, {rules_case("lower(text)", R.INDUSTRY_RULES_TRAIN, "Other")} AS industry,
  {rules_case("lower(text)", R.STAGE_RULES_TRAIN, R.STAGE_DEFAULT)} AS stage FROM documents""")
def c2_classify_documents(spark, sf_dir):
    """The keyword rules over whole document texts."""
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", C.industry_class("text").alias("industry"), C.stage_code("text").alias("stage"))


@query("c3_fold_rare", f"""WITH {RECORDS}, fixed AS (SELECT id, {CITY_FIXED} AS City FROM records),
frequent AS (SELECT City AS kept FROM fixed WHERE City IS NOT NULL GROUP BY City ORDER BY count(*) DESC, City LIMIT 15)
SELECT id, CASE WHEN kept IS NULL THEN 'Other' ELSE City END AS City FROM fixed LEFT JOIN frequent ON City = kept""")
def c3_fold_rare(spark, sf_dir):
    df = V.raw_records(spark, sf_dir).select("id", "City").replace(R.CITY_FIXES, subset=["City"])
    return E.fold_rare(df, "City", 15)


@query("c3_fold_rare_sources", """WITH frequent AS (SELECT p_name AS kept FROM part GROUP BY p_name
  ORDER BY count(*) DESC, p_name LIMIT 10)
SELECT p_partkey, CASE WHEN kept IS NULL THEN 'Other' ELSE p_name END AS p_name
FROM part LEFT JOIN frequent ON p_name = kept""")
def c3_fold_rare_sources(spark, sf_dir):
    return E.fold_rare(V.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", 10)


@query("c4_ordinal", """WITH codes AS (SELECT c_name AS value, CAST(row_number() OVER (ORDER BY c_name) - 1 AS INT) AS code
  FROM (SELECT DISTINCT c_name FROM customer))
SELECT o_orderkey, code AS CustomerEncoded FROM orders JOIN customer ON o_custkey = c_custkey JOIN codes ON c_name = value""")
def c4_ordinal(spark, sf_dir):
    """Fit and apply over a category with as many values as there are customers."""
    names = V.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    encoding = E.fit_ordinal(names, "c_name")
    orders = V.table(spark, sf_dir, "orders").join(names, F.col("o_custkey") == F.col("c_custkey"))
    return E.apply_ordinal(orders, "c_name", encoding, "CustomerEncoded").select("o_orderkey", "CustomerEncoded")


@query("c4_ordinal_null_label", f"""WITH {RECORDS}, named AS (SELECT id, coalesce(Industry, 'nan') AS v FROM records),
codes AS (SELECT v AS value, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM (SELECT DISTINCT v FROM named))
SELECT id, code AS IndustryEncoded FROM named JOIN codes ON v = value""")
def c4_ordinal_null_label(spark, sf_dir):
    df = V.raw_records(spark, sf_dir).select("id", "Industry")
    encoding = E.fit_ordinal(df, "Industry", null_label="nan")
    return E.apply_ordinal(df, "Industry", encoding, null_label="nan").select("id", "IndustryEncoded")


@query("c5_apply_encoding", f"""WITH {RECORDS} SELECT id,
  CAST({map_case('City', R.SERVICE_CITY_CODES, '0')} AS INT) AS CityService,
  CAST({map_case('City', R.DASHBOARD_CITY_CODES, '0')} AS INT) AS CityDashboard,
  CAST({map_case('Industry', R.DASHBOARD_INDUSTRY_CODES, '1')} AS INT) AS IndustryDashboard,
  CAST({map_case('Stage', R.DASHBOARD_STAGE_CODES, '2')} AS INT) AS StageDashboard FROM records""")
def c5_apply_encoding(spark, sf_dir):
    service, dashboard = io.SERVICE_CODES, io.encoding_table(spark, io.DASHBOARD_CODES)
    df = V.raw_records(spark, sf_dir)
    df = E.apply_encoding(df, "City", service, 0, "CityService")
    df = E.apply_encoding(df, "City", dashboard, 0, "CityDashboard")
    df = E.apply_encoding(df, "Industry", dashboard, 1, "IndustryDashboard")
    df = E.apply_encoding(df, "Stage", dashboard, 2, "StageDashboard")
    return df.select("id", "CityService", "CityDashboard", "IndustryDashboard", "StageDashboard")


@query("c6_membership_flag", f"""WITH {RECORDS} SELECT id,
  CASE WHEN City IN {in_list(R.MAJOR_CITIES)} THEN 1 ELSE 0 END AS IsMajorCity,
  CASE WHEN Industry IN {in_list(R.TECH_INDUSTRIES)} THEN 1 ELSE 0 END AS IsTechIndustry FROM records""")
def c6_membership_flag(spark, sf_dir):
    df = E.membership_flag(V.raw_records(spark, sf_dir), "City", R.MAJOR_CITIES, "IsMajorCity")
    return E.membership_flag(df, "Industry", R.TECH_INDUSTRIES, "IsTechIndustry").select("id", "IsMajorCity", "IsTechIndustry")


@query("c7_band", f"""WITH {MASTER} SELECT id, {band_case('TotalFunding')} AS FundingBand FROM master
UNION ALL SELECT -1 - c_custkey, {band_case('c_acctbal * 1000')} FROM customer""")
def c7_band(spark, sf_dir):
    """Bands of the amounts, missing ones included, and of account balances with negatives."""
    records = E.band(V.master_records(spark, sf_dir), "TotalFunding").select("id", "FundingBand")
    balances = V.table(spark, sf_dir, "customer").select(
        (-1 - F.col("c_custkey")).alias("id"), C.band(F.col("c_acctbal") * 1000).alias("FundingBand"))
    return records.unionByName(balances)


@query("c8_decode_labels", f"""WITH {RECORDS}, coded AS (SELECT id, {stage_case()} AS code FROM records)
SELECT id, coalesce({map_case('code', R.STAGE_LABELS)}, CAST(code AS VARCHAR)) AS stage,
  coalesce({map_case('id % 3', {0: 'Failed', 1: 'Safe'})}, CAST(id % 3 AS VARCHAR)) AS outcome FROM coded""")
def c8_decode_labels(spark, sf_dir):
    df = E.encode_stage(V.raw_records(spark, sf_dir), out="code").withColumn("outcome", F.col("id") % 3)
    df = E.decode_labels(df, "code", R.STAGE_LABELS, "stage")
    return E.decode_labels(df, "outcome", {0: "Failed", 1: "Safe"}, "outcome").select("id", "stage", "outcome")


@query("d1_quantile", f"""WITH {MASTER} SELECT q, round(CASE q WHEN 0.99 THEN (SELECT quantile_cont(TotalFunding, 0.99) FROM master)
  WHEN 0.5 THEN (SELECT quantile_cont(TotalFunding, 0.5) FROM master)
  ELSE (SELECT quantile_cont(c_acctbal, 0.05) FROM customer) END, 6) AS value
FROM (SELECT CAST(unnest([0.05, 0.5, 0.99]) AS DOUBLE) AS q)""")
def d1_quantile(spark, sf_dir):
    master = V.saved_master(spark, sf_dir)
    parts = [D.quantile(V.table(spark, sf_dir, "customer"), "c_acctbal", 0.05),
             D.quantile(master, "TotalFunding", 0.5), D.quantile(master, "TotalFunding", 0.99)]
    return parts[0].union(parts[1]).union(parts[2]).select("q", F.round("value", 6).alias("value"))


@query("d2_winsorize_upper", f"""WITH {MASTER}, cap AS (SELECT quantile_cont(TotalFunding, 0.99) AS c FROM master)
SELECT id, round(CASE WHEN TotalFunding > c THEN c ELSE TotalFunding END, 4) AS TotalFunding FROM master, cap""")
def d2_winsorize_upper(spark, sf_dir):
    df = D.winsorize_upper(V.saved_master(spark, sf_dir), "TotalFunding")
    return df.select("id", F.round("TotalFunding", 4).alias("TotalFunding"))


@query("d3_floor_fill", f"WITH {RECORDS} SELECT id, greatest(coalesce(FundingRounds, 1), 1) AS FundingRounds FROM records")
def d3_floor_fill(spark, sf_dir):
    return V.raw_records(spark, sf_dir).select("id", C.floor_fill("FundingRounds").alias("FundingRounds"))


@query("d4_safe_ratio", """SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 8) AS price,
  round(l_extendedprice / nullif(l_discount, 0), 8) AS per_discount FROM lineitem""")
def d4_safe_ratio(spark, sf_dir):
    return V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(C.safe_ratio("l_extendedprice", "l_quantity"), 8).alias("price"),
        F.round(C.safe_ratio("l_extendedprice", "l_discount"), 8).alias("per_discount"))


@query("d5_log1p", """SELECT c_custkey, round(CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END, 6) AS log_balance
FROM customer""")
def d5_log1p(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select("c_custkey", F.round(C.log1p("c_acctbal"), 6).alias("log_balance"))


def rounded(df, keep=("id",)):
    """Feature columns at the precision the SQL counterparts use."""
    digits = {"TotalFunding": 4, "FundingPerRound": 7, "LogFunding": 6, "LogFundingPerRound": 6}
    return df.select(*keep, *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in FEATURE_LIST])


@query("d6_build_features", f"WITH {FEATURES} SELECT {ROUNDED_FEATURES} FROM features")
def d6_build_features(spark, sf_dir):
    master = V.saved_master(spark, sf_dir)
    return rounded(D.fit_features(master).transform(master, ["id"]))


@query("d6_request_features", f"""WITH {HISTORY} SELECT pred_id AS id, CAST(Funding AS DOUBLE) AS TotalFunding,
  CAST(greatest(Rounds, 1) AS DOUBLE) AS FundingRounds, round(CAST(Funding AS DOUBLE) / greatest(Rounds, 1), 7) AS FundingPerRound,
  round(ln(1 + CAST(Funding AS DOUBLE)), 6) AS LogFunding,
  round(ln(1 + CAST(Funding AS DOUBLE) / greatest(Rounds, 1)), 6) AS LogFundingPerRound,
  {stage_case(rules='serve')} AS StageEncoded,
  CAST({map_case('City', R.SERVICE_CITY_CODES, '0')} AS INT) AS CityEncoded,
  CAST({map_case(industry_case(rules='serve'), R.SERVICE_INDUSTRY_CODES, '0')} AS INT) AS IndustryEncoded,
  CASE WHEN City IN {in_list(R.MAJOR_CITIES)} THEN 1 ELSE 0 END AS IsMajorCity,
  CASE WHEN {industry_case(rules='serve')} IN {in_list(R.TECH_INDUSTRIES)} THEN 1 ELSE 0 END AS IsTechIndustry,
  {band_case('Funding')} AS FundingBand FROM history""")
def d6_request_features(spark, sf_dir):
    """The service's features of score requests, with its frozen codes."""
    from recordrisk.operators.score import request_features

    requests = V.requests_from(V.history(spark, sf_dir))
    return rounded(request_features(requests, keep=["request_id"]).withColumnRenamed("request_id", "id"))


@query("d7_features_basic", f"""WITH {RECORDS},
named AS (SELECT id, coalesce(TRY_CAST(TotalFunding AS DOUBLE), 0.0) AS TotalFunding,
  coalesce(CAST(FundingRounds AS DOUBLE), 0.0) AS FundingRounds, coalesce(City, 'Unknown') AS City,
  coalesce(Industry, 'Unknown') AS Industry FROM records),
cc AS (SELECT City AS v, CAST(row_number() OVER (ORDER BY City) - 1 AS INT) AS code FROM (SELECT DISTINCT City FROM named)),
ic AS (SELECT Industry AS v, CAST(row_number() OVER (ORDER BY Industry) - 1 AS INT) AS code FROM (SELECT DISTINCT Industry FROM named))
SELECT id, TotalFunding, FundingRounds, cc.code AS CityEncoded, ic.code AS IndustryEncoded
FROM named JOIN cc ON City = cc.v JOIN ic ON Industry = ic.v""")
def d7_features_basic(spark, sf_dir):
    records = V.raw_records(spark, sf_dir)
    return D.build_features_basic(records, D.fit_encodings_basic(records), keep=["id"]).select("id", *FEATURES_BASIC)


@query("d8_assemble", f"""WITH {FEATURES} SELECT id, round(coalesce(TotalFunding, 0), 4) AS f0,
  round(coalesce(LogFunding, 0), 6) AS f3, CAST(FundingBand AS DOUBLE) AS f10, 11 AS size FROM features""")
def d8_assemble(spark, sf_dir):
    """Positions of the assembled vector, missing values as zero."""
    master = V.saved_master(spark, sf_dir)
    v = vector_to_array("features")
    return D.assemble(D.fit_features(master).transform(master, ["id"])).select(
        "id", F.round(v[0], 4).alias("f0"), F.round(v[3], 6).alias("f3"), v[10].alias("f10"), F.size(v).alias("size"))


@query("d9_standardize", """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq,
  avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity,
  round((l_extendedprice - mp) / sp, 6) AS l_extendedprice FROM lineitem, s""")
def d9_standardize(spark, sf_dir):
    df = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    scaled = D.standardize(df, ["l_quantity", "l_extendedprice"])
    return scaled.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"),
                         F.round("l_extendedprice", 6).alias("l_extendedprice"))


