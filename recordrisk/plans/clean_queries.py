"""Queries of projection, filtering and cleaning."""

from recordrisk.functions import tables as R
from recordrisk.operators import clean as B
from recordrisk.plans.registry import query
from recordrisk.plans.sqltext import HISTORY, MASTER, RECORDS, MONEY, CITY_FIXED, map_case
from recordrisk.sources import views as V


@query("b1_select_columns", f"WITH {HISTORY} SELECT City, Industry, Stage, Funding, Prediction, Confidence FROM history")
def b1_select_columns(spark, sf_dir):
    """The display columns of the log, those that exist."""
    shown = ["City", "Industry", "Stage", "Funding", "Prediction", "Confidence", "Reason"]
    return B.select_columns(V.history(spark, sf_dir), shown, existing_only=True)


@query("b2_rename_columns", "SELECT o_orderkey AS Startup, o_orderstatus AS Status, o_totalprice AS TotalFunding FROM orders")
def b2_rename_columns(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return B.rename_columns(orders, ["Startup", "Status", "TotalFunding"])


@query("b3_filter_equals", f"WITH {RECORDS} SELECT id, Startup, City FROM records WHERE Country = 'ASIA'")
def b3_filter_equals(spark, sf_dir):
    return B.filter_equals(V.raw_records(spark, sf_dir), "Country", "ASIA").select("id", "Startup", "City")


@query("b4_filter_in", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F')")
def b4_filter_in(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return B.filter_in(orders, "o_orderstatus", ["O", "F"])


@query("b5_binary_target", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target FROM orders")
def b5_binary_target(spark, sf_dir):
    return B.binary_target(V.table(spark, sf_dir, "orders"), "o_orderstatus", "F").select("o_orderkey", "target")


@query("b6_map_values", f"""WITH {RECORDS} SELECT id, {map_case('Status', R.STATUS_CODES)} AS StatusCode,
  {map_case('Industry', {'EdTech': 1, 'FinTech': 2})} AS IndustryCode FROM records""")
def b6_map_values(spark, sf_dir):
    df = B.map_values(V.raw_records(spark, sf_dir), "Status", R.STATUS_CODES, "StatusCode")
    return B.map_values(df, "Industry", {"EdTech": 1, "FinTech": 2}, "IndustryCode").select("id", "StatusCode", "IndustryCode")


@query("b7_replace_values", f"WITH {RECORDS} SELECT id, {CITY_FIXED} AS City FROM records")
def b7_replace_values(spark, sf_dir):
    return B.replace_values(V.raw_records(spark, sf_dir), "City", R.CITY_FIXES).select("id", "City")


@query("b8_parse_money", f"WITH {RECORDS} SELECT id, {MONEY} AS TotalFunding FROM records")
def b8_parse_money(spark, sf_dir):
    return B.parse_money(V.raw_records(spark, sf_dir), "TotalFunding").select("id", "TotalFunding")


@query("b9_to_number", f"""WITH {RECORDS}
SELECT id, coalesce(TRY_CAST(TotalFunding AS DOUBLE), 0.0) AS TotalFunding FROM records""")
def b9_to_number(spark, sf_dir):
    """Amounts with commas do not parse and become zero, as they do in the reference."""
    return B.to_number(V.raw_records(spark, sf_dir), "TotalFunding").select("id", "TotalFunding")


@query("b10_fill_missing", f"""WITH {RECORDS} SELECT id, coalesce(City, 'Unknown') AS City,
  coalesce(Industry, 'Unknown') AS Industry, coalesce(FundingRounds, 1) AS FundingRounds FROM records""")
def b10_fill_missing(spark, sf_dir):
    df = V.raw_records(spark, sf_dir).select("id", "City", "Industry", "FundingRounds")
    return B.fill_missing(df, {"City": "Unknown", "Industry": "Unknown", "FundingRounds": 1})


@query("b11_stringify_category", f"WITH {RECORDS} SELECT id, coalesce(City, 'nan') AS City FROM records")
def b11_stringify_category(spark, sf_dir):
    return B.stringify_category(V.raw_records(spark, sf_dir).select("id", "City"), "City")


_AUDITED = ["City", "Industry", "Stage", "TotalFunding", "FundingRounds", "FoundedAt", "FirstFundingAt", "Status"]


@query("b12_null_audit", f"""WITH {RECORDS} SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing FROM records" for c in _AUDITED
) + ") WHERE missing > 0")
def b12_null_audit(spark, sf_dir):
    return B.null_audit(V.raw_records(spark, sf_dir), _AUDITED)


@query("b13_table_shape", f"WITH {RECORDS} SELECT count(*) AS n_rows, 12 AS n_cols FROM records")
def b13_table_shape(spark, sf_dir):
    return B.table_shape(V.raw_records(spark, sf_dir))


@query("b13_head_rows", f"WITH {MASTER} SELECT * FROM master ORDER BY id LIMIT 5")
def b13_head_rows(spark, sf_dir):
    return B.head_rows(V.master_records(spark, sf_dir), ["id"])
