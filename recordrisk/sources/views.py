"""Stand-in views over the star-schema tables: records, prediction log, scores."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordrisk.functions import columns as C, tables as R
from recordrisk.schemas import TARGET
from recordrisk.workspace import durable

# --- fixed values of the stand-in views --------------------------------------------------
CITIES = (
    "Bengaluru|Bangalore|New Delhi|Delhi|Gurugram|Gurgaon|Ncr|Delhi Ncr|Mumbai|Hyderabad|Chennai|Pune"
    "|Noida|Ahmedabad|Kolkata|Jaipur|Kochi|Indore|Patna|Visakhapatnam|Surat|Nagpur|Goa|Bhopal|"
)
INDUSTRIES = (
    "EdTech|Online Education|FinTech|Digital Payments|HealthTech|Pharma|E-Commerce|Retail Trading|SaaS"
    "|Consumer Internet|Food Delivery|FoodTech|Logistics|Real Estate|Agriculture|AgriTech|Media"
    "|Manufacturing|Consulting|Travel|Space|"
)
STAGES = (
    "Pre-Seed|Angel|Seed Round| seed |Pre-Series A|Bridge|Series A|Series B|SERIES C|Series D|Series F"
    "|Private Equity|Post-IPO|Debt|Registered|Unspecified|Unknown|"
)
LOG_CITIES = "Bangalore|Mumbai|Delhi|Surat|Kochi"
LOG_STAGES = "Seed|Series A|Bridge|Private Equity"
LOG_INDUSTRIES = {"view": "EdTech", "click": "FinTech", "purchase": "E-Commerce", "signup": "Logistics"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names, position):
    return F.split_part(F.lit(names), F.lit("|"), position.cast("int") + 1)


def _pick_or_null(names, position):
    return F.nullif(_pick(names, position), F.lit(""))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw record per order: money as text, messy category names, missing values.

    The line counts are aggregated on the order key first, so orders and lines meet on one
    shuffle key; nation and region are a few rows and Catalyst broadcasts them by size.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lines = (
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.min("l_shipdate").alias("first_ship"),
             F.max("l_shipdate").alias("last_ship"))
    )
    key = F.col("o_orderkey")
    amount = F.col("o_totalprice") * F.when(key % 3 == 0, 1).when(key % 3 == 1, 10).otherwise(100)
    place = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("o_custkey"), "n_nationkey", "r_name")
    )
    return (
        orders.join(place, "o_custkey").join(lines, "o_orderkey", "left")
        .select(
            key.alias("id"),
            F.concat(F.lit("Record#"), key.cast("string")).alias("Startup"),
            F.col("r_name").alias("Country"),
            _pick_or_null(CITIES, F.col("n_nationkey")).alias("City"),
            _pick_or_null(INDUSTRIES, key % 22).alias("Industry"),
            _pick_or_null(STAGES, key % 18).alias("Stage"),
            F.when(key % 17 == 0, "-").when(key % 101 == 0, F.lit(None))
            .otherwise(F.format_number(amount, 2)).alias("TotalFunding"),
            F.col("n_lines").alias("FundingRounds"),
            F.col("o_orderdate").cast("date").cast("string").alias("FoundedAt"),
            F.col("first_ship").cast("date").cast("string").alias("FirstFundingAt"),
            F.col("last_ship").cast("date").cast("string").alias("LastFundingAt"),
            F.when(F.col("o_orderstatus") == "O", "operating")
            .when(F.col("o_orderstatus") == "F", "closed")
            .when(key % 2 == 0, "acquired").otherwise("ipo").alias("Status"),
        )
    )


def master_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with numeric money and the binary label (1 unless closed)."""
    return raw_records(spark, sf_dir).select(
        "id", "City", "Industry", "Stage",
        C.money("TotalFunding").alias("TotalFunding"),
        F.col("FundingRounds").cast("double").alias("FundingRounds"),
        F.when(F.col("Status") == "closed", 0).otherwise(1).alias(TARGET),
        F.when(F.col("Status") == "closed", "Failed").otherwise("Safe").alias("Status"),
    )


def saved_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned records written out once, for work that passes over them several times."""
    return durable(master_records(spark, sf_dir))


def prediction_log(events: DataFrame) -> DataFrame:
    """Prediction log derived from the event table; works on a stream as well."""
    funding = F.floor(F.col("value") * 10000).cast("long")
    key = F.col("event_id")
    return events.select(
        key.alias("pred_id"), funding.alias("Funding"), (key % 6).cast("int").alias("Rounds"),
        _pick(LOG_CITIES, F.col("user_id") % 5).alias("City"),
        F.coalesce(C.map_literal("event_type", LOG_INDUSTRIES), F.lit("Other")).alias("Industry"),
        _pick(LOG_STAGES, key % 4).alias("Stage"),
        F.when(funding > R.RULE_THRESHOLD, "Safe").otherwise("Failed").alias("Prediction"),
        F.round(F.lit(0.5) + (key % 500) / F.lit(1000.0), 4).alias("Confidence"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_log(table(spark, sf_dir, "events"))


def requests_from(log: DataFrame) -> DataFrame:
    """Score requests with the inputs of logged predictions; works on a stream as well."""
    return log.select(
        F.col("pred_id").alias("request_id"), F.col("Funding").cast("double").alias("total_funding"),
        F.col("Rounds").alias("funding_rounds"), F.col("City").alias("city"),
        F.col("Industry").alias("industry"), F.col("Stage").alias("stage"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, prediction and score per order, for the evaluation operators."""
    return scores_of(table(spark, sf_dir, "orders"))


def scores_of(orders: DataFrame) -> DataFrame:
    """The same from a table or stream of orders."""
    score = F.round(F.col("o_totalprice") / 500000, 4)
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("label"),
        F.when(score > 0.5, 1).otherwise(0).alias("prediction"),
        score.alias("score"),
    )
