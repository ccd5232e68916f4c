"""The flagship query: survival rate by industry over engineered records."""

from pyspark.sql import functions as F

from recordrisk.operators.features import fit_features
from recordrisk.operators.profile import rate_by, rate_tier
from recordrisk.plans.registry import query
from recordrisk.plans.sqltext import FEATURES
from recordrisk.schemas import TARGET
from recordrisk.sources import views as V


@query("survival_by_industry", f"""WITH {FEATURES}, r AS (SELECT IndustryClean, avg(StatusCode) AS rate, count(*) AS n
  FROM features GROUP BY IndustryClean)
SELECT IndustryClean, round(rate, 6) AS rate, n,
  CASE WHEN rate > 0.7 THEN 'high' WHEN rate > 0.5 THEN 'middle' ELSE 'low' END AS tier FROM r""")
def survival_by_industry(spark, sf_dir):
    master = V.saved_master(spark, sf_dir)
    table = fit_features(master).transform(master, [TARGET, "IndustryClean"])
    rates = rate_tier(rate_by(table, "IndustryClean", TARGET), "rate", 0.7, 0.5)
    return rates.select("IndustryClean", F.round("rate", 6).alias("rate"), "n", "tier")
