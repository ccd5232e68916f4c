"""Feature tables the model queries train on."""

from pyspark.sql import functions as F

from recordrisk.operators.features import fit_features
from recordrisk.schemas import TARGET
from recordrisk.sources import views as V
from recordrisk.workspace import durable


# The label of the model queries follows from a feature without noise, so the right predictions can be told by SQL.
LATE_STAGE = 4


def model_table(spark, sf_dir):
    """The eleven features of every record with the label and the clear label, written once."""
    return fitted_table(spark, sf_dir)[1]


def fitted_table(spark, sf_dir):
    master = V.saved_master(spark, sf_dir)
    fit = fit_features(master)
    return fit, durable(clear(fit.transform(master, ["id", TARGET])))


def clear(table, label="target"):
    """1 from a late stage on."""
    return table.withColumn(label, F.when(F.col("StageEncoded") >= LATE_STAGE, 1).otherwise(0))


def clear_classes(table, label="stage3"):
    """Early, middle and late stages."""
    return table.withColumn(label, F.when(F.col("StageEncoded") <= 2, 0).when(F.col("StageEncoded") <= 5, 1).otherwise(2))


# Labels that need two features, again without noise.
MANY_ROUNDS = 4


def both_clear(table, label="target"):
    """1 from a late stage and several rounds on."""
    late, many = F.col("StageEncoded") >= LATE_STAGE, F.coalesce(F.col("FundingRounds"), F.lit(0)) >= MANY_ROUNDS
    return table.withColumn(label, F.when(late & many, 1).otherwise(0))


def both_classes(table, label="class3"):
    """0 for early stages, else 1 or 2 by the number of rounds."""
    many = F.coalesce(F.col("FundingRounds"), F.lit(0)) >= MANY_ROUNDS
    return table.withColumn(label, F.when(F.col("StageEncoded") <= 2, 0).when(many, 2).otherwise(1))


def learnable(table, label="target"):
    """A label that follows from the features but for one record in twenty."""
    rule = (F.coalesce(F.col("TotalFunding"), F.lit(0.0)) > 500_000) & (F.col("FundingRounds") >= 3)
    noise = F.col("id") % 20 == 0
    return table.withColumn(label, F.when(rule != noise, 1).otherwise(0))
