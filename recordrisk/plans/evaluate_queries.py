"""Queries of evaluation over the label, prediction and score of every order."""

from pyspark.sql import functions as F

from recordrisk.operators import evaluate as H
from recordrisk.plans.registry import query
from recordrisk.plans.sqltext import SCORES
from recordrisk.sources import views as V


@query("h1_confusion_matrix", f"WITH {SCORES} SELECT label, prediction, count(*) AS n FROM scores GROUP BY ALL")
def h1_confusion_matrix(spark, sf_dir):
    return H.confusion_matrix(V.scores(spark, sf_dir))


@query("h1_confusion_counts", f"""WITH {SCORES} SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM scores""")
def h1_confusion_counts(spark, sf_dir):
    return H.confusion_counts(V.scores(spark, sf_dir))


CELLS = """cells AS (SELECT CAST(count(*) FILTER (label = 1 AND prediction = 1) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (label = 0 AND prediction = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (label = 1 AND prediction = 0) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (label = 0 AND prediction = 0) AS DOUBLE) AS tn FROM scores)"""


@query("h2_binary_metrics", f"""WITH {SCORES}, {CELLS} SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM cells""")
def h2_binary_metrics(spark, sf_dir):
    m = H.binary_metrics(V.scores(spark, sf_dir))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def _report_sql(source, classes):
    """Report in SQL, one sub-select per class as a person would write it."""
    per = " UNION ALL ".join(f"""SELECT '{c}' AS class,
      count(*) FILTER (y = '{c}' AND p = '{c}') / CAST(greatest(count(*) FILTER (p = '{c}'), 1) AS DOUBLE) AS precision,
      count(*) FILTER (y = '{c}' AND p = '{c}') / CAST(greatest(count(*) FILTER (y = '{c}'), 1) AS DOUBLE) AS recall,
      count(*) FILTER (y = '{c}') AS support FROM {source}""" for c in classes)
    return f"""pr AS ({per}), per AS (SELECT class, precision, recall,
      CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM pr),
    report AS (SELECT class, precision, recall, f1, support FROM per
      UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM {source}), (SELECT count(*) FROM {source})
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report"""


def _rounded(report):
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("h3_classification_report", f"""WITH {SCORES}, s AS (SELECT CAST(label AS VARCHAR) AS y, CAST(prediction AS VARCHAR) AS p FROM scores),
{_report_sql('s', ['0', '1'])}""")
def h3_classification_report(spark, sf_dir):
    return _rounded(H.classification_report(V.scores(spark, sf_dir)))


@query("h3_report_three_classes", f"""WITH s AS (SELECT o_orderstatus AS y,
  CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O' ELSE 'P' END AS p FROM orders),
{_report_sql('s', ['F', 'O', 'P'])}""")
def h3_report_three_classes(spark, sf_dir):
    price = F.col("o_totalprice")
    guess = F.when(price > 300000, "F").when(price > 150000, "O").otherwise("P")
    df = V.table(spark, sf_dir, "orders").select("o_orderstatus", guess.alias("guess"))
    return _rounded(H.classification_report(df, "o_orderstatus", "guess"))


AUC = """ranked AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scores),
area AS (SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
  / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)) AS auc FROM ranked)"""


@query("h4_roc_auc", f"WITH {SCORES}, {AUC} SELECT round(auc, 9) AS roc_auc FROM area")
def h4_roc_auc(spark, sf_dir):
    return H.roc_auc(V.scores(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


_CURVE = """per AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scores GROUP BY score),
curve AS (SELECT score, pos, neg, sum(neg) OVER w AS fp, sum(pos) OVER w AS tp, lead(pos) OVER w AS pos2, lead(neg) OVER w AS neg2,
  row_number() OVER w AS i FROM per WINDOW w AS (ORDER BY score DESC)),
ends AS (SELECT CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n FROM per)"""


def _curve_rows(curve):
    return curve.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("h5_roc_curve", f"""WITH {SCORES}, {_CURVE}
SELECT score AS threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM curve, ends
UNION ALL SELECT NULL, 0.0, 0.0""")
def h5_roc_curve(spark, sf_dir):
    return _curve_rows(H.roc_curve(V.scores(spark, sf_dir)))


@query("h5_roc_curve_corners", f"""WITH {SCORES}, {_CURVE}
SELECT score AS threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM curve, ends
WHERE i = 1 OR pos2 IS NULL OR pos <> pos2 OR neg <> neg2
UNION ALL SELECT NULL, 0.0, 0.0""")
def h5_roc_curve_corners(spark, sf_dir):
    return _curve_rows(H.roc_curve(V.scores(spark, sf_dir), drop_intermediate=True))


_ONE_MODEL = f"""{CELLS}, {AUC},
m AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp) AS precision,
  tp / (tp + fn) AS recall, auc FROM cells, area)"""


def _variant(predictions, name):
    """The metrics of one rule over the shared scores, as a sub-select."""
    return f"""(WITH scores AS (SELECT label, {predictions} AS prediction, score FROM base), {_ONE_MODEL}
      SELECT '{name}' AS model, round(accuracy, 4) AS accuracy, round(f1, 4) AS f1, round(precision, 4) AS precision,
        round(recall, 4) AS recall, round(auc, 4) AS roc_auc FROM m)"""


_RULES = {"half": 0.5, "low": 0.2, "high": 0.8}
_VARIANTS = SCORES.replace("scores AS", "base AS") + ", v AS (" + " UNION ALL ".join(
    _variant(f"CASE WHEN score > {t} THEN 1 ELSE 0 END", n) for n, t in _RULES.items()) + ")"


def _results(spark, sf_dir):
    scores = V.scores(spark, sf_dir)
    return {n: scores.withColumn("prediction", F.when(F.col("score") > t, 1).otherwise(0)) for n, t in _RULES.items()}


@query("h6_metrics_table", f"WITH {_VARIANTS} " + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, {m} AS value FROM v" for m in H.METRICS)
    + " UNION ALL SELECT 'run', 'test_rows', CAST(count(*) AS DOUBLE) FROM base")
def h6_metrics_table(spark, sf_dir):
    return H.metrics_table(_results(spark, sf_dir), extra={"test_rows": V.scores(spark, sf_dir).count()})


@query("g9_compare_models", f"""WITH {_VARIANTS}
SELECT model, accuracy, f1, precision, recall, roc_auc, CASE WHEN model = (SELECT model FROM v WHERE f1 > 0
  ORDER BY f1 DESC, {' '.join(['CASE model'] + [f"WHEN '{n}' THEN {i}" for i, n in enumerate(_RULES)] + ['END'])} LIMIT 1)
  THEN 1 ELSE 0 END AS is_best FROM v""")
def g9_compare_models(spark, sf_dir):
    return H.compare_models(H.metrics_table(_results(spark, sf_dir)), list(_RULES))
