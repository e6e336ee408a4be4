"""Queries on scores of a naive forecast."""

from pyspark.sql import functions as F

from threshcast.catalogue.base import (
    FORECASTS,
    FORECASTS_WITH_HOLES,
    forecasts,
    query,
    rounded,
)
from threshcast.functions.measures import aliased, confusion, core_suite, log_percentage_error
from threshcast.operators.scoring import (
    fold_scores,
    long_scores,
    performance_table,
    score,
    summarise_folds,
)

HIGH, WARN = 100.0, 50.0


def _core_sql(t=100, w=50):
    """Core scores over a relation with columns y and p."""
    return f"""count(*) FILTER (ty AND tp) AS "TP", count(*) FILTER (NOT ty AND tp) AS "FP",
  count(*) FILTER (NOT ty AND NOT tp) AS "TN", count(*) FILTER (ty AND NOT tp) AS "FN",
  round(sqrt(avg((y-p)*(y-p))), 6) AS rmse,
  round(sqrt(avg((y-p)*(y-p)) FILTER (NOT ty)), 6) AS rmse_safe,
  round(sqrt(avg((y-p)*(y-p)) FILTER (ty)), 6) AS rmse_exceedance,
  round(1 - sum((y-p)*(y-p)) / (var_pop(y) FILTER (y IS NOT NULL AND p IS NOT NULL)
     * count(*) FILTER (y IS NOT NULL AND p IS NOT NULL)), 6) AS r2,
  round(100 * sum(abs(y-p)) FILTER (NOT ty) / nullif(sum(abs(y)) FILTER (NOT ty), 0), 6) AS wmape_safe,
  round(100 * sum(abs(y-p)) FILTER (ty) / nullif(sum(abs(y)) FILTER (ty), 0), 6) AS wmape_exceedance,
  round(coalesce(count(*) FILTER (ty AND tp) / nullif(count(*) FILTER (ty), 0), 1), 6) AS sensitivity,
  round(coalesce(count(*) FILTER (NOT ty AND NOT tp) / nullif(count(*) FILTER (NOT ty), 0), 1), 6) AS specificity,
  round(coalesce(count(*) FILTER (ty AND coalesce(p >= {w}, false)) / nullif(count(*) FILTER (ty), 0), 1), 6)
    AS precautionary_sensitivity"""


def _flags(t=100):
    return f""", m AS (SELECT *, coalesce(y >= {t}, false) AS ty, coalesce(p >= {t}, false) AS tp FROM fc)"""


@query("WITH " + FORECASTS + _flags() + " SELECT " + _core_sql() + " FROM m")
def core_metrics(spark, folder):
    return rounded(score(forecasts(spark, folder), "y", "p", threshold=HIGH, precaution=WARN))


@query("WITH " + FORECASTS + _flags(280) + " SELECT " + _core_sql(280, 140) + " FROM m")
def core_metrics_default_thresholds(spark, folder):
    return rounded(score(forecasts(spark, folder), "y", "p"))


@query(
    "WITH "
    + FORECASTS_WITH_HOLES
    + _flags()
    + " SELECT season, "
    + _core_sql()
    + " FROM m GROUP BY season"
)
def core_metrics_missing_values(spark, folder):
    """Truth or forecast may be missing: such a row is not at a threshold and has no error."""
    fc = forecasts(spark, folder, complete=False)
    return rounded(score(fc, "y", "p", ["season"], threshold=HIGH, precaution=WARN))


@query(
    "WITH "
    + FORECASTS
    + _flags()
    + """ SELECT site, count(*) FILTER (ty AND tp) AS "TP", count(*) FILTER (NOT ty AND tp) AS "FP",
  count(*) FILTER (NOT ty AND NOT tp) AS "TN", count(*) FILTER (ty AND NOT tp) AS "FN" FROM m GROUP BY site"""
)
def confusion_counts(spark, folder):
    return forecasts(spark, folder).groupBy("site").agg(*aliased(confusion("y", "p", HIGH)))


@query(
    "WITH "
    + FORECASTS
    + _flags()
    + """ SELECT season, round(coalesce(count(*) FILTER (ty AND p >= 50) / nullif(count(*) FILTER (ty), 0), 1), 6)
  AS precautionary_sensitivity FROM m GROUP BY season"""
)
def precautionary(spark, folder):
    column = core_suite("y", "p", HIGH, WARN)["precautionary_sensitivity"]
    out = forecasts(spark, folder).groupBy("season")
    return rounded(out.agg(column.alias("precautionary_sensitivity")))


def _regression_class(name, rows):
    return f""",
  CASE WHEN count(*) FILTER ({rows}) = 0 THEN -1 ELSE round(avg(abs(y-q)) FILTER ({rows}), 6) END AS mae_{name},
  CASE WHEN count(*) FILTER ({rows}) = 0 THEN -1
    ELSE round(sum(abs(y-q)) FILTER ({rows} AND y <> 0) / sum(y) FILTER ({rows} AND y <> 0), 6) END AS weighted_mape_{name},
  CASE WHEN count(*) FILTER ({rows}) = 0 THEN -1
    ELSE round(sum(abs(ly-lq)) FILTER ({rows} AND ly <> 0) / sum(ly) FILTER ({rows} AND ly <> 0), 6) END
    AS log_weighted_mape_{name},
  CASE WHEN count(*) FILTER ({rows}) = 0 THEN -1
    WHEN max(y) FILTER ({rows}) = min(y) FILTER ({rows}) THEN -1
    ELSE round(100 * sqrt(avg((y-q)*(y-q)) FILTER ({rows})) / (max(y) FILTER ({rows}) - min(y) FILTER ({rows})), 6) END
    AS nrmse_{name},
  CASE WHEN count(*) FILTER ({rows}) = 0 THEN -1 WHEN count(*) FILTER ({rows}) < 2 THEN NULL
    ELSE round(1 - sum((ly-lq)*(ly-lq)) FILTER ({rows})
      / (var_pop(ly) FILTER ({rows}) * count(*) FILTER ({rows})), 6) END AS log_r2_{name}"""


_REGRESSION = (
    """round(sqrt(avg((ly-lq)*(ly-lq))), 6) AS log_rmse, round(avg(abs(y-q)), 6) AS mae,
  round(100 * sqrt(avg((ly-lq)*(ly-lq))) / (max(ly) - min(ly)), 6) AS log_nrmse,
  round(sum(abs(y-q)) FILTER (y <> 0) / sum(y), 6) AS weighted_mape,
  round(sum(abs(ly-lq)) FILTER (ly <> 0) / sum(ly), 6) AS log_weighted_mape,
  round(1 - sum((ly-lq)*(ly-lq)) / (var_pop(ly) * count(*)), 6) AS log_r2"""
    + _regression_class("safe", "y < 100")
    + _regression_class("exceedance", "y >= 100")
)


@query(
    "WITH "
    + FORECASTS
    + """, a AS (SELECT season, y, CASE WHEN p - 20 <= 0 THEN 5 ELSE p - 20 END AS q FROM fc),
b AS (SELECT *, ln(1 + y) AS ly, ln(1 + q) AS lq FROM a)
SELECT season, """
    + _REGRESSION
    + " FROM b GROUP BY season"
)
def regression_scores(spark, folder):
    fc = forecasts(spark, folder).withColumn("p", F.col("p") - 20)
    return rounded(score(fc, "y", "p", ["season"], "regression", HIGH))


_COUNTS = """count(*) FILTER (ty AND tp) AS tp, count(*) FILTER (NOT ty AND tp) AS fp,
  count(*) FILTER (NOT ty AND NOT tp) AS tn, count(*) FILTER (ty AND NOT tp) AS fn,
  count(*) FILTER (ty AND p >= 50 AND p < 100) AS warned"""
_RATES = """round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
  round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS recall_safe,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall_exceedance,
  round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS precision_safe,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_exceedance,
  round((coalesce(tn / nullif(tn + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0)) / 2, 6) AS balanced_accuracy,
  round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
  round(coalesce(3.25 * tn / nullif(3.25 * tn + 2.25 * fp + fn, 0), 0), 6) AS fbeta_safe_1_5,
  round(coalesce(3.25 * tp / nullif(3.25 * tp + 2.25 * fn + fp, 0), 0), 6) AS fbeta_exceedance_1_5,
  round(coalesce(5.0 * tn / nullif(5.0 * tn + 4.0 * fp + fn, 0), 0), 6) AS fbeta_safe_2,
  round(coalesce(5.0 * tp / nullif(5.0 * tp + 4.0 * fn + fp, 0), 0), 6) AS fbeta_exceedance_2,
  tn, fp, fn, tp, warned + tp AS precautionary,
  round(coalesce((warned + tp) / nullif(tp + fn, 0), 0), 6) AS recall_precautionary"""


@query(
    "WITH "
    + FORECASTS
    + _flags()
    + ", c AS (SELECT site, "
    + _COUNTS
    + " FROM m GROUP BY site) SELECT site, "
    + _RATES
    + " FROM c"
)
def classification_scores(spark, folder):
    fc = forecasts(spark, folder)
    return rounded(score(fc, "y", "p", ["site"], "classification", HIGH, WARN))


@query(
    "WITH "
    + FORECASTS
    + """ SELECT season, round(avg(abs((ln(1 + y) - ln(1 + p)) / ln(1 + y))) FILTER (ln(1 + y) <> 0), 5) AS log_mape
FROM fc GROUP BY season"""
)
def log_mape(spark, folder):
    out = forecasts(spark, folder).groupBy("season")
    return rounded(out.agg(log_percentage_error("y", "p").alias("log_mape")), 5)


_FOLD = """, x AS (SELECT *, CASE WHEN season IN ('click', 'view') THEN 'a' ELSE 'b' END AS model,
  'fold_' || (1 + day(t) // 11) AS fold FROM m)"""


def _folded(spark, folder):
    first = F.col("season").isin("click", "view")
    fold = F.concat(F.lit("fold_"), (1 + F.floor(F.dayofmonth("t") / 11)).cast("string"))
    fc = forecasts(spark, folder)
    return fc.withColumns({"model": F.when(first, "a").otherwise("b"), "fold": fold})


@query(
    "WITH "
    + FORECASTS
    + _flags()
    + _FOLD
    + " SELECT model, coalesce(fold, 'overall') AS fold, "
    + _core_sql()
    + " FROM x GROUP BY GROUPING SETS ((model, fold), (model))"
)
def fold_metrics_pooled(spark, folder):
    out = fold_scores(_folded(spark, folder), "y", "p", "fold", ["model"], HIGH, WARN)
    return rounded(out)


@query(
    "WITH "
    + FORECASTS
    + _flags()
    + _FOLD
    + """, c AS (SELECT model, fold, count(*) FILTER (ty AND tp) AS tp, count(*) FILTER (NOT ty AND tp) AS fp,
  count(*) FILTER (NOT ty AND NOT tp) AS tn, count(*) FILTER (ty AND NOT tp) AS fn,
  sqrt(avg((y-p)*(y-p))) AS rmse FROM x GROUP BY ALL)
SELECT model, CAST(sum(tp) AS BIGINT) AS "TP", CAST(sum(fp) AS BIGINT) AS "FP", CAST(sum(tn) AS BIGINT) AS "TN",
  CAST(sum(fn) AS BIGINT) AS "FN", round(avg(rmse), 4) AS rmse,
  round(avg(coalesce(tp / nullif(tp + fn, 0), 1)), 4) AS sensitivity,
  round(avg(coalesce(tn / nullif(tn + fp, 0), 1)), 4) AS specificity FROM c GROUP BY model"""
)
def fold_summary(spark, folder):
    folds = score(_folded(spark, folder), "y", "p", ["model", "fold"], "core", HIGH, WARN)
    out = summarise_folds(folds.drop("fold"), ["model"])
    return out.select("model", "TP", "FP", "TN", "FN", "rmse", "sensitivity", "specificity")


_CLASSES = ["safe", "exceedance"]
_ERRORS = ["log_rmse", "mae", "log_nrmse", "weighted_mape", "log_weighted_mape", "log_r2"] + [
    f"{m}_{c}" for c in _CLASSES for m in ("mae", "weighted_mape", "log_weighted_mape", "nrmse", "log_r2")
]


@query(
    "WITH "
    + FORECASTS
    + _flags()
    + _FOLD
    + """, a AS (SELECT model, fold, y, CASE WHEN p - 20 <= 0 THEN 5 ELSE p - 20 END AS q FROM x),
b AS (SELECT *, ln(1 + y) AS ly, ln(1 + q) AS lq FROM a), d AS (SELECT model, fold, """
    + _REGRESSION.replace(", 6)", ", 14)")
    + " FROM b GROUP BY model, fold) SELECT model, "
    + ", ".join(f"round(avg({c}), 4) AS {c}" for c in _ERRORS)
    + " FROM d GROUP BY model"
)
def regression_fold_summary(spark, folder):
    fc = _folded(spark, folder).withColumn("p", F.col("p") - 20)
    folds = score(fc, "y", "p", ["model", "fold"], "regression", HIGH)
    return rounded(summarise_folds(folds.drop("fold"), ["model"]))


_SHARES = ["accuracy", "balanced_accuracy", "specificity", "recall_precautionary"] + [
    f"{m}_{c}" for c in _CLASSES for m in ("recall", "precision")
] + [f"fbeta_{c}_{b}" for c in _CLASSES for b in ("1_5", "2")]


@query(
    "WITH "
    + FORECASTS
    + _flags()
    + _FOLD
    + ", c AS (SELECT model, fold, "
    + _COUNTS
    + " FROM x GROUP BY model, fold), d AS (SELECT model, "
    + _RATES.replace(", 6)", ", 14)")
    + " FROM c) SELECT model, "
    + ", ".join(f"round(avg({c}), 4) AS {c}" for c in _SHARES)
    + ", "
    + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("tp", "fp", "tn", "fn", "precautionary"))
    + " FROM d GROUP BY model"
)
def classification_fold_summary(spark, folder):
    folds = score(_folded(spark, folder), "y", "p", ["model", "fold"], "classification", HIGH, WARN)
    return rounded(summarise_folds(folds.drop("fold"), ["model"]))


@query(
    "WITH "
    + FORECASTS
    + _flags()
    + """, c AS (SELECT season, count(*) FILTER (ty AND tp) AS tp, count(*) FILTER (NOT ty AND tp) AS fp,
  sqrt(avg((y-p)*(y-p))) AS rmse FROM m GROUP BY season)
SELECT season, 'TP' AS metric, CAST(tp AS DOUBLE) AS value FROM c
UNION ALL SELECT season, 'FP', CAST(fp AS DOUBLE) FROM c UNION ALL SELECT season, 'rmse', round(rmse, 6) FROM c"""
)
def metrics_long(spark, folder):
    wide = score(forecasts(spark, folder), "y", "p", ["season"], "core", HIGH, WARN)
    return rounded(long_scores(wide.select("season", "TP", "FP", "rmse"), ["season"]))


PERFORMANCE_SQL = (
    "WITH "
    + FORECASTS
    + _flags()
    + """, b AS (SELECT *, ln(1 + y) AS ly, ln(1 + CASE WHEN p <= 0 THEN 5 ELSE p END) AS lp FROM m),
c AS (SELECT CASE WHEN grouping(site) = 1 THEN 'OVERALL' ELSE CAST(site AS VARCHAR) END AS site,
  count(*) FILTER (ty AND tp) AS tp, count(*) FILTER (NOT ty AND tp) AS fp,
  count(*) FILTER (NOT ty AND NOT tp) AS tn, count(*) FILTER (ty AND NOT tp) AS fn,
  sum(abs(ly-lp)) FILTER (ly <> 0) / sum(ly) AS e,
  sum(abs(ly-lp)) FILTER (ly <> 0 AND ty) / nullif(sum(ly) FILTER (ty), 0) AS ee,
  sum(abs(ly-lp)) FILTER (ly <> 0 AND NOT ty) / nullif(sum(ly) FILTER (NOT ty), 0) AS es
  FROM b GROUP BY ROLLUP (site))
SELECT site, round_even((tp + tn) / (tp + tn + fp + fn) * 100, 0) / 100 AS accuracy,
  round_even(coalesce(tp / nullif(tp + fn, 0), 0) * 100, 0) / 100 AS recall_exceedance,
  round_even(coalesce(tn / nullif(tn + fp, 0), 0) * 100, 0) / 100 AS specificity,
  tp AS "TP", fn AS "FN", tn AS "TN", fp AS "FP",
  round_even(coalesce(e, -1) * 100, 0) / 100 AS log_weighted_mape,
  round_even(coalesce(ee, -1) * 100, 0) / 100 AS log_weighted_mape_exceedance,
  round_even(coalesce(es, -1) * 100, 0) / 100 AS log_weighted_mape_safe FROM c"""
)


@query(PERFORMANCE_SQL)
def site_performance_rollup(spark, folder):
    return performance_table(forecasts(spark, folder), "site", "y", "p", HIGH)
