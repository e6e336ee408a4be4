"""Queries giving chart-ready tables."""

from pyspark.sql import functions as F

from threshcast.catalogue.base import FORECASTS, forecasts, query, rounded
from threshcast.operators.charts import (
    cap_numbers,
    error_table,
    histogram,
    model_comparison,
    quantile_band,
    scatter_bound,
    scatter_pairs,
    site_series,
)

_CAP = "CASE WHEN {0} > 150 THEN 150 ELSE round({0}, 6) END AS {1}"


@query(
    "WITH "
    + FORECASTS
    + f""" SELECT season, row_number() OVER (PARTITION BY season ORDER BY t) - 1 AS position,
  strftime(t, '%Y-%m-%d %H:%M') AS label, {_CAP.format('y', 'y')}, {_CAP.format('p', 'p')},
  280.0::DOUBLE AS exceedance, 140.0::DOUBLE AS precaution FROM fc"""
)
def model_comparison_table(spark, folder):
    out = model_comparison(forecasts(spark, folder), "season", "t", ["y", "p"], upper=150)
    return rounded(out)


@query(
    "WITH "
    + FORECASTS
    + f""" SELECT season, row_number() OVER (PARTITION BY season ORDER BY t) - 1 AS position,
  strftime(t, '%Y-%m-%d %H:%M') AS label, {_CAP.format('y', 'y')}, {_CAP.format('p', 'p')},
  {_CAP.format('(p * 0.5)', 'band_lower')}, {_CAP.format('(p * 2)', 'band_upper')},
  280.0::DOUBLE AS exceedance, 140.0::DOUBLE AS precaution FROM fc WHERE season = 'click'"""
)
def quantile_band_table(spark, folder):
    p = F.col("p")
    fc = forecasts(spark, folder).withColumns(
        {"q_0.05": p * 0.5, "q_0.3": p * 0.8, "q_0.9": p * 2.0, "q_0.95": p * 3.0}
    )
    return rounded(quantile_band(fc, "season", "t", "y", "p", "click", 150))


@query(
    "WITH "
    + FORECASTS
    + f""" SELECT event_id, season, {_CAP.format('y', 'y')}, {_CAP.format('p', 'p')} FROM fc"""
)
def capped_numbers(spark, folder):
    fc = forecasts(spark, folder).select("event_id", "season", "y", "p")
    return rounded(cap_numbers(fc, ["event_id"], 150))


@query(
    "WITH "
    + FORECASTS
    + """ SELECT round(greatest(max(y), max(p)), 6) AS max_value, round(greatest(max(y), max(p)) * 1.1, 6) AS axis_end FROM fc"""
)
def scatter_bounds(spark, folder):
    return rounded(scatter_bound(forecasts(spark, folder), "y", "p"))


@query("WITH " + FORECASTS + " SELECT event_id, round(y, 6) AS y, round(p, 6) AS p FROM fc")
def scatter_points(spark, folder):
    return rounded(scatter_pairs(forecasts(spark, folder), ["event_id"], "y", "p"))


@query(
    "WITH "
    + FORECASTS
    + """ SELECT event_id, round(abs(y - p), 6) AS abs_error,
  CASE WHEN y <> 0 THEN round(least(100 * abs(y - p) / y, 200), 6) END AS pct_error FROM fc"""
)
def error_values(spark, folder):
    out = error_table(forecasts(spark, folder), "y", "p").select("event_id", "abs_error", "pct_error")
    return rounded(out)


@query(
    "WITH "
    + FORECASTS
    + """, e AS (SELECT abs(y - p) AS v FROM fc), b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20 AS w FROM e)
SELECT CAST(least(floor((v - lo) / w), 19) AS BIGINT) AS bin,
  round(any_value(lo) + least(floor((v - lo) / w), 19) * any_value(w), 4) AS lower,
  round(any_value(lo) + (least(floor((v - lo) / w), 19) + 1) * any_value(w), 4) AS upper,
  count(*) AS n FROM e, b GROUP BY least(floor((v - lo) / w), 19)"""
)
def error_histogram(spark, folder):
    errors = error_table(forecasts(spark, folder), "y", "p")
    return rounded(histogram(errors, "abs_error", 20), 4)


@query(
    "WITH "
    + FORECASTS
    + """ SELECT site, t, round(y, 6) AS y, round(p, 6) AS p FROM
  (SELECT *, count(*) OVER (PARTITION BY site) AS n FROM fc) WHERE n >= 60"""
)
def site_series_rows(spark, folder):
    return rounded(site_series(forecasts(spark, folder), "site", "t", ["y", "p"], 60))
