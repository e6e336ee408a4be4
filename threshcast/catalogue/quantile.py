"""Queries on given quantile forecasts and calibrated intervals."""

from pyspark.sql import functions as F

from threshcast.catalogue.base import FORECASTS, forecasts, query, rounded
from threshcast.functions.columns import cols, row_median
from threshcast.operators.conformal import apply_shift, conformal_shift, coverage
from threshcast.operators.quantiles import point_forecast, sort_quantiles

_Q = """, q AS (SELECT event_id, season, y, p, p * 0.3 AS "q_0.05",
  CASE WHEN event_id % 6 <> 0 THEN y * 0 + event_id % 97 END AS "q_0.5",
  p * 1.2 - event_id % 31 AS "q_0.9", p * 1.8 AS "q_0.95" FROM fc)"""

_COLUMNS = ["q_0.05", "q_0.5", "q_0.9", "q_0.95"]


def _quantiles(spark, folder):
    k, p = F.col("event_id"), F.col("p")
    return forecasts(spark, folder).select(
        "event_id",
        "season",
        "y",
        "p",
        (p * 0.3).alias("q_0.05"),
        F.when(k % 6 != 0, (k % 97).cast("double")).alias("q_0.5"),
        (p * 1.2 - k % 31).alias("q_0.9"),
        (p * 1.8).alias("q_0.95"),
    )


_LIST = """list_sort(["q_0.05", "q_0.5", "q_0.9", "q_0.95"], 'ASC', 'NULLS LAST')"""


@query(
    "WITH "
    + FORECASTS
    + _Q
    + f""" SELECT event_id, round(l[1], 7) AS "q_0.05", round(l[2], 7) AS "q_0.5", round(l[3], 7) AS "q_0.9", round(l[4], 7) AS "q_0.95"
FROM (SELECT event_id, {_LIST} AS l FROM q)"""
)
def quantile_sort(spark, folder):
    out = sort_quantiles(_quantiles(spark, folder), _COLUMNS)
    return rounded(out.select("event_id", *cols(_COLUMNS)), 7)


@query(
    "WITH "
    + FORECASTS
    + _Q
    + """ SELECT event_id, round(list_median(list_filter(["q_0.05", "q_0.5", "q_0.9", "q_0.95"],
  lambda x: x IS NOT NULL)), 7) AS med FROM q"""
)
def quantile_median(spark, folder):
    median = row_median(_COLUMNS)
    return rounded(_quantiles(spark, folder).select("event_id", median.alias("med")), 7)


def _limit(c):
    return f"round_even(CASE WHEN {c} < 5 THEN 5 ELSE {c} END, 0)"


@query(
    "WITH "
    + FORECASTS
    + _Q
    + f""", a AS (SELECT event_id, {", ".join(f'{_limit(chr(34) + c + chr(34))} AS "{c}"' for c in _COLUMNS)} FROM q),
b AS (SELECT event_id, {_LIST} AS l, list_median(list_filter(["q_0.05", "q_0.5", "q_0.9", "q_0.95"],
  lambda x: x IS NOT NULL)) AS m FROM a)
SELECT event_id, l[1] AS "q_0.05", l[2] AS "q_0.5", l[3] AS "q_0.9", l[4] AS "q_0.95",
  {_limit("m")} AS predictions FROM b"""
)
def point_from_quantiles(spark, folder):
    out = point_forecast(_quantiles(spark, folder), _COLUMNS)
    return out.select("event_id", *cols(_COLUMNS), "predictions")


def _cqr_sql(groups):
    by = f"PARTITION BY {groups}" if groups else ""
    select = f"{groups}, " if groups else ""
    join = f"USING ({groups})" if groups else "ON true"
    group = f"GROUP BY {groups}" if groups else ""
    return (
        "WITH "
        + FORECASTS
        + f""", b AS (SELECT event_id, season, y, p * 0.5 AS lo, p * 1.5 AS hi FROM fc),
s AS (SELECT season, greatest(lo - y, y - hi) AS e FROM b WHERE event_id % 4 = 0),
r AS (SELECT *, row_number() OVER ({by} ORDER BY e) AS k, count(*) OVER ({by}) AS n FROM s),
t AS (SELECT {select}max(CASE WHEN k = ceil(round((n + 1) * 0.9, 9)) THEN e END) AS s FROM r {group}),
o AS (SELECT b.*, lo - s AS pi_lower, hi + s AS pi_upper FROM b JOIN t {join})"""
    )


def _band(spark, folder):
    p = F.col("p")
    return forecasts(spark, folder).select(
        "event_id", "season", "y", (p * 0.5).alias("lo"), (p * 1.5).alias("hi")
    )


def _calibrated(spark, folder, groups=(), **options):
    band = _band(spark, folder)
    held = band.filter(F.col("event_id") % 4 == 0)
    shift = conformal_shift(held, "lo", "hi", "y", 0.10, groups, **options)
    return apply_shift(band, shift, "lo", "hi", groups)


_CQR = (
    _cqr_sql("")
    + " SELECT event_id, round(pi_lower, 6) AS pi_lower, round(pi_upper, 6) AS pi_upper FROM o"
)


@query(_CQR)
def cqr_interval(spark, folder):
    return rounded(_calibrated(spark, folder).select("event_id", "pi_lower", "pi_upper"))


@query(_CQR)
def cqr_interval_by_selection(spark, folder):
    """The same with the rank found by repeated selection, as for very many scores."""
    out = _calibrated(spark, folder, sort_rows=100)
    return rounded(out.select("event_id", "pi_lower", "pi_upper"))


@query(
    _cqr_sql("season")
    + " SELECT event_id, round(pi_lower, 6) AS pi_lower, round(pi_upper, 6) AS pi_upper FROM o"
)
def cqr_interval_per_group(spark, folder):
    out = _calibrated(spark, folder, ["season"])
    return rounded(out.select("event_id", "pi_lower", "pi_upper"))


@query(
    _cqr_sql("season")
    + """ SELECT season, count(*) AS n, round(avg(CASE WHEN y >= pi_lower AND y <= pi_upper THEN 1.0 ELSE 0 END), 6)
  AS coverage, round(avg(pi_upper - pi_lower), 5) AS mean_width FROM o WHERE event_id % 4 <> 0 GROUP BY season"""
)
def cqr_coverage(spark, folder):
    out = _calibrated(spark, folder, ["season"]).filter(F.col("event_id") % 4 != 0)
    out = rounded(coverage(out, "pi_lower", "pi_upper", "y", ["season"]))
    return out.withColumn("mean_width", F.round("mean_width", 5))
