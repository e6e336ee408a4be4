"""Queries on strictly-past windows."""

from pyspark.sql import functions as F

from threshcast.catalogue.base import (
    OBS,
    events_as_observations,
    observations,
    query,
    rounded,
    table,
)
from threshcast.operators.series import Past, past_features, recent_history, sequence_position

_LAGGED_MEAN = (
    "WITH "
    + OBS
    + """ SELECT event_id, round(avg(y) OVER (PARTITION BY site, season ORDER BY t
  ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS m FROM obs"""
)


@query(_LAGGED_MEAN)
def lagged_mean5(spark, folder):
    obs = observations(spark, folder)
    out = past_features(obs, ["site", "season"], "t", [Past("m", "y", "avg", 5)])
    return rounded(out.select("event_id", "m"))


_HISTORY = (
    "WITH "
    + OBS
    + """, g AS (SELECT event_id, t, y, CASE WHEN site % 10 <> 0 THEN site END AS site, season FROM obs)
SELECT event_id,
  CASE WHEN site IS NOT NULL THEN round(avg(y) OVER (PARTITION BY site, season ORDER BY t
    ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) END AS m,
  CASE WHEN site IS NOT NULL THEN
    round(coalesce(sum(CASE WHEN y >= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY site, season ORDER BY t
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    / row_number() OVER (PARTITION BY site, season ORDER BY t), 6) END AS r FROM g"""
)


def _history(spark, folder, **options):
    obs = observations(spark, folder)
    obs = obs.withColumn("site", F.when(F.col("site") % 10 != 0, F.col("site")))
    out = recent_history(obs, "site", "season", "t", "y", 100.0, 5, "m", "r", **options)
    return rounded(out.select("event_id", "m", "r"))


@query(_HISTORY)
def exceedance_rate(spark, folder):
    return _history(spark, folder)


@query(_HISTORY)
def exceedance_rate_long_series(spark, folder):
    """The same features with series cut into pieces, as for a site that holds most rows."""
    return _history(spark, folder, rows=100)


_POSITION = """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS position
FROM events"""


@query(_POSITION)
def site_sequence(spark, folder):
    out = sequence_position(table(spark, folder, "events"), "event_type", "ts")
    return out.select("event_id", "position")


@query(_POSITION)
def site_sequence_long_series(spark, folder):
    out = sequence_position(table(spark, folder, "events"), "event_type", "ts", rows=500)
    return out.select("event_id", "position")


_FRAMES = """SELECT event_id,
  CASE WHEN count(value) OVER w7 >= 3 THEN round(avg(value) OVER w7, 9) END AS mean_7,
  CASE WHEN count(value) OVER w7 >= 1 THEN round(max(value) OVER w7, 6) END AS max_7,
  CASE WHEN count(value) OVER wall >= 1 THEN round(min(value) OVER wall, 6) END AS min_all,
  CASE WHEN count(value) OVER wall >= 2 THEN round(avg(value) OVER wall, 9) END AS mean_all
FROM events WINDOW w7 AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
  wall AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def _frames(spark, folder, **options):
    specs = [
        Past("mean_7", "y", "avg", 7, 3),
        Past("max_7", "y", "max", 7),
        Past("min_all", "y", "min"),
        Past("mean_all", "y", "avg", None, 2),
    ]
    out = past_features(events_as_observations(spark, folder), ["site"], "t", specs, **options)
    return rounded(out.select("event_id", *[s.name for s in specs]), 9)


@query(_FRAMES)
def past_frames(spark, folder):
    return _frames(spark, folder)


@query(_FRAMES)
def past_frames_long_series(spark, folder):
    return _frames(spark, folder, rows=20)
