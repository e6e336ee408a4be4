"""Registration, table access and the inputs several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threshcast.functions.columns import col
from threshcast.operators.series import Past, past_features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its own name, with its SQL twin if there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded, whole numbers as long: comparable across engines."""
    kinds = dict(df.dtypes)
    out = []
    for c in df.columns:
        column = col(c)
        if kinds[c] in ("double", "float"):
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        elif kinds[c] in ("int", "smallint", "tinyint"):
            column = column.cast("long")
        out.append(column.alias(c))
    return df.select(*out)


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Events as observations; every seventh value is missing."""
    ev = table(spark, folder, "events")
    return ev.select(
        "event_id",
        F.col("user_id").alias("site"),
        F.col("ts").alias("t"),
        F.col("event_type").alias("season"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("y"),
    )


OBS = """obs AS (
  SELECT event_id, user_id AS site, ts AS t, event_type AS season,
         CASE WHEN event_id % 7 <> 0 THEN value END AS y
  FROM events)"""


def forecasts(spark: SparkSession, folder: str, complete: bool = True) -> DataFrame:
    """A forecast both engines can make: the mean of up to 5 previous values of the site and
    season. ``complete`` drops rows where truth or forecast is missing."""
    obs = observations(spark, folder) if not complete else events_as_observations(spark, folder)
    out = past_features(obs, ["site", "season"], "t", [Past("p", "y", "avg", 5)])
    return out.filter(F.col("p").isNotNull()) if complete else out


def events_as_observations(spark: SparkSession, folder: str) -> DataFrame:
    ev = table(spark, folder, "events")
    return ev.select(
        "event_id",
        F.col("user_id").alias("site"),
        F.col("ts").alias("t"),
        F.col("event_type").alias("season"),
        F.col("value").alias("y"),
    )


FORECASTS = """fc AS (
  SELECT * FROM (
    SELECT event_id, user_id AS site, ts AS t, event_type AS season, value AS y,
           avg(value) OVER (PARTITION BY user_id, event_type ORDER BY ts
                            ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p
    FROM events) WHERE p IS NOT NULL)"""

FORECASTS_WITH_HOLES = (
    OBS
    + """, fc AS (
  SELECT *, avg(y) OVER (PARTITION BY site, season ORDER BY t
                         ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p
  FROM obs)"""
)
