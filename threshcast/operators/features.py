"""Calendar, holiday and wind features, and the full feature step."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshcast.functions.columns import (
    at_midnight,
    calendar_columns,
    cols,
    holiday_flag,
    shore_class,
)
from threshcast.functions.fixed_values import EXCEEDANCE, HOLIDAYS, WIND_WINDOWS
from threshcast.operators.series import SERIES_ROWS, recent_history


def add_calendar(df: DataFrame, time: str = "DateTime") -> DataFrame:
    return df.withColumns({**calendar_columns(time), "HOLIDAY_FLAG": holiday_flag(time)})


def calendar_days(calendar: DataFrame) -> DataFrame:
    """Month-day ranges (name, start, end) to days: at most 366 rows (month * 100 + day, whole).

    ``whole`` is False for a day that is only ever the last of its range, where just midnight
    belongs to it.
    """
    leap_year = "2000-"
    first = F.to_date(F.concat(F.lit(leap_year), "start"))
    last = F.to_date(F.concat(F.lit(leap_year), "end"))
    last = F.when(last < first, F.add_months(last, 12)).otherwise(last)
    days = calendar.select(last.alias("__end"), F.explode(F.sequence(first, last)).alias("__d"))
    day = F.month("__d") * 100 + F.dayofmonth("__d")
    return days.groupBy(day.alias("day")).agg(
        F.max(F.col("__d") < F.col("__end")).alias("whole")
    )


def holiday_join(
    df: DataFrame, calendar: DataFrame, time: str, name: str = "HOLIDAY_FLAG"
) -> DataFrame:
    """Holiday flag from a calendar table, as an equi-join on the month and day.

    The day table has 366 rows at most whatever the data, so it is broadcast.
    """
    days = calendar_days(calendar).select(F.col("day").alias("__day"), "whole")
    day = F.month(time) * 100 + F.dayofmonth(time)
    joined = df.join(F.broadcast(days), day == F.col("__day"), "left")
    inside = F.col("whole") | (F.col("__day").isNotNull() & at_midnight(time))
    flag = F.coalesce(inside, F.lit(False))
    return joined.select(*cols(df.columns), flag.cast("int").alias(name))


def holiday_table(spark, calendar: Iterable[tuple[str, str, str]] = HOLIDAYS) -> DataFrame:
    return spark.createDataFrame(list(calendar), "name string, start string, end string")


def add_shore_classes(
    df: DataFrame,
    windows: Sequence[str] = WIND_WINDOWS,
    orientation: str = "beach_orientation_angle",
) -> DataFrame:
    """``wind_shore_<window>`` for each window whose direction column is present."""
    present = [w for w in windows if f"wind_direction_{w}" in df.columns]
    return df.withColumns(
        {f"wind_shore_{w}": shore_class(f"wind_direction_{w}", orientation) for w in present}
    )


def engineer_features(
    df: DataFrame,
    site: str = "SITE_NAME",
    time: str = "DateTime",
    season: str = "Season",
    target: str = "Enterococci",
    threshold: float = EXCEEDANCE,
    rows: int = SERIES_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Calendar, wind and past features; the season and the year are dropped afterwards."""
    out = add_shore_classes(add_calendar(df, time))
    out = recent_history(out, site, season, time, target, threshold, rows=rows, longest=longest)
    return out.drop(season, "YEAR")
