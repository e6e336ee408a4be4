"""The time-by-site matrix in long form (time, site, value), and its wide view.

Filling a day overwrites every time of that day with one value per site, so all times of a
day share one matrix row. The matrix is kept as its observed (day, site) cells and one fill per
row; values are looked up for a table of requested (time, site) pairs, the grid of all pairs is
never built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshcast.functions.columns import col
from threshcast.operators.cleaning import keep_first
from threshcast.operators.joins import equi_join
from threshcast.session import broadcast_if_small, cut


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def complete_pairs(
    pairs: DataFrame, obs: DataFrame, time: str, site: str, value: str
) -> DataFrame:
    """The requested pairs with their observed value, NULL where there is none."""
    return equi_join(pairs, obs.select(time, site, value), [time, site], "left")


def day_values(
    obs: DataFrame, time: str, site: str, value: str, order: Sequence[str] = ()
) -> DataFrame:
    """First non-missing value by time of each (day, site): an aggregate, no window.

    Several values of one time are told apart by ``order``, then by size.
    """
    known = obs.filter(
        F.col(value).isNotNull() & F.col(time).isNotNull() & F.col(site).isNotNull()
    )
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate([time, *order, value])])
    return known.groupBy(F.to_date(time).alias("day"), site).agg(
        F.min_by(value, place).cast("double").alias(value)
    )


def _with_day(pairs: DataFrame, time: str) -> DataFrame:
    return pairs.withColumn("__day", F.to_date(time))


def _looked_up(pairs: DataFrame, days: DataFrame, site: str, value: str) -> DataFrame:
    """``pairs`` (with __day) and their day's value; no day is gathered for a small table."""
    days = broadcast_if_small(days.withColumnRenamed("day", "__day"))
    return equi_join(pairs, days, ["__day", site], "left")


def daily_fill(
    pairs: DataFrame, obs: DataFrame, time: str, site: str, value: str, order: Sequence[str] = ()
) -> DataFrame:
    """The requested pairs with their site's first value of the day, also where there was another."""
    days = cut(day_values(obs, time, site, value, order))
    return _looked_up(_with_day(pairs, time), days, site, value).drop("__day")


def row_means(cells: DataFrame, row: str, value: str) -> DataFrame:
    return cells.groupBy(row).agg(F.avg(value).alias("row_mean"))


def day_weights(obs: DataFrame, time: str) -> DataFrame:
    """(day, weight): how many times a day has, which is how many equal rows it stands for."""
    times = obs.filter(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day"))
    return times.agg(F.countDistinct(time).alias("weight"))


def fill_row_means(
    pairs: DataFrame,
    days: DataFrame,
    time: str,
    site: str,
    value: str,
    weights: DataFrame | None = None,
) -> DataFrame:
    """The requested pairs with the value of their (day, site), or else the mean of the day's row.

    Means are taken over the observed cells ``days``. With ``weights`` (day, weight) a row without
    any value gets the mean of all filled cells, each day counted as often as it has times.
    """
    means = row_means(days, "day", value).withColumnRenamed("day", "__day")
    out = _looked_up(_with_day(pairs, time), days, site, value)
    out = equi_join(out, broadcast_if_small(means, derived=True), ["__day"], "left")
    fill = F.coalesce(F.col(value), F.col("row_mean"))
    if weights is not None:
        whole = equi_join(days, weights, ["day"]).filter(F.col(value).isNotNull())
        mean = whole.agg(F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).first()[0]
        fill = F.coalesce(fill, F.lit(mean))
    return out.select(*[c for c in pairs.columns if c != value], fill.alias(value))


def target_values(
    pairs: DataFrame,
    obs: DataFrame,
    time: str,
    site: str,
    value: str,
    order: Sequence[str] = (),
    fill_target: bool = True,
) -> DataFrame:
    """Values of the completed matrix at the requested pairs: target filled with its mean, one row
    per key, day fill, row means."""
    days = cut(target_days(obs, time, site, value, order, fill_target))
    return fill_row_means(pairs, days, time, site, value)


def target_days(
    obs: DataFrame,
    time: str,
    site: str,
    value: str,
    order: Sequence[str] = (),
    fill_target: bool = True,
) -> DataFrame:
    """(day, site, value) a matrix is built from.

    With a filled target the first row of a key is also the first of its day, so one
    aggregation does both; otherwise a first row without value must hide the later ones.
    """
    cells = obs.select(*dict.fromkeys([time, site, value, *order]))
    if fill_target:
        mean = cells.agg(F.avg(value)).first()[0]
        cells = cells.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(mean)))
    else:
        cells = keep_first(cells, [time, site], list(order) or [value])
    return day_values(cells, time, site, value, order)


def to_wide(cells: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """Pivot over an explicit list of columns, so the plan needs no extra pass to find them."""
    return cells.groupBy(row).pivot(column, list(columns)).agg(F.first(value, ignorenulls=True))


def to_long(wide: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(list(keys), [c for c in wide.columns if c not in keys], name, value)


def group_means(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Mean of each column per key; rows without a key are dropped."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.avg(col(c)).alias(c) for c in columns])
    )
