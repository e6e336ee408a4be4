"""Tables ready to be drawn; the drawing itself is left to a plotting tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshcast.functions.columns import (
    absolute_error,
    clip_range,
    clip_upper,
    col,
    percentage_error,
    time_label,
)
from threshcast.functions.fixed_values import CHART_MAXIMUM, EXCEEDANCE, PRECAUTION
from threshcast.operators.cleaning import numeric_columns
from threshcast.operators.joins import equi_join
from threshcast.operators.series import SERIES_ROWS, sequence_position
from threshcast.session import broadcast_if_small


def _site_rows(df: DataFrame, site: str, only_site) -> DataFrame:
    return df if only_site is None else df.filter(col(site) == only_site)


def model_comparison(
    joined: DataFrame,
    site: str,
    time: str,
    columns: Sequence[str],
    only_site=None,
    upper: float = CHART_MAXIMUM,
    rows: int = SERIES_ROWS,
) -> DataFrame:
    """Position, time label, capped truth and models, and the two threshold lines per site."""
    placed = sequence_position(_site_rows(joined, site, only_site), site, time, rows=rows)
    return placed.select(
        site,
        "position",
        time_label(time).alias("label"),
        *[clip_upper(c, upper).alias(c) for c in columns],
        F.lit(EXCEEDANCE).alias("exceedance"),
        F.lit(PRECAUTION).alias("precaution"),
    )


def band_columns(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """First column named q_0.0... or q_0.1..., and first one named q_0.9..."""
    lower = next((c for c in columns if c.startswith(("q_0.0", "q_0.1"))), None)
    return lower, next((c for c in columns if c.startswith("q_0.9")), None)


def quantile_band(
    df: DataFrame,
    site: str,
    time: str,
    target: str,
    prediction: str,
    only_site=None,
    upper: float = CHART_MAXIMUM,
    rows: int = SERIES_ROWS,
) -> DataFrame:
    """As :func:`model_comparison` for one model with its lower and upper quantile."""
    low, high = band_columns(df.columns)
    if low is None or high is None:
        raise ValueError("no lower or upper quantile column")
    placed = sequence_position(_site_rows(df, site, only_site), site, time, rows=rows)
    return placed.select(
        site,
        "position",
        time_label(time).alias("label"),
        clip_upper(target, upper).alias(target),
        clip_upper(prediction, upper).alias(prediction),
        clip_upper(low, upper).alias("band_lower"),
        clip_upper(high, upper).alias("band_upper"),
        F.lit(EXCEEDANCE).alias("exceedance"),
        F.lit(PRECAUTION).alias("precaution"),
    )


def cap_numbers(
    df: DataFrame, without: Sequence[str] = (), upper: float = CHART_MAXIMUM
) -> DataFrame:
    """Every numeric column but the named ones, capped."""
    names = [c for c in numeric_columns(df) if c not in without]
    return df.withColumns({c: clip_upper(c, upper) for c in names})


def scatter_bound(df: DataFrame, y: str, p: str) -> DataFrame:
    """Largest value of both columns, and that times 1.1 as axis end."""
    top = F.greatest(F.max(y), F.max(p))
    return df.agg(top.alias("max_value"), (top * 1.1).alias("axis_end"))


def scatter_pairs(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    return df.select(*keys, y, p)


def error_table(df: DataFrame, y: str, p: str) -> DataFrame:
    """Adds the absolute error, and the percentage error limited to 0...200."""
    return df.withColumns(
        {
            "abs_error": absolute_error(y, p),
            "pct_error": clip_range(percentage_error(y, p), 0, 200),
        }
    )


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and the largest value: bin, lower, upper, n.

    The last bin includes its upper edge. Empty bins are not listed.
    """
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if edges["lo"] is None:
        lo, width = 0.0, 0.0
    else:
        lo, width = float(edges["lo"]), (float(edges["hi"]) - float(edges["lo"])) / bins
    place = F.floor((F.col(value) - lo) / width) if width > 0 else F.lit(0)
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (F.lit(lo) + F.col("bin") * width).alias("lower"),
            (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"),
            "n",
        )
    )


def site_series(
    df: DataFrame, site: str, time: str, columns: Sequence[str], min_rows: int = 2
) -> DataFrame:
    """Rows of the sites with at least ``min_rows`` rows.

    Counting is an aggregate, and the counts come back by a join, so a site with most of the
    rows is never gathered in one window task.
    """
    enough = df.groupBy(site).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_rows)
    kept = equi_join(df, broadcast_if_small(enough, derived=True), [site])
    return kept.select(site, time, *columns)
