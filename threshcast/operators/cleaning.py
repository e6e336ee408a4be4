"""Projection, deduplication, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshcast.functions.columns import clip_upper, col, cols, parse_us_time, to_minute
from threshcast.functions.fixed_values import (
    CATEGORY_COLUMNS,
    OBSERVATION_COLUMNS,
    TARGET_MAXIMUM,
)
from threshcast.operators.selection import SORT_ROWS, median


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def pick_columns(
    df: DataFrame,
    names: Sequence[str] | None = None,
    without: Sequence[str] = (),
    prefix: str = "",
    suffix: str = "",
) -> list[str]:
    """Column names that are present, in table order, after the given rules."""
    return [
        c
        for c in df.columns
        if (names is None or c in names)
        and c not in without
        and c.startswith(prefix)
        and c.endswith(suffix)
    ]


def project(df: DataFrame, columns: Sequence[str] = OBSERVATION_COLUMNS) -> DataFrame:
    """Exactly these columns; a missing one is an ``AnalysisException``."""
    return df.select(*[col(c) for c in columns])


def split_target(df: DataFrame, target: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Features without the target, and the target next to its key."""
    return df.drop(target), df.select(*cols([*keys, target]))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order``; equal order values fall back on the row itself.

    The smallest row is an aggregate, so copies meet before the shuffle and a key with very
    many copies costs one row per task. Missing keys equal each other.
    """
    first = [col(o) for o in order]
    # columns named in the order stand in the struct once, as part of the order
    places = {o: f"__o{i}" for i, o in enumerate(order) if isinstance(o, str) and o in df.columns}
    rest = [c for c in df.columns if c not in keys and c not in places]
    ranked = F.struct(
        *[c.alias(f"__o{i}") for i, c in enumerate(first)], *[col(c) for c in rest]
    )
    best = df.groupBy(*[col(k) for k in keys]).agg(F.min(ranked).alias("__first"))
    return best.select(
        *[
            col(c) if c in keys else F.col("__first").getField(places.get(c, c)).alias(c)
            for c in df.columns
        ]
    )


def clean_observations(
    raw: DataFrame,
    order: Sequence[str | Column],
    site: str = "SITE_NAME",
    time: str = "DateTime",
    target: str = "Enterococci",
    columns: Sequence[str] = OBSERVATION_COLUMNS,
    upper: float = TARGET_MAXIMUM,
) -> DataFrame:
    """Project, parse the time to the minute, keep the first row per site and time, clip."""
    parsed = raw.withColumn(time, to_minute(parse_us_time(time)))
    extra = [c for c in order if isinstance(c, str) and c not in columns]
    kept = keep_first(project(parsed, [*columns, *extra]), [site, time], order)
    return project(kept, columns).withColumn(target, clip_upper(target, upper))


def as_categories(df: DataFrame, columns: Sequence[str] = CATEGORY_COLUMNS) -> DataFrame:
    """Text form of the category columns that are present."""
    return df.withColumns({c: col(c).cast("string") for c in pick_columns(df, columns)})


def fill_values(
    df: DataFrame,
    strategy: str = "mean",
    columns: Sequence[str] | None = None,
    sort_rows: int = SORT_ROWS,
) -> dict[str, float]:
    """Mean or exact median of every numeric column; columns without any value are left out."""
    if strategy not in ("mean", "median"):
        raise ValueError("strategy must be 'mean' or 'median'")
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        return {}
    if strategy == "mean":
        row = df.agg(*[F.avg(f"`{c}`").alias(c) for c in names]).first()
        return {c: row[c] for c in names if row[c] is not None}
    long = df.select(*[col(c).cast("double").alias(c) for c in names])
    long = long.unpivot([], names, "column", "v")
    # one row per numeric column
    rows = median(long, F.col("v"), ["column"], sort_rows=sort_rows).collect()
    return {r["column"]: r["median"] for r in rows if r["median"] is not None}


def fill_missing(
    df: DataFrame,
    strategy: str = "mean",
    columns: Sequence[str] | None = None,
    values: dict[str, float] | None = None,
    sort_rows: int = SORT_ROWS,
) -> DataFrame:
    """Fill missing numbers with the column's statistic, or with ``values`` fitted earlier."""
    values = fill_values(df, strategy, columns, sort_rows) if values is None else values
    return df.withColumns(
        {c: F.coalesce(col(c).cast("double"), F.lit(v)) for c, v in values.items()}
    )


def profile(df: DataFrame) -> DataFrame:
    """Row count, column count and column list."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
    )
