"""Alignment of tables by key. Nothing is ever matched by row position."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshcast.functions.columns import col, cols
from threshcast.session import broadcast_if_small


def equi_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on equal keys where missing equals missing; the left key columns are kept."""
    other = right.select(
        *[col(k).alias(f"__r_{k}") for k in keys],
        *[col(c) for c in right.columns if c not in keys],
    )
    same = [col(k).eqNullSafe(F.col(f"`__r_{k}`")) for k in keys]
    return left.join(other, same, how).drop(*[f"__r_{k}" for k in keys])


def align(requested: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every requested row with its grid values, NULL where the grid has none."""
    return equi_join(requested, grid, keys, "left")


def side_by_side(
    parts: Sequence[DataFrame], keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Columns of several tables next to each other, matched on the key."""
    return reduce(lambda a, b: equi_join(a, b, keys, how), parts)


def join_models(
    forecasts: dict[str, DataFrame], prediction: str = "predictions", quantile_prefix: str = "q_"
) -> DataFrame:
    """Inner join of forecast tables on all columns they share, one column per model.

    The key is every column of the first table but the forecast and its quantiles; quantile
    columns come along from the table that has them. Rows repeated in several tables multiply.
    """
    first = next(iter(forecasts.values()))
    keys = [c for c in first.columns if c != prediction and not c.startswith(quantile_prefix)]
    parts = []
    for model, df in forecasts.items():
        extra = [c for c in df.columns if c.startswith(quantile_prefix)]
        parts.append(
            df.withColumnRenamed(prediction, model).select(*cols([*keys, *extra, model]))
        )
    return side_by_side(parts, keys)


def drop_members(df: DataFrame, column: str, members: Sequence[str]) -> DataFrame:
    """Rows whose value is not in the list; a missing value stays."""
    return df.filter(F.coalesce(~F.col(column).isin(list(members)), F.lit(True)))


def anti_members(df: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """:func:`drop_members` for a list held in a table."""
    side = members.select(F.col(column).alias("__member")).distinct()
    return df.join(
        broadcast_if_small(side), F.col(column) == F.col("__member"), "left_anti"
    )


def table_diff(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Differing cells of two tables: keys, column, left_value, right_value (as text).

    Columns default to those present in both, in alphabetical order; numbers are compared as
    doubles. A row present on one side only differs wherever the other side has a value.
    """
    if columns is None:
        columns = sorted(c for c in left.columns if c in right.columns and c not in keys)

    def side(df: DataFrame, tag: str) -> DataFrame:
        types = dict(df.dtypes)

        def cell(c: str) -> Column:
            return F.col(c) if types[c] in ("string", "boolean") or "time" in types[c] or types[
                c
            ] == "date" else F.col(c).cast("double")

        return df.select(
            *[F.col(k).alias(f"{tag}{k}") for k in keys],
            *[cell(c).alias(f"{tag}{c}") for c in columns],
        )

    same = [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys]
    both = side(left, "l_").join(side(right, "r_"), same, "full")
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                (~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias("differs"),
                F.col(f"l_{c}").cast("string").alias("left_value"),
                F.col(f"r_{c}").cast("string").alias("right_value"),
            )
            for c in columns
        ]
    )
    return both.select(
        *[F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in keys],
        F.explode(F.filter(cells, lambda x: x["differs"])).alias("x"),
    ).select(*keys, "x.column", "x.left_value", "x.right_value")
