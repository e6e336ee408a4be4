"""Split-conformal calibration of an interval (Romano, Patterson and Candes, 2019)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshcast.functions.columns import col, cols
from threshcast.operators.joins import equi_join
from threshcast.operators.selection import SORT_ROWS, order_statistic
from threshcast.session import broadcast_if_small


def conformal_shift(
    calibration: DataFrame,
    lower: str,
    upper: str,
    target: str,
    alpha: float = 0.10,
    groups: Sequence[str] = (),
    sort_rows: int = SORT_ROWS,
) -> DataFrame:
    """How far the interval must move outwards: (groups, n, shift).

    The score of a row is max(lower - y, y - upper); the shift is the score ranked
    ceil((n + 1)(1 - alpha)). With too few rows for that rank it is infinite.
    """
    value = F.when(
        col(target).isNotNull() & col(lower).isNotNull() & col(upper).isNotNull(),
        F.greatest(col(lower) - col(target), col(target) - col(upper)),
    )
    # the product is rounded so that e.g. (9 + 1) * 0.9 does not end up just above 9
    rank = F.ceil(F.round((F.col("n") + 1) * (1 - alpha), 9))
    shift = order_statistic(calibration, value, rank, None, groups, "shift", sort_rows)
    return shift.withColumn("shift", F.coalesce("shift", F.lit(float("inf"))))


def apply_shift(
    df: DataFrame,
    shift: DataFrame | float,
    lower: str,
    upper: str,
    groups: Sequence[str] = (),
    names: tuple[str, str] = ("pi_lower", "pi_upper"),
) -> DataFrame:
    """Add the calibrated bounds. Without groups ``shift`` may be a number or a one-row table."""
    if not groups:
        if isinstance(shift, DataFrame):
            row = shift.first()
            shift = row["shift"] if row is not None else float("inf")
        s: Column = F.lit(float(shift))
        return df.withColumns({names[0]: col(lower) - s, names[1]: col(upper) + s})
    side = broadcast_if_small(shift.select(*groups, F.col("shift").alias("__shift")))
    s = F.coalesce("__shift", F.lit(float("inf")))
    return equi_join(df, side, list(groups), "left").select(
        *cols(df.columns),
        (col(lower) - s).alias(names[0]),
        (col(upper) + s).alias(names[1]),
    )


def coverage(
    df: DataFrame, lower: str, upper: str, target: str, groups: Sequence[str] = ()
) -> DataFrame:
    """Rows, share of true values inside the interval, and its mean width."""
    inside = (col(target) >= col(lower)) & (col(target) <= col(upper))
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(inside.cast("double")).alias("coverage"),
        F.avg(col(upper) - col(lower)).alias("mean_width"),
    )
