"""Rows and the intervals that hold their time, by a sweep over end points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threshcast.functions.columns import col, cols
from threshcast.operators.joins import equi_join
from threshcast.session import cut

#: Marks (end points and asked times) of one time range, and the most ranges there are.
RANGE_ROWS, RANGES = 1_000_000, 512


def count_covering(
    df: DataFrame,
    intervals: DataFrame,
    time: str,
    start: str,
    end: str,
    keys: Sequence[str] = (),
    name: str = "covering",
    range_rows: int | None = None,
) -> DataFrame:
    """``df`` with the number of intervals of the row's keys that hold its time, ends included.

    Intervals may overlap and be of any length; nothing is exploded and no pair of a row and an
    interval is made. Openings (+1), asked times and closings (-1) are united, cut into time
    ranges by a quantile sketch, and counted up inside each range and key; what is open when a
    range begins is the sum of the ranges before, a few numbers for each key. Each different time
    is asked once, so a time that many rows share costs one mark; counts come back by an equi-join.
    Missing keys match each other. A row without a time is held by none; an interval without one
    of its ends, or whose end lies before its start, holds none.
    """
    if name in df.columns:
        raise ValueError(f"the table has a column {name}")
    plain = [f"k{i}" for i in range(len(keys))]
    key = lambda: [col(k).alias(n) for k, n in zip(keys, plain)]

    def mark(rows: DataFrame, at: str, order: int, change: int) -> DataFrame:
        return rows.select(*key(), col(at).alias("t"), F.lit(order).alias("o"), F.lit(change).alias("d"))

    sound = intervals.filter(col(start) <= col(end))
    asked = mark(df.filter(col(time).isNotNull()), time, 1, 0).distinct()
    marks = cut(mark(sound, start, 0, 1).union(asked).union(mark(sound, end, 2, -1)))
    ranges = min(RANGES, 1 + marks.count() // (range_rows or RANGE_ROWS))
    borders = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        borders = sorted(set(marks.agg(F.percentile_approx("t", shares, 10_000)).first()[0] or []))
    kind = marks.schema["t"].dataType
    below = F.filter(F.array(*[F.lit(b).cast(kind) for b in borders]), lambda b: b <= F.col("t")) if borders else None
    marks = marks.withColumn("p", F.lit(0) if below is None else F.size(below))
    inside = W.partitionBy(*plain, "p").orderBy("t", "o").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*plain).orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    open_ = marks.groupBy(*plain, "p").agg(F.sum("d").alias("change"))
    open_ = open_.select(*plain, "p", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("open"))
    running = marks.withColumn("n", F.sum("d").over(inside)).filter("o = 1")
    counts = equi_join(running, open_, [*plain, "p"]).select(
        *[F.col(n).alias(k) for k, n in zip(keys, plain)], F.col("t").alias(time), (F.col("n") + F.col("open")).alias(name)
    )
    joined = equi_join(df, counts, [*keys, time], "left")
    return joined.select(*cols(df.columns), F.coalesce(col(name), F.lit(0)).cast("long").alias(name))


def covered(
    df: DataFrame,
    intervals: DataFrame,
    time: str,
    start: str,
    end: str,
    keys: Sequence[str] = (),
    name: str = "HOLIDAY_FLAG",
) -> DataFrame:
    """``df`` with 1 where any interval holds the row's time, else 0."""
    found = count_covering(df, intervals, time, start, end, keys, name)
    return found.withColumn(name, (col(name) > 0).cast("int"))
