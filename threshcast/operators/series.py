"""Strictly-past features of ordered series, safe against one series holding most rows.

A window runs one series in one task. When the largest series is bigger than a task should
take, it is cut into consecutive pieces of similar size; windows run per piece and the state
at the end of each piece (a few numbers, or the last few values) is carried into the next
ones. Results are the same either way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threshcast.functions.columns import at_least, col, cols
from threshcast.functions.fixed_values import EXCEEDANCE
from threshcast.session import broadcast_if_small

#: Longest series one task sorts and scans.
SERIES_ROWS = 20_000_000

_PIECE = "__piece"


@dataclass(frozen=True)
class Past:
    """One feature over the rows before the current one.

    ``fn`` is avg, sum, count, min or max; ``size`` the number of previous rows looked at
    (None: all of them); fewer than ``min_periods`` values give NULL (count gives NULL too).
    """

    name: str
    value: str | Column
    fn: str = "avg"
    size: int | None = None
    min_periods: int = 1

    def column(self) -> Column:
        return col(self.value)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def interval_index(value: Column, bounds: Column) -> Column:
    """How many of the ascending ``bounds`` lie below ``value``, by a two-step search."""
    n = F.size(bounds)
    step = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    marks = F.sequence(F.lit(0), n - 1, step)
    coarse = F.size(F.filter(marks, lambda i: F.get(bounds, i) < value))
    start = F.greatest(coarse - 1, F.lit(0)) * step
    fine = F.size(F.filter(F.slice(bounds, start + 1, step), lambda b: b < value))
    return F.when(n == 0, F.lit(0)).otherwise(start + fine)


def split_series(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    rows: int = SERIES_ROWS,
    longest: int | None = None,
) -> DataFrame | None:
    """Add a piece number to the rows of series longer than ``rows``; None if there is none.

    ``longest`` is an upper bound of the series length, when the caller has one; otherwise the
    rows of each series are counted.

    Cut points come from one mergeable quantile sketch per long series, so at most
    2 * (total rows / ``rows``) of them exist in all.
    """
    if longest is not None and longest <= rows:
        return None
    longest = largest_group(df, keys)
    if longest <= rows:
        return None
    pieces = math.ceil(longest / rows)
    grid = [i / pieces for i in range(1, pieces)]
    long_ones = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows)
    long_ones = broadcast_if_small(
        long_ones.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__n"), derived=True
    )
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    bounds = (
        df.join(long_ones, same)
        .groupBy(*[f"__k_{k}" for k in keys])
        .agg(
            F.max("__n").alias("__n"),
            F.percentile_approx(time, grid, max(10_000, 20 * pieces)).alias("__all"),
        )
        .select(
            *[f"__k_{k}" for k in keys],
            F.filter(
                F.array_distinct("__all"),
                lambda b, i: i % F.greatest(F.floor(pieces * rows / F.col("__n")), F.lit(1)) == 0,
            ).alias("__bounds"),
        )
    )
    piece = F.coalesce(interval_index(F.col(time), F.col("__bounds")), F.lit(0))
    # a missing time sorts after every other one
    piece = F.when(F.col(time).isNull(), F.size("__bounds")).otherwise(piece)
    return df.join(broadcast_if_small(bounds, derived=True), same, "left").select(
        *cols(df.columns), F.when(F.col("__bounds").isNull(), 0).otherwise(piece).alias(_PIECE)
    )


def _needs(fn: str) -> tuple[str, ...]:
    return {"avg": ("sum", "count"), "count": ("count",)}.get(fn, (fn, "count"))


_AGGREGATE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _last(values: Column, n: Column) -> Column:
    """The last ``n`` elements of an array."""
    return F.filter(values, lambda _, i: i >= F.size(values) - n)


def _merge(part: str, a: Column, b: Column) -> Column:
    if part in ("sum", "count"):
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.least(a, b) if part == "min" else F.greatest(a, b)


def _result(spec: Past, parts: dict[str, Column]) -> Column:
    value = (
        F.try_divide(parts["sum"], parts["count"]) if spec.fn == "avg" else parts[spec.fn]
    )
    return F.when(parts["count"] >= spec.min_periods, value)


def past_features(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    specs: Sequence[Past],
    rows: int = SERIES_ROWS,
    longest: int | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add one column per :class:`Past`. (``keys``, ``time``, ``ties``) should identify a row;
    rows of one time are ordered by the columns ``ties``."""
    order = [F.col(time).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    split = split_series(df, keys, time, rows, longest)
    if split is None:
        w = Window.partitionBy(*keys).orderBy(*order)

        def parts(s: Past) -> dict[str, Column]:
            frame = w.rowsBetween(Window.unboundedPreceding if s.size is None else -s.size, -1)
            return {p: _AGGREGATE[p](s.column()).over(frame) for p in _needs(s.fn)}

        return df.withColumns({s.name: _result(s, parts(s)) for s in specs})

    piece_keys = [*keys, _PIECE]
    w = Window.partitionBy(*piece_keys).orderBy(*order)
    whole = Window.partitionBy(*piece_keys)
    local = {"__i": F.row_number().over(w) - 1, "__len": F.count(F.lit(1)).over(whole)}
    for j, s in enumerate(specs):
        frame = w.rowsBetween(Window.unboundedPreceding if s.size is None else -s.size, -1)
        local[f"__v{j}"] = s.column()
        for p in _needs(s.fn):
            local[f"__{p}{j}"] = _AGGREGATE[p](s.column()).over(frame)
    body = split.withColumns(local)

    # State each piece hands on: totals for open frames, last `size` values for fixed ones.
    totals, carry = [], {}
    before = Window.partitionBy(*keys).orderBy(_PIECE)
    for j, s in enumerate(specs):
        if s.size is None:
            for p in _needs(s.fn):
                totals.append(_AGGREGATE[p](f"__v{j}").alias(f"__t_{p}{j}"))
                merge = F.sum if p in ("sum", "count") else _AGGREGATE[p]
                carry[f"__c_{p}{j}"] = merge(f"__t_{p}{j}").over(
                    before.rowsBetween(Window.unboundedPreceding, -1)
                )
        else:
            last = F.when(
                F.col("__i") >= F.col("__len") - s.size,
                F.struct(F.col("__i").alias("i"), F.col(f"__v{j}").alias("v")),
            )
            totals.append(F.sort_array(F.collect_list(last)).alias(f"__t{j}"))
            seen = F.flatten(F.collect_list(f"__t{j}").over(before.rowsBetween(-s.size, -1)))
            carry[f"__c{j}"] = _last(F.transform(seen, lambda x: x["v"]), F.lit(s.size))
    state = body.groupBy(*piece_keys).agg(*totals).withColumns(carry)
    state = state.select(*[F.col(k).alias(f"__k_{k}") for k in piece_keys], *carry)
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in piece_keys]
    joined = body.join(broadcast_if_small(state, derived=True), same, "left")

    out = {}
    for j, s in enumerate(specs):
        parts = {}
        for p in _needs(s.fn):
            here = F.col(f"__{p}{j}")
            if s.size is None:
                parts[p] = _merge(p, F.col(f"__c_{p}{j}"), here)
                continue
            missing = F.greatest(F.lit(s.size) - F.col("__i"), F.lit(0))
            tail = F.array_compact(_last(F.col(f"__c{j}"), missing))
            earlier = {
                "sum": F.aggregate(tail, F.lit(0.0), lambda a, x: a + x),
                "count": F.size(tail),
                "min": F.array_min(tail),
                "max": F.array_max(tail),
            }[p]
            parts[p] = _merge(p, earlier, here)
        out[s.name] = _result(s, parts)
    return joined.withColumns(out).select(*cols(df.columns), *out)


def recent_history(
    df: DataFrame,
    site: str,
    season: str,
    time: str,
    value: str,
    threshold: float = EXCEEDANCE,
    size: int = 5,
    mean_name: str = "Site_Season_Average",
    rate_name: str = "Site_Historical_Exceedance_Rate",
    rows: int = SERIES_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Mean of up to ``size`` previous values and the past exceedance rate, per site and season.

    The rate is (earlier rows at the threshold) / (earlier rows + 1): the first row counts as
    one that is not at the threshold. Rows without site or season get NULL in both columns.
    """
    grouped = F.col(site).isNotNull() & F.col(season).isNotNull()
    # rows of no series go past the window: together they could be most rows, in one group
    alone = df.filter(~grouped).withColumns(
        {c: F.lit(None).cast("double") for c in (mean_name, rate_name)}
    )
    out = past_features(
        df.filter(grouped),
        [site, season],
        time,
        [
            Past(mean_name, F.col(value).cast("double"), "avg", size),
            Past("__hits", at_least(value, threshold).cast("long"), "sum"),
            Past("__seen", F.lit(1), "count"),
        ],
        rows,
        longest,
    )
    rate = F.coalesce("__hits", F.lit(0)) / (F.coalesce("__seen", F.lit(0)) + 1)
    out = out.select(*cols(df.columns), F.col(mean_name), rate.alias(rate_name))
    return out.unionByName(alone)


def sequence_position(
    df: DataFrame, site: str, time: str, name: str = "position", rows: int = SERIES_ROWS
) -> DataFrame:
    """0-based position of a row within its site by time."""
    out = past_features(df, [site], time, [Past("__seen", F.lit(1), "count")], rows)
    return out.select(*cols(df.columns), F.coalesce("__seen", F.lit(0)).cast("long").alias(name))
