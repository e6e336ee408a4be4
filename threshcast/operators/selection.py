"""Exact order statistics and dense global ranks without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threshcast.functions.columns import cols
from threshcast.operators.series import interval_index, largest_group
from threshcast.session import broadcast_if_small, cut

#: Most distinct values one window task sorts.
SORT_ROWS = 1_000_000


def global_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """0-based position of each row in the total order ``order``.

    Range-partitioned sort; the position inside a partition plus the sizes of the partitions
    before it. The sorted rows are checkpointed so that both steps see the same partitions.
    """
    placed = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition of the sort
    sizes = placed.groupBy(part.alias("__part")).agg((F.max(inside) + 1).alias("__size"))
    starts = sizes.select(
        "__part",
        F.coalesce(
            F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("__start"),
    )
    return (
        placed.withColumn("__part", part)
        .join(broadcast_if_small(starts), "__part")
        .select(*cols(df.columns), (F.col("__start") + inside).alias(name))
    )


def order_statistic(
    df: DataFrame,
    value: Column,
    first_rank: Column,
    last_rank: Column | None = None,
    groups: Sequence[str] = (),
    name: str = "value",
    sort_rows: int = SORT_ROWS,
) -> DataFrame:
    """Mean of the values ranked ``first_rank`` to ``last_rank`` (1-based) of each group.

    The ranks are expressions of ``n``, the number of non-missing values. The result has
    ``groups``, ``n`` and ``name``; ranks beyond ``n`` give NULL.

    While a group has more than ``sort_rows`` candidates, a quantile sketch cuts its value
    range into about 1000 intervals, exact counts tell which of them hold the wanted ranks,
    and only those stay. The rest is one small sort per group.
    """
    last_rank = first_rank if last_rank is None else last_rank
    keys = list(groups) or ["__all"]
    rows = df.withColumn("__all", F.lit(0)) if not groups else df
    rows = rows.select(*keys, value.cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(
        sizes.select(
            *keys,
            "n",
            first_rank.cast("long").alias("__lo"),
            last_rank.cast("long").alias("__hi"),
            F.lit(0).cast("long").alias("__below"),
        )
    )
    weighted = rows.withColumn("__w", F.lit(1).cast("long"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    while longest > sort_rows:
        grid = [i / 1000 for i in range(1, 1000)]
        bounds = weighted.groupBy(*keys).agg(
            F.array_distinct(F.percentile_approx("__v", grid, 20_000)).alias("__bounds")
        )
        placed = _join(weighted, broadcast_if_small(bounds, 2_000, derived=True), keys).withColumn(
            "__slot", interval_index(F.col("__v"), F.col("__bounds"))
        )
        counts = placed.groupBy(*keys, "__slot").agg(F.sum("__w").alias("__c"))
        upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__slot"))
        chosen = (
            _join(counts.withColumn("__upto", upto), broadcast_if_small(sizes), keys)
            .withColumn("__from", F.col("__upto") - F.col("__c"))
            .filter(
                (F.col("__from") < F.col("__hi") - F.col("__below"))
                & (F.col("__upto") >= F.col("__lo") - F.col("__below"))
            )
            .select(*keys, "__slot", "__from")
        )
        chosen = cut(chosen)
        kept = _join(placed, broadcast_if_small(chosen), [*keys, "__slot"])
        weighted = cut(kept.groupBy(*keys, "__v").agg(F.sum("__w").alias("__w")))
        gone = chosen.groupBy(*keys).agg(F.min("__from").alias("__gone"))
        sizes = cut(
            _join(sizes, broadcast_if_small(gone), keys, "left").select(
                *keys,
                "n",
                "__lo",
                "__hi",
                (F.col("__below") + F.coalesce("__gone", F.lit(0))).alias("__below"),
            )
        )
        smaller = largest_group(weighted, keys)
        if smaller >= longest:
            break
        longest = smaller
    counts = weighted.groupBy(*keys, "__v").agg(F.sum("__w").alias("__w"))
    upto = F.sum("__w").over(Window.partitionBy(*keys).orderBy("__v"))
    placed = _join(counts.withColumn("__upto", upto), broadcast_if_small(sizes), keys)
    placed = placed.withColumns(
        {
            "__a": F.greatest(
                F.col("__upto") - F.col("__w") + F.col("__below") + 1, F.col("__lo")
            ),
            "__b": F.least(F.col("__upto") + F.col("__below"), F.col("__hi")),
        }
    ).withColumn("__take", F.greatest(F.col("__b") - F.col("__a") + 1, F.lit(0)))
    taken = F.sum("__take")
    picked = placed.groupBy(*keys).agg(
        F.when(
            taken == F.max(F.col("__hi") - F.col("__lo") + 1),
            F.sum(F.when(F.col("__take") > 0, F.col("__v") * F.col("__take"))) / taken,
        ).alias(name),
    )
    return _join(sizes.select(*keys, "n"), picked, keys, "left").select(*groups, "n", name)


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that treats missing keys as equal and keeps the left ones."""
    other = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *cols(c for c in right.columns if c not in keys)
    )
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"__r_{k}" for k in keys])


def median(
    df: DataFrame,
    value: Column,
    groups: Sequence[str] = (),
    name: str = "median",
    sort_rows: int = SORT_ROWS,
) -> DataFrame:
    """Exact median: the middle value, or the mean of the middle two."""
    n = F.col("n")
    return order_statistic(
        df, value, F.floor((n + 1) / 2), F.floor(n / 2) + 1, groups, name, sort_rows
    )
