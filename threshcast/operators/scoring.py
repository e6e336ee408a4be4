"""Score tables over folds, models and sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshcast.functions.columns import at_least, col, positive_or, round_even
from threshcast.functions.fixed_values import EXCEEDANCE, PRECAUTION
from threshcast.functions.measures import (
    aliased,
    classification_rates,
    classification_suite,
    confusion,
    core_suite,
    regression_suite,
)

#: Scores that are counts: added over folds, while all others are averaged.
COUNTS = ("TP", "FP", "TN", "FN", "tp", "fp", "tn", "fn", "precautionary")


def score(
    forecasts: DataFrame,
    y: str,
    p: str,
    by: Sequence[str] = (),
    suite: str = "core",
    threshold: float = EXCEEDANCE,
    precaution: float = PRECAUTION,
) -> DataFrame:
    """One row of scores per group in one aggregation; suite core, regression, classification."""
    scores = {
        "core": lambda: core_suite(y, p, threshold, precaution),
        "regression": lambda: regression_suite(y, p, threshold),
        "classification": lambda: classification_suite(y, p, threshold, precaution),
    }[suite]()
    return forecasts.groupBy(*by).agg(*aliased(scores))


def fold_scores(
    forecasts: DataFrame,
    y: str,
    p: str,
    fold: str = "fold",
    by: Sequence[str] = (),
    threshold: float = EXCEEDANCE,
    precaution: float = PRECAUTION,
) -> DataFrame:
    """Core scores per fold and over the pooled rows of all folds (fold 'overall').

    Pooled means every row counts once; it is not the mean of the fold scores. One scan: the
    two grouping sets share the partial aggregation.
    """
    grouped = forecasts.withColumn("__fold", col(fold))
    sets = [[*by, "__fold"], list(by)]
    out = grouped.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*by, "__fold"]]
    ).agg(
        F.grouping("__fold").alias("__total"), *aliased(core_suite(y, p, threshold, precaution))
    )
    name = F.when(F.col("__total") == 1, F.lit("overall")).otherwise(F.col("__fold"))
    return out.select(*by, name.alias(fold), *[c for c in out.columns if c not in (*by, "__fold", "__total")])


def summarise_folds(scores: DataFrame, by: Sequence[str], digits: int = 4) -> DataFrame:
    """Mean of the rates and sum of the counts over folds, rounded."""
    names = [c for c in scores.columns if c not in by and dict(scores.dtypes)[c] != "string"]
    return scores.groupBy(*by).agg(
        *[
            (F.sum(c) if c in COUNTS else round_even(F.avg(c), digits)).alias(c)
            for c in names
        ]
    )


def long_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value), the storage form of a score table."""
    names = [c for c in scores.columns if c not in keys]
    wide = scores.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot(list(keys), names, "metric", "value").filter(F.col("value").isNotNull())


def performance_table(
    forecasts: DataFrame, site: str, y: str, p: str, threshold: float = EXCEEDANCE
) -> DataFrame:
    """One row per site and one named OVERALL: rates rounded to 2, counts, weighted log errors.

    Everything shown derives from sums, so rows are summed per site first and the total is
    added up from the site rows. A missing site is a row of its own.
    """
    t = at_least(y, threshold)
    ly, lp = F.log1p(col(y)), F.log1p(positive_or(p))
    parts: dict[str, Column] = confusion(y, p, threshold)
    for name, rows in (("all", F.lit(True)), ("exceedance", t), ("safe", col(y) < threshold)):
        used = rows & (ly != 0)
        parts[f"__e_{name}"] = F.sum(F.when(used, F.signum(ly) * F.abs(ly - lp)))
        parts[f"__w_{name}"] = F.sum(F.when(used, ly))
    per_site = forecasts.groupBy(col(site).cast("string").alias("__site")).agg(*aliased(parts))
    total = per_site.rollup("__site").agg(
        F.grouping("__site").alias("__total"), *[F.sum(c).alias(c) for c in parts]
    )
    rates = classification_rates(*[F.col(c) for c in ("TP", "FP", "TN", "FN")])

    def error(name: str) -> Column:
        return round_even(
            F.coalesce(F.try_divide(F.col(f"__e_{name}"), F.col(f"__w_{name}")), F.lit(-1.0)), 2
        )

    return total.select(
        F.when(F.col("__total") == 1, "OVERALL").otherwise(F.col("__site")).alias("site"),
        round_even(rates["accuracy"], 2).alias("accuracy"),
        round_even(rates["recall_exceedance"], 2).alias("recall_exceedance"),
        round_even(rates["specificity"], 2).alias("specificity"),
        "TP",
        "FN",
        "TN",
        "FP",
        error("all").alias("log_weighted_mape"),
        error("exceedance").alias("log_weighted_mape_exceedance"),
        error("safe").alias("log_weighted_mape_safe"),
    )
