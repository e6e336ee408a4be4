"""The evaluation report: scores of all models as JSON, their tables next to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshcast.functions.fixed_values import EXCEEDANCE, PRECAUTION
from threshcast.operators.scoring import long_scores
from threshcast.sources.tables import write_table


def report_rows(
    scores: DataFrame,
    model: str = "model",
    fold: str = "fold",
    threshold: float = EXCEEDANCE,
    precaution: float = PRECAUTION,
    tables: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """One row per model: thresholds, metric names, fold results, table names and columns.

    Counts of rows of the tables are taken by one aggregate each. The nesting collects scores
    only, a fixed number per model and fold.
    """
    long = long_scores(scores, [model, fold])
    per_fold = long.groupBy(model, fold).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m")
    )
    names = long.groupBy(model).agg(F.sort_array(F.collect_set("metric")).alias("metrics"))
    nested = per_fold.groupBy(model).agg(
        F.map_from_entries(F.collect_list(F.struct(fold, "m"))).alias("f")
    )
    summary = [
        F.struct(
            F.lit(name).alias("name"),
            F.array(F.lit(df.count()), F.lit(len(df.columns)).cast("long")).alias("shape"),
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        )
        for name, df in (tables or {}).items()
    ]
    out = nested.join(names, model).select(
        model,
        "metrics",
        F.lit(threshold).alias("exceedance_threshold"),
        F.lit(precaution).alias("precautionary_threshold"),
        F.col("f").alias("fold_results"),
    )
    return out.withColumn("tables", F.array(*summary)) if summary else out


def write_report(
    scores: DataFrame,
    path: str,
    tables: dict[str, DataFrame] | None = None,
    fmt: str = "parquet",
    mode: str = "error",
    **names,
) -> None:
    """``<path>/report`` as JSON, one line per model, and each table in ``<path>/<name>``."""
    rows = report_rows(scores, tables=tables, **names)
    rows.coalesce(1).write.mode(mode).json(f"{path}/report")
    for name, df in (tables or {}).items():
        write_table(df, f"{path}/{name}", fmt, mode=mode)


def read_report(spark, path: str, metrics: Sequence[str] | None = None) -> DataFrame:
    """The scores of a report as (model, fold, metric, value)."""
    schema = (
        "model string, metrics array<string>, exceedance_threshold double, "
        "precautionary_threshold double, fold_results map<string, map<string, double>>"
    )
    df = spark.read.schema(schema).json(f"{path}/report")
    folds = df.select("model", F.explode("fold_results").alias("fold", "m"))
    out = folds.select("model", "fold", F.explode("m").alias("metric", "value"))
    return out if metrics is None else out.filter(F.col("metric").isin(list(metrics)))
