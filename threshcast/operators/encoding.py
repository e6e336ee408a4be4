"""Label codes: position of a label among the sorted distinct labels of its column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threshcast.functions.columns import label_text
from threshcast.operators.cleaning import text_columns
from threshcast.operators.selection import SORT_ROWS, global_index
from threshcast.session import BROADCAST_ROWS, broadcast_if_small, cut, fits


def fit_codes(
    df: DataFrame, columns: Sequence[str] | None = None, sort_rows: int = SORT_ROWS
) -> DataFrame:
    """Table (column, label, code). Labels are text in ascending order, so "10" precedes "2".

    Few labels are ranked per column; many are ranked by a range-partitioned sort.
    """
    columns = text_columns(df) if columns is None else list(columns)
    return ranked_labels(cut(labels_of(df, columns).distinct()), sort_rows)


def labels_of(df: DataFrame, columns: Sequence[str], *more: str) -> DataFrame:
    """(more, column, label): one row for each cell of the columns."""
    return df.select(*more, *[label_text(c).alias(c) for c in columns]).unpivot(
        list(more), list(columns), "column", "label"
    )


def ranked_labels(labels: DataFrame, sort_rows: int = SORT_ROWS) -> DataFrame:
    """(column, label, code) of different (column, label)."""
    if fits(labels, sort_rows):
        w = Window.partitionBy("column").orderBy("label")
        return labels.withColumn("code", (F.row_number().over(w) - 1).cast("long"))
    placed = global_index(labels, ["column", "label"])
    start = placed.groupBy("column").agg(F.min("idx").alias("__start"))
    return placed.join(broadcast_if_small(start), "column").select(
        "column", "label", (F.col("idx") - F.col("__start")).alias("code")
    )


def code_counts(codes: DataFrame) -> dict[str, int]:
    """Number of labels of each column."""
    rows = codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["column"]: r["n"] for r in rows}


def apply_codes(
    df: DataFrame,
    codes: DataFrame,
    columns: Sequence[str],
    suffix: str = "",
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """Replace each column by its code (or add ``<column><suffix>``).

    A label not seen when fitting gets the code after the last one. ``counts`` saves counting
    the labels again; only label lists known to be short are broadcast.
    """
    counts = code_counts(codes) if counts is None else counts
    out = df
    for i, c in enumerate(columns):
        n = counts.get(c, 0)
        side = codes.filter(F.col("column") == c).select(
            F.col("label").alias(f"__l{i}"), F.col("code").alias(f"__c{i}")
        )
        small = n <= BROADCAST_ROWS and fits(side)
        missing = out.filter(F.col(c).isNull())
        if not small:
            # missing labels are all one label; they take its code without a join
            found = side.filter(F.col(f"__l{i}") == label_text(F.lit(None))).first()
            missing = missing.withColumn(f"__c{i}", F.lit(None if found is None else found[1]).cast("long"))
            out = out.filter(F.col(c).isNotNull())
        side = F.broadcast(side) if small else side
        out = out.join(side, label_text(c) == F.col(f"__l{i}"), "left").drop(f"__l{i}")
        out = out if small else out.unionByName(missing)
        code = F.coalesce(F.col(f"__c{i}"), F.lit(n).cast("long"))
        out = out.withColumn(f"{c}{suffix}", code).drop(f"__c{i}")
    return out


def label_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fit and apply in one step."""
    columns = text_columns(df) if columns is None else list(columns)
    return apply_codes(df, fit_codes(df, columns), columns)
