"""Reading observation tables and writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshcast.functions.columns import col, markers_to_null, nan_to_null
from threshcast.functions.fixed_values import NULL_MARKERS, OBSERVATION_TEXT_COLUMNS

#: Row position in the input, the order "first" refers to.
ROW_ID = "_row"


def _with_row_id(df: DataFrame, fmt: str) -> DataFrame:
    """File and position of each row. Parquet knows the row number, text files do not: there
    it is the block of the file and the place inside it, stable for unchanged files."""
    if fmt == "parquet":
        place = [F.col("_metadata.row_index").alias("pos")]
    else:
        place = [
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
        ]
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), *place).alias(ROW_ID))


def _nan_columns_to_null(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(col(c).cast("double")) for c in doubles})


def read_parquet(spark: SparkSession, path: str, row_id: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return _nan_columns_to_null(_with_row_id(df, "parquet") if row_id else df)


def read_csv(
    spark: SparkSession,
    path: str,
    text: Sequence[str] = OBSERVATION_TEXT_COLUMNS,
    types: dict[str, str] | None = None,
    row_id: bool = False,
    lenient: bool = False,
) -> DataFrame:
    """CSV with header. Columns named in ``text`` are text, those in ``types`` have that type,
    all others are numbers; only the header line is read to find the column order. A cell that is
    not of its type is an error; with ``lenient`` it is missing."""
    header = spark.read.option("header", True).csv(path).columns
    kinds = {c: "string" for c in text} | (types or {})
    schema = T.StructType(
        [T.StructField(c, T._parse_datatype_string(kinds.get(c, "double"))) for c in header]
    )
    df = spark.read.schema(schema).options(
        header=True, enforceSchema=False, mode="PERMISSIVE" if lenient else "FAILFAST"
    ).csv(path)
    return _nan_columns_to_null(_with_row_id(df, "csv") if row_id else df)


def read_csv_with_markers(
    spark: SparkSession,
    path: str,
    numbers: Sequence[str],
    markers: Sequence[str] = NULL_MARKERS,
    lenient: bool = False,
) -> DataFrame:
    """CSV whose missing values are written as one of several markers.

    Any other text in a column of ``numbers`` is an error; with ``lenient`` it is missing.
    """
    df = spark.read.options(header=True, inferSchema=False).csv(path)

    def number(c: str) -> Column:
        value = markers_to_null(c, markers)
        checked = F.when(
            value.isNotNull() & value.try_cast("double").isNull(),
            F.raise_error(F.concat(F.lit(f"not a number in column {c}: "), value)),
        )
        parsed = value.try_cast("double")
        return parsed if lenient else F.coalesce(checked.cast("double"), parsed)

    return df.select(
        *[(number(c) if c in numbers else markers_to_null(c, markers)).alias(c) for c in df.columns]
    )


def read_if_present(spark: SparkSession, path: str, reader=read_csv, **options) -> DataFrame | None:
    """A table that may not exist; None if the path is missing, other errors are raised."""
    try:
        return reader(spark, path, **options)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "error",
) -> None:
    """One table in its own folder; every task writes its part, nothing is gathered first."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS"
        )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_forecasts(
    observations: DataFrame,
    forecasts: dict[str, DataFrame],
    keys: Sequence[str],
    path: str,
    fmt: str = "parquet",
    mode: str = "error",
) -> None:
    """Observation columns plus ``<model>_predictions`` of each model, matched by key."""
    from threshcast.operators.joins import align

    out = observations
    for model, df in forecasts.items():
        column = df.select(*keys, F.col("predictions").alias(f"{model}_predictions"))
        out = align(out, column, keys)
    write_table(out, path, fmt, mode=mode)


def write_fold_features(
    folds: DataFrame, path: str, fmt: str = "parquet", mode: str = "error"
) -> None:
    """Feature rows of each data set and fold, one folder per pair.

    Every task writes its rows into the folders they belong to; rows are not gathered by fold,
    as one fold may hold most of them.
    """
    write_table(folds, path, fmt, ["dataset", "fold"], mode)
