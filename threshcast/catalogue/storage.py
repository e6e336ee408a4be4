"""Queries that write a table to the shared folder and read it back."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from threshcast.catalogue.base import (
    FORECASTS,
    OBS,
    forecasts,
    observations,
    query,
    rounded,
    table,
)
from threshcast.catalogue.evaluation import HIGH, WARN, _core_sql, _flags
from threshcast.catalogue.matrices import _TARGET, target
from threshcast.operators.cleaning import keep_first
from threshcast.operators.folds import assign_folds, parse_periods
from threshcast.operators.scoring import fold_scores
from threshcast.session import fresh_path
from threshcast.sources.reports import read_report, write_report
from threshcast.sources.tables import (
    ROW_ID,
    read_csv,
    read_csv_with_markers,
    read_if_present,
    read_parquet,
    write_fold_features,
    write_forecasts,
    write_table,
)


@query("SELECT * FROM events")
def csv_scan(spark, folder):
    path = fresh_path(spark, "csv")
    ev = table(spark, folder, "events")
    write_table(ev, path, "csv")
    kinds = dict(ev.dtypes)
    text = [c for c, k in kinds.items() if k == "string"]
    numbers = {c: k for c, k in kinds.items() if k not in ("string", "double")}
    return read_csv(spark, path, text, numbers)


@query(
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN value END AS value,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM events"""
)
def csv_null_marker_scan(spark, folder):
    path, k = fresh_path(spark, "markers"), F.col("event_id")
    text = F.when(k % 7 == 0, "NA").when(k % 11 == 0, "?").otherwise(F.col("value").cast("string"))
    kind = F.when(k % 5 == 0, "NA").otherwise(F.col("event_type"))
    ev = table(spark, folder, "events")
    write_table(ev.select("event_id", text.alias("value"), kind.alias("event_type")), path, "csv")
    out = read_csv_with_markers(spark, path, ["event_id", "value"])
    return out.withColumn("event_id", F.col("event_id").cast("long"))


@query("SELECT CAST(0 AS BIGINT) AS missing, count(*) AS present FROM supplier")
def optional_source(spark, folder):
    """A second source that is absent, and one that is there."""
    absent = read_if_present(spark, f"{folder}/no_such_table.parquet", read_parquet)
    there = read_if_present(spark, f"{folder}/supplier.parquet", read_parquet)
    n = F.lit(0 if absent is None else 1).cast("long")
    return there.agg(F.count(F.lit(1)).alias("present")).select(n.alias("missing"), "present")


@query(
    """SELECT l_orderkey, first(round(l_extendedprice, 4) ORDER BY file_row_number) AS price
FROM (SELECT l_orderkey, l_extendedprice, row_number() OVER () AS file_row_number FROM lineitem) GROUP BY l_orderkey"""
)
def keep_first_in_file_order(spark, folder):
    """First row per key by its place in the file."""
    lines = read_parquet(spark, f"{folder}/lineitem.parquet", row_id=True)
    first = keep_first(lines.select("l_orderkey", "l_extendedprice", ROW_ID), ["l_orderkey"], [ROW_ID])
    return rounded(first.select("l_orderkey", F.col("l_extendedprice").alias("price")), 4)


@query(
    "WITH "
    + FORECASTS
    + """ SELECT e.event_id, e.user_id AS site, round(fc.p, 6) AS mean5_predictions,
  CASE WHEN e.value > 20 THEN round(e.value * 0.5, 6) END AS half_predictions
FROM events e LEFT JOIN fc USING (event_id)"""
)
def forecast_sink(spark, folder):
    path = fresh_path(spark, "forecasts")
    obs = table(spark, folder, "events").select("event_id", F.col("user_id").alias("site"), "value")
    fc = forecasts(spark, folder).select("event_id", F.col("p").alias("predictions"))
    key = F.when(F.col("value") > 20, F.col("event_id")).otherwise(-1 - F.col("event_id"))
    half = obs.select(key.alias("event_id"), (F.col("value") * 0.5).alias("predictions"))
    write_forecasts(obs.drop("value"), {"mean5": fc, "half": half}, ["event_id"], path)
    return rounded(spark.read.parquet(path))


@query(
    """WITH f(fold, s, e) AS (VALUES ('fold_1', TIMESTAMP '1998-01-01', TIMESTAMP '1999-01-01'),
  ('fold_2', TIMESTAMP '1999-01-01', TIMESTAMP '2000-01-01'))
SELECT o_orderkey, o_totalprice, fold, CASE WHEN o_orderdate < s THEN 'train' ELSE 'test' END AS dataset
FROM orders JOIN f ON o_orderdate < e"""
)
def fold_feature_sink(spark, folder):
    path = fresh_path(spark, "folds")
    periods = parse_periods(["1998-01-01_1999-01-01", "1999-01-01_2000-01-01"])
    folds = assign_folds(table(spark, folder, "orders"), periods, "o_orderdate")
    folds = folds.withColumnRenamed("role", "dataset")
    write_fold_features(folds.select("o_orderkey", "o_totalprice", "dataset", "fold"), path)
    return spark.read.parquet(path)


@query(_TARGET)
def matrix_sink(spark, folder):
    path = fresh_path(spark, "matrix")
    write_table(target(spark, folder), path)
    return rounded(spark.read.parquet(path))


@query(
    "WITH "
    + FORECASTS
    + _flags()
    + ", s AS (SELECT season AS model, 'fold_' || (1 + day(t) // 16) AS fold, * EXCLUDE (season) FROM m), c AS (SELECT model, coalesce(fold, 'overall') AS fold, "
    + _core_sql()
    + """ FROM s GROUP BY GROUPING SETS ((model, fold), (model)))
SELECT model, fold, metric, round(value, 6) AS value FROM (
  UNPIVOT (SELECT model, fold, CAST("TP" AS DOUBLE) AS "TP", CAST("FN" AS DOUBLE) AS "FN", rmse, sensitivity FROM c)
  ON "TP", "FN", rmse, sensitivity INTO NAME metric VALUE value)"""
)
def report_sink(spark, folder):
    """Scores through the JSON report, with the forecasts as its table."""
    path = fresh_path(spark, "report")
    fold = F.concat(F.lit("fold_"), (1 + F.floor(F.dayofmonth("t") / 16)).cast("string"))
    fc = forecasts(spark, folder).withColumns({"model": F.col("season"), "fold": fold})
    scores = fold_scores(fc, "y", "p", "fold", ["model"], HIGH, WARN)
    shown = fc.select("p", "t", "site", "y")
    write_report(scores, path, {"fold_predictions": shown}, threshold=HIGH, precaution=WARN)
    return rounded(read_report(spark, path, ["TP", "FN", "rmse", "sensitivity"]))


@query("WITH " + OBS + " SELECT * FROM obs")
def training_set_sink(spark, folder):
    path = fresh_path(spark, "training")
    write_table(observations(spark, folder), path)
    return read_parquet(spark, path)


@query("WITH " + OBS + """, s AS (SELECT *, row_number() OVER (ORDER BY nullif(site, 7) NULLS LAST, t NULLS LAST, event_id) AS place FROM obs)
SELECT * REPLACE (nullif(site, 7) AS site) FROM s""")
def sorted_sink(spark, folder):
    """Rows written in order of site and time, missing sites last, and read with their places."""
    path = fresh_path(spark, "sorted")
    obs = observations(spark, folder)
    obs = obs.withColumn("site", F.nullif(F.col("site"), F.lit(7).cast("long")))
    order = [F.asc_nulls_last("site"), F.asc_nulls_last("t"), F.asc("event_id")]
    write_table(obs.orderBy(*order), path)
    back = read_parquet(spark, path, row_id=True)
    # files are numbered in the order of the sort; a file's rows count on from those before it
    files = back.groupBy(F.col(f"{ROW_ID}.file").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    out = back.join(F.broadcast(files), F.col(f"{ROW_ID}.file") == F.col("file"))
    place = F.col("earlier") + F.col(f"{ROW_ID}.pos") + 1
    return out.select(*[c for c in obs.columns], place.cast("long").alias("place"))
