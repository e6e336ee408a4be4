"""Scores, quantiles, calibration and charts."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from threshcast.functions.measures import aliased, core_suite, log_percentage_error
from threshcast.operators.charts import band_columns, histogram, model_comparison, site_series
from threshcast.operators.conformal import apply_shift, conformal_shift, coverage
from threshcast.operators.quantiles import point_forecast
from threshcast.operators.scoring import fold_scores, performance_table, score, summarise_folds
from threshcast.sources.reports import read_report, write_report


def counts_table(spark, fold, tp, fp, tn, fn):
    rows = [(fold, 300.0, 300.0)] * tp + [(fold, 10.0, 300.0)] * fp
    rows += [(fold, 10.0, 10.0)] * tn + [(fold, 300.0, 200.0)] * fn
    return spark.createDataFrame(rows, "fold string, y double, p double")


# Published counts per fold with their sensitivity and specificity.
GOLDEN = {
    "fold_1": (17, 14, 213, 12, 0.5862068965517241, 0.9383259911894273),
    "fold_2": (22, 8, 291, 12, 0.6470588235294118, 0.9732441471571907),
    "fold_3": (18, 36, 385, 19, 0.4864864864864865, 0.9144893111638955),
    "overall": (57, 58, 889, 43, 0.57, 0.938753959873284),
}


def golden_folds(spark):
    parts = [counts_table(spark, f, *GOLDEN[f][:4]) for f in ("fold_1", "fold_2", "fold_3")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def test_golden_fold_arithmetic(spark):
    out = {r["fold"]: r for r in fold_scores(golden_folds(spark), "y", "p").collect()}
    for fold, (tp, fp, tn, fn, sensitivity, specificity) in GOLDEN.items():
        r = out[fold]
        assert (r["TP"], r["FP"], r["TN"], r["FN"]) == (tp, fp, tn, fn)
        assert r["sensitivity"] == pytest.approx(sensitivity, abs=1e-15)
        assert r["specificity"] == pytest.approx(specificity, abs=1e-15)
        assert r["precautionary_sensitivity"] == 1.0


def test_summary_adds_counts_and_averages_rates(spark):
    folds = score(golden_folds(spark), "y", "p", ["fold"]).withColumn("model", F.lit("m"))
    r = summarise_folds(folds.drop("fold"), ["model"]).first()
    assert (r["TP"], r["FP"], r["TN"], r["FN"]) == GOLDEN["overall"][:4]
    mean = np.mean([GOLDEN[f][4] for f in ("fold_1", "fold_2", "fold_3")])
    assert r["sensitivity"] == pytest.approx(round(mean, 4))


def test_core_scores_by_numpy(spark):
    draw = np.random.default_rng(1)
    y = np.round(draw.exponential(200, 400), 1)
    p = np.round(y * draw.uniform(0.3, 1.8, 400), 1)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist(), strict=True)), "y double, p double")
    r = score(df, "y", "p").first()
    high = y >= 280
    assert r["rmse"] == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert r["rmse_exceedance"] == pytest.approx(np.sqrt(np.mean((y - p)[high] ** 2)))
    assert r["r2"] == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    assert r["wmape_safe"] == pytest.approx(100 * np.abs(y - p)[~high].sum() / y[~high].sum())
    assert r["precautionary_sensitivity"] == pytest.approx((high & (p >= 140)).sum() / high.sum())
    g = score(df, "y", "p", suite="regression").first()
    ly, lp = np.log1p(y), np.log1p(np.where(p <= 0, 5, p))
    assert g["log_rmse"] == pytest.approx(np.sqrt(np.mean((ly - lp) ** 2)))
    assert g["log_weighted_mape_exceedance"] == pytest.approx(np.abs(ly - lp)[high].sum() / ly[high].sum())
    assert g["nrmse_safe"] == pytest.approx(
        100 * np.sqrt(np.mean((y - p)[~high] ** 2)) / np.ptp(y[~high])
    )


def test_empty_classes(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 300.0)], "y double, p double")
    r = score(df, "y", "p").first()
    assert r["sensitivity"] == 1.0 and r["rmse_exceedance"] is None and r["wmape_exceedance"] is None
    g = score(df, "y", "p", suite="regression").first()
    assert [g[f"{m}_exceedance"] for m in ("mae", "weighted_mape", "nrmse", "log_r2")] == [-1] * 4
    c = score(df, "y", "p", suite="classification").first()
    assert c["recall_exceedance"] == 0 and c["recall_precautionary"] == 0 and c["fp"] == 1


def test_no_rows_score_like_one_perfect_forecast(spark):
    empty = spark.createDataFrame([], "y double, p double")
    g = score(empty, "y", "p", suite="regression").first()
    assert g["log_rmse"] == 0 and g["mae"] == 0 and g["log_nrmse"] == -1 and g["mae_safe"] == 0
    assert g["weighted_mape"] == 0 and g["mae_exceedance"] == -1 and g["log_r2"] is None


def test_constant_truth(spark):
    df = spark.createDataFrame([(5.0, 5.0), (5.0, 5.0)], "y double, p double")
    assert score(df, "y", "p").first()["r2"] == 1.0
    assert score(df.withColumn("p", F.lit(6.0)), "y", "p").first()["r2"] == 0.0
    assert score(df.limit(1), "y", "p").first()["r2"] is None


def test_missing_values_are_not_at_the_threshold(spark):
    df = spark.createDataFrame([(None, 300.0), (300.0, None), (300.0, 310.0)], "y double, p double")
    r = df.agg(*aliased(core_suite("y", "p"))).first()
    assert (r["TP"], r["FP"], r["TN"], r["FN"]) == (1, 1, 0, 1)
    assert r["rmse"] == 10.0


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(280.0, 140.0)], "y double, p double")
    r = score(df, "y", "p").first()
    assert r["FN"] == 1 and r["precautionary_sensitivity"] == 1.0


def test_log_percentage_error_skips_zero_truth(spark):
    df = spark.createDataFrame([(0.0, 5.0), (np.e - 1, 0.0)], "y double, p double")
    assert df.agg(log_percentage_error("y", "p")).first()[0] == pytest.approx(1.0)


def test_performance_table_total_and_missing_site(spark):
    rows = [("a", 300.0, 300.0), ("a", 10.0, 300.0), (None, 10.0, 10.0), ("b", 300.0, 0.0)]
    df = spark.createDataFrame(rows, "site string, y double, p double")
    out = {r["site"]: r for r in performance_table(df, "site", "y", "p").collect()}
    assert set(out) == {"OVERALL", "a", "b", None}
    total = out["OVERALL"]
    assert (total["TP"], total["FN"], total["TN"], total["FP"]) == (1, 1, 1, 1)
    assert total["accuracy"] == 0.5 and out["b"]["log_weighted_mape_safe"] == -1
    assert out["b"]["log_weighted_mape"] == pytest.approx(
        round(abs(np.log1p(300) - np.log1p(5)) / np.log1p(300), 2)
    )


def test_point_forecast(spark):
    df = spark.createDataFrame([(1, 9.5, 2.5, 6.5)], "k int, `q_0.05` double, `q_0.5` double, `q_0.9` double")
    r = point_forecast(df).first()
    assert (r["q_0.05"], r["q_0.5"], r["q_0.9"], r["predictions"]) == (5.0, 6.0, 10.0, 6.0)


def test_conformal_rank(spark):
    rows = [(float(i), 0.0, 0.0) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "y double, lo double, hi double")
    # (9 + 1) * 0.9 = 9: the largest of the nine scores
    assert conformal_shift(df, "lo", "hi", "y").first()["shift"] == 9.0
    assert conformal_shift(df.limit(8), "lo", "hi", "y").first()["shift"] == float("inf")


def test_conformal_coverage(spark):
    draw = np.random.default_rng(2)
    y = draw.normal(0, [1, 3] * 2000).tolist()
    rows = [(i, "ab"[i % 2], v, -0.5, 0.5) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "i int, g string, y double, lo double, hi double")
    held, rest = df.filter("i % 4 < 2"), df.filter("i % 4 >= 2")
    shift = conformal_shift(held, "lo", "hi", "y", 0.1, ["g"])
    out = coverage(apply_shift(rest, shift, "lo", "hi", ["g"]), "pi_lower", "pi_upper", "y", ["g"])
    for r in out.collect():
        assert 0.86 < r["coverage"] < 0.94


def test_charts(spark):
    assert band_columns(["q_0.05", "q_0.3", "q_0.9", "q_0.95"]) == ("q_0.05", "q_0.9")
    assert band_columns(["q_0.2", "q_0.5"]) == (None, None)
    t = datetime.datetime(2024, 5, 6, 7, 8, 9)
    rows = [("a", t, 2000.0, 5.0), ("a", t - datetime.timedelta(days=1), 1.0, None), ("b", t, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "site string, t timestamp_ntz, y double, p double")
    out = model_comparison(df, "site", "t", ["y", "p"]).orderBy("site", "position").collect()
    assert [(r["position"], r["y"], r["p"]) for r in out] == [(0, 1.0, None), (1, 1000.0, 5.0), (0, 1.0, 1.0)]
    assert out[1]["label"] == "2024-05-06 07:08" and out[1]["precaution"] == 140.0
    assert {r["site"] for r in site_series(df, "site", "t", ["y"]).collect()} == {"a"}


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    out = {r["bin"]: r["n"] for r in histogram(df, "v", 5).collect()}
    assert out == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [(r["bin"], r["n"]) for r in histogram(flat, "v", 5).collect()] == [(0, 2)]


def test_report(spark, tmp_path):
    folds = golden_folds(spark)
    scores = fold_scores(folds, "y", "p").withColumn("model", F.lit("m"))
    write_report(scores, str(tmp_path / "r"), {"fold_predictions": folds})
    files = list((tmp_path / "r" / "report").glob("*.json"))
    report = json.loads(files[0].read_text())
    assert report["fold_results"]["overall"]["TP"] == 57
    assert report["exceedance_threshold"] == 280 and report["precautionary_threshold"] == 140
    assert report["tables"][0] == {
        "name": "fold_predictions", "shape": [1047, 3], "columns": ["fold", "y", "p"],
    }
    back = read_report(spark, str(tmp_path / "r"), ["sensitivity"])
    assert {r["fold"]: r["value"] for r in back.collect()}["overall"] == 0.57
    assert spark.read.parquet(str(tmp_path / "r" / "fold_predictions")).count() == 1047
