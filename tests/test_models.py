"""Factorisation, forests, boosting and the whole flow, by their invariants."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from threshcast.functions.fixed_values import QUANTILE_LEVELS
from threshcast.operators.baselines import Baseline, BaselineModel
from threshcast.operators.boosting import PoissonBoost, PoissonBoostModel
from threshcast.operators.factors import (
    Factors,
    ImplicitMatrix,
    dense_matrix,
    factorise,
    implicit_target_matrix,
    reconstruct,
)
from threshcast.operators.folds import parse_periods
from threshcast.operators.learning import FeatureFrame
from threshcast.operators.matrix import (
    complete_pairs,
    daily_fill,
    day_values,
    day_weights,
    fill_row_means,
    target_values,
)
from threshcast.operators.matrix_model import MatrixForecasterModel
from threshcast.operators.quantiles import MetaLearner, QuantileForest, out_of_fold
from threshcast.plans.forecasting import (
    BaselineForecaster,
    Layout,
    PoissonForecaster,
    QuantileForecaster,
    QuantileForecasterModel,
    evaluate_models,
    matrix_forecaster,
    predict_models,
    train_models,
)

LAYOUT = Layout("site", "t", "y", "season")


def dense(factors, rows, cols):
    W = {r["row"]: r["w"] for r in factors.W.collect()}
    H = {r["col"]: r["h"] for r in factors.H.collect()}
    return np.array([W[r] for r in rows]), np.array([H[c] for c in cols])


def cells(spark, X):
    rows = [(i, j, float(X[i, j])) for i in range(X.shape[0]) for j in range(X.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, x double")


@pytest.fixture(scope="module")
def low_rank():
    draw = np.random.default_rng(4)
    return draw.uniform(0, 1, (30, 3)) @ draw.uniform(0, 1, (3, 12)) + draw.uniform(0, 0.05, (30, 12))


@pytest.mark.parametrize("init", ["nndsvd", "seeded"])
def test_objective_never_rises(spark, low_rank, init):
    f = factorise(dense_matrix(cells(spark, low_rank)), 3, init, sweeps=6, tol=0)
    assert all(b <= a + 1e-9 for a, b in zip(f.objective, f.objective[1:], strict=False))
    W, H = dense(f, range(30), range(12))
    assert (W >= 0).all() and (H >= 0).all()
    assert 0.5 * np.sum((low_rank - W @ H.T) ** 2) == pytest.approx(f.objective[-1], rel=1e-6)


def test_singular_vector_start(spark, low_rank):
    f = factorise(dense_matrix(cells(spark, low_rank)), 3, sweeps=0, tol=0, svd_passes=8)
    W, H = dense(f, range(30), range(12))
    U, S, Vt = np.linalg.svd(low_rank)
    assert W[:, 0] == pytest.approx(np.sqrt(S[0]) * np.abs(U[:, 0]), rel=1e-6)
    assert H[:, 0] == pytest.approx(np.sqrt(S[0]) * np.abs(Vt[0]), rel=1e-6)
    for j in (1, 2):
        parts = []
        for s in (1, -1):
            u, v = np.maximum(s * U[:, j], 0), np.maximum(s * Vt[j], 0)
            parts.append((np.linalg.norm(u) * np.linalg.norm(v), u, v))
        m, u, v = max(parts, key=lambda p: p[0])
        assert W[:, j] == pytest.approx(np.sqrt(S[j] * m) * u / np.linalg.norm(u), abs=1e-3)
        assert H[:, j] == pytest.approx(np.sqrt(S[j] * m) * v / np.linalg.norm(v), abs=1e-3)


def test_sweeps_by_numpy_with_shuffled_sides(spark, low_rank):
    """Same numbers when both factor tables are too long to broadcast."""
    W = np.abs(np.sin(np.arange(60))).reshape(30, 2) + 0.1
    H = np.abs(np.cos(np.arange(24))).reshape(12, 2) + 0.1
    start = Factors(
        spark.createDataFrame([(i, W[i].tolist()) for i in range(30)], "row int, w array<double>"),
        spark.createDataFrame([(i, H[i].tolist()) for i in range(12)], "col int, h array<double>"),
        2,
    )
    for _ in range(2):
        W = W * (low_rank @ H) / (W @ (H.T @ H))
        H = H * (low_rank.T @ W) / (H @ (W.T @ W))
    x = dense_matrix(cells(spark, low_rank))
    for rows in (1000, 3):
        f = factorise(x, 2, sweeps=2, tol=0, start=start, broadcast_rows=rows)
        w, h = dense(f, range(30), range(12))
        assert w == pytest.approx(W, rel=1e-9) and h == pytest.approx(H, rel=1e-9)


def test_zeros_stay_zero_and_stop_rule(spark, low_rank):
    start = Factors(
        spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)], "row int, w array<double>"),
        spark.createDataFrame([(i, [1.0, 0.0]) for i in range(12)], "col int, h array<double>"),
        2,
    )
    f = factorise(dense_matrix(cells(spark, low_rank)), 2, sweeps=100, tol=1e-3, start=start)
    W, H = dense(f, range(30), range(12))
    assert (W[:, 1] == 0).all() and (H[:, 1] == 0).all() and len(f.objective) < 100


def observed(spark):
    at = datetime.datetime
    rows = [
        (at(2024, 1, 1, 8), "a", 1.0),
        (at(2024, 1, 1, 9), "a", 9.0),
        (at(2024, 1, 1, 9), "b", 4.0),
        (at(2024, 1, 2, 9), "b", 6.0),
        (at(2024, 1, 3, 9), "c", None),
    ]
    return spark.createDataFrame(rows, "t timestamp_ntz, site string, v double")


def all_pairs(obs):
    times, sites = obs.select("t").distinct(), obs.select("site").distinct()
    rows = [(t["t"], s["site"]) for t in times.collect() for s in sites.collect()]
    return obs.sparkSession.createDataFrame(rows, "t timestamp_ntz, site string")


def test_matrix_steps(spark):
    obs = observed(spark)
    pairs = all_pairs(obs)
    assert complete_pairs(pairs, obs, "t", "site", "v").count() == pairs.count() == 12
    found = daily_fill(pairs, obs, "t", "site", "v").collect()
    daily = {(r["t"].day, r["t"].hour, r["site"]): r["v"] for r in found}
    # the first value of the day also replaces the later 9.0, and reaches back to 8 o'clock
    assert daily[1, 8, "a"] == daily[1, 9, "a"] == 1.0 and daily[1, 8, "b"] == 4.0
    assert daily[2, 9, "a"] is None
    days = day_values(obs, "t", "site", "v")
    filled = fill_row_means(pairs, days, "t", "site", "v").collect()
    means = {(r["t"].day, r["site"]): r["v"] for r in filled}
    assert means[1, "c"] == 2.5 and means[2, "a"] == 6.0 and means[3, "a"] is None
    whole = fill_row_means(pairs, days, "t", "site", "v", day_weights(obs, "t"))
    assert {r["v"] for r in whole.filter("day(t) = 3").collect()} == {(1 + 1 + 4 + 4 + 6) / 5}


def test_implicit_matrix_equals_full_one(spark):
    obs = observed(spark)
    full = {(r["t"], r["site"]): r["v"] for r in target_values(all_pairs(obs), obs, "t", "site", "v").collect()}
    x = implicit_target_matrix(obs, "t", "site", "v")
    rows = {r["row"]: (r["fill"], r["weight"]) for r in x.rows.collect()}
    entries = {(r["row"], r["col"]): r["x"] for r in x.entries.collect()}
    assert sum(w for _, w in rows.values()) == 4
    for (t, site), v in full.items():
        assert v == pytest.approx(entries.get((t.date(), site), rows[t.date()][0]))
    explicit = spark.createDataFrame(
        [(t, s, v) for (t, s), v in full.items()], "row timestamp_ntz, col string, x double"
    )
    a = factorise(x, 2, "nndsvd", sweeps=3, tol=0)
    b = factorise(dense_matrix(explicit), 2, "nndsvd", sweeps=3, tol=0)
    assert a.objective == pytest.approx(b.objective, rel=1e-6)


def test_reconstruct_by_hand(spark):
    W = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 1.0])], "t int, w array<double>")
    H = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [4.0, 5.0])], "s string, h array<double>")
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "t int, s string")
    got = {(r["t"], r["s"]): r["predictions"] for r in reconstruct(wanted, W, H, "t", "s", 2).collect()}
    assert got == {(1, "a"): 3.0, (1, "b"): 4.0, (2, "a"): 6.0, (2, "b"): 13.0, (3, "a"): None}


def test_rank_beyond_columns(spark):
    with pytest.raises(ValueError):
        factorise(dense_matrix(cells(spark, np.ones((3, 2)))), 5)
    empty = dense_matrix(cells(spark, np.ones((1, 1))))
    assert isinstance(empty, ImplicitMatrix)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    draw = np.random.default_rng(8)
    start = datetime.datetime(2021, 1, 1)
    rows = []
    for i in range(1500):
        site, rain = int(draw.integers(0, 8)), float(draw.gamma(2, 3))
        mean = 20 + 6 * site + 8 * rain
        y = float(draw.poisson(draw.gamma(3, mean / 3)))
        t = start + datetime.timedelta(hours=17 * i)
        rows.append((f"s{site}", t, None if i % 40 == 7 else rain, float(site), "wet" if rain > 6 else None, y))
    df = spark.createDataFrame(
        rows, "site string, t timestamp_ntz, rain double, Latitude double, kind string, y double"
    )
    path = str(tmp_path_factory.mktemp("data") / "table")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def frame(table):
    return FeatureFrame.fit(table, *LAYOUT.feature_columns(table))


def test_poisson_deviance_falls(table, frame, spark, tmp_path):
    settings = PoissonBoost(rounds=6, rate=0.3, max_depth=3, row_share=1.0, feature_share=1.0, cut_every=2)
    model = settings.fit(table, frame, "y", ["site", "t"])

    def deviance(rounds):
        mu = F.col("mu")
        term = F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / mu)).otherwise(0.0)
        out = model.predict_mean(table, "mu", rounds)
        return out.agg(F.sum(2 * (term - F.col("y") + mu))).first()[0]

    falls = [deviance(n) for n in (0, 2, 4, 6)]
    assert falls == sorted(falls, reverse=True) and falls[3] < 0.8 * falls[0]
    importance = model.importance()
    assert max(importance, key=importance.get) in ("rain", "kind", "site", "Latitude")
    assert set(importance) == {"rain", "Latitude", "site", "kind"}
    out = model.predict(table).select("predictions").distinct().collect()
    assert all(r[0] >= 5 and r[0] == round(r[0]) for r in out)
    model.write(str(tmp_path / "m"), spark)
    again = PoissonBoostModel.read(spark, str(tmp_path / "m"))
    both = model.predict(table, "a").join(again.predict(table, "b").select("site", "t", "b"), ["site", "t"])
    assert both.filter("a <> b").count() == 0


def test_poisson_sampling_is_repeatable(table, frame):
    settings = PoissonBoost(rounds=2, rate=0.3, max_depth=3)
    a, b = (
        sorted(r[0] for r in settings.fit(t, frame, "y", ["site", "t"]).predict_mean(table).select("predictions").collect())
        for t in (table, table)
    )
    assert a == b


def test_quantile_forest(table, frame):
    model = QuantileForest(trees=8, max_depth=4).fit(table, frame, "y")
    names = [f"q_{q}" for q in QUANTILE_LEVELS]
    out = model.predict(table).toPandas()
    q = out[names].to_numpy()
    assert (np.diff(q, axis=1) >= 0).all()
    for level, name in ((0.05, "q_0.05"), (0.5, "q_0.5"), (0.95, "q_0.95")):
        assert abs((out.y <= out[name]).mean() - level) < 0.08


def test_out_of_fold_covers_every_row_once(table, frame):
    forest = QuantileForest(levels=[0.1, 0.9], trees=4, max_depth=3)
    out = out_of_fold(table, forest, frame, "y", ["site", "t"])
    assert out.count() == table.count() == out.select("site", "t").distinct().count()
    meta = MetaLearner(["q_0.1", "q_0.9"], rounds=3, max_depth=2)
    with pytest.raises(ValueError):
        meta.predict(out)
    best = meta.tune(out, "y", {"maxDepth": [1, 3]}, folds=2)
    assert best["maxDepth"] in (1, 3) and best["mae"] > 0
    assert meta.predict(out).filter("predictions < 5").count() == 0


def test_meta_learner_fits_a_hot_vector_and_all_rows(spark):
    ids = spark.range(600)
    tenth = F.pmod(F.xxhash64(F.col("v").cast("double")), F.lit(10)) == 0
    values = spark.range(5, 200).select(F.col("id").alias("v"))
    hot = values.filter(tenth).first()[0]
    cold = values.filter(~tenth).first()[0]
    rows = ids.withColumn("q", F.when(F.col("id") % 3 == 0, hot).otherwise(cold).cast("double"))
    rows = rows.withColumn("y", F.when(F.col("q") == hot, 90.0).otherwise(10.0))
    settings = {"rounds": 12, "rate": 0.5, "max_depth": 1}
    for keys in (["id"], None):
        out = MetaLearner(["q"], **settings).fit(rows, "y", keys).predict(rows)
        assert {(r.y, r.predictions) for r in out.collect()} == {(90.0, 90.0), (10.0, 10.0)}
    meta = MetaLearner(["q"], **settings)
    meta.tune(rows, "y", {"maxDepth": [1, 2]}, folds=2, keys=["id"])
    assert {(r.y, r.predictions) for r in meta.predict(rows).collect()} == {(90.0, 90.0), (10.0, 10.0)}
    one = rows.filter(F.col("q") == hot)  # all on one side of a hash of the quantiles
    for table in (one, one.select("q", "y")):
        out = MetaLearner(["q"], **settings).fit(table, "y").predict(table)
        assert {r.predictions for r in out.collect()} == {90.0}


@pytest.mark.parametrize("meta", [False, True])
def test_calibrated_forecaster(table, spark, tmp_path, meta):
    train, test = table.filter("t < '2023-01-01'"), table.filter("t >= '2023-01-01'")
    settings = QuantileForecaster(
        LAYOUT, QuantileForest(trees=6, max_depth=4), meta=meta, meta_options={"rounds": 3}
    )
    model = settings.fit(train)
    out = model.predict(test)
    pdf = out.toPandas()
    assert ((pdf.y >= pdf.pi_lower) & (pdf.y <= pdf.pi_upper)).mean() > 0.82
    assert (pdf.predictions >= 5).all() and (pdf.predictions == pdf.predictions.round()).all()
    model.write(str(tmp_path / "q"), spark)
    again = QuantileForecasterModel.read(spark, str(tmp_path / "q")).predict(test)
    assert out.exceptAll(again).count() == 0


def test_matrix_forecaster(table, spark, tmp_path):
    settings = matrix_forecaster(table, LAYOUT, rank=2, sweeps=5, trees=5, max_depth=4)
    assert settings.time_features == ["rain"] and list(settings.site_numbers) == ["Latitude"]
    known = table.filter("site <> 's7'")
    model = settings.fit(known)
    out = model.predict(table)
    assert out.count() == table.count()
    # a site never seen in training is forecast from its attributes
    assert out.filter("site = 's7' AND predictions IS NOT NULL").count() > 0
    assert out.filter("predictions < 0").count() == 0
    model.write(str(tmp_path / "m"), spark)
    again = MatrixForecasterModel.read(spark, str(tmp_path / "m")).predict(table)
    diff = out.withColumnRenamed("predictions", "a").join(again.select("site", "t", "predictions"), ["site", "t"])
    assert diff.filter("abs(a - predictions) > 1e-9").count() == 0


def test_evaluation_and_batch_scoring(table, spark, tmp_path):
    periods = parse_periods(["2022-01-01_2022-07-01", "2022-07-01_2023-01-01"])
    makers = {
        "tree": lambda _: BaselineForecaster(Baseline("tree"), LAYOUT),
        "linear": lambda _: BaselineForecaster(Baseline("linear"), LAYOUT),
    }
    scores, forecasts = evaluate_models(makers, table, periods, LAYOUT, untested=["s3"])
    rows = {(r["model"], r["dataset"], r["fold"]): r for r in scores.collect()}
    assert len(rows) == 2 * 2 * 3
    counts = ("TP", "FP", "TN", "FN")
    for model in makers:
        parts = [rows[model, "test", f] for f in ("fold_1", "fold_2")]
        for c in counts:
            assert rows[model, "test", "overall"][c] == sum(p[c] for p in parts)
    assert forecasts.filter("dataset = 'test' AND site = 's3'").count() == 0
    assert forecasts.filter("dataset = 'train' AND site = 's3'").count() > 0

    path = str(tmp_path / "models")
    makers = {"tree": makers["tree"], "poisson": lambda _: PoissonForecaster(LAYOUT, PoissonBoost(rounds=2))}
    train_models(makers, table, path)
    loaders = {
        "tree": lambda: BaselineModel.read(spark, f"{path}/tree"),
        "absent": lambda: BaselineModel.read(spark, f"{path}/absent"),
        "poisson": lambda: PoissonBoostModel.read(spark, f"{path}/poisson"),
    }
    out, scored, absent = predict_models(loaders, table, LAYOUT)
    assert absent == ["absent"]
    assert set(out.columns) == {*table.columns, "tree_predictions", "poisson_predictions"}
    assert set(scored) == {"tree", "poisson"} and out.count() == table.count()


def test_one_rule_for_any_number_of_labels(spark):
    from threshcast.operators.learning import FeatureFrame

    rules = set()
    for n in (63, 64, 1000):
        df = spark.range(n).selectExpr("id * 1.0 AS x", "concat('l', id) AS label")
        frame = FeatureFrame.fit(df, ["x"], ["label"])
        out = frame.transform(df)
        kinds = out.schema["features"].metadata["ml_attr"]["attrs"]
        rules.add((frame.max_bins, tuple(sorted(kinds))))
        assert {float(r.features[1]) for r in out.collect()} == set(map(float, range(n)))
    assert rules == {(64, ("numeric",))}


def test_bad_csv_cells_are_errors(spark, tmp_path):
    from threshcast.sources.tables import read_csv, read_csv_with_markers

    (tmp_path / "a.csv").write_text("name,x\na,1.5\nb,oops\n")
    path = str(tmp_path / "a.csv")
    with pytest.raises(Exception, match="oops|MALFORMED"):
        read_csv(spark, path, ["name"]).collect()
    assert [r.x for r in read_csv(spark, path, ["name"], lenient=True).collect()] == [1.5, None]
    with pytest.raises(Exception, match="not a number in column x"):
        read_csv_with_markers(spark, path, ["x"]).collect()
    found = read_csv_with_markers(spark, path, ["x"], markers=["oops"]).collect()
    assert [r.x for r in found] == [1.5, None]
    assert read_csv_with_markers(spark, path, ["x"], lenient=True).collect()[1].x is None
