"""Boosted members: leaf values, leaf limits, quantile levels, staged search, files, estimators."""

import datetime

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from threshcast.operators import histograms, members
from threshcast.operators.boosting import PoissonBoost, PoissonBoostModel, training_rows
from threshcast.operators.estimators import (
    BaselineEstimator,
    MatrixEstimator,
    MetaEstimator,
    PinballEstimator,
    PoissonEstimator,
    QuantileForestEstimator,
)
from threshcast.operators.intervals import count_covering, covered
from threshcast.operators.learning import FeatureFrame, saved, saving
from threshcast.operators.members import Boosting, Growth, Loss, Member
from threshcast.operators.matrix_model import FactorForest
from threshcast.operators.quantiles import MetaLearner, PinballBoost, pinball_loss, sort_quantiles
from threshcast.operators.trees import Lookup, Tree, cut_back, fall, leaf_value
from threshcast.plans.forecasting import Layout, QuantileForecaster, QuantileForecasterModel


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    draw = np.random.default_rng(3)
    start = datetime.datetime(2021, 1, 1)
    rows = []
    for i in range(1200):
        a, b = float(draw.uniform(0, 10)), float(draw.integers(0, 5))
        rows.append((i, f"s{i % 6}", start + datetime.timedelta(hours=7 * i), a, b, 10 + 4 * a + b * float(draw.gamma(2, 4))))
    df = spark.createDataFrame(rows, "id long, site string, t timestamp_ntz, a double, b double, y double")
    path = str(tmp_path_factory.mktemp("members") / "table")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def frame(table):
    return FeatureFrame.fit(table, ["a", "b"])


def small_tree():
    tree = Tree()
    tree.add(0, 5.0)
    tree.left[0] = tree.add(1, 2.0)
    tree.left[1], tree.right[1] = tree.add(value=0.0), tree.add(value=1.0)
    tree.right[0] = tree.add(value=2.0)
    return tree


def test_lookup_and_cutting_back():
    tree, sums = small_tree(), {0: (10.0, 4.0), 1: (-2.0, 3.0), 2: (-9.0, 5.0)}
    x = np.array([[1.0, 1.0], [5.0, 3.0], [6.0, 0.0]])
    assert Lookup([tree, tree])(x).tolist() == [[0, 0], [1, 1], [2, 2]]
    whole = cut_back(tree, sums, 9, 0.0, 0.0)
    assert Lookup([whole])(x).ravel() == pytest.approx([2.5, -2 / 3, -1.8])
    two = cut_back(tree, sums, 2, 1.0, 2.0)
    assert Lookup([two])(x).ravel() == pytest.approx([7 / 9, 7 / 9, -8 / 7])
    assert two.gain[0] == pytest.approx(fall(8, 7, 1, 2) + fall(-9, 5, 1, 2) - fall(-1, 12, 1, 2))
    assert len(cut_back(tree, sums, 1, 0.0, 0.0).feature) == 1
    assert leaf_value(3.0, 0.0, 0.0, 0.0) == 0.0 and leaf_value(-3.0, 1.0, 5.0, 0.0) == 0.0
    # a split that gains nothing is not taken
    assert len(cut_back(tree, {0: (1.0, 1.0), 1: (1.0, 1.0), 2: (2.0, 2.0)}, 9, 0.0, 0.0).feature) == 1


def test_penalties_shrink_and_leaves_are_limited(table, frame):
    plain = PoissonBoost(rounds=3, rate=0.5, row_share=1.0, feature_share=1.0)
    base = plain.fit(table, frame, "y", ["id"]).boosted.trees
    shrunk = PoissonBoost(rounds=3, rate=0.5, row_share=1.0, feature_share=1.0, l1=200.0, l2=5000.0, leaves=4)
    held = shrunk.fit(table, frame, "y", ["id"]).boosted.trees
    assert all(len(side[0].leaves) <= 4 for side in held) and len(base[0][0].leaves) > 4
    assert max(map(abs, held[0][0].value)) < max(map(abs, base[0][0].value))


def test_levels_beat_constants_and_reload(table, frame, spark, tmp_path):
    train, test = table.filter("id % 4 <> 0"), table.filter("id % 4 = 0")
    levels = [0.9, 0.1, 0.5]
    model = PinballBoost(levels, rounds=8, rate=0.4, max_depth=3).fit(train, frame, "y")
    assert model.levels == [0.1, 0.5, 0.9]
    names = ["q_0.1", "q_0.5", "q_0.9"]
    out = sort_quantiles(model.predict(test), names)
    found = out.agg(*pinball_loss("y", names, model.levels)).first()
    constants = train.agg(*[F.percentile_approx("y", q).cast("double").alias(c) for q, c in zip(model.levels, names)])
    plain = test.join(F.broadcast(constants)).agg(*pinball_loss("y", names, model.levels)).first()
    assert all(found[c] < 0.85 * plain[c] for c in names)
    model.write(str(tmp_path / "m"), spark)
    again = type(model).read(spark, str(tmp_path / "m")).predict(test)
    assert model.predict(test).exceptAll(again).count() == 0


def test_pooled_folds_never_see_their_rows(table, frame):
    """A row's own value does not move its forecast: only the fold that holds it may."""
    boost = PinballBoost([0.2, 0.8], rounds=2, rate=0.5, max_depth=2)
    out = boost.out_of_fold(table, frame, "y", ["id"])
    assert out.columns == ["id", "y", "q_0.2", "q_0.8"] and out.count() == 1200
    far = table.withColumn("y", F.when(F.col("id") == 17, 1e6).otherwise(F.col("y")))
    moved = boost.out_of_fold(far, frame, "y", ["id"])
    a, b = out.filter("id = 17").first(), moved.filter("id = 17").first()
    assert a["q_0.2"] == b["q_0.2"] and a["q_0.8"] == b["q_0.8"] and b["y"] == 1e6


def test_staged_search_finds_what_separate_fits_find(table, spark):
    rows = table.select("id", F.col("a").alias("q_0.5"), "y")
    grid = {"n_estimators": [1, 4], "learning_rate": [0.2, 0.7], "num_leaves": [2, 5],
            "min_data_in_leaf": [5], "colsample_bytree": [1.0], "reg_lambda": [0.5]}
    fold = F.col("id") % 2
    best = MetaLearner(["q_0.5"], max_depth=3).tune(rows, "y", grid, folds=2, fold=fold)
    errors = {}
    for n in (1, 4):
        for rate in (0.2, 0.7):
            for leaves in (2, 5):
                each = []
                for f in (0, 1):
                    meta = MetaLearner(["q_0.5"], n, rate, 3, 5, 1.0, leaves=leaves, l2=0.5)
                    model = meta.fit(rows.filter(fold != f), "y").model
                    scored = meta._assemble(rows.filter(fold == f)).withColumn("p", model.score("__meta")[0])
                    each.append(scored.agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0])
                errors[n, rate, leaves] = float(np.mean(each))
    assert (best["n_estimators"], best["learning_rate"], best["num_leaves"]) == min(errors, key=errors.get)
    assert best["mae"] == pytest.approx(min(errors.values()), rel=1e-9)
    with pytest.raises(ValueError):
        MetaLearner(["q_0.5"]).tune(rows, "y", {"depth": [1]})


def test_vector_leaves_are_means(table, frame):
    rows = table.filter("id < 300").withColumn("parts", F.array("a", F.col("b") * 3))
    forest = FactorForest.fit(rows, frame, "parts", 2, 12, 6, 1)
    out = forest.predict(rows, "p").selectExpr("corr(a, p[0]) x", "corr(b, p[1]) y").first()
    assert forest.lookup.shape[0] == 12 and forest.lookup.shape[2] == 2 and out.x > 0.8 and out.y > 0.8


def test_a_stopped_writer_leaves_the_old_model(table, frame, spark, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        PoissonBoostModel.read(spark, path)
    first, second = (PoissonBoost(rounds=n, rate=0.5).fit(table, frame, "y", ["id"]) for n in (1, 2))
    first.write(path, spark)
    with pytest.raises(RuntimeError):
        with saving(spark, path) as part:
            second.nodes(spark).write.parquet(f"{part}/nodes")
            raise RuntimeError("stopped between parts")
    assert len(PoissonBoostModel.read(spark, path).boosted.trees) == 1
    before = saved(spark, path)
    second.write(path, spark)
    assert len(PoissonBoostModel.read(spark, path).boosted.trees) == 2 and saved(spark, path) != before
    kept = [p.name for p in (tmp_path / "model").iterdir() if p.name.startswith("version-")]
    assert len(kept) == 1  # what the stopped writer and the first model left is gone


def test_boosted_levels_in_the_forecaster(table, spark, tmp_path):
    layout = Layout("site", "t", "y", "season")
    boost = PinballBoost([0.1, 0.5, 0.9], rounds=3, rate=0.6, max_depth=3)
    model = QuantileForecaster(layout, boost, meta=True, meta_options={"rounds": 2}).fit(table)
    out = model.predict(table)
    assert out.filter("pi_lower > pi_upper or predictions < 5").count() == 0
    model.write(str(tmp_path / "q"), spark)
    again = QuantileForecasterModel.read(spark, str(tmp_path / "q")).predict(table)
    assert out.exceptAll(again).count() == 0


def test_estimators_in_a_pipeline(table, spark, tmp_path):
    common = {"numericCols": ["a", "b"], "labelCols": ["site"], "keyCols": ["id"], "targetCol": "y"}
    quantiles = PinballEstimator(levels=[0.2, 0.5, 0.8], rounds=2, rate=0.5, max_depth=2, **common)
    meta = MetaEstimator(columns=["q_0.2", "q_0.5", "q_0.8"], rounds=2, rate=0.5, keyCols=["id"], targetCol="y")
    pipeline = Pipeline(stages=[quantiles, meta])
    pipeline.write().overwrite().save(str(tmp_path / "p"))
    model = Pipeline.load(str(tmp_path / "p")).fit(table)
    model.write().overwrite().save(str(tmp_path / "m"))
    out = model.transform(table)
    assert {"q_0.2", "predictions"} <= set(out.columns)
    assert out.exceptAll(PipelineModel.load(str(tmp_path / "m")).transform(table)).count() == 0
    for estimator in (
        PoissonEstimator(rounds=1, **common),
        QuantileForestEstimator(trees=2, max_depth=2, **common),
        BaselineEstimator(kind="linear", numericCols=["a"], targetCol="y"),
        MatrixEstimator(time="t", site="site", target="y", time_features=["a"], site_numbers=["b"], rank=1, sweeps=2, trees=2),
    ):
        fitted = estimator.fit(table)
        fitted.write().overwrite().save(str(tmp_path / "one"))
        again = type(fitted).load(str(tmp_path / "one"))
        assert again.uid == fitted.uid and again.transform(table).columns == fitted.transform(table).columns


def test_estimator_in_a_cross_validator(table):
    tree = BaselineEstimator(kind="tree", numericCols=["a", "b"], targetCol="y", min_leaf=5)
    grid = ParamGridBuilder().addGrid(tree.getParam("max_depth"), [1, 4]).build()
    judge = RegressionEvaluator(labelCol="y", predictionCol="predictions", metricName="mae")
    found = CrossValidator(estimator=tree, estimatorParamMaps=grid, evaluator=judge, numFolds=2, seed=1).fit(table)
    assert found.avgMetrics[1] < found.avgMetrics[0]


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_intervals_by_pairs(spark, range_rows):
    draw = np.random.default_rng(5)
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=int(m))
    spans = [(["a", "b", None][i % 3], at(s), at(s + d)) for i, (s, d) in enumerate(zip(draw.integers(0, 500, 60), draw.integers(-20, 300, 60)))]
    spans += [("a", None, at(3)), ("a", at(3), None), ("b", at(7), at(7)), ("b", at(7), at(7))]
    rows = [(i, ["a", "b", None, "c"][i % 4], at(m)) for i, m in enumerate(draw.integers(-5, 800, 200))] + [(900, "b", at(7))] * 3 + [(901, "a", None)]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp_ntz")
    table = spark.createDataFrame(spans, "k string, s timestamp_ntz, e timestamp_ntz")
    for keys in ([], ["k"]):
        want = [
            (i, k, t, sum(s is not None and e is not None and t is not None and s <= t <= e and (not keys or k == o) for o, s, e in spans))
            for i, k, t in rows
        ]
        got = count_covering(df, table, "t", "s", "e", keys, range_rows=range_rows)
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    flags = covered(df, table.limit(0), "t", "s", "e")
    assert {r.HOLIDAY_FLAG for r in flags.collect()} == {0} and flags.count() == len(rows)
    with pytest.raises(ValueError):
        count_covering(df, table, "t", "s", "e", name="id")


def test_frames_of_all_folds_from_one_scan(table):
    rows = table.withColumn("a", F.when(F.col("id") % 9 != 0, F.col("a"))).withColumn("t", F.when(F.col("id") % 50 != 1, F.col("t")))
    starts = [datetime.datetime(2021, 9, 1), datetime.datetime(2021, 3, 1), datetime.datetime(2020, 1, 1)]
    for start, got in zip(starts, FeatureFrame.fit_before(rows, "t", starts, ["a", "b"], ["site"])):
        past = rows.filter(F.col("t") < F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"))
        want = FeatureFrame.fit(past, ["a", "b"], ["site"])
        assert got.means == pytest.approx(want.means) and got.sizes == want.sizes
        assert sorted(map(tuple, got.codes.select("column", "label", "code").collect())) == sorted(map(tuple, want.codes.select("column", "label", "code").collect()))


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def some_members():
    held = [None, *(F.col("__key") % 3 == k for k in (0, 1))]
    squared = [Member(Loss(), Growth(0.3, 4, leaves, 5, 0.0, 0.65, feature_share=0.5), h) for leaves in (3, 40) for h in held]
    return squared, [Member(Loss("pinball", q), Growth(0.3, 4, 31, 10, 0.0, 0.45), h) for q in (0.1, 0.9) for h in held]


def test_common_passes_grow_the_trees_of_single_fits(table, frame, spark, monkeypatch):
    data = training_rows(table.filter("id % 7 <> 0 and a > 1").coalesce(1), frame, "y", ["id"])
    for limit in ("EXACT", "SUMS_BYTES", "COLLECT_BYTES"):
        if limit != "EXACT":  # passes of one node, and sums added by tasks
            monkeypatch.setattr(histograms, limit, 1)
        squared, pinball = some_members()
        both, boost = squared[:2] + pinball[:2], Boosting()
        conditions, at = boost._conditions([m.learns() for m in both])
        cuts = histograms.cuts_of(data, "x", conditions, 2, 64)
        now = data.withColumn("__b", cuts.binned("x")).withColumn("F", F.array(*[F.lit(30.0)] * len(both))).cache()
        for number in (0, 1):
            found = boost._grown(now, both, range(len(both)), at, number, 2, cuts, 1)
            for i, (m, (tree, sums)) in enumerate(zip(both, found)):
                want, rest = boost._grow(now, m, i, number, 2, 64)
                assert (tree.feature, tree.threshold, tree.left) == (want.feature, want.threshold, want.left)
                assert {k: pytest.approx(v) for k, v in rest.items()} == sums
        now.unpersist()


def test_a_member_alone_is_what_passes_make_of_it(table, frame, monkeypatch):
    data = training_rows(table, frame, "y", ["id"])
    squared, _ = some_members()
    stop = lambda out: len(out.errors) == 4
    runs = []
    for size in (members.ALONE_BYTES, 0):
        monkeypatch.setattr(members, "ALONE_BYTES", size)
        runs += [Boosting(3, watch=True).fit(data, squared, 2, 64), Boosting(9, watch=True, stop=stop).fit(data, squared[1:2], 2, 64)]
    for a, b in zip(runs[:2], runs[2:]):
        assert len(a.trees) == len(b.trees) == 3 and list(a.losses) == list(b.losses)
        assert np.array(a.errors) == pytest.approx(np.array(b.errors), nan_ok=True)
        for one, other in zip((t for s in a.trees for t in s), (t for s in b.trees for t in s)):
            assert one.feature == other.feature and one.value == pytest.approx(other.value)


def test_jobs_do_not_grow_with_the_members(table, frame, spark, monkeypatch):
    """A tree of its own took a fit of some eight jobs for each member and round."""
    data = training_rows(table, frame, "y", ["id"])
    squared, pinball = some_members()
    assert jobs_of(spark, "alone", lambda: Boosting(3, watch=True).fit(data, squared, 2, 64)) <= 12
    assert jobs_of(spark, "pinball", lambda: Boosting(2).fit(data, pinball, 2, 64)) <= 2 * (4 + 2) + 12


def test_cuts_of_many_values_share_the_rows(spark, monkeypatch):
    rows = spark.range(0, 40_000, 1, 4).selectExpr("array(cast(id as double), cast(id % 3 as double)) x", "id % 4 = 0 as held")
    monkeypatch.setattr(histograms, "EXACT", 500)
    monkeypatch.setattr(histograms, "SUMMARY", 400)
    cuts = histograms.cuts_of(rows, "x", [F.lit(True), F.col("held")], 2, 16)
    for own in cuts.own:
        assert own[1].tolist() == [0.5, 1.5]
        assert own[0] == pytest.approx([2500 * k for k in range(1, 16)], abs=250)
    few = histograms.thresholds(np.array([1.0, 2.0, 4.0]), np.array([5.0, 0.0, 1.0]), 64)
    assert few.tolist() == [2.5] and not len(histograms.thresholds(np.array([3.0]), np.array([9.0]), 64))


def test_sorted_residuals_give_the_quantiles_of_sketches(table, frame, monkeypatch):
    """Tables of many rows take another way to the same leaves; with few kept ranks they are near."""
    data = training_rows(table, frame, "y", ["id"])
    _, pinball = some_members()
    sketched = Boosting(2).fit(data, pinball, 2, 64)
    monkeypatch.setattr(members, "DEALT", 0)
    monkeypatch.setattr(members, "tree_sql", None)  # sketches need leaf numbers in SQL
    monkeypatch.setattr(histograms, "_HELD_AT_ONCE", 100)  # batches are not cut, so each is a piece
    exact = Boosting(2).fit(data, pinball, 2, 64)
    for a, b in zip((t for side in sketched.trees for t in side), (t for side in exact.trees for t in side)):
        assert a.feature == b.feature and a.value == pytest.approx(b.value)
    cuts, leaf = histograms.cuts_of(data, "x", [F.lit(True)], 2, 64), Tree()
    leaf.add()
    now = data.withColumn("__b", cuts.binned("x")).withColumn("F", F.array(F.lit(7.0)))
    [coarse] = histograms.leaf_quantiles(now, [leaf], [0.3], [-1], [], cuts, 40)
    rank = data.filter(F.col("y") - 7.0 <= coarse[0]).count()
    assert 360 <= rank <= 360 + 1200 / 40
