"""Queries that fit models.

Trees grown on many features have no SQL twin; the tests check their invariants. On one
two-valued feature a tree is known beforehand, so boosting, forests and the evaluation flow are
checked by SQL there. They run with the operators' own settings; where fits are long, the option
that ends them when nothing is gained any more (``tol``) is given.
"""

from pyspark.sql import functions as F

from threshcast.catalogue.base import events_as_observations, query, rounded
from threshcast.catalogue.evaluation import _core_sql
from threshcast.functions.columns import calendar_columns, cols, key_fraction
from threshcast.operators.baselines import Baseline
from threshcast.operators.boosting import PoissonBoost
from threshcast.operators.folds import parse_periods
from threshcast.operators.joins import equi_join
from threshcast.operators.learning import FeatureFrame
from threshcast.operators.matrix_model import FactorForest, MatrixForecaster
from threshcast.operators.quantiles import (
    MetaLearner,
    PinballBoost,
    QuantileForest,
    level_column,
    out_of_fold,
    pinball_loss,
    sort_quantiles,
)
from threshcast.operators.scoring import fold_scores, score
from threshcast.operators.series import recent_history
from threshcast.plans.forecasting import (
    BaselineForecaster,
    Layout,
    PoissonForecaster,
    QuantileForecaster,
    evaluate_models,
    fold_forecasts,
    predict_models,
    train_models,
)
from threshcast.session import fresh_path, observed
from threshcast.sources.tables import write_table

LAYOUT = Layout(site="site", time="t", target="y", season="season")
_PERIODS = parse_periods(["2024-01-15_2024-01-22", "2024-01-22_2024-01-30"])
_NESTED = parse_periods(["2025-01-10_2025-01-20", "2025-01-20_2025-01-31"])
_HIGH, _WARN = 100.0, 50.0
_TOL = 5e-3


def learning_table(spark, folder):
    """Events with calendar and past features."""
    obs = events_as_observations(spark, folder)
    out = recent_history(obs, "site", "season", "t", "y", _HIGH, 5, "recent_mean", "past_rate")
    out = out.withColumns(calendar_columns("t")).drop("event_id")
    # written once: fitting reads it many times, and a lost executor does not cost the windows
    path = fresh_path(spark, "learning")
    write_table(out, path)
    return spark.read.parquet(path)


def _frame(df):
    return FeatureFrame.fit(df, *LAYOUT.feature_columns(df))


def _split(df):
    """First three weeks to learn from, the rest to forecast."""
    late = F.col("t") >= F.lit("2024-01-22").cast("timestamp_ntz")
    return df.filter(~late), df.filter(late)


def _forest(**options):
    return QuantileForest(**options)


@query()
def poisson_boosting(spark, folder):
    df = learning_table(spark, folder)
    train, test = _split(df)
    model = PoissonBoost(tol=_TOL).fit(train, _frame(train), "y", ["site", "t"])
    return rounded(model.predict(test).select("site", "t", "y", "predictions"))


@query()
def feature_importance(spark, folder):
    df = learning_table(spark, folder)
    model = PoissonBoost(tol=_TOL).fit(df, _frame(df), "y", ["site", "t"])
    return rounded(
        spark.createDataFrame(list(model.importance().items()), "feature string, importance double")
    )


@query()
def quantile_forest(spark, folder):
    df = learning_table(spark, folder)
    train, test = _split(df)
    model = _forest().fit(train, _frame(train), "y")
    return rounded(model.predict(test).drop("season"))


@query()
def oof_quantiles(spark, folder):
    df = learning_table(spark, folder)
    return rounded(out_of_fold(df, _forest(), _frame(df), "y", ["site", "t"]))


@query()
def meta_learner(spark, folder):
    """Point forecast learnt from out-of-fold quantiles, applied to those of later rows."""
    df = learning_table(spark, folder)
    train, test = _split(df)
    frame, forest = _frame(train), _forest()
    oof = out_of_fold(train, forest, frame, "y", ["site", "t"])
    columns = [level_column(q) for q in forest.levels]
    meta = MetaLearner(columns, tol=1e-3).fit(oof, "y", ["site", "t"])
    scored = meta.predict(forest.fit(train, frame, "y").predict(test))
    return rounded(scored.select("site", "t", "y", "predictions"))


@query()
def meta_learner_grid(spark, folder):
    """Grid search of the meta-learner by mean absolute error."""
    df = learning_table(spark, folder)
    forest = _forest()
    oof, _ = observed(out_of_fold(df, forest, _frame(df), "y", ["site", "t"]), "oof")
    meta = MetaLearner([level_column(q) for q in forest.levels])
    grid = {"n_estimators": [10, 20, 40], "learning_rate": [0.05, 0.2], "num_leaves": [4, 12]}
    best = meta.tune(oof, "y", grid, keys=["site", "t"])
    rows = [(k, float(v)) for k, v in best.items()]
    return rounded(spark.createDataFrame(rows, "name string, value double"))


@query()
def calibrated_forecast(spark, folder):
    """Quantiles, point forecast and calibrated interval in one model."""
    train, test = _split(learning_table(spark, folder))
    model = QuantileForecaster(LAYOUT, _forest()).fit(train)
    return rounded(model.predict(test).drop("season"))


def _matrix_settings(**options):
    return MatrixForecaster(
        "t",
        "site",
        "y",
        ["DAY_OF_WEEK", "WEEKEND", "TIME_OF_DAY"],
        ["lat", "size"],
        ["zone"],
        **options,
    )


def _matrix_table(spark, folder):
    df = learning_table(spark, folder)
    s = F.col("site")
    attributes = {
        "lat": (s % 17) / 10.0,
        "size": (s % 7).cast("double"),
        "zone": F.concat(F.lit("z"), (s % 3).cast("string")),
    }
    return df.withColumns(attributes)


@query()
def temporal_factor_forest(spark, folder):
    """Forecast time factors of unseen days."""
    train, test = _split(_matrix_table(spark, folder))
    model = _matrix_settings(rank=2).fit(train)
    days = model.settings.times_of(test).withColumn("day", F.to_date("t"))
    out = model.temporal.predict(days, "w").groupBy("day")
    out = out.agg(*[F.avg(F.col("w")[j]).alias(f"w{j}") for j in range(2)])
    return rounded(out.withColumn("day", F.col("day").cast("string")))


@query()
def spatial_factor_forest(spark, folder):
    """Forecast factors of sites, about one in five of which is new."""
    df = _matrix_table(spark, folder)
    model = _matrix_settings(rank=2).fit(df.filter(key_fraction(["site"], 7) >= 0.2))
    out = model.spatial.predict(model.settings.sites_of(df), "h")
    return rounded(out.select("site", *[F.col("h")[j].alias(f"h{j}") for j in range(2)]))


@query()
def matrix_forecast(spark, folder):
    """Forecast as the product of both factors, for the requested rows."""
    train, test = _split(_matrix_table(spark, folder))
    model = _matrix_settings(rank=3).fit(train)
    return rounded(model.predict(test).select("site", "t", "y", "predictions"))


@query()
def linear_baseline(spark, folder):
    train, test = _split(learning_table(spark, folder))
    model = Baseline("linear").fit(train, _frame(train), "y")
    return rounded(model.predict(test).select("site", "t", "y", "predictions"))


@query()
def tree_baseline(spark, folder):
    train, test = _split(learning_table(spark, folder))
    model = Baseline("tree").fit(train, _frame(train), "y")
    return rounded(model.predict(test).select("site", "t", "y", "predictions"))


@query()
def tscv_evaluate(spark, folder):
    """Two models over out-of-time folds: scores per model, data set and fold, and pooled."""
    df = learning_table(spark, folder)
    makers = {
        "tree": lambda _: BaselineForecaster(Baseline("tree"), LAYOUT),
        "linear": lambda _: BaselineForecaster(Baseline("linear"), LAYOUT),
    }
    scores, _ = evaluate_models(
        makers, df, _PERIODS, LAYOUT, _HIGH, _WARN, untested=[3, 4, 5]
    )
    return rounded(scores)


@query()
def nested_tscv_evaluate(spark, folder):
    """Nested folds: fitted on the training and validation parts, scored on the test part."""
    df = learning_table(spark, folder)
    # the second half of the rows is moved a year on, so that a preceding year exists
    later = F.make_interval(years=F.when(F.col("site") % 2 == 0, 1).otherwise(0))
    df = df.withColumn("t", F.col("t") + later)
    maker = lambda _: BaselineForecaster(Baseline("tree"), LAYOUT)
    forecasts = fold_forecasts(maker, df, _NESTED, LAYOUT, nested=True)
    return rounded(fold_scores(forecasts, "y", "predictions", "fold", (), _HIGH, _WARN))


@query()
def batch_scoring(spark, folder):
    """Saved models loaded again and applied side by side; one of them cannot be loaded."""
    from threshcast.operators.baselines import BaselineModel
    from threshcast.operators.boosting import PoissonBoostModel

    train, test = _split(learning_table(spark, folder))
    path = fresh_path(spark, "models")
    makers = {
        "tree": lambda _: BaselineForecaster(Baseline("tree"), LAYOUT),
        "poisson": lambda _: PoissonForecaster(LAYOUT, PoissonBoost(tol=_TOL)),
    }
    train_models(makers, train, path)
    loaders = {
        "tree": lambda: BaselineModel.read(spark, f"{path}/tree"),
        "poisson": lambda: PoissonBoostModel.read(spark, f"{path}/poisson"),
        "absent": lambda: BaselineModel.read(spark, f"{path}/absent"),
    }
    out, _, absent = predict_models(loaders, test, LAYOUT, _HIGH, _WARN)
    out = out.select("site", "t", "y", "tree_predictions", "poisson_predictions")
    return rounded(out.withColumn("left_out", F.lit(",".join(absent))))


@query()
def model_scores(spark, folder):
    """Fit, forecast, and score one model on one set."""
    train, test = _split(learning_table(spark, folder))
    forecast = Baseline("tree").fit(train, _frame(train), "y").predict(test)
    return rounded(score(forecast, "y", "predictions", (), "core", _HIGH, _WARN))


# -- models with a closed form -------------------------------------------------------------

_WEEK = """e AS (SELECT event_id, user_id AS site, ts AS t, event_type AS season, value AS y,
    CAST(isodow(ts) >= 6 AS DOUBLE) AS weekend FROM events)"""


def _two_valued(spark, folder):
    weekend = calendar_columns("t")["WEEKEND"].cast("double")
    return events_as_observations(spark, folder).withColumn("weekend", weekend)


_ROUND = """, f{n} AS (SELECT weekend, f + 0.3 * (m / exp(f) - 1) AS f, m FROM f{o})"""


def _three_rounds(df):
    boost = PoissonBoost(3, 0.3, 2, row_share=1.0, feature_share=1.0)
    return boost.fit(df, FeatureFrame.fit(df, ["weekend"]), "y", ["event_id"])


def _reloaded(spark, model):
    """The model as it comes back from its files."""
    path = fresh_path(spark, "model")
    model.write(path, spark)
    return type(model).read(spark, path)


@query(
    "WITH "
    + _WEEK
    + """ SELECT 'weekend' AS feature, CASE WHEN count(DISTINCT weekend) > 1 THEN 3.0::DOUBLE ELSE 0 END AS importance FROM e"""
)
def importance_two_groups(spark, folder):
    """Each round splits on the one feature there is, so it has all of the round's gain."""
    found = _three_rounds(_two_valued(spark, folder)).importance()
    return rounded(spark.createDataFrame(list(found.items()), "feature string, importance double"))


@query(
    "WITH "
    + _WEEK
    + """, f0 AS (SELECT weekend, ln((SELECT avg(y) FROM e)) AS f, avg(y) AS m FROM e GROUP BY weekend)"""
    + "".join(_ROUND.format(n=i, o=i - 1) for i in (1, 2, 3))
    + """ SELECT event_id, round(exp(f), 5) AS mean, round_even(CASE WHEN exp(f) < 5 THEN 5 ELSE exp(f) END, 0)
  AS predictions FROM e JOIN f3 USING (weekend)"""
)
def poisson_boosting_two_groups(spark, folder):
    """Three rounds on weekend or not: each leaf takes the Newton step of its group."""
    df = _two_valued(spark, folder)
    model = _reloaded(spark, _three_rounds(df))
    out = model.predict(model.predict_mean(df, "mean"))
    return rounded(out.select("event_id", "mean", "predictions"), 5)


_PENALISED = """, f{n} AS (SELECT weekend, n, s, f + 0.3 * sign(s - n * exp(f))
    * greatest(abs(s - n * exp(f)) - 40.0, 0) / (n * exp(f) + 900.0) AS f FROM f{o})"""


@query(
    "WITH "
    + _WEEK
    + """, f0 AS (SELECT weekend, count(*) AS n, sum(y) AS s, ln((SELECT avg(y) FROM e)) AS f FROM e GROUP BY weekend)"""
    + "".join(_PENALISED.format(n=i, o=i - 1) for i in (1, 2, 3))
    + """ SELECT event_id, round(exp(f), 5) AS mean FROM e JOIN f3 USING (weekend)"""
)
def poisson_boosting_penalised(spark, folder):
    """Leaves with both penalties: the sum of gradients moved towards 0, the weight raised."""
    df = _two_valued(spark, folder)
    boost = PoissonBoost(3, 0.3, 2, row_share=1.0, feature_share=1.0, l1=40.0, l2=900.0)
    model = boost.fit(df, FeatureFrame.fit(df, ["weekend"]), "y", ["event_id"])
    return rounded(_reloaded(spark, model).predict_mean(df, "mean").select("event_id", "mean"), 5)


@query(
    "WITH "
    + _WEEK
    + """, d AS (SELECT event_id, y, CASE WHEN isodow(t) >= 6 THEN 2 WHEN isodow(t) = 5 THEN 1 ELSE 0 END AS x FROM e),
m AS (SELECT avg(y) AS m FROM e),
s AS (SELECT cut, x >= cut AS high, sum(y - m) AS g, count(*) * any_value(m) AS h
  FROM d, m, (VALUES (1), (2)) AS c(cut) GROUP BY ALL),
b AS (SELECT cut FROM s GROUP BY cut ORDER BY sum(g * g / (h + 50.0)) DESC LIMIT 1),
v AS (SELECT high, cut, 0.5 * g / (h + 50.0) AS v FROM s JOIN b USING (cut))
SELECT event_id, round(exp(ln(m) + v), 5) AS mean FROM d, m JOIN v ON (d.x >= v.cut) = v.high"""
)
def poisson_boosting_two_leaves(spark, folder):
    """Three groups and room for two leaves: the split that gains most stays."""
    day = F.dayofweek("t")  # Sunday 1 to Saturday 7
    kind = F.when(day.isin(1, 7), 2.0).when(day == 6, 1.0).otherwise(0.0)
    df = events_as_observations(spark, folder).withColumn("x", kind)
    boost = PoissonBoost(1, 0.5, 3, row_share=1.0, feature_share=1.0, leaves=2, l2=50.0)
    model = boost.fit(df, FeatureFrame.fit(df, ["x"]), "y", ["event_id"])
    return rounded(model.predict_mean(df, "mean").select("event_id", "mean"), 5)


@query(
    "WITH "
    + _WEEK
    + """, f0 AS (SELECT weekend, count(*) AS n, sum(y) AS s, ln((SELECT avg(y) FROM e)) AS f FROM e GROUP BY weekend),
f1 AS (SELECT weekend, n, s, f + 0.3 * (s / n / exp(f) - 1) AS f FROM f0),
f2 AS (SELECT weekend, n, s, f + 0.3 * (s / n / exp(f) - 1) AS f FROM f1),
r AS (SELECT 1 AS k, * FROM f0 UNION ALL SELECT 2, * FROM f1 UNION ALL SELECT 3, * FROM f2),
g AS (SELECT k, sum(pow(s - n * exp(f), 2) / (n * exp(f))) - pow(sum(s - n * exp(f)), 2) / sum(n * exp(f)) AS gain,
  count(*) AS groups FROM r GROUP BY k)
SELECT 'weekend' AS feature, count(*) FILTER (groups = 2) AS splits, round(sum(gain), 4) AS gain FROM g"""
)
def gain_importance_two_groups(spark, folder):
    """What each round's split takes off the loss, in the loss's own units."""
    return rounded(_three_rounds(_two_valued(spark, folder)).gains(spark), 4)


@query(
    "WITH "
    + _WEEK
    + """, r AS (SELECT weekend, y, row_number() OVER (PARTITION BY weekend ORDER BY y) AS k,
  count(*) OVER (PARTITION BY weekend) AS n FROM e),
q AS (SELECT weekend, max(y) FILTER (k = ceil(0.25 * n)) AS a, max(y) FILTER (k = ceil(0.5 * n)) AS b,
  max(y) FILTER (k = ceil(0.875 * n)) AS c FROM r GROUP BY weekend)
SELECT event_id, round(a, 6) AS "q_0.25", round(b, 6) AS "q_0.5", round(c, 6) AS "q_0.875" FROM e JOIN q USING (weekend)"""
)
def quantile_forest_two_groups(spark, folder):
    """Leaves are weekend or not, so forecasts are the quantiles of both groups."""
    df = _two_valued(spark, folder)
    forest = QuantileForest([0.25, 0.5, 0.875], trees=3, max_depth=2, accuracy=200_000)
    model = _reloaded(spark, forest.fit(df, FeatureFrame.fit(df, ["weekend"]), "y"))
    return rounded(model.predict(df).select("event_id", *cols(["q_0.25", "q_0.5", "q_0.875"])))


@query(
    "WITH "
    + _WEEK
    + """, x(f) AS (VALUES (0), (1)),
r AS (SELECT f, weekend, y, row_number() OVER (PARTITION BY f, weekend ORDER BY y) AS k,
  count(*) OVER (PARTITION BY f, weekend) AS n FROM e JOIN x ON event_id % 2 <> f),
q AS (SELECT f, weekend, max(y) FILTER (k = ceil(0.25 * n)) AS a, max(y) FILTER (k = ceil(0.875 * n)) AS b
  FROM r GROUP BY f, weekend)
SELECT event_id, round(y, 6) AS y, round(a, 6) AS "q_0.25", round(b, 6) AS "q_0.875"
FROM e JOIN q ON q.weekend = e.weekend AND q.f = event_id % 2"""
)
def oof_quantiles_two_groups(spark, folder):
    """Out-of-fold quantiles are those of the group in the other fold; levels in any order."""
    df = _two_valued(spark, folder)
    forest = QuantileForest([0.875, 0.25], trees=3, max_depth=2, accuracy=200_000)
    frame = FeatureFrame.fit(df, ["weekend"])
    return rounded(out_of_fold(df, forest, frame, "y", ["event_id"], fold=F.col("event_id") % 2))


@query()
def pinball_boosting(spark, folder):
    """A boosted model for each quantile level, forecasts of a row in ascending order."""
    train, test = _split(learning_table(spark, folder))
    model = PinballBoost(rounds=20, rate=0.2).fit(train, _frame(train), "y")
    columns = [level_column(q) for q in model.levels]
    return rounded(sort_quantiles(model.predict(test), columns).drop("season"))


@query()
def pinball_losses(spark, folder):
    """Mean pinball loss of each level on later rows: boosting, the forest, and constants."""
    train, test = _split(learning_table(spark, folder))
    frame, levels = _frame(train), [0.05, 0.5, 0.9, 0.95]
    columns = [level_column(q) for q in levels]
    constants = train.agg(*[F.percentile_approx("y", q).cast("double").alias(c) for q, c in zip(levels, columns)])
    forecasts = {
        "boosted": PinballBoost(levels, rounds=20, rate=0.2).fit(train, frame, "y").predict(test),
        "forest": QuantileForest(levels).fit(train, frame, "y").predict(test),
        "constant": test.join(F.broadcast(constants)),
    }
    parts = [
        f.agg(*pinball_loss("y", columns, levels)).withColumn("model", F.lit(name))
        for name, f in forecasts.items()
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_START = """, x(q) AS (VALUES (0.25), (0.75)),
z AS (SELECT q, {cols} y, row_number() OVER (PARTITION BY q{part} ORDER BY y) AS k, count(*) OVER (PARTITION BY q{part}) AS n
  FROM {rows}),
b AS (SELECT q{part}, max(y) FILTER (k = ceil(q * n)) AS f0 FROM z GROUP BY q{part}),
w AS (SELECT q{part}, weekend, y, row_number() OVER (PARTITION BY q{part}, weekend ORDER BY y) AS k,
  count(*) OVER (PARTITION BY q{part}, weekend) AS n FROM {rows}),
g AS (SELECT q{part}, weekend, max(y) FILTER (k = ceil(q * n)) AS top FROM w GROUP BY q{part}, weekend),
m AS (SELECT q{part}, weekend, top + (f0 - top) * 0.4 * 0.4 AS f FROM g JOIN b USING (q{part}))"""


@query(
    "WITH "
    + _WEEK
    + _START.format(cols="weekend,", part="", rows="e, x")
    + """ SELECT event_id, round(max(f) FILTER (q = 0.25), 6) AS "q_0.25", round(max(f) FILTER (q = 0.75), 6) AS "q_0.75"
FROM e JOIN m USING (weekend) GROUP BY event_id"""
)
def pinball_boosting_two_groups(spark, folder):
    """Two rounds on weekend or not: each leaf goes 60 % of the way to its group's quantile."""
    df = _two_valued(spark, folder)
    boost = PinballBoost([0.75, 0.25], rounds=2, rate=0.6, max_depth=2, accuracy=200_000)
    model = _reloaded(spark, boost.fit(df, FeatureFrame.fit(df, ["weekend"]), "y"))
    return rounded(model.predict(df).select("event_id", *cols(["q_0.25", "q_0.75"])))


@query(
    "WITH "
    + _WEEK
    + """, d AS (SELECT *, event_id % 2 AS d1, (event_id // 2) % 2 AS d2 FROM e)"""
    + _START.format(
        cols="weekend, fold,",
        part=", fold",
        rows="(SELECT d.*, q, fold FROM d, x, (VALUES (0), (1)) AS o(fold) WHERE CASE WHEN q = 0.25 THEN d1 ELSE d2 END <> fold)",
    )
    + """ SELECT event_id, round(y, 6) AS y, round(a.f, 6) AS "q_0.25", round(b.f, 6) AS "q_0.75" FROM d
JOIN m AS a ON a.weekend = d.weekend AND a.q = 0.25 AND a.fold = d1
JOIN m AS b ON b.weekend = d.weekend AND b.q = 0.75 AND b.fold = d2"""
)
def pinball_out_of_fold(spark, folder):
    """Each level has folds of its own; no row is forecast by a model that learnt from it."""
    df = _two_valued(spark, folder)
    boost = PinballBoost([0.25, 0.75], rounds=2, rate=0.6, max_depth=2, accuracy=200_000)
    draw = [F.col("event_id") % 2, F.floor(F.col("event_id") / 2) % 2]
    return rounded(boost.out_of_fold(df, FeatureFrame.fit(df, ["weekend"]), "y", ["event_id"], draw=draw))


@query(
    "WITH "
    + _WEEK
    + """, m AS (SELECT weekend, avg(y) AS m FROM e GROUP BY weekend)
SELECT event_id, round_even(greatest(m, 5), 0) AS predictions FROM e JOIN m USING (weekend)"""
)
def meta_learner_two_groups(spark, folder):
    """On one two-valued quantile the meta-learner gives the mean of each group."""
    df = _two_valued(spark, folder).withColumn("q_0.5", F.col("weekend") * 10)
    meta = MetaLearner(["q_0.5"], rounds=2, rate=1.0, l2=0.0).fit(df, "y")
    return rounded(meta.predict(df).select("event_id", "predictions"))


@query(
    "WITH "
    + _WEEK
    + """, m AS (SELECT weekend, avg(y) AS m FROM e GROUP BY weekend)
SELECT event_id, round(m, 6) AS predictions FROM e JOIN m USING (weekend)"""
)
def tree_baseline_two_groups(spark, folder):
    df = _two_valued(spark, folder)
    model = _reloaded(spark, Baseline("tree").fit(df, FeatureFrame.fit(df, ["weekend"]), "y"))
    return rounded(model.predict(df).select("event_id", "predictions"))


@query(
    "WITH "
    + _WEEK
    + """, x AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 89 AS DOUBLE) END AS x0 FROM e),
z AS (SELECT *, coalesce(x0, (SELECT avg(x0) FROM x)) AS x FROM x),
c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM z)
SELECT event_id, round(a + b * x, 5) AS predictions FROM z, c"""
)
def linear_baseline_one_feature(spark, folder):
    """Least squares on one feature whose missing values take its mean."""
    x = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 89).cast("double"))
    df = events_as_observations(spark, folder).withColumn("x", x)
    model = _reloaded(spark, Baseline("linear", alpha=0.0).fit(df, FeatureFrame.fit(df, ["x"]), "y"))
    return rounded(model.predict(df).select("event_id", "predictions"), 5)


class SeasonMean:
    """Forecast by the training mean of the season; stands in for a learner in flow checks."""

    def fit(self, df):
        self.means = df.groupBy("season").agg(F.avg("y").alias("predictions"))
        return self

    def predict(self, df):
        return equi_join(df, self.means, ["season"], "left")


_FLOW = """, m AS (SELECT *, coalesce(y >= 100, false) AS ty, coalesce(p >= 100, false) AS tp FROM fc)"""


@query(
    "WITH "
    + _WEEK
    + """, f(fold, s, x) AS (VALUES ('fold_1', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-22'),
  ('fold_2', TIMESTAMP '2024-01-22', TIMESTAMP '2024-01-30')),
r AS (SELECT fold, e.*, CASE WHEN t < s THEN 'train' ELSE 'test' END AS dataset FROM e JOIN f ON t < x
  WHERE t < s OR site NOT IN (3, 4, 5)),
g AS (SELECT fold, season, avg(y) * 2.2 AS p FROM r WHERE dataset = 'train' GROUP BY ALL),
fc AS (SELECT r.*, g.p FROM r LEFT JOIN g USING (fold, season))"""
    + _FLOW
    + " SELECT 'mean' AS model, dataset, coalesce(fold, 'overall') AS fold, "
    + _core_sql()
    + " FROM m GROUP BY GROUPING SETS ((dataset, fold), (dataset))"
)
def tscv_season_mean(spark, folder):
    """The out-of-time evaluation around a forecast SQL can make: fit per fold, score both sets."""
    df = events_as_observations(spark, folder).drop("event_id")
    makers = {"mean": lambda _: _Scaled(2.2)}
    scores, _ = evaluate_models(makers, df, _PERIODS, LAYOUT, _HIGH, _WARN, untested=[3, 4, 5])
    return rounded(scores)


class _Scaled(SeasonMean):
    def __init__(self, factor):
        self.factor = factor

    def predict(self, df):
        out = super().predict(df)
        return out.withColumn("predictions", F.col("predictions") * self.factor)


@query(
    "WITH "
    + _WEEK
    + """, l AS (SELECT * REPLACE (CASE WHEN site % 2 = 0 THEN t + INTERVAL 1 YEAR ELSE t END AS t) FROM e),
f(fold, s, x) AS (VALUES ('fold_1', TIMESTAMP '2025-01-10', TIMESTAMP '2025-01-20'),
  ('fold_2', TIMESTAMP '2025-01-20', TIMESTAMP '2025-01-31')),
g AS (SELECT fold, season, avg(y) * 2.2 AS p FROM l JOIN f ON t < s GROUP BY ALL),
fc AS (SELECT fold, l.*, g.p FROM l JOIN f ON t >= s AND t < x LEFT JOIN g USING (fold, season))"""
    + _FLOW
    + " SELECT coalesce(fold, 'overall') AS fold, "
    + _core_sql()
    + " FROM m GROUP BY GROUPING SETS ((fold), ())"
)
def nested_tscv_season_mean(spark, folder):
    """Nested evaluation: training and validation parts together make the forecast."""
    later = F.make_interval(years=F.when(F.col("site") % 2 == 0, 1).otherwise(0))
    df = events_as_observations(spark, folder).withColumn("t", F.col("t") + later)
    forecasts = fold_forecasts(lambda _: _Scaled(2.2), df, _NESTED, LAYOUT, nested=True)
    return rounded(fold_scores(forecasts, "y", "predictions", "fold", (), _HIGH, _WARN))


@query(
    "WITH "
    + _WEEK
    + """, g AS (SELECT season, avg(y) AS p FROM e WHERE t < TIMESTAMP '2024-01-22' GROUP BY season)
SELECT site, t, y, season, round(p, 6) AS mean_predictions, round(p * 2.2, 6) AS high_predictions, 'broken' AS left_out
FROM e LEFT JOIN g USING (season) WHERE t >= TIMESTAMP '2024-01-22'"""
)
def batch_season_mean(spark, folder):
    """Several models side by side on the requested rows; one that fails is left out."""
    train, test = _split(events_as_observations(spark, folder).drop("event_id"))
    models = {"mean": SeasonMean().fit(train), "high": _Scaled(2.2).fit(train)}
    models["broken"] = lambda: {}["no such model"]
    out, _, absent = predict_models(models, test, LAYOUT, _HIGH, _WARN)
    return rounded(out.withColumn("left_out", F.lit(",".join(absent))))


@query(
    "WITH "
    + _WEEK
    + """, m AS (SELECT weekend, avg(y) AS a, avg(sqrt(y)) AS b, avg(-y) AS c FROM e GROUP BY weekend)
SELECT event_id, round(a, 6) AS h0, round(b, 6) AS h1, round(c, 6) AS h2 FROM e JOIN m USING (weekend)"""
)
def factor_forest_two_groups(spark, folder):
    """One forest whose leaves, weekend or not, hold the mean vector of their group."""
    df = _two_valued(spark, folder)
    rows = df.withColumn("parts", F.array("y", F.sqrt("y"), -F.col("y")))
    forest = FactorForest.fit(rows, FeatureFrame.fit(df, ["weekend"]), "parts", 3, 5, 2, 42)
    out = _reloaded(spark, forest).predict(df, "h")
    return rounded(out.select("event_id", *[F.col("h")[j].alias(f"h{j}") for j in range(3)]))


@query(
    "WITH "
    + _WEEK
    + """, d AS (SELECT *, event_id % 2 AS fold FROM e),
g AS (SELECT f.fold, weekend, count(*) AS n, sum(y) AS s FROM d JOIN (VALUES (0), (1)) AS f(fold) ON d.fold <> f.fold GROUP BY ALL),
b AS (SELECT fold, sum(s) / sum(n) AS f0 FROM g GROUP BY fold),
r(rate, l2, k) AS (SELECT * FROM (VALUES (0.3), (0.6)), (VALUES (1.0), (400.0)), (VALUES (1), (3))),
p AS (SELECT rate, l2, k, fold, weekend, s / n + (f0 - s / n) * pow(1 - rate * n / (n + l2), k) AS f FROM r, g JOIN b USING (fold)),
m AS (SELECT rate, l2, k, fold, avg(abs(y - f)) AS mae FROM p JOIN d USING (fold, weekend) GROUP BY ALL),
t AS (SELECT rate, l2, k, avg(mae) AS mae FROM m GROUP BY ALL ORDER BY avg(mae) LIMIT 1)
SELECT unnest(['n_estimators', 'learning_rate', 'reg_lambda', 'mae']) AS name,
  unnest([k::DOUBLE, rate::DOUBLE, l2::DOUBLE, round(mae, 6)]) AS value FROM t"""
)
def meta_learner_grid_two_groups(spark, folder):
    """The best of eight points on one two-valued quantile: fold errors have a closed form."""
    df = _two_valued(spark, folder).withColumn("q_0.5", F.col("weekend") * 10)
    meta = MetaLearner(["q_0.5"], feature_share=1.0)
    grid = {"n_estimators": [1, 3], "learning_rate": [0.3, 0.6], "reg_lambda": [1.0, 400.0]}
    fold = F.col("event_id") % 2
    best = meta.tune(df, "y", grid, folds=2, fold=fold)
    rows = [(k, float(v)) for k, v in best.items()]
    return rounded(spark.createDataFrame(rows, "name string, value double"))
