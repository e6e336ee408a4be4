"""Train, evaluate and predict with several forecasters over one observation table."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from inspect import signature
from multiprocessing.pool import ThreadPool
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from threshcast.functions.columns import col, key_fraction
from threshcast.functions.fixed_values import (
    EXCEEDANCE,
    NOT_TEMPORAL_COLUMNS,
    PRECAUTION,
    SITE_COLUMNS,
    UNTESTED_SITES,
)
from threshcast.operators.boosting import PoissonBoost
from threshcast.operators.cleaning import (
    clean_observations,
    numeric_columns,
    text_columns,
)
from threshcast.operators.conformal import apply_shift, conformal_shift
from threshcast.operators.features import engineer_features
from threshcast.operators.folds import Period, fold_tables, nested_fold_tables
from threshcast.operators.learning import FeatureFrame, read_state, saved, saving, write_state
from threshcast.operators.matrix_model import MatrixForecaster
from threshcast.operators.quantiles import (
    MetaLearner,
    PinballBoost,
    PinballBoostModel,
    QuantileForest,
    QuantileForestModel,
    constrain,
    level_column,
    out_of_fold,
    point_forecast,
)
from threshcast.operators.scoring import fold_scores, score
from threshcast.operators.series import largest_group
from threshcast.session import observed
from threshcast.sources.tables import ROW_ID

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Layout:
    """Column names of an observation table."""

    site: str = "SITE_NAME"
    time: str = "DateTime"
    target: str = "Enterococci"
    season: str = "Season"

    @property
    def keys(self) -> list[str]:
        return [self.site, self.time]

    def feature_columns(self, df: DataFrame) -> tuple[list[str], list[str]]:
        """(numbers, labels) to learn from: everything but the time and the target."""
        out = (self.time, self.target, ROW_ID)
        return (
            [c for c in numeric_columns(df) if c not in out],
            [c for c in text_columns(df) if c not in out],
        )


def prepare(raw: DataFrame, layout: Layout = Layout(), order: Sequence[str] = (ROW_ID,)) -> DataFrame:
    """Raw observations to features. The target is clipped before the past features are taken,
    in training and in prediction alike."""
    clean = clean_observations(raw, order, layout.site, layout.time, layout.target)
    # raw series are at least as long as cleaned ones, and counting them reads two columns
    longest = largest_group(raw, [layout.site, layout.season])
    return engineer_features(
        clean, layout.site, layout.time, layout.season, layout.target, longest=longest
    )


# -- forecasters: settings with fit(df) -> model with predict(df) --------------------------


@dataclass
class PoissonForecaster:
    layout: Layout = field(default_factory=Layout)
    settings: PoissonBoost = field(default_factory=PoissonBoost)

    def fit(self, df: DataFrame, frame: FeatureFrame | None = None):
        frame = frame or FeatureFrame.fit(df, *self.layout.feature_columns(df))
        return self.settings.fit(df, frame, self.layout.target, self.layout.keys)


@dataclass
class BaselineForecaster:
    settings: object
    layout: Layout = field(default_factory=Layout)

    def fit(self, df: DataFrame, frame: FeatureFrame | None = None):
        frame = frame or FeatureFrame.fit(df, *self.layout.feature_columns(df))
        return self.settings.fit(df, frame, self.layout.target)


def matrix_forecaster(df: DataFrame, layout: Layout = Layout(), **options) -> MatrixForecaster:
    """Settings whose site attributes and time features follow from the columns present."""
    site_columns = [c for c in SITE_COLUMNS if c in df.columns and c != layout.site]
    numbers = numeric_columns(df)
    left_out = {*site_columns, *NOT_TEMPORAL_COLUMNS, layout.site, layout.time, layout.target}
    return MatrixForecaster(
        layout.time,
        layout.site,
        layout.target,
        [c for c in numbers if c not in left_out],
        [c for c in site_columns if c in numbers],
        [c for c in site_columns if c not in numbers],
        **options,
    )


@dataclass
class QuantileForecaster:
    """Quantiles, a point forecast, and a calibrated interval.

    Part of the rows, chosen by key, is kept from the forest and used to calibrate; with
    ``calibration_share`` 0 the interval is left out. ``meta`` trains the meta-learner on
    out-of-fold quantiles; without it none are computed.
    """

    layout: Layout = field(default_factory=Layout)
    forest: QuantileForest | PinballBoost = field(default_factory=QuantileForest)
    alpha: float = 0.10
    calibration_share: float = 0.2
    meta: bool = False
    meta_options: dict = field(default_factory=dict)
    seed: int = 42

    def fit(self, df: DataFrame, frame: FeatureFrame | None = None) -> QuantileForecasterModel:
        lay, share = self.layout, self.calibration_share
        frame = frame or FeatureFrame.fit(df, *lay.feature_columns(df))
        draw = key_fraction(lay.keys, self.seed)
        fitted = self.forest.fit(df.filter(draw >= share) if share else df, frame, lay.target, lay.keys)
        columns = [level_column(q) for q in fitted.levels]
        shift = None
        if share:
            held = constrain(fitted.predict(df.filter(draw < share)), columns)
            row = conformal_shift(
                held, columns[0], self._upper(fitted.levels), lay.target, self.alpha
            ).first()
            shift = row["shift"] if row is not None else float("inf")
        meta = None
        if self.meta:
            oof = out_of_fold(df, self.forest, frame, lay.target, lay.keys)
            meta = MetaLearner(columns, **self.meta_options).fit(constrain(oof, columns), lay.target, lay.keys)
        return QuantileForecasterModel(fitted, columns, self._upper(fitted.levels), shift, meta)

    def _upper(self, levels: Sequence[float]) -> str:
        """The level nearest to the mirror image of the lowest one."""
        return level_column(min(levels, key=lambda q: abs(q - (1 - min(levels)))))


class QuantileForecasterModel:
    def __init__(
        self,
        forest: QuantileForestModel | PinballBoostModel,
        columns: list[str],
        upper: str,
        shift: float | None,
        meta: MetaLearner | None,
    ) -> None:
        self.forest, self.columns, self.upper = forest, columns, upper
        self.shift, self.meta = shift, meta

    def predict(self, df: DataFrame) -> DataFrame:
        """Quantiles, ``predictions``, and ``pi_lower``/``pi_upper`` when calibrated."""
        raw = constrain(self.forest.predict(df), self.columns)
        if self.shift is not None:
            raw = apply_shift(raw, self.shift, self.columns[0], self.upper)
        if self.meta is None:
            return point_forecast(raw, self.columns)
        point = self.meta.predict(raw, "__point")
        out = point_forecast(point, self.columns)
        return out.withColumn("predictions", F.col("__point")).drop("__point")

    def write(self, path: str, spark) -> None:
        with saving(spark, path) as part:
            self.forest.write(f"{part}/forest", spark)
            if self.meta is not None:
                self.meta.write(f"{part}/meta", spark)
            state = {"columns": self.columns, "upper": self.upper, "shift": self.shift}
            state |= {"meta": self.meta is not None, "boosted": isinstance(self.forest, PinballBoostModel)}
            write_state(spark, part, json.dumps(state))

    @classmethod
    def read(cls, spark, path: str) -> QuantileForecasterModel:
        part = saved(spark, path)
        s = json.loads(read_state(spark, part))
        kind = PinballBoostModel if s["boosted"] else QuantileForestModel
        meta = MetaLearner.read(spark, f"{part}/meta") if s["meta"] else None
        return cls(kind.read(spark, f"{part}/forest"), s["columns"], s["upper"], s["shift"], meta)


# -- evaluation ----------------------------------------------------------------------------


def fold_forecasts(
    maker: Callable[[DataFrame], object],
    df: DataFrame,
    periods: Sequence[Period],
    layout: Layout = Layout(),
    untested: Sequence[str] = UNTESTED_SITES,
    nested: bool = False,
    with_train: bool = True,
    at_once: int = 3,
) -> DataFrame:
    """Fit per fold on what lies before it and forecast: (keys, target, predictions, q_...,
    dataset, fold).

    ``maker`` turns the training rows into forecaster settings. Nested folds are trained on
    the training and validation parts together and only tested. Windows expand, so fill values
    and label codes of all folds are added up from slices of time (``FeatureFrame.fit_before``),
    for forecasters whose ``fit`` takes them; folds are then fitted ``at_once`` side by side. The
    forecasts form one lazy union.
    """
    frames: dict[str, FeatureFrame] = {}

    def prepared() -> dict[str, FeatureFrame]:
        with lock:
            if not frames:
                found = FeatureFrame.fit_before(
                    df, layout.time, [p.start for p in periods], *layout.feature_columns(df)
                )
                frames.update(zip([p.fold for p in periods], found, strict=True))
        return frames

    def fitted(p: Period) -> list[DataFrame]:
        df.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", p.fold)
        if nested:
            train, validation, test = nested_fold_tables(df, p, layout.time)
            train = train.unionByName(validation)
        else:
            train, test = fold_tables(df, p, layout.time, layout.site, untested)
        forecaster = maker(train)
        takes = "frame" in signature(forecaster.fit).parameters
        model = forecaster.fit(train, frame=prepared()[p.fold]) if takes else forecaster.fit(train)
        sets = {"test": test} if nested or not with_train else {"test": test, "train": train}
        parts = []
        for name, rows in sets.items():
            forecast = model.predict(rows)
            shown = [c for c in forecast.columns if c.startswith("q_") or c == "predictions"]
            parts.append(
                forecast.select(
                    *layout.keys,
                    layout.target,
                    *[col(c) for c in shown],
                    F.lit(name).alias("dataset"),
                    F.lit(p.fold).alias("fold"),
                )
            )
        return parts

    lock = Lock()
    with ThreadPool(max(1, min(at_once, len(periods)))) as pool:
        found = pool.map(inheritable_thread_target(df.sparkSession)(fitted), list(periods))
    parts = [part for side in found for part in side]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate_models(
    makers: dict[str, Callable[[DataFrame], object]],
    df: DataFrame,
    periods: Sequence[Period],
    layout: Layout = Layout(),
    threshold: float = EXCEEDANCE,
    precaution: float = PRECAUTION,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(scores, forecasts) of several models; scores per model, data set and fold, with the
    pooled rows as fold 'overall', from one aggregation over the forecasts.

    Fitting reads the table many times; it is best prepared once and written."""
    parts = [
        fold_forecasts(make, df, periods, layout, **options).withColumn("model", F.lit(name))
        for name, make in makers.items()
    ]
    forecasts = parts[0]
    for p in parts[1:]:
        forecasts = forecasts.unionByName(p, allowMissingColumns=True)
    scores = fold_scores(
        forecasts, layout.target, "predictions", "fold", ["model", "dataset"], threshold, precaution
    )
    return scores, forecasts


# -- prediction ----------------------------------------------------------------------------


def train_models(
    makers: dict[str, Callable[[DataFrame], object]], df: DataFrame, path: str | None = None
) -> dict[str, object]:
    """Fit each forecaster on all rows; with ``path`` each model is saved below it.

    The rows are written to the shared folder once and stay, as a model may still refer to them.
    """
    data, _ = observed(df, "training")
    models = {}
    for name, make in makers.items():
        models[name] = make(data).fit(data)
        if path is not None:
            models[name].write(f"{path}/{name}", df.sparkSession)
    return models


def predict_models(
    models: dict[str, object | Callable[[], object]],
    df: DataFrame,
    layout: Layout = Layout(),
    threshold: float = EXCEEDANCE,
    precaution: float = PRECAUTION,
) -> tuple[DataFrame, dict[str, DataFrame], list[str]]:
    """Observation rows with ``<model>_predictions`` (and ``<model>_q_...``), scores, and the names
    of the models left out.

    Models only add columns, so each forecasts on the table the others have added to; no row is
    matched with itself. A model may be given as a loader; one whose files or entry are missing is
    logged and left out. Any other error is raised.
    """
    out, scores, absent = df, {}, []
    for name, model in models.items():
        try:
            ready = model if hasattr(model, "predict") else model()
        except (AnalysisException, Py4JJavaError, LookupError, FileNotFoundError) as e:
            log.error("model %s left out: %s", name, e)
            absent.append(name)
            continue
        forecast = ready.predict(out)
        added = [c for c in forecast.columns if c not in out.columns]
        shown = [c for c in added if c.startswith(("q_", "pi_")) or c == "predictions"]
        if layout.target in df.columns:
            scores[name] = score(
                forecast,
                layout.target,
                "predictions",
                suite="core",
                threshold=threshold,
                precaution=precaution,
            )
        out = forecast.select(
            *[col(c) for c in out.columns], *[col(c).alias(f"{name}_{c}") for c in shown]
        )
    return out, scores, absent
