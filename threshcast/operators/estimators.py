"""The learners as ``pyspark.ml`` estimators: for ``Pipeline``, ``CrossValidator`` and model files.

An estimator has the columns it reads and every setting of its learner as a ``Param``, so grids can
name them. Its model adds the forecast columns of the learner and is saved with its parts.
"""

from __future__ import annotations

from dataclasses import MISSING, fields
from importlib import import_module

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame

from threshcast.operators.baselines import Baseline
from threshcast.operators.boosting import PoissonBoost
from threshcast.operators.learning import FeatureFrame
from threshcast.operators.matrix_model import MatrixForecaster
from threshcast.operators.quantiles import MetaLearner, PinballBoost, QuantileForest

_COLUMNS = {
    "numericCols": ([], "numeric feature columns", TypeConverters.toListString),
    "labelCols": ([], "text feature columns, encoded by their order", TypeConverters.toListString),
    "keyCols": ([], "columns that identify a row", TypeConverters.toListString),
    "targetCol": ("y", "column to forecast", TypeConverters.toString),
}


class _Learner(Params):
    """Params for the columns and for each setting of ``learner``, with its defaults."""

    learner: type

    def _declare(self) -> None:
        for name, (default, doc, kind) in self._own_columns().items():
            setattr(self, name, Param(self, name, doc, kind))
            self._setDefault(**{name: default})
        for name, default in self._settings().items():
            setattr(self, name, Param(self, name, f"setting of {self.learner.__name__}", TypeConverters.identity))
            if default is not MISSING:
                self._setDefault(**{name: default})

    def _own_columns(self) -> dict:
        return _COLUMNS

    def _settings(self) -> dict:
        out = {}
        for f in fields(self.learner):
            made = f.default_factory is not MISSING
            out[f.name] = f.default_factory() if made else f.default
        return out

    def _made(self):
        """The learner with the settings as they are now."""
        return self.learner(**{n: self.getOrDefault(n) for n in self._settings() if self.isDefined(n)})


class LearnerEstimator(_Learner, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Encodes and fills features as the learner's tables are prepared everywhere, then fits it."""

    def __init__(self, **values) -> None:
        super().__init__()
        self._declare()
        self._set(**values)

    def _fit(self, dataset: DataFrame) -> LearnerModel:
        return LearnerModel(self._fitted(dataset))

    def _frame(self, df: DataFrame) -> FeatureFrame:
        return FeatureFrame.fit(df, self.getOrDefault("numericCols"), self.getOrDefault("labelCols"))

    def _fitted(self, df: DataFrame):
        target, keys = self.getOrDefault("targetCol"), self.getOrDefault("keyCols")
        return self._made().fit(df, self._frame(df), target, keys)


class PoissonEstimator(LearnerEstimator):
    learner = PoissonBoost


class PinballEstimator(LearnerEstimator):
    learner = PinballBoost


class QuantileForestEstimator(LearnerEstimator):
    learner = QuantileForest


class BaselineEstimator(LearnerEstimator):
    learner = Baseline

    def _fitted(self, df: DataFrame):
        return self._made().fit(df, self._frame(df), self.getOrDefault("targetCol"))


class MatrixEstimator(LearnerEstimator):
    """Its columns are settings of the learner."""

    learner = MatrixForecaster

    def _own_columns(self) -> dict:
        return {}

    def _fitted(self, df: DataFrame):
        return self._made().fit(df)


class MetaEstimator(LearnerEstimator):
    """``columns`` are the quantiles to learn from."""

    learner = MetaLearner

    def _own_columns(self) -> dict:
        return {n: _COLUMNS[n] for n in ("keyCols", "targetCol")}

    def _settings(self) -> dict:
        made = MetaLearner([])
        grown = {n: getattr(made.growth, n) for n in ("rate", "max_depth", "min_leaf", "feature_share", "seed", "leaves", "l2", "l1")}
        return {"columns": MISSING, "rounds": made.rounds, "tol": made.tol, **grown}

    def _fitted(self, df: DataFrame):
        return self._made().fit(df, self.getOrDefault("targetCol"), self.getOrDefault("keyCols") or None)


class LearnerModel(Model, MLReadable, MLWritable):
    """A fitted learner as a transformer: its forecast columns are added."""

    def __init__(self, fitted=None) -> None:
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.predict(dataset)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, instance: LearnerModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        kind = type(self.instance.fitted)
        named = {"fitted": f"{kind.__module__}:{kind.__qualname__}"}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=named)
        self.instance.fitted.write(f"{path}/fitted", self.sparkSession)


class _ModelReader(MLReader):
    def __init__(self, cls: type[LearnerModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> LearnerModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        module, name = found["fitted"].split(":")
        if not module.startswith(f"{__package__.split('.')[0]}."):
            raise ValueError(f"not a learner of this library: {found['fitted']}")
        out = self.cls(getattr(import_module(module), name).read(self.sparkSession, f"{path}/fitted"))
        out._resetUid(found["uid"])
        return out
