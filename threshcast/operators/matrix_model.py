"""Forecasts from latent factors: forests predict w(time) and h(site), their product the target."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshcast.functions.columns import cols, constrain_forecast
from threshcast.operators.cleaning import keep_first
from threshcast.operators.factors import Factors, factorise, implicit_target_matrix, reconstruct
from threshcast.operators.joins import equi_join
from threshcast.operators.learning import FeatureFrame, read_state, saved, saving, write_state
from threshcast.operators.matrix import group_means
from threshcast.operators.trees import leaf_means
from threshcast.session import broadcast_if_small, discard, observed


class FactorForest:
    """One forest for all latent parts: a leaf holds the mean vector of the rows that reach it.

    Trees are split on the direction in which the vectors vary most (first principal axis of
    their covariance); the leaf table comes from one grouped aggregation by tree and leaf. It is
    part of the model: trees x leaves x parts numbers, whatever the data.
    """

    def __init__(self, forest: RandomForestRegressionModel, lookup: np.ndarray, frame: FeatureFrame) -> None:
        self.forest, self.lookup, self.frame = forest, lookup, frame

    @classmethod
    def fit(
        cls,
        features: DataFrame,
        frame: FeatureFrame,
        parts: str,
        rank: int,
        trees: int,
        max_depth: int,
        seed: int,
    ) -> FactorForest:
        y = [F.col(f"y{j}") for j in range(rank)]
        data = frame.transform(features, "__features").select(
            F.col("__features").alias("features"), *[F.col(parts)[j].cast("double").alias(f"y{j}") for j in range(rank)]
        )
        data, _ = observed(data, "factor-rows")
        pairs = [(i, j) for i in range(rank) for j in range(i + 1)]
        found = data.agg(*[F.covar_pop(y[i], y[j]) for i, j in pairs]).first()
        spread = np.zeros((rank, rank))
        for (i, j), c in zip(pairs, found, strict=True):
            spread[i, j] = spread[j, i] = c or 0.0
        axis = np.linalg.eigh(spread)[1][:, -1]
        axis = axis * np.sign(axis[np.argmax(np.abs(axis))])
        along = sum((y[j] * float(a) for j, a in enumerate(axis)), F.lit(0.0))
        forest = RandomForestRegressor(
            featuresCol="features",
            labelCol="__along",
            leafCol="leaves",
            numTrees=trees,
            maxDepth=max_depth,
            maxBins=frame.max_bins,
            seed=seed,
        ).fit(data.withColumn("__along", along))
        leaves = forest.transform(data).select(
            *[f"y{j}" for j in range(rank)], F.posexplode(vector_to_array("leaves")).alias("tree", "leaf")
        )
        rows = leaves.groupBy("tree", F.col("leaf").cast("int").alias("leaf")).agg(
            F.array(*[F.avg(c) for c in y]).alias("mean")
        ).collect()
        discard(data)
        lookup = np.zeros((trees, 1 + max(r["leaf"] for r in rows), rank))
        for r in rows:
            lookup[r["tree"], r["leaf"]] = r["mean"]
        return cls(forest, lookup, frame)

    def predict(self, features: DataFrame, name: str) -> DataFrame:
        scored = self.forest.transform(self.frame.transform(features))
        return scored.select(*cols(features.columns), leaf_means(self.lookup, "leaves").alias(name))

    def write(self, path: str, spark) -> None:
        with saving(spark, path) as part:
            self.forest.write().save(f"{part}/forest")
            self.frame.write(f"{part}/frame", spark)
            write_state(spark, part, json.dumps({"lookup": self.lookup.tolist()}))

    @classmethod
    def read(cls, spark, path: str) -> FactorForest:
        part = saved(spark, path)
        lookup = np.array(json.loads(read_state(spark, part))["lookup"])
        forest = RandomForestRegressionModel.load(f"{part}/forest")
        return cls(forest, lookup, FeatureFrame.read(spark, f"{part}/frame"))


@dataclass
class MatrixForecaster:
    """Settings; the columns say what describes a time and what describes a site."""

    time: str
    site: str
    target: str
    time_features: Sequence[str]
    site_numbers: Sequence[str] = ()
    site_labels: Sequence[str] = ()
    order: Sequence[str] = ()
    rank: int = 4
    init: str = "nndsvd"
    sweeps: int = 1000
    tol: float = 1e-4
    trees: int = 100
    max_depth: int = 10
    seed: int = 42
    factor_options: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> MatrixForecasterModel:
        x = implicit_target_matrix(df, self.time, self.site, self.target, self.order)
        factors = factorise(
            x, self.rank, self.init, self.sweeps, self.tol, self.seed, **self.factor_options
        )
        temporal = self._temporal(df, factors)
        spatial = self._spatial(df, factors)
        return MatrixForecasterModel(self, factors, temporal, spatial)

    def times_of(self, df: DataFrame) -> DataFrame:
        """Mean features per time, in training and in prediction alike."""
        return group_means(df, self.time, self.time_features)

    def sites_of(self, df: DataFrame) -> DataFrame:
        """One row of attributes per site, the first by time."""
        columns = [self.site, *self.site_numbers, *self.site_labels]
        known = df.filter(F.col(self.site).isNotNull()).select(*columns, self.time)
        return keep_first(known, [self.site], [self.time]).select(*columns)

    def _temporal(self, df: DataFrame, factors: Factors) -> FactorForest:
        times = self.times_of(df)
        frame = FeatureFrame.fit(times, self.time_features)
        W = factors.W.select(F.col("row").alias("__day"), "w")
        W = broadcast_if_small(W, derived=True)
        labelled = equi_join(times.withColumn("__day", F.to_date(self.time)), W, ["__day"])
        return self._forest(labelled, frame, "w")

    def _spatial(self, df: DataFrame, factors: Factors) -> FactorForest:
        sites = self.sites_of(df)
        frame = FeatureFrame.fit(sites, self.site_numbers, self.site_labels)
        H = factors.H.select(F.col("col").alias(self.site), "h")
        return self._forest(equi_join(sites, H, [self.site]), frame, "h")

    def _forest(self, labelled: DataFrame, frame: FeatureFrame, parts: str) -> FactorForest:
        return FactorForest.fit(
            labelled, frame, parts, self.rank, self.trees, self.max_depth, self.seed
        )


class MatrixForecasterModel:
    def __init__(
        self,
        settings: MatrixForecaster,
        factors: Factors,
        temporal: FactorForest,
        spatial: FactorForest,
    ) -> None:
        self.settings, self.factors = settings, factors
        self.temporal, self.spatial = temporal, spatial

    def predict(
        self, df: DataFrame, name: str = "predictions", constrained: bool = False
    ) -> DataFrame:
        """Forecast the given rows, including sites never seen in training.

        Values are neither floored nor rounded unless ``constrained``.
        """
        s = self.settings
        W = self.temporal.predict(s.times_of(df), "w").select(s.time, "w")
        H = self.spatial.predict(s.sites_of(df), "h").select(s.site, "h")
        out = reconstruct(df, W, H, s.time, s.site, s.rank, name)
        return out.withColumn(name, constrain_forecast(name)) if constrained else out

    def write(self, path: str, spark) -> None:
        s = self.settings
        state = {f.name: getattr(s, f.name) for f in fields(s)}
        state = {k: list(v) if isinstance(v, tuple) else v for k, v in state.items()}
        with saving(spark, path) as part:
            self.factors.write(f"{part}/factors")
            self.temporal.write(f"{part}/temporal", spark)
            self.spatial.write(f"{part}/spatial", spark)
            write_state(spark, part, json.dumps(state))

    @classmethod
    def read(cls, spark, path: str) -> MatrixForecasterModel:
        part = saved(spark, path)
        return cls(
            MatrixForecaster(**json.loads(read_state(spark, part))),
            Factors.read(spark, f"{part}/factors"),
            FactorForest.read(spark, f"{part}/temporal"),
            FactorForest.read(spark, f"{part}/spatial"),
        )
