"""Boosted trees for counts: Newton steps on the Poisson loss."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshcast.functions.columns import col, cols, constrain_forecast
from threshcast.functions.fixed_values import BOOST_RATE, BOOST_ROUNDS
from threshcast.operators.learning import FeatureFrame, read_state, saved, saving, write_state
from threshcast.operators.members import KEY, Boosted, Boosting, Growth, Loss, Member
from threshcast.operators.trees import node_table, read_nodes


def training_rows(df: DataFrame, frame: FeatureFrame, target: str, keys: Sequence[str | Column], *more: Column) -> DataFrame:
    """Features as an array, target and a hash of the keys, for rows that have a target."""
    hashed = F.xxhash64(*[col(k) if isinstance(k, str) else k for k in keys]) if keys else F.lit(0).cast("long")
    data = frame.transform(df.filter(F.col(target).isNotNull()), "__features")
    return data.select(*more, hashed.alias(KEY), vector_to_array("__features").alias("x"), F.col(target).cast("double").alias("y"))


def settled(tol: float, floor: float, span: int = 10):
    """A stop rule: whether the last ``span`` rounds (or more) lowered the loss by less than ``tol``
    of what there was to explain (the loss at first, less ``floor``)."""

    def stop(out: Boosted) -> bool:
        now = max(out.losses)
        before = max((n for n in out.losses if n <= now - span), default=None)
        if before is None:
            return False
        return out.losses[before][0] - out.losses[now][0] < tol * (out.losses[0][0] - floor)

    return stop


@dataclass
class PoissonBoost:
    """Settings.

    Trees grow to ``max_depth`` and keep their best ``leaves`` leaves by gain; a leaf takes
    soft(sum of (y - mu), ``l1``) / (sum of mu + ``l2``). All ``rounds`` are run, unless ``tol``
    is above 0: then rounds end once ten of them lower the deviance by less than ``tol`` of what
    it was at first.
    """

    rounds: int = BOOST_ROUNDS
    rate: float = BOOST_RATE
    max_depth: int = 5
    min_leaf: int = 20
    row_share: float = 0.8
    row_period: int = 5
    feature_share: float = 0.8
    seed: int = 42
    cut_every: int = 5
    tol: float = 0.0
    leaves: int = 31
    l1: float = 0.0
    l2: float = 0.0

    def fit(
        self, df: DataFrame, frame: FeatureFrame, target: str, keys: list[str]
    ) -> PoissonBoostModel:
        """``keys`` identify a row and decide which rows a bag holds."""
        data = training_rows(df, frame, target, keys)
        growth = Growth(
            self.rate, self.max_depth, self.leaves, self.min_leaf, self.l1, self.l2,
            self.row_share, self.row_period, self.feature_share, self.seed,
        )
        stop = None
        if self.tol > 0:
            # half the Poisson deviance, without what the forecast does not change
            y = F.col("y")
            best = F.sum(F.when(y > 0, y - y * F.log(y)).otherwise(F.lit(0.0)))
            stop = settled(self.tol, data.agg(best).first()[0] or 0.0)
        boosting = Boosting(self.rounds, self.cut_every, stop=stop)
        out = boosting.fit(data, [Member(Loss("poisson"), growth)], len(frame.names), frame.max_bins)
        return PoissonBoostModel(out, frame)


class PoissonBoostModel:
    def __init__(self, boosted: Boosted, frame: FeatureFrame) -> None:
        self.boosted, self.frame = boosted, frame

    def predict_mean(self, df: DataFrame, name: str = "predictions", rounds: int | None = None):
        """Expected count without limits, from all rounds or the first few."""
        scored = self.frame.transform(df, "__features")
        score = self.boosted.score("__features", rounds)[0]
        return scored.select(*cols(df.columns), F.exp(score).alias(name))

    def predict(self, df: DataFrame, name: str = "predictions") -> DataFrame:
        """Expected count, at least 5 and rounded to a whole number."""
        return self.predict_mean(df, name).withColumn(name, constrain_forecast(name))

    def nodes(self, spark) -> DataFrame:
        """The splits and leaves of all rounds as a table."""
        return node_table(spark, self.boosted.trees)

    def gains(self, spark) -> DataFrame:
        """(feature, splits, gain): what the splits on each feature gained, over all rounds.

        The gain of a split is G^2 / H of both sides less that of the whole (G the sum of gradients
        after ``l1``, H of weights and ``l2``). Features never split on have 0.
        """
        names = spark.createDataFrame(list(enumerate(self.frame.names)), "feature int, name string")
        found = self.nodes(spark).filter("feature >= 0").groupBy("feature")
        found = found.agg(F.count("*").alias("splits"), F.sum("gain").alias("gain"))
        return names.join(F.broadcast(found), "feature", "left").select(
            F.col("name").alias("feature"), F.coalesce("splits", F.lit(0)).alias("splits"),
            F.coalesce("gain", F.lit(0.0)).alias("gain"),
        )

    def importance(self) -> dict[str, float]:
        """Share of each round's gain by feature, added over the rounds."""
        out = dict.fromkeys(self.frame.names, 0.0)
        for side in self.boosted.trees:
            total = sum(side[0].gain)
            for feature, gain in zip(side[0].feature, side[0].gain):
                if feature >= 0 and total > 0:
                    out[self.frame.names[feature]] += gain / total
        return out

    def write(self, path: str, spark) -> None:
        with saving(spark, path) as part:
            self.nodes(spark).write.parquet(f"{part}/nodes")
            self.frame.write(f"{part}/frame", spark)
            write_state(spark, part, json.dumps({"base": self.boosted.base}))

    @classmethod
    def read(cls, spark, path: str) -> PoissonBoostModel:
        part = saved(spark, path)
        trees = read_nodes(spark.read.parquet(f"{part}/nodes"))
        boosted = Boosted([], json.loads(read_state(spark, part))["base"], trees)
        return cls(boosted, FeatureFrame.read(spark, f"{part}/frame"))
