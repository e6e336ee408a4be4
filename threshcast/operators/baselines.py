"""Linear and single-tree forecasters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshcast.functions.columns import cols
from threshcast.functions.fixed_values import (
    BASELINE_ALPHA,
    BASELINE_DEPTH,
    BASELINE_L1_RATIO,
    BASELINE_LEAF,
)
from threshcast.operators.learning import FeatureFrame, saved, saving


@dataclass
class Baseline:
    """kind 'linear' (elastic net) or 'tree' (one regression tree)."""

    kind: str = "linear"
    alpha: float = BASELINE_ALPHA
    l1_ratio: float = BASELINE_L1_RATIO
    max_depth: int = BASELINE_DEPTH
    min_leaf: int = BASELINE_LEAF

    def fit(self, df: DataFrame, frame: FeatureFrame, target: str) -> BaselineModel:
        data = frame.transform(df.filter(F.col(target).isNotNull()))
        data = data.select("features", F.col(target).cast("double").alias("y"))
        common = {"featuresCol": "features", "labelCol": "y", "predictionCol": "__p"}
        if self.kind == "linear":
            learner = LinearRegression(
                regParam=self.alpha, elasticNetParam=self.l1_ratio, **common
            )
        elif self.kind == "tree":
            learner = DecisionTreeRegressor(
                maxDepth=self.max_depth,
                minInstancesPerNode=self.min_leaf,
                maxBins=frame.max_bins,
                **common,
            )
        else:
            raise ValueError("kind must be 'linear' or 'tree'")
        return BaselineModel(PipelineModel([learner.fit(data)]), frame)


class BaselineModel:
    def __init__(self, model: PipelineModel, frame: FeatureFrame) -> None:
        self.model, self.frame = model, frame

    def predict(self, df: DataFrame, name: str = "predictions") -> DataFrame:
        scored = self.model.transform(self.frame.transform(df))
        return scored.select(*cols(df.columns), F.col("__p").alias(name))

    def write(self, path: str, spark) -> None:
        with saving(spark, path) as part:
            self.model.write().save(f"{part}/model")
            self.frame.write(f"{part}/frame", spark)

    @classmethod
    def read(cls, spark, path: str) -> BaselineModel:
        part = saved(spark, path)
        return cls(PipelineModel.load(f"{part}/model"), FeatureFrame.read(spark, f"{part}/frame"))
