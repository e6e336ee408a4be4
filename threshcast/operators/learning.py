"""Feature vectors for ``pyspark.ml`` learners, fitted once and reused."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshcast.functions.columns import col
from threshcast.operators.cleaning import fill_missing, fill_values
from threshcast.operators.encoding import (
    apply_codes,
    code_counts,
    fit_codes,
    labels_of,
    ranked_labels,
)
from threshcast.session import cut

#: Files of a saved model: the one that names the current version, and the versions.
MANIFEST, VERSION = "CURRENT", "version-"
#: Bins a tree may cut each column into.
MAX_BINS = 64


class FeatureFrame:
    """Means of numeric columns, label codes of text columns, and the vector made of both.

    Columns to be neutralised (time, site name) are simply not listed. A missing number takes
    the training mean, a label unseen in training the code after the last one. Label codes are
    ordered numbers, however many labels there are; ``max_bins`` holds for every column.
    """

    def __init__(
        self,
        numeric: Sequence[str],
        labels: Sequence[str],
        means: dict[str, float],
        codes: DataFrame | None,
        sizes: dict[str, int],
        max_bins: int = MAX_BINS,
    ) -> None:
        self.numeric, self.labels = list(numeric), list(labels)
        self.means, self.codes, self.sizes, self.max_bins = means, codes, sizes, max_bins

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        numeric: Sequence[str],
        labels: Sequence[str] = (),
        max_bins: int = MAX_BINS,
    ) -> FeatureFrame:
        means = fill_values(df, "mean", list(numeric))
        means = {c: means.get(c, 0.0) for c in numeric}
        if not labels:
            return cls(numeric, [], means, None, {}, max_bins)
        codes = fit_codes(df, list(labels))
        return cls(numeric, labels, means, codes, code_counts(codes), max_bins)

    @classmethod
    def fit_before(
        cls,
        df: DataFrame,
        time: str,
        starts: Sequence[datetime.datetime],
        numeric: Sequence[str],
        labels: Sequence[str] = (),
        max_bins: int = MAX_BINS,
    ) -> list[FeatureFrame]:
        """For each start what ``fit`` gives on the rows before it, for all starts from one scan of
        the numbers and one of the labels.

        The starts cut time into slices. Sums and counts of numbers are taken by slice and added
        up to each start; of a label the first slice that has it is kept. Rows without a time are
        before no start.
        """
        order = sorted(set(starts))
        bounds = [F.lit(s.isoformat(sep=" ")).cast("timestamp_ntz") for s in order]
        at = sum((F.when(col(time) >= b, 1).otherwise(0) for b in bounds), F.lit(0))
        past = df.filter(col(time) < bounds[-1]).withColumn("__slice", at)
        sums = []
        for i, c in enumerate(numeric):
            sums += [F.sum(col(c).cast("double")).alias(f"s{i}"), F.count(col(c)).alias(f"n{i}")]
        found = past.groupBy("__slice").agg(F.count(F.lit(1)).alias("rows"), *sums).collect()
        first = None
        if labels:
            seen = labels_of(past, list(labels), "__slice").groupBy("column", "label")
            first = cut(seen.agg(F.min("__slice").alias("__slice")))
        frames = {}
        for i, start in enumerate(order):
            before = [r for r in found if r["__slice"] <= i]
            means = {}
            for k, c in enumerate(numeric):
                n = sum(r[f"n{k}"] for r in before)
                means[c] = sum(r[f"s{k}"] or 0.0 for r in before) / n if n else 0.0
            codes, sizes = None, {}
            if first is not None:
                codes = cut(ranked_labels(first.filter(F.col("__slice") <= i).select("column", "label")))
                sizes = code_counts(codes)
            frames[start] = cls(numeric, labels, means, codes, sizes, max_bins)
        return [frames[s] for s in starts]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.labels]

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add the vector; all other columns stay as they are."""
        out = df.withColumns({f"__x_{c}": col(c).cast("double") for c in self.numeric})
        out = fill_missing(out, values={f"__x_{c}": v for c, v in self.means.items()})
        if self.labels:
            out = out.withColumns({f"__x_{c}": col(c) for c in self.labels})
            codes = self.codes.withColumn("column", F.concat(F.lit("__x_"), "column"))
            counts = {f"__x_{c}": n for c, n in self.sizes.items()}
            out = apply_codes(out, codes, [f"__x_{c}" for c in self.labels], counts=counts)
            for c in self.labels:
                out = out.withColumn(f"__x_{c}", F.col(f"__x_{c}").cast("double"))
        cols = [f"__x_{c}" for c in self.names]
        return VectorAssembler(inputCols=cols, outputCol=output).transform(out).drop(*cols)

    def write(self, path: str, spark) -> None:
        state = json.dumps(
            {
                "numeric": self.numeric,
                "labels": self.labels,
                "means": self.means,
                "sizes": self.sizes,
                "max_bins": self.max_bins,
            }
        )
        write_state(spark, path, state)
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def read(cls, spark, path: str) -> FeatureFrame:
        s = json.loads(read_state(spark, path))
        codes = spark.read.parquet(f"{path}/codes") if s["labels"] else None
        return cls(s["numeric"], s["labels"], s["means"], codes, s["sizes"], s["max_bins"])


def _files(spark, path: str):
    """Hadoop's path and file system of a folder, local or not."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def saving(spark, path: str) -> Iterator[str]:
    """A fresh folder below ``path`` for the parts of a model, made its current version at the end.

    The manifest that names the version is written last, under another name, and moved into
    place; until then readers see the version before, also when a writer stops half way. What
    earlier versions and stopped writers left is deleted once the new version is current.
    """
    part = f"{path}/{VERSION}{uuid.uuid4().hex}"
    yield part
    at, files = _files(spark, path)
    jvm = spark._jvm.org.apache.hadoop
    fresh = jvm.fs.Path(f"{path}/_{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    try:
        out.write(bytearray(part.rsplit("/", 1)[1].encode()))
    finally:
        out.close()
    context = jvm.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    option = getattr(jvm.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(option, 1)
    over[0] = option.OVERWRITE
    context.rename(fresh, jvm.fs.Path(f"{path}/{MANIFEST}"), over)
    for found in files.listStatus(at):
        name = found.getPath().getName()
        if name.startswith(VERSION) and name != part.rsplit("/", 1)[1]:
            files.delete(found.getPath(), True)


def saved(spark, path: str) -> str:
    """The folder of the current version of the model at ``path``."""
    at, files = _files(spark, f"{path}/{MANIFEST}")
    if not files.exists(at):
        raise FileNotFoundError(f"no model at {path}")
    source = files.open(at)
    try:
        name = bytes(source.readAllBytes()).decode()
    finally:
        source.close()
    return f"{path}/{name}"


def write_state(spark, path: str, text: str) -> None:
    """One line of text, stored where the tables of a model are."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/state"
    )


def read_state(spark, path: str) -> str:
    return spark.read.text(f"{path}/state").first()[0]
