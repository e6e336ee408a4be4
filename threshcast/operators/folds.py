"""Out-of-time folds and repeatable random splits."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshcast.functions.columns import cols, key_fraction
from threshcast.functions.fixed_values import TEST_PERIODS, UNTESTED_SITES
from threshcast.operators.joins import drop_members


@dataclass(frozen=True)
class Period:
    """Half-open test period."""

    fold: str
    start: datetime.datetime
    end: datetime.datetime

    @property
    def validation_start(self) -> datetime.datetime:
        """One year before ``start``; 29 February becomes the 28th."""
        try:
            return self.start.replace(year=self.start.year - 1)
        except ValueError:
            return self.start.replace(year=self.start.year - 1, day=28)


def parse_periods(texts: Sequence[str] = TEST_PERIODS) -> list[Period]:
    """``start_end`` texts to periods named fold_1, fold_2, ..."""
    out = []
    for i, text in enumerate(texts, 1):
        start, end = (datetime.datetime.strptime(p, "%Y-%m-%d") for p in text.split("_"))
        out.append(Period(f"fold_{i}", start, end))
    return out


def _at(value: datetime.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def between(df: DataFrame, time: str, start=None, end=None) -> DataFrame:
    """Half-open time filter that reaches the Parquet scan."""
    if start is not None:
        df = df.filter(F.col(time) >= _at(start))
    return df if end is None else df.filter(F.col(time) < _at(end))


def fold_tables(
    df: DataFrame,
    period: Period,
    time: str,
    site: str | None = None,
    untested: Sequence[str] = UNTESTED_SITES,
) -> tuple[DataFrame, DataFrame]:
    """(train, test): everything before the period, and the period without untested sites."""
    test = between(df, time, period.start, period.end)
    if site is not None:
        test = drop_members(test, site, untested)
    return between(df, time, end=period.start), test


def nested_fold_tables(
    df: DataFrame, period: Period, time: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, test): the year before the period is the validation part."""
    return (
        between(df, time, end=period.validation_start),
        between(df, time, period.validation_start, period.start),
        between(df, time, period.start, period.end),
    )


def assign_folds(
    df: DataFrame,
    periods: Sequence[Period],
    time: str,
    site: str | None = None,
    untested: Sequence[str] = UNTESTED_SITES,
    nested: bool = False,
) -> DataFrame:
    """Add fold and role; a row appears once for each fold it takes part in.

    The few periods are constants of the plan, so this is a projection: no join, no shuffle.
    """
    t = F.col(time)
    tested = F.lit(True)
    if site is not None and not nested:
        tested = F.coalesce(~F.col(site).isin(list(untested)), F.lit(True))
    entries = []
    for p in periods:
        role = F.when((t >= _at(p.start)) & (t < _at(p.end)) & tested, "test")
        if nested:
            role = role.when((t >= _at(p.validation_start)) & (t < _at(p.start)), "validation")
            role = role.when(t < _at(p.validation_start), "train")
        else:
            role = role.when(t < _at(p.start), "train")
        entries.append(F.struct(F.lit(p.fold).alias("fold"), role.alias("role")))
    used = F.filter(F.array(*entries), lambda e: e["role"].isNotNull())
    return df.withColumn("__f", F.explode(used)).select(*cols(df.columns), "__f.fold", "__f.role")


def fold_sizes(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


def split_by_key(
    df: DataFrame,
    keys: Sequence[str],
    train_share: float = 0.8,
    seed: int = 42,
    draw: Column | None = None,
) -> DataFrame:
    """Add role train or test, decided by the key alone, so it is the same on every run.

    ``draw`` replaces the hash by any expression in [0, 1).
    """
    u = key_fraction(keys, seed) if draw is None else draw
    return df.withColumn("role", F.when(u < train_share, "train").otherwise("test"))
