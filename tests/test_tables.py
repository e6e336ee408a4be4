"""Cleaning, encoding, joins, folds, past features, selection."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from threshcast.operators.cleaning import (
    as_categories,
    clean_observations,
    fill_missing,
    keep_first,
    project,
)
from threshcast.operators.encoding import apply_codes, fit_codes, label_encode
from threshcast.operators.folds import (
    assign_folds,
    fold_tables,
    nested_fold_tables,
    parse_periods,
    split_by_key,
)
from threshcast.operators.joins import align, drop_members, equi_join, join_models, table_diff
from threshcast.operators.selection import global_index, median, order_statistic
from threshcast.operators.series import Past, past_features, recent_history, sequence_position


def test_projection_is_strict(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert project(df, ["b"]).columns == ["b"]
    with pytest.raises(AnalysisException):
        project(df, ["c"])


def test_keep_first_with_hot_and_missing_keys(spark):
    rows = [("hot", None, i, float(i)) for i in range(500, 0, -1)]
    rows += [(None, 1, 7, 70.0), (None, 1, 3, 30.0), ("x", 2, 1, None)]
    df = spark.createDataFrame(rows, "k string, t int, pos int, v double")
    out = {(r["k"], r["t"]): (r["pos"], r["v"]) for r in keep_first(df, ["k", "t"], ["pos"]).collect()}
    assert out == {("hot", None): (1, 1.0), (None, 1): (3, 30.0), ("x", 2): (1, None)}


def test_clean_observations(spark):
    rows = [
        ("1/2/21 9:30", "a", 20000.0, 1),
        ("01/02/21 09:30", "a", 5.0, 2),
        ("1/2/21 9:31", "a", None, 3),
        ("1/2/21 9:30", "b", 1.0, 4),
    ]
    df = spark.createDataFrame(rows, "DateTime string, SITE_NAME string, Enterococci double, _row int")
    out = clean_observations(df, ["_row"], columns=["DateTime", "SITE_NAME", "Enterococci"])
    got = sorted((r["SITE_NAME"], r["DateTime"].minute, r["Enterococci"]) for r in out.collect())
    assert got[0] == ("a", 30, 10000.0) and got[1] == ("a", 31, None) and got[2] == ("b", 30, 1.0)


def test_fill_missing(spark):
    df = spark.createDataFrame(
        [(1.0, None, "x"), (None, None, None), (4.0, None, "y"), (100.0, None, "z")],
        "a double, b double, c string",
    )
    assert [r["a"] for r in fill_missing(df, "mean").collect()] == [1.0, 35.0, 4.0, 100.0]
    assert [r["a"] for r in fill_missing(df, "median").collect()] == [1.0, 4.0, 4.0, 100.0]
    assert fill_missing(df).filter("b IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        fill_missing(df, "mode")


def test_categories(spark):
    df = spark.createDataFrame([(1, 2)], "WEEK int, other int")
    assert as_categories(df).dtypes == [("WEEK", "string"), ("other", "int")]


def test_label_codes_are_ordered_as_text(spark):
    df = spark.createDataFrame([("2",), ("10",), (None,), ("b",)], "s string")
    got = [r["s"] for r in label_encode(df).collect()]
    assert got == [1, 0, 3, 2]


def test_codes_fitted_once(spark):
    codes = fit_codes(spark.createDataFrame([("a",), ("c",)], "s string"), ["s"])
    new = spark.createDataFrame([("c",), ("b",), (None,)], "s string")
    assert [r["s"] for r in apply_codes(new, codes, ["s"]).collect()] == [1, 2, 2]


def test_codes_of_many_labels(spark):
    df = spark.range(3000).selectExpr("concat('l', id % 701) AS s", "concat('m', id % 13) AS t")
    few, many = fit_codes(df, ["s", "t"]), fit_codes(df, ["s", "t"], sort_rows=10)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_global_index(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS k").repartition(7)
    assert all(r["k"] == r["idx"] for r in global_index(df, ["k"]).collect())


@pytest.mark.parametrize("sort_rows", [10**6, 20])
def test_medians(spark, sort_rows):
    draw = random.Random(3)
    rows = [(g, round(draw.expovariate(0.1), 1)) for g in "abc" for _ in range(draw.randint(90, 333))]
    rows += [("tied", 4.0)] * 200 + [("pair", 1.0), ("pair", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = pd.DataFrame(rows, columns=["g", "v"]).dropna().groupby("g").v.median().to_dict()
    got = median(df, F.col("v"), ["g"], sort_rows=sort_rows).collect()
    assert {r["g"]: r["median"] for r in got} == want


@pytest.mark.parametrize("sort_rows", [10**6, 25])
def test_order_statistic(spark, sort_rows):
    values = [float((i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for rank in (1, 250, 451, 500):
        row = order_statistic(df, F.col("v"), F.lit(rank), sort_rows=sort_rows).first()
        assert row["value"] == sorted(values)[rank - 1] and row["n"] == 500
    assert order_statistic(df, F.col("v"), F.lit(501), sort_rows=sort_rows).first()["value"] is None


def series(n=600):
    draw = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        site = "hot" if i % 3 else draw.choice(["a", "b", None])
        season = draw.choice(["s", "w"]) if i % 50 else None
        value = None if i % 11 == 0 else round(draw.expovariate(0.005), 1)
        rows.append((i, site, season, start + datetime.timedelta(minutes=i * 7 % n), value))
    return rows


SERIES = "id int, site string, season string, t timestamp_ntz, y double"


def expected_history(rows):
    df = pd.DataFrame(rows, columns=["id", "site", "season", "t", "y"]).sort_values("t")
    groups = df.groupby(["site", "season"])["y"]
    df["m"] = groups.transform(lambda x: x.shift(1).rolling(5, min_periods=1).mean())

    def rate(x):
        past = x.shift(1) >= 280
        return past.rolling(len(past), min_periods=1).mean()

    df["r"] = groups.transform(rate)
    return df.set_index("id")[["m", "r"]]


@pytest.mark.parametrize("limit", [10**6, 50, 7])
def test_recent_history(spark, limit):
    rows = series()
    df = spark.createDataFrame(rows, SERIES)
    out = recent_history(
        df, "site", "season", "t", "y", mean_name="m", rate_name="r", rows=limit
    ).toPandas()
    out, want = out.set_index("id").sort_index(), expected_history(rows).sort_index()
    for c in ("m", "r"):
        a, b = out[c].to_numpy(float), want[c].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all()
        assert np.nanmax(np.abs(a - b)) < 1e-9


def test_first_row_of_history(spark):
    df = spark.createDataFrame([(1, "a", "s", datetime.datetime(2024, 1, 1), 500.0)], SERIES)
    row = recent_history(df, "site", "season", "t", "y").first()
    assert row["Site_Season_Average"] is None and row["Site_Historical_Exceedance_Rate"] == 0.0


@pytest.mark.parametrize("limit", [10**6, 40])
def test_past_features_brute_force(spark, limit):
    rows = series(300)
    df = spark.createDataFrame(rows, SERIES)
    specs = [
        Past("a", "y", "sum", 4, 2),
        Past("b", "y", "min", None),
        Past("c", "y", "max", 3),
        Past("d", "y", "count", None),
    ]
    got = {r["id"]: (r["a"], r["b"], r["c"], r["d"]) for r in past_features(df, ["site"], "t", specs, limit).collect()}
    for i, site, _, t, _ in rows:
        past = [r[4] for r in sorted(rows, key=lambda r: r[3]) if r[1] == site and r[3] < t]
        known = [v for v in past if v is not None]
        four, three = ([v for v in past[-n:] if v is not None] for n in (4, 3))
        want = (
            sum(four) if len(four) >= 2 else None,
            min(known) if known else None,
            max(three) if three else None,
            len(known) or None,
        )
        assert got[i] == pytest.approx(want), i


@pytest.mark.parametrize("limit", [10**6, 30])
def test_sequence_position(spark, limit):
    df = spark.createDataFrame(series(400), SERIES)
    out = sequence_position(df, "site", "t", rows=limit).toPandas().sort_values("t")
    assert (out.groupby("site", dropna=False).cumcount() == out.position).all()


def test_joins_match_missing_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(None, 5), (2, 6)], "k int, b int")
    got = sorted(map(tuple, align(a, b, ["k"]).collect()), key=str)
    assert got == [(1, "x", None), (None, "y", 5)]
    twice = a.unionByName(a)
    assert equi_join(twice, twice.withColumnRenamed("a", "c"), ["k"]).count() == 8


def test_join_models(spark):
    base = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k int, y double")
    a = base.withColumn("predictions", F.lit(1.0))
    b = base.filter("k = 1").withColumns({"q_0.05": F.lit(0.5), "predictions": F.lit(2.0)})
    out = join_models({"a": a, "b": b})
    assert out.columns == ["k", "y", "a", "q_0.05", "b"]
    assert [tuple(r) for r in out.collect()] == [(1, 10.0, 1.0, 0.5, 2.0)]


def test_drop_members_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert sorted(str(r["s"]) for r in drop_members(df, "s", ["a"]).collect()) == ["None", "b"]


def test_table_diff(spark):
    left = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y")], "k int, v double, s string")
    right = spark.createDataFrame([(1, 1.0, "z"), (3, 3.0, "w")], "k int, v double, s string")
    got = sorted(map(tuple, table_diff(left, right, ["k"]).collect()), key=str)
    assert got == [
        (1, "s", "x", "z"),
        (2, "s", "y", None),
        (3, "s", None, "w"),
        (3, "v", None, "3.0"),
    ]


def test_folds_agree(spark):
    periods = parse_periods(["2021-10-01_2022-10-01", "2022-10-01_2023-10-01"])
    days = [datetime.datetime(2019, 1, 1) + datetime.timedelta(days=11 * i) for i in range(160)]
    rows = [(i, d, "gone" if i % 4 == 0 else None if i % 5 == 0 else "s") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "id int, t timestamp_ntz, site string")
    flat = assign_folds(df, periods, "t", "site", ["gone"])
    nested = assign_folds(df, periods, "t", nested=True)

    def ids(frame):
        return sorted(r["id"] for r in frame.collect())

    for p in periods:
        train, test = fold_tables(df, p, "t", "site", ["gone"])
        assert ids(test) == [
            i for i, d, s in rows if p.start <= d < p.end and s != "gone"
        ]
        assert ids(train) == [i for i, d, _ in rows if d < p.start]
        mine = flat.filter(F.col("fold") == p.fold)
        assert ids(mine.filter("role = 'train'")) == ids(train)
        assert ids(mine.filter("role = 'test'")) == ids(test)
        mine = nested.filter(F.col("fold") == p.fold)
        for role, part in zip(("train", "validation", "test"), nested_fold_tables(df, p, "t"), strict=True):
            assert ids(mine.filter(F.col("role") == role)) == ids(part)
    assert "Exchange" not in flat._jdf.queryExecution().toString()


def test_key_split_is_repeatable(spark):
    df = spark.range(5000)
    a = {r["id"]: r["role"] for r in split_by_key(df, ["id"]).collect()}
    b = {r["id"]: r["role"] for r in split_by_key(df.repartition(3), ["id"]).collect()}
    assert a == b
    share = sum(v == "train" for v in a.values()) / 5000
    assert abs(share - 0.8) < 0.03
