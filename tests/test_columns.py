import datetime

import pytest
from pyspark.sql import functions as F

from threshcast.functions import columns as C
from threshcast.functions.fixed_values import HOLIDAYS, OBSERVATION_COLUMNS
from threshcast.operators.features import add_shore_classes, holiday_join, holiday_table


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_observation_layout():
    assert len(OBSERVATION_COLUMNS) == 32 and len(set(OBSERVATION_COLUMNS)) == 32
    assert len(HOLIDAYS) == 9


def test_limits_keep_missing(spark):
    out = values(
        spark,
        [(None,), (3.0,), (20000.0,)],
        "v double",
        up=C.clip_upper("v"),
        low=C.clip_lower("v", 5),
        both=C.clip_range("v", 4, 200),
    )
    assert out == [(None, None, None), (3.0, 5.0, 4.0), (10000.0, 20000.0, 200.0)]


def test_forecast_constraint_rounds_half_to_even(spark):
    rows = [(2.5,), (6.5,), (7.5,), (-1.0,), (None,)]
    out = values(spark, rows, "v double", c=C.constrain_forecast("v"))
    assert [r[0] for r in out] == [5.0, 6.0, 8.0, 5.0, None]


def test_threshold_label_of_missing_is_safe(spark):
    out = values(
        spark, [(280.0,), (279.9,), (None,)], "v double", c=C.threshold_label("v"), m=C.at_least("v")
    )
    assert out == [("EXCEEDANCE", True), ("SAFE", False), ("SAFE", False)]


def test_nan_becomes_null(spark):
    out = values(spark, [(float("nan"),), (1.0,)], "v double", c=C.nan_to_null("v"))
    assert [r[0] for r in out] == [None, 1.0]


def test_us_times(spark):
    rows = [("1/2/21 9:30",), ("01/02/21 09:30",), ("6/30/75 0:00",), ("12/31/68 23:59",)]
    at = datetime.datetime
    want = [at(2021, 1, 2, 9, 30), at(2021, 1, 2, 9, 30), at(1975, 6, 30), at(2068, 12, 31, 23, 59)]
    for strict in (True, False):
        out = values(spark, rows, "s string", t=C.parse_us_time("s", strict))
        assert [r[0] for r in out] == want


def test_bad_us_time(spark):
    rows = [("13/40/21 9:30",), ("soon",), (None,)]
    out = values(spark, rows, "s string", t=C.parse_us_time("s", strict=False))
    assert [r[0] for r in out] == [None, None, None]
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|parse"):
        values(spark, rows[1:2], "s string", t=C.parse_us_time("s"))


def test_calendar(spark):
    rows = [(datetime.datetime(2021, 1, 1, 13, 5),), (datetime.datetime(2021, 1, 3),)]
    out = values(spark, rows, "t timestamp_ntz", **C.calendar_columns("t"))
    assert out == [(2021, 1, 53, 4, 0, 13), (2021, 1, 53, 6, 1, 0)]


def test_to_minute(spark):
    rows = [(datetime.datetime(2021, 1, 1, 13, 5, 59, 999999),)]
    out = values(spark, rows, "t timestamp_ntz", t=C.to_minute("t"), h=C.to_hour("t"))
    assert out == [(datetime.datetime(2021, 1, 1, 13, 5), datetime.datetime(2021, 1, 1, 13))]


HOLIDAY_CASES = [
    (datetime.datetime(2021, 1, 1), 1),
    (datetime.datetime(2021, 1, 6), 1),
    (datetime.datetime(2021, 1, 6, 9, 30), 0),
    (datetime.datetime(2021, 1, 5, 23, 59), 1),
    (datetime.datetime(2021, 4, 22, 10), 1),
    (datetime.datetime(2021, 4, 30, 10), 0),
    (datetime.datetime(2020, 12, 31), 1),
    (datetime.datetime(2020, 12, 31, 0, 1), 0),
    (datetime.datetime(2020, 7, 1), 0),
]


def test_holidays_both_forms(spark):
    df = spark.createDataFrame(HOLIDAY_CASES, "t timestamp_ntz, want int")
    for out in (
        df.withColumn("HOLIDAY_FLAG", C.holiday_flag("t")),
        holiday_join(df, holiday_table(spark), "t"),
    ):
        assert all(r["want"] == r["HOLIDAY_FLAG"] for r in out.collect())


def test_holiday_range_over_new_year(spark):
    calendar = [("turn of the year", "12-30", "01-02")]
    cases = [
        (datetime.datetime(2020, 12, 30), 1),
        (datetime.datetime(2020, 12, 31, 12), 1),
        (datetime.datetime(2021, 1, 1, 12), 1),
        (datetime.datetime(2021, 1, 2), 1),
        (datetime.datetime(2021, 1, 2, 12), 0),
        (datetime.datetime(2021, 6, 1), 0),
    ]
    df = spark.createDataFrame(cases, "t timestamp_ntz, want int")
    flagged = df.withColumn("HOLIDAY_FLAG", C.holiday_flag("t", calendar))
    joined = holiday_join(df, holiday_table(spark, calendar), "t")
    for out in (flagged, joined):
        assert all(r["want"] == r["HOLIDAY_FLAG"] for r in out.collect())


def test_shore_classes(spark):
    # facing 0: the opposite direction is 180
    rows = [(180.0, 0.0), (225.0, 0.0), (315.0, 0.0), (316.0, 0.0), (350.0, 190.0), (None, 0.0)]
    out = values(spark, rows, "w double, o double", c=C.shore_class("w", "o"))
    assert [r[0] for r in out] == [
        "Onshore", "Alongshore", "Alongshore", "Offshore", "Onshore", "Unknown",
    ]


def test_shore_windows_follow_present_columns(spark):
    df = spark.createDataFrame(
        [(10.0, 20.0)], "wind_direction_3h double, beach_orientation_angle double"
    )
    assert add_shore_classes(df).columns[2:] == ["wind_shore_3h"]


def test_row_median_and_sort(spark):
    rows = [(3.0, 1.0, 2.0, 10.0), (3.0, None, 1.0, 2.0), (None, None, None, None)]
    names = ["q_0.1", "q_0.5", "q_0.7", "q_0.9"]
    schema = ", ".join(f"`{n}` double" for n in names)
    out = values(spark, rows, schema, m=C.row_median(names), s=C.sorted_values(names))
    assert [r[0] for r in out] == [2.5, 2.0, None]
    assert out[1][1] == [1.0, 2.0, 3.0, None]


def test_text_rules(spark):
    rows = [("linear_regression_predictions",), ("mlp",)]
    out = values(spark, rows, "s string", c=C.model_title("s"))
    assert [r[0] for r in out] == ["Linear Regression", "Mlp"]
    start, end = C.period_bounds(F.lit("2021-10-01_2022-10-01"))
    assert values(spark, [(1,)], "x int", a=start, b=end) == [
        (datetime.datetime(2021, 10, 1), datetime.datetime(2022, 10, 1))
    ]


def test_year_before_leap_day(spark):
    out = values(spark, [(datetime.date(2020, 2, 29),)], "d date", c=C.year_before("d"))
    assert out == [(datetime.date(2019, 2, 28),)]
