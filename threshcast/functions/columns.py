"""Scalar column expressions. All of them stay inside generated JVM code.

A missing value is NULL everywhere; :func:`nan_to_null` is applied where data is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threshcast.functions.fixed_values import (
    EXCEEDANCE,
    FORECAST_MINIMUM,
    HOLIDAYS,
    MISSING_LABEL,
    NULL_MARKERS,
    TARGET_MAXIMUM,
)


def col(c: str | Column) -> Column:
    """Column of exactly this name; a dot in a name (``q_0.05``) is no field access."""
    return F.col(c if c.startswith("`") else f"`{c}`") if isinstance(c, str) else c


def cols(names: Iterable[str]) -> list[Column]:
    return [col(c) for c in names]


# -- missing values and limits -------------------------------------------------------------


def nan_to_null(c: str | Column) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))


def markers_to_null(c: str | Column, markers: Sequence[str] = NULL_MARKERS) -> Column:
    """Text with missing-value markers (and empty text) as NULL."""
    text = F.trim(col(c))
    return F.when(~text.isin([*markers, ""]), text)


def clip_upper(c: str | Column, upper: float = TARGET_MAXIMUM) -> Column:
    """Upper limit that keeps NULL (``least`` would turn NULL into the limit)."""
    c = col(c)
    return F.when(c > upper, F.lit(float(upper))).otherwise(c)


def clip_lower(c: str | Column, lower: float) -> Column:
    c = col(c)
    return F.when(c < lower, F.lit(float(lower))).otherwise(c)


def clip_range(c: str | Column, lower: float, upper: float) -> Column:
    return clip_upper(clip_lower(c, lower), upper)


def constrain_forecast(c: str | Column, lower: float = FORECAST_MINIMUM) -> Column:
    """Floor, then round half to even to a whole number."""
    return F.rint(clip_lower(c, lower))


def round_even(c: str | Column, digits: int) -> Column:
    """Round half to even after scaling by a power of ten."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / scale


def positive_or(c: str | Column, replacement: float = FORECAST_MINIMUM) -> Column:
    c = col(c)
    return F.when(c <= 0, F.lit(float(replacement))).otherwise(c)


# -- threshold classes ---------------------------------------------------------------------


def at_least(c: str | Column, threshold: float = EXCEEDANCE) -> Column:
    """Boolean mask; a missing value is not at the threshold."""
    return F.coalesce(col(c) >= threshold, F.lit(False))


def threshold_label(c: str | Column, threshold: float = EXCEEDANCE) -> Column:
    return F.when(at_least(c, threshold), "EXCEEDANCE").otherwise("SAFE")


# -- time ----------------------------------------------------------------------------------


def parse_us_time(c: str | Column, strict: bool = True) -> Column:
    """``month/day/two-digit-year hour:minute``; 69 to 99 mean the 1900s.

    ``strict`` raises on text that is no such time, otherwise it becomes NULL.
    """
    if strict:
        parsed = F.to_timestamp_ntz(col(c), F.lit("M/d/yy H:mm"))
        century = F.make_interval(years=F.lit(-100))
        return F.when(F.year(parsed) >= 2069, parsed + century).otherwise(parsed)
    shape = r"^(\d{1,2})/(\d{1,2})/(\d{2}) (\d{1,2}):(\d{2})$"
    month, day, yy, hour, minute = (
        F.regexp_extract(col(c), shape, i).try_cast("int") for i in range(1, 6)
    )
    year = F.when(yy >= 69, yy + 1900).otherwise(yy + 2000)
    return F.try_make_timestamp_ntz(year, month, day, hour, minute, F.lit(0))


def to_minute(c: str | Column) -> Column:
    """Seconds off. Local times are never routed through a time zone."""
    t = col(c)
    return t - F.make_dt_interval(secs=F.date_part(F.lit("SECOND"), t))


def to_hour(c: str | Column) -> Column:
    t = to_minute(c)
    return t - F.make_dt_interval(mins=F.minute(t))


def at_midnight(c: str | Column) -> Column:
    return col(c) == F.to_date(col(c)).cast("timestamp_ntz")


def time_label(c: str | Column, seconds: bool = False) -> Column:
    return F.substring(col(c).cast("string"), 1, 19 if seconds else 16)


def calendar_columns(time: str | Column) -> dict[str, Column]:
    """Year, month, ISO week, weekday (Monday 0), weekend flag and hour."""
    t = col(time)
    weekday = F.weekday(t)
    return {
        "YEAR": F.year(t),
        "MONTH": F.month(t),
        "WEEK": F.weekofyear(t),
        "DAY_OF_WEEK": weekday,
        "WEEKEND": (weekday >= 5).cast("int"),
        "TIME_OF_DAY": F.hour(t),
    }


def holiday_flag(
    time: str | Column, calendar: Iterable[tuple[str, str, str]] = HOLIDAYS
) -> Column:
    """1 inside a month-day range. Both ends count from 00:00, so on the last day only
    midnight itself is inside. A range whose end lies before its start wraps the year."""
    t = col(time)
    day = F.month(t) * 100 + F.dayofmonth(t)
    midnight = at_midnight(t)
    hit = F.lit(False)
    for _, first, last in calendar:
        a, b = int(first.replace("-", "")), int(last.replace("-", ""))
        after, before = day >= a, (day < b) | ((day == b) & midnight)
        hit = hit | ((after & before) if a <= b else (after | before))
    return F.coalesce(hit, F.lit(False)).cast("int")


def year_before(c: str | Column) -> Column:
    return F.add_months(col(c), -12)


# -- angles --------------------------------------------------------------------------------


def angle_between(a: str | Column, b: str | Column) -> Column:
    """Smallest difference of two directions in degrees."""
    d = F.abs(col(a) - col(b))
    return F.when(d.isNotNull(), F.least(d, 360.0 - d))


def shore_class(wind: str | Column, orientation: str | Column) -> Column:
    """Wind against the direction opposite to where the site faces."""
    d = angle_between(wind, F.pmod(col(orientation) + 180.0, F.lit(360.0)))
    return (
        F.when(d < 45, "Onshore")
        .when(d > 135, "Offshore")
        .when(d.isNotNull(), "Alongshore")
        .otherwise("Unknown")
    )


# -- text ----------------------------------------------------------------------------------


def label_text(c: str | Column) -> Column:
    """The text a category is encoded from."""
    return F.coalesce(col(c).cast("string"), F.lit(MISSING_LABEL))


def model_title(c: str | Column, suffix: str = "_predictions") -> Column:
    """Display name of a forecast column: suffix off, underscores to blanks, title case."""
    c = col(c)
    bare = F.when(
        c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))
    ).otherwise(c)
    return F.initcap(F.replace(bare, F.lit("_"), F.lit(" ")))


def period_bounds(c: str | Column) -> tuple[Column, Column]:
    """``start_end`` text to two midnights."""
    parts = F.split(col(c), "_")
    return parts[0].cast("timestamp_ntz"), parts[1].cast("timestamp_ntz")


# -- quantile arrays -----------------------------------------------------------------------


def sorted_values(cols: Sequence[str | Column]) -> Column:
    """Values of one row in ascending order, missing last."""
    return F.array_sort(F.array(*[col(c) for c in cols]))


def row_median(cols: Sequence[str | Column]) -> Column:
    """Median across columns of one row; missing values are skipped."""
    present = F.array_sort(F.array_compact(F.array(*[col(c) for c in cols])))
    n = F.size(present)
    low = F.get(present, F.floor((n - 1) / 2).cast("int"))
    high = F.get(present, F.floor(n / 2).cast("int"))
    return (low + high) / 2


# -- errors --------------------------------------------------------------------------------


def absolute_error(y: str | Column, p: str | Column) -> Column:
    return F.abs(col(y) - col(p))


def percentage_error(y: str | Column, p: str | Column) -> Column:
    return F.try_divide(100.0 * absolute_error(y, p), col(y))


# -- deterministic random choices ----------------------------------------------------------


def key_fraction(keys: Sequence[str | Column], seed: int = 42) -> Column:
    """Uniform number in [0, 1) that depends on the key and the seed alone."""
    h = F.xxhash64(*[col(k) for k in keys], F.lit(seed))
    return F.pmod(h, F.lit(1_000_000)) / 1_000_000.0
