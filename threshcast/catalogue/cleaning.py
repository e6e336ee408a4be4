"""Queries on projection, parsing, deduplication, missing values, encoding, features."""

from pyspark.sql import functions as F

from threshcast.catalogue.base import OBS, observations, query, rounded, table
from threshcast.functions.columns import (
    at_least,
    calendar_columns,
    clip_upper,
    constrain_forecast,
    holiday_flag,
    markers_to_null,
    model_title,
    parse_us_time,
    period_bounds,
    positive_or,
    shore_class,
    threshold_label,
    time_label,
    to_minute,
    year_before,
)
from threshcast.functions.fixed_values import HOLIDAYS, OBSERVATION_COLUMNS
from threshcast.operators.cleaning import (
    as_categories,
    fill_missing,
    fill_values,
    keep_first,
    pick_columns,
    profile,
    project,
    split_target,
)
from threshcast.operators.encoding import apply_codes, fit_codes, label_encode
from threshcast.operators.features import holiday_join, holiday_table
from threshcast.plans.forecasting import prepare


@query(
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
                 l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem)
WHERE rn = 1"""
)
def clean_dedupe_first(spark, folder):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    order += ["l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    out = keep_first(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], order)
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


@query(
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"""
)
def strict_projection(spark, folder):
    orders = table(spark, folder, "orders")
    return project(orders, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("""SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part""")
def columns_by_rule(spark, folder):
    part = table(spark, folder, "part")
    names = pick_columns(part, without=["p_name", "p_brand", "p_type"], prefix="p_")
    return rounded(part.select(*names))


@query(
    """SELECT f.o_orderkey, f.o_orderstatus, f.o_orderpriority, t.o_totalprice
FROM orders f JOIN orders t USING (o_orderkey)"""
)
def feature_target_split(spark, folder):
    orders = table(spark, folder, "orders").drop("o_custkey", "o_orderdate")
    features, target = split_target(orders, "o_totalprice", ["o_orderkey"])
    return features.join(target, "o_orderkey")


_US_TEXT = """us AS (
  SELECT o_orderkey,
         month(d) || '/' || day(d) || '/' || lpad(CAST(year(d) % 100 AS VARCHAR), 2, '0')
           || ' ' || (o_orderkey % 24) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS txt,
         d
  FROM (SELECT o_orderkey,
               CAST(o_orderdate - to_years(CAST(o_orderkey % 60 AS INTEGER)) AS DATE) AS d
        FROM orders))"""


def _us_text(spark, folder):
    back = F.make_interval(years=-(F.col("o_orderkey") % 60).cast("int"))
    orders = table(spark, folder, "orders")
    orders = orders.withColumn("d", (F.col("o_orderdate") + back).cast("date"))
    k = F.col("o_orderkey")
    text = F.concat_ws(
        "/", F.month("d"), F.dayofmonth("d"), F.lpad((F.year("d") % 100).cast("string"), 2, "0")
    )
    clock = F.concat_ws(":", k % 24, F.lpad((k % 60).cast("string"), 2, "0"))
    return orders.select("o_orderkey", F.concat_ws(" ", text, clock).alias("txt"))


@query(
    "WITH "
    + _US_TEXT
    + """ SELECT o_orderkey, txt,
  make_timestamp(CASE WHEN year(d) % 100 >= 69 THEN 1900 ELSE 2000 END + year(d) % 100,
                 month(d), day(d), o_orderkey % 24, o_orderkey % 60, 0) AS t
FROM us"""
)
def parse_us_timestamp(spark, folder):
    return _us_text(spark, folder).withColumn("t", parse_us_time("txt"))


@query(
    "WITH "
    + _US_TEXT
    + """ SELECT o_orderkey,
  CASE WHEN o_orderkey % 5 <> 0 THEN
  make_timestamp(CASE WHEN year(d) % 100 >= 69 THEN 1900 ELSE 2000 END + year(d) % 100,
                 month(d), day(d), o_orderkey % 24, o_orderkey % 60, 0) END AS t
FROM us"""
)
def parse_us_timestamp_lenient(spark, folder):
    text = _us_text(spark, folder)
    broken = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), "txt")).otherwise(F.col("txt"))
    return text.select("o_orderkey", parse_us_time(broken, strict=False).alias("t"))


@query(
    """SELECT event_id, date_trunc('minute', ts) AS t_minute,
  strftime(ts, '%Y-%m-%d %H:%M') AS label, strftime(ts, '%Y-%m-%d') AS day,
  strftime(ts - INTERVAL 1 YEAR, '%Y-%m-%d') AS year_before FROM events"""
)
def time_labels(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        to_minute("ts").alias("t_minute"),
        time_label("ts").alias("label"),
        F.to_date("ts").cast("string").alias("day"),
        year_before("ts").cast("string").alias("year_before"),
    )


@query(
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS "YEAR",
  CAST(month(o_orderdate) AS BIGINT) AS "MONTH", CAST(weekofyear(o_orderdate) AS BIGINT) AS "WEEK",
  CAST(isodow(o_orderdate) - 1 AS BIGINT) AS "DAY_OF_WEEK",
  CAST(isodow(o_orderdate) >= 6 AS BIGINT) AS "WEEKEND",
  CAST(hour(o_orderdate) AS BIGINT) AS "TIME_OF_DAY" FROM orders"""
)
def calendar_features(spark, folder):
    orders = table(spark, folder, "orders")
    columns = calendar_columns("o_orderdate")
    return rounded(orders.select("o_orderkey", *[c.alias(n) for n, c in columns.items()]))


_HOLIDAY_ROWS = ", ".join(
    "('{}', {}, {})".format(n.replace("'", "''"), int(a.replace("-", "")), int(b.replace("-", "")))
    for n, a, b in HOLIDAYS
)
# every time of the events is moved over the year so that all ranges are met
_HOLIDAY_SQL = f"""WITH cal(name, a, b) AS (VALUES {_HOLIDAY_ROWS}),
e AS (SELECT event_id, ts + to_days(CAST(event_id % 365 AS INTEGER)) AS t0 FROM events),
e2 AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', t0) ELSE t0 END AS t FROM e)
SELECT event_id, CAST(max(CASE WHEN a IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS "HOLIDAY_FLAG"
FROM e2 LEFT JOIN cal ON t >= make_timestamp(year(t), a // 100, a % 100, 0, 0, 0)
  AND t <= make_timestamp(year(t), b // 100, b % 100, 0, 0, 0) GROUP BY event_id"""


def _spread_over_year(spark, folder):
    ev = table(spark, folder, "events")
    moved = F.col("ts") + F.make_interval(days=(F.col("event_id") % 365).cast("int"))
    t = F.when(F.col("event_id") % 3 == 0, F.to_date(moved).cast("timestamp_ntz")).otherwise(moved)
    return ev.select("event_id", t.alias("t"))


@query(_HOLIDAY_SQL)
def holiday_flags(spark, folder):
    flag = holiday_flag("t").cast("long").alias("HOLIDAY_FLAG")
    return _spread_over_year(spark, folder).select("event_id", flag)


@query(_HOLIDAY_SQL)
def holiday_range_join(spark, folder):
    out = holiday_join(_spread_over_year(spark, folder), holiday_table(spark), "t")
    return rounded(out.select("event_id", "HOLIDAY_FLAG"))


@query(
    """WITH a AS (SELECT event_id,
  CASE WHEN event_id % 11 <> 0 THEN CAST((event_id * 37) % 360 AS DOUBLE) END AS wind,
  CAST((user_id * 53) % 360 AS DOUBLE) AS facing FROM events),
b AS (SELECT event_id, abs(wind - ((facing + 180) % 360)) AS d0 FROM a),
c AS (SELECT event_id, CASE WHEN d0 IS NOT NULL THEN least(d0, 360 - d0) END AS d FROM b)
SELECT event_id, CASE WHEN d < 45 THEN 'Onshore' WHEN d > 135 THEN 'Offshore'
  WHEN d IS NOT NULL THEN 'Alongshore' ELSE 'Unknown' END AS shore FROM c"""
)
def wind_shore_class(spark, folder):
    ev = table(spark, folder, "events")
    wind = F.when(F.col("event_id") % 11 != 0, F.pmod(F.col("event_id") * 37, F.lit(360)))
    facing = F.pmod(F.col("user_id") * 53, F.lit(360)).cast("double")
    return ev.select("event_id", shore_class(wind.cast("double"), facing).alias("shore"))


@query(
    "WITH "
    + OBS
    + """ SELECT event_id, CASE WHEN y > 100 THEN 100.0::DOUBLE ELSE y END AS clipped,
  CASE WHEN y >= 100 THEN 'EXCEEDANCE' ELSE 'SAFE' END AS label,
  coalesce(y >= 50, false) AS warned,
  round_even(CASE WHEN y - 40 < 5 THEN 5 ELSE y - 40 END, 0) AS constrained,
  CASE WHEN y - 40 <= 0 THEN 5.0::DOUBLE ELSE round(y - 40, 6) END AS positive FROM obs"""
)
def limits_and_labels(spark, folder):
    moved = F.col("y") - 40
    out = observations(spark, folder).select(
        "event_id",
        clip_upper("y", 100).alias("clipped"),
        threshold_label("y", 100).alias("label"),
        at_least("y", 50).alias("warned"),
        constrain_forecast(moved).alias("constrained"),
        positive_or(moved).alias("positive"),
    )
    return rounded(out)


@query(
    """WITH d AS (SELECT p_partkey,
    CASE WHEN p_partkey % 13 = 0 THEN 'nan' ELSE p_type END AS p_type,
    CAST(p_size AS VARCHAR) AS p_size FROM part),
t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM d)),
s AS (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS code FROM (SELECT DISTINCT p_size FROM d))
SELECT p_partkey, t.code AS p_type, s.code AS p_size
FROM d JOIN t USING (p_type) JOIN s USING (p_size)"""
)
def label_encoding(spark, folder):
    part = table(spark, folder, "part")
    kind = F.when(F.col("p_partkey") % 13 != 0, F.col("p_type"))
    part = part.select("p_partkey", kind.alias("p_type"), F.col("p_size").cast("string").alias("p_size"))
    return label_encode(part, ["p_type", "p_size"])


@query(
    """SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(value > 50 AS VARCHAR) AS high FROM events"""
)
def category_casts(spark, folder):
    """Category columns as text, whatever their type; those that are absent are passed over."""
    ev = table(spark, folder, "events").select("event_id", "user_id", "event_type", (F.col("value") > 50).alias("high"))
    return as_categories(ev, ["user_id", "event_type", "high", "no_such_column"])


_UNSEEN_SQL = """WITH seen AS (SELECT DISTINCT p_brand FROM part WHERE p_size < 2),
c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM seen)
SELECT p_partkey, coalesce(c.code, (SELECT count(*) FROM c)) AS p_brand
FROM part LEFT JOIN c USING (p_brand)"""


@query(_UNSEEN_SQL)
def label_encoding_unseen(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    codes = fit_codes(part.filter("p_size < 2"), ["p_brand"])
    return apply_codes(part.drop("p_size"), codes, ["p_brand"])


@query(
    """SELECT c_custkey, row_number() OVER (ORDER BY c_name) - 1 AS c_name FROM customer"""
)
def label_encoding_many(spark, folder):
    """Codes by the range-partitioned sort used when a column has very many labels."""
    names = table(spark, folder, "customer").select("c_custkey", "c_name")
    return apply_codes(names, fit_codes(names, ["c_name"], sort_rows=100), ["c_name"])


@query(
    "WITH "
    + OBS
    + " SELECT event_id, round(coalesce(y, (SELECT avg(y) FROM obs)), 6) AS y FROM obs"
)
def impute_mean(spark, folder):
    out = observations(spark, folder).select("event_id", "y")
    return rounded(fill_missing(out, "mean", ["y"]))


_IMPUTE_MEDIAN = (
    "WITH "
    + OBS
    + " SELECT event_id, round(coalesce(y, (SELECT median(y) FROM obs)), 6) AS y FROM obs"
)


@query(_IMPUTE_MEDIAN)
def impute_median(spark, folder):
    out = observations(spark, folder).select("event_id", "y")
    return rounded(fill_missing(out, "median", ["y"]))


@query(_IMPUTE_MEDIAN)
def impute_median_by_selection(spark, folder):
    """The same median by repeated selection, as for columns too long for one sort."""
    out = observations(spark, folder).select("event_id", "y")
    return rounded(fill_missing(out, "median", ["y"], sort_rows=100))


@query(
    """WITH o AS (SELECT round(avg(l_quantity), 6) AS a, round(avg(l_discount), 6) AS b,
  round(avg(l_tax), 6) AS c FROM lineitem)
SELECT 'l_quantity' AS "column", a AS mean FROM o UNION ALL SELECT 'l_discount', b FROM o
UNION ALL SELECT 'l_tax', c FROM o"""
)
def impute_statistics(spark, folder):
    lines = table(spark, folder, "lineitem")
    means = fill_values(lines, "mean", ["l_quantity", "l_discount", "l_tax"])
    return rounded(spark.createDataFrame(list(means.items()), "column string, mean double"))


@query(
    """WITH k AS (SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS n FROM events)
SELECT event_id, CASE WHEN n % 7 = 0 OR n % 11 = 0 THEN NULL ELSE CAST(n AS DOUBLE) END AS k FROM k"""
)
def null_markers(spark, folder):
    digits = F.regexp_extract("props", r"(\d+)", 1)
    n = digits.cast("long")
    text = F.when(n % 7 == 0, "NA").when(n % 11 == 0, "?").otherwise(digits)
    ev = table(spark, folder, "events")
    return ev.select("event_id", markers_to_null(text).try_cast("double").alias("k"))


@query(
    """SELECT (SELECT count(*) FROM orders) AS n_rows, CAST(6 AS BIGINT) AS n_columns,
'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns"""
)
def table_profile(spark, folder):
    return profile(table(spark, folder, "orders"))


@query("SELECT DISTINCT year(o_orderdate)::BIGINT AS y, o_orderpriority FROM orders")
def distinct_sorted(spark, folder):
    orders = table(spark, folder, "orders")
    years = F.year("o_orderdate").cast("long").alias("y")
    return orders.select(years, "o_orderpriority").distinct().orderBy("y", "o_orderpriority")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Lightgbm' WHEN 1 THEN 'Linear Regression'
  ELSE 'Plain' END AS title,
  make_timestamp(2000 + (o_orderkey % 20), 10, 1, 0, 0, 0) AS start_at,
  make_timestamp(2001 + (o_orderkey % 20), 10, 1, 0, 0, 0) AS end_at FROM orders"""
)
def text_rules(spark, folder):
    k = F.col("o_orderkey")
    name = (
        F.when(k % 3 == 0, "lightgbm_predictions")
        .when(k % 3 == 1, "linear_regression_predictions")
        .otherwise("plain")
    )
    period = F.concat(
        (2000 + k % 20).cast("string"), F.lit("-10-01_"), (2001 + k % 20).cast("string"), F.lit("-10-01")
    )
    start, end = period_bounds(period)
    orders = table(spark, folder, "orders")
    return orders.select(
        "o_orderkey", model_title(name).alias("title"), start.alias("start_at"), end.alias("end_at")
    )


def raw_observations(spark, folder):
    """Events widened to the full observation table; each row also comes a second time with a
    larger value, so that cleaning has something to do."""
    ev = table(spark, folder, "events")
    e, u = F.col("event_id"), F.col("user_id")
    text = F.concat_ws(
        " ", F.date_format("ts", "M/d/yy"), F.date_format("ts", "H:mm")
    )
    columns = {
        "DateTime": text,
        "SITE_NAME": F.concat(F.lit("site "), u.cast("string")),
        "Harbour": F.concat(F.lit("h"), (u % 3).cast("string")),
        "Enterococci": F.col("value") * 25,
        "Season": F.col("event_type"),
        "tidal_state": F.when(e % 2 == 0, "high").otherwise("low"),
        "Catchment_slope": (u % 7).cast("double") + 1,
        "Latitude": u / 10.0 - 40,
        "Longitude": u / 20.0 + 170,
        "beach_orientation_angle": F.pmod(u * 53, F.lit(360)).cast("double"),
        "wind_direction_3h": F.pmod(e * 37, F.lit(360)).cast("double"),
        "wind_direction_6h": F.when(e % 11 != 0, F.pmod(e * 41, F.lit(360)).cast("double")),
        "wind_direction_12h": F.pmod(e * 43, F.lit(360)).cast("double"),
    }
    texts = ("Shallowness", "Soil_type", "Landcover_catchment", "watercraft_use")
    for i, c in enumerate([*texts, "sewage_discharge_beach", "high_intensity_agri_beach"]):
        columns[c] = F.concat(F.lit("c"), (u % (i + 2)).cast("string"))
    for i, c in enumerate([c for c in OBSERVATION_COLUMNS if c not in columns]):
        columns[c] = F.pmod(e * (i + 3), F.lit(101)) / 10.0
    raw = ev.select(*[columns[c].alias(c) for c in OBSERVATION_COLUMNS], e.alias("_row"))
    again = raw.withColumn("Enterococci", F.col("Enterococci") + 1).withColumn(
        "_row", F.col("_row") + 1_000_000_000
    )
    return raw.unionByName(again)


@query(
    f"""WITH cal(name, a, b) AS (VALUES {_HOLIDAY_ROWS}),
raw AS (SELECT event_id, 'site ' || user_id AS s, date_trunc('minute', ts) AS t, event_type AS season,
   value * 25 AS v, user_id AS u FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY event_id) AS rn FROM raw),
c AS (SELECT * REPLACE (CASE WHEN v > 10000 THEN 10000 ELSE v END AS v) FROM ranked WHERE rn = 1),
f AS (SELECT *, avg(v) OVER w5 AS m,
   coalesce(sum(CASE WHEN v >= 280 THEN 1 ELSE 0 END) OVER wall, 0)
     / row_number() OVER (PARTITION BY s, season ORDER BY t) AS r
 FROM c WINDOW w5 AS (PARTITION BY s, season ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
   wall AS (PARTITION BY s, season ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w AS (SELECT *, CAST((event_id * 37) % 360 AS DOUBLE) AS w3,
   CASE WHEN event_id % 11 <> 0 THEN CAST((event_id * 41) % 360 AS DOUBLE) END AS w6,
   ((u * 53) % 360 + 180) % 360 AS back FROM f)
SELECT s AS "SITE_NAME", t AS "DateTime", round(v, 6) AS "Enterococci",
  CAST(weekofyear(t) AS BIGINT) AS "WEEK", CAST(isodow(t) - 1 AS BIGINT) AS "DAY_OF_WEEK",
  (SELECT CAST(count(*) > 0 AS BIGINT) FROM cal
    WHERE t >= make_timestamp(year(t), a // 100, a % 100, 0, 0, 0)
      AND t <= make_timestamp(year(t), b // 100, b % 100, 0, 0, 0)) AS "HOLIDAY_FLAG",
  CASE WHEN least(abs(w3 - back), 360 - abs(w3 - back)) < 45 THEN 'Onshore'
       WHEN least(abs(w3 - back), 360 - abs(w3 - back)) > 135 THEN 'Offshore' ELSE 'Alongshore' END AS wind_shore_3h,
  CASE WHEN w6 IS NULL THEN 'Unknown' WHEN least(abs(w6 - back), 360 - abs(w6 - back)) < 45 THEN 'Onshore'
       WHEN least(abs(w6 - back), 360 - abs(w6 - back)) > 135 THEN 'Offshore' ELSE 'Alongshore' END AS wind_shore_6h,
  round(m, 6) AS "Site_Season_Average", round(r, 6) AS "Site_Historical_Exceedance_Rate"
FROM w"""
)
def feature_table(spark, folder):
    """Cleaning and all features, from raw text times to the table models learn from."""
    out = prepare(raw_observations(spark, folder))
    shown = ["SITE_NAME", "DateTime", "Enterococci", "WEEK", "DAY_OF_WEEK", "HOLIDAY_FLAG"]
    shown += ["wind_shore_3h", "wind_shore_6h", "Site_Season_Average"]
    return rounded(out.select(*shown, "Site_Historical_Exceedance_Rate"))
