"""Queries on the time-by-site matrix and its factors."""

from pyspark.sql import functions as F

from threshcast.catalogue.base import query, rounded, table
from threshcast.operators.factors import (
    Factors,
    dense_matrix,
    factorise,
    implicit_target_matrix,
    reconstruct,
)
from threshcast.operators.matrix import (
    complete_pairs,
    daily_fill,
    day_values,
    day_weights,
    fill_row_means,
    group_means,
    target_values,
    to_long,
    to_wide,
)
from threshcast.session import cut, fresh_path

_TYPES = ["click", "error", "purchase", "signup", "view"]


def observed_cells(spark, folder):
    """Every event as a cell of the time-by-user matrix; some have a missing value."""
    ev = table(spark, folder, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return ev.select(F.col("ts").alias("t"), F.col("user_id").alias("site"), value.alias("v"), "event_id")


def requested(spark, folder):
    """Every event's own cell, that of the next user, and one of a day without any value."""
    ev = table(spark, folder, "events").select("event_id", F.col("ts").alias("t"), F.col("user_id").alias("site"))
    part = lambda k, t, s: ev.select("event_id", F.lit(k).alias("part"), t.alias("t"), s.alias("site"))
    later = F.col("t") + F.make_interval(years=F.lit(9))
    return (
        part("own", F.col("t"), F.col("site"))
        .union(part("next", F.col("t"), F.col("site") + 1))
        .union(part("later", later, F.col("site")))
    )


_CELLS = """h AS (SELECT ts AS t, user_id AS site, CASE WHEN event_id % 7 <> 0 THEN value END AS v, event_id FROM events),
q AS (SELECT event_id, 'own' AS part, ts AS t, user_id AS site FROM events
  UNION ALL SELECT event_id, 'next', ts, user_id + 1 FROM events
  UNION ALL SELECT event_id, 'later', ts + INTERVAL 9 YEAR, user_id FROM events)"""
_DAYS = (
    _CELLS
    + """, f AS (SELECT site, CAST(t AS DATE) AS day, first(v ORDER BY t, event_id) AS v FROM h WHERE v IS NOT NULL GROUP BY ALL),
m AS (SELECT day, avg(v) AS v FROM f GROUP BY day), n AS (SELECT CAST(t AS DATE) AS day, count(DISTINCT t) AS w FROM h GROUP BY ALL)"""
)


@query(
    "WITH "
    + _CELLS
    + " SELECT q.event_id, q.part, q.t, q.site, h.v FROM q LEFT JOIN h ON h.t = q.t AND h.site = q.site"
)
def grid_complete(spark, folder):
    """Requested pairs of the grid, with or without an observation."""
    return complete_pairs(requested(spark, folder), observed_cells(spark, folder), "t", "site", "v")


@query(
    "WITH "
    + _DAYS
    + """ SELECT q.event_id, q.part, q.t, q.site, f.v FROM q LEFT JOIN f
ON f.site = q.site AND f.day = CAST(q.t AS DATE)"""
)
def daily_fill_values(spark, folder):
    cells = observed_cells(spark, folder)
    return daily_fill(requested(spark, folder), cells, "t", "site", "v", ["event_id"])


_FILLED = """ FROM q LEFT JOIN f ON f.site = q.site AND f.day = CAST(q.t AS DATE) LEFT JOIN m ON m.day = CAST(q.t AS DATE)"""


@query("WITH " + _DAYS + " SELECT q.event_id, q.part, q.t, q.site, round(coalesce(f.v, m.v), 6) AS v" + _FILLED)
def row_mean_fill(spark, folder):
    days = cut(day_values(observed_cells(spark, folder), "t", "site", "v", ["event_id"]))
    return rounded(fill_row_means(requested(spark, folder), days, "t", "site", "v"))


@query(
    "WITH "
    + _DAYS
    + """ SELECT q.event_id, q.part, q.t, q.site, round(coalesce(f.v, m.v,
  (SELECT sum(f.v * n.w) / sum(n.w) FROM f JOIN n USING (day))), 6) AS v"""
    + _FILLED
)
def row_mean_fill_global(spark, folder):
    cells = observed_cells(spark, folder)
    days = cut(day_values(cells, "t", "site", "v", ["event_id"]))
    filled = fill_row_means(requested(spark, folder), days, "t", "site", "v", day_weights(cells, "t"))
    return rounded(filled)


_TARGET_DAYS = (
    _CELLS
    + """, i AS (SELECT t, site, coalesce(v, (SELECT avg(v) FROM h)) AS v, event_id FROM h),
f AS (SELECT site, CAST(t AS DATE) AS day, first(v ORDER BY t, event_id) AS v FROM i GROUP BY ALL),
m AS (SELECT day, avg(v) AS v FROM f GROUP BY day)"""
)
_TARGET = (
    "WITH " + _TARGET_DAYS + " SELECT q.event_id, q.part, q.t, q.site, round(coalesce(f.v, m.v), 6) AS v" + _FILLED
)


def target(spark, folder):
    cells = observed_cells(spark, folder)
    return target_values(requested(spark, folder), cells, "t", "site", "v", ["event_id"])


@query(_TARGET)
def target_matrix_long(spark, folder):
    return rounded(target(spark, folder))


def _daily_cells(spark, folder):
    """First value of each day and event type."""
    ev = table(spark, folder, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v")
    cells = ev.select(F.col("ts").alias("t"), F.col("event_type").alias("site"), value, "event_id")
    days = day_values(cells, "t", "site", "v", ["event_id"])
    return days.withColumn("day", F.col("day").cast("string"))


_DAY_CELLS = """c AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS site,
  first(value ORDER BY ts, event_id) AS v FROM events WHERE event_id % 7 <> 0 AND value IS NOT NULL GROUP BY ALL)"""


@query(
    "WITH "
    + _DAY_CELLS
    + " SELECT day, "
    + ", ".join(f"max(v) FILTER (site = '{s}') AS {s}" for s in _TYPES)
    + " FROM c GROUP BY day"
)
def pivot_matrix(spark, folder):
    return to_wide(_daily_cells(spark, folder), "day", "site", "v", _TYPES)


@query(
    "WITH "
    + _DAY_CELLS
    + """, s AS (SELECT DISTINCT site FROM c), d AS (SELECT DISTINCT day FROM c)
SELECT day, site, v FROM d CROSS JOIN s LEFT JOIN c USING (day, site)"""
)
def melt_matrix(spark, folder):
    wide = to_wide(_daily_cells(spark, folder), "day", "site", "v", _TYPES)
    return to_long(wide, ["day"], "site", "v")


@query(
    """SELECT o_orderdate AS t, round(avg(o_totalprice), 7) AS o_totalprice, round(avg(o_custkey), 7) AS o_custkey
FROM orders GROUP BY o_orderdate"""
)
def group_feature_mean(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderdate", "t")
    return rounded(group_means(orders, "t", ["o_totalprice", "o_custkey"]), 7)


def _start(x, rank):
    """Fixed factors that SQL can compute too."""
    day, size = F.dayofmonth("row"), F.col("col")
    w = [(((day + 3 * j) % 7) + 1) / 7.0 for j in range(rank)]
    h = [(((size + 2 * j) % 5) + 1) / 5.0 for j in range(rank)]
    W = x.rows.select("row", F.array(*w).alias("w"))
    H = x.entries.select("col").distinct().select("col", F.array(*h).alias("h"))
    return Factors(W, H, rank)


def _sweep_sql(i):
    """CTEs w{i}, h{i} from w{i-1}, h{i-1}; factors in long form (key, j, value)."""
    o, n = i - 1, i
    return f""",
hh{n} AS (SELECT a.j, b.j AS l, sum(a.v * b.v) AS v FROM h{o} a JOIN h{o} b USING (site) GROUP BY ALL),
p{n} AS (SELECT t, j, sum(x.v * h.v) AS v FROM x JOIN h{o} h USING (site) GROUP BY ALL),
q{n} AS (SELECT t, hh.j, sum(w.v * hh.v) AS v FROM w{o} w JOIN hh{n} hh ON w.j = hh.l GROUP BY ALL),
w{n} AS (SELECT t, j, w.v * p.v / q.v AS v FROM w{o} w JOIN p{n} p USING (t, j) JOIN q{n} q USING (t, j)),
ww{n} AS (SELECT a.j, b.j AS l, sum(a.v * b.v) AS v FROM w{n} a JOIN w{n} b USING (t) GROUP BY ALL),
r{n} AS (SELECT site, j, sum(x.v * w.v) AS v FROM x JOIN w{n} w USING (t) GROUP BY ALL),
s{n} AS (SELECT site, ww.j, sum(h.v * ww.v) AS v FROM h{o} h JOIN ww{n} ww ON h.j = ww.l GROUP BY ALL),
h{n} AS (SELECT site, j, h.v * r.v / s.v AS v FROM h{o} h JOIN r{n} r USING (site, j) JOIN s{n} s USING (site, j))"""


_TWO_SWEEPS = (
    "WITH "
    + _TARGET_DAYS
    + """, x AS (SELECT a.t, s.site, coalesce(f.v, m.v) AS v FROM (SELECT DISTINCT t FROM h) a
  CROSS JOIN (SELECT DISTINCT site FROM h) s LEFT JOIN f ON f.site = s.site AND f.day = CAST(a.t AS DATE)
  LEFT JOIN m ON m.day = CAST(a.t AS DATE)), j AS (SELECT unnest(range(2)) AS j),
w0 AS (SELECT t, j, (((day(t) + 3 * j) % 7) + 1) / 7.0::DOUBLE AS v FROM (SELECT DISTINCT t FROM x), j),
h0 AS (SELECT site, j, (((site + 2 * j) % 5) + 1) / 5.0::DOUBLE AS v FROM (SELECT DISTINCT site FROM x), j)"""
    + _sweep_sql(1)
    + _sweep_sql(2)
    + """ SELECT 'W' AS part, CAST(CAST(t AS DATE) AS VARCHAR) AS key, j, round(avg(v), 5) AS value FROM w2 GROUP BY ALL
UNION ALL SELECT 'H', CAST(site AS VARCHAR), j, round(v, 5) FROM h2"""
)


def _two_sweeps(spark, folder):
    x = implicit_target_matrix(observed_cells(spark, folder), "t", "site", "v", ["event_id"])
    return factorise(x, 2, sweeps=2, tol=0, start=_start(x, 2))


def _long_factors(f):
    W = f.W.select(
        F.lit("W").alias("part"),
        F.col("row").cast("string").alias("key"),
        F.posexplode("w").alias("j", "value"),
    )
    H = f.H.select(
        F.lit("H").alias("part"), F.col("col").cast("string").alias("key"), F.posexplode("h").alias("j", "value")
    )
    return rounded(W.unionByName(H), 5)


@query(_TWO_SWEEPS)
def nmf_two_sweeps(spark, folder):
    """Two updates from fixed factors. SQL works on the full times-by-users matrix, the query
    on days with weights and without the filled cells."""
    return _long_factors(_two_sweeps(spark, folder))


@query(_TWO_SWEEPS)
def factor_sink(spark, folder):
    """Factors written to the shared folder and read back."""
    path = fresh_path(spark, "factors")
    _two_sweeps(spark, folder).write(path)
    return _long_factors(Factors.read(spark, path))


@query()
def nmf_fit(spark, folder):
    """Factors of the completed matrix from the singular-vector start."""
    x = implicit_target_matrix(observed_cells(spark, folder), "t", "site", "v", ["event_id"])
    return _long_factors(factorise(x))


@query()
def nmf_fit_orders(spark, folder):
    """Day by clerk's customer sums, factorised as given from seeded factors."""
    orders = table(spark, folder, "orders")
    cells = orders.groupBy(
        F.to_date("o_orderdate").alias("row"), F.col("o_custkey").alias("col")
    ).agg(F.sum("o_totalprice").alias("x"))
    return _long_factors(factorise(dense_matrix(cells), 3, "seeded"))


@query(
    """WITH w AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS a, count(*) AS b FROM events GROUP BY ALL),
h AS (SELECT CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS event_type,
  avg(value) / 100 AS a, max(value) / 100 AS b FROM events GROUP BY ALL)
SELECT event_id, CASE WHEN h.a IS NOT NULL THEN round(w.a * h.a + w.b * h.b, 4) END AS predictions
FROM events e LEFT JOIN w ON w.day = CAST(e.ts AS DATE) LEFT JOIN h ON h.event_type = e.event_type"""
)
def reconstruct_pairs(spark, folder):
    ev = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    both = F.array(F.avg("value"), F.count(F.lit(1)).cast("double"))
    W = ev.groupBy("day").agg(both.alias("w"))
    kind = F.when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type"))
    known = ev.withColumn("event_type", kind).groupBy("event_type")
    H = known.agg(F.array(F.avg("value") / 100, F.max("value") / 100).alias("h"))
    wanted = ev.select("event_id", "day", "event_type")
    out = reconstruct(wanted, W, H, "day", "event_type", 2)
    return rounded(out.select("event_id", "predictions"), 4)
