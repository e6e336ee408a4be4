"""Queries on key alignment, differences and folds."""

from pyspark.sql import functions as F

from threshcast.catalogue.base import FORECASTS, forecasts, query, rounded, table
from threshcast.operators.folds import (
    assign_folds,
    between,
    fold_sizes,
    fold_tables,
    parse_periods,
    split_by_key,
)
from threshcast.operators.intervals import count_covering
from threshcast.operators.joins import (
    align,
    anti_members,
    drop_members,
    equi_join,
    join_models,
    side_by_side,
    table_diff,
)

_PERIODS = ["1998-01-01_1999-01-01", "1999-01-01_2000-01-01", "2000-02-29_2001-01-01"]


@query(
    """SELECT o.o_orderkey, o.o_custkey, c.c_acctbal AS predictions
FROM orders o LEFT JOIN customer c ON o.o_custkey = CASE WHEN c.c_acctbal > 0 THEN c.c_custkey ELSE -c.c_custkey END"""
)
def align_right_join(spark, folder):
    """Requested rows keep their place; those without a forecast get NULL."""
    key = F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey"))
    grid = table(spark, folder, "customer")
    grid = grid.select(key.alias("o_custkey"), F.col("c_acctbal").alias("predictions"))
    return align(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), grid, ["o_custkey"])


@query(
    """SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other, round(b.l_quantity, 4) AS q
FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey"""
)
def self_align_rows(spark, folder):
    """Joining a table to its own, repeated key: every row with every row of its key."""
    lines = table(spark, folder, "lineitem")
    right = lines.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("l_quantity").alias("q"))
    out = align(lines.select("l_orderkey", "l_linenumber"), right, ["l_orderkey"])
    return rounded(out, 4)


@query(
    """SELECT a.l_orderkey, count(*) AS n, round(sum(b.l_quantity), 4) AS q
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
GROUP BY a.l_orderkey"""
)
def self_align_fanout(spark, folder):
    """Joining a table to its own keys multiplies repeated keys.

    Both sides are summed per key before they meet, so a key with n copies costs one row and
    not n * n."""
    keys = ["l_orderkey", "l_linenumber"]
    lines = table(spark, folder, "lineitem").groupBy(*keys)
    left = lines.agg(F.count(F.lit(1)).alias("copies"))
    right = lines.agg(F.count(F.lit(1)).alias("matches"), F.sum("l_quantity").alias("quantity"))
    out = equi_join(left, right, keys, "left").groupBy("l_orderkey")
    pairs, quantity = F.col("copies") * F.col("matches"), F.col("copies") * F.col("quantity")
    return rounded(out.agg(F.sum(pairs).alias("n"), F.sum(quantity).alias("q")), 4)


_MODELS = (
    "WITH "
    + FORECASTS
    + """, k AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN site END AS site, season, t, y, p FROM fc)
SELECT a.event_id, a.site, a.t, round(a.y, 6) AS y, round(a.p, 6) AS mean5, round(b.y * 0.5, 6) AS half,
  round(c.p * 0.1, 6) AS "q_0.05"
FROM k a JOIN (SELECT * REPLACE (CASE WHEN season <> 'error' THEN event_id ELSE -1 - event_id END AS event_id) FROM k) b
  ON a.event_id = b.event_id AND a.site IS NOT DISTINCT FROM b.site AND a.t = b.t AND a.y = b.y
JOIN (SELECT * REPLACE (CASE WHEN y > 10 THEN event_id ELSE -1 - event_id END AS event_id) FROM k) c
  ON a.event_id = c.event_id AND a.site IS NOT DISTINCT FROM c.site AND a.t = c.t AND a.y = c.y"""
)


@query(_MODELS)
def model_inner_join(spark, folder):
    fc = forecasts(spark, folder).withColumn(
        "site", F.when(F.col("event_id") % 9 != 0, F.col("site"))
    )
    base = fc.select("event_id", "site", "t", "y")

    def moved(stays):
        """All rows; those that are to have no partner get another key."""
        key = F.when(F.expr(stays), F.col("event_id")).otherwise(-1 - F.col("event_id"))
        return fc.withColumn("event_id", key)

    tables = {
        "mean5": fc.select(*base.columns, F.col("p").alias("predictions")),
        "half": moved("season <> 'error'").select(
            *base.columns, (F.col("y") * 0.5).alias("predictions")
        ),
        "quantiles": moved("y > 10").select(
            *base.columns, (F.col("p") * 0.1).alias("q_0.05"), F.col("p").alias("predictions")
        ),
    }
    return rounded(join_models(tables).drop("quantiles"))


@query(
    """SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders"""
)
def side_by_side_parts(spark, folder):
    """Parts of a table put next to each other again by key, not by position."""
    orders = table(spark, folder, "orders")
    parts = [orders.select("o_orderkey", c) for c in ("o_totalprice", "o_orderstatus", "o_orderpriority")]
    return side_by_side([p.orderBy(F.rand(i)) for i, p in enumerate(parts)], ["o_orderkey"])


@query(
    """WITH a AS (SELECT CASE WHEN s_acctbal > 500 THEN s_suppkey ELSE -s_suppkey END AS s_suppkey, s_name, s_acctbal,
  CAST(s_nationkey AS DOUBLE) AS n FROM supplier),
b AS (SELECT CASE WHEN s_nationkey <> 7 THEN s_suppkey ELSE -100000000 - s_suppkey END AS s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal,
  CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_nationkey AS DOUBLE) END AS n FROM supplier),
j AS (SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, a.n AS an, b.n AS bn, a.s_acctbal AS aa,
  b.s_acctbal AS ba, a.s_name AS an2, b.s_name AS bn2 FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey),
d AS (SELECT s_suppkey, 's_nationkey' AS "column", an AS l, bn AS r FROM j WHERE an IS DISTINCT FROM bn
UNION ALL SELECT s_suppkey, 's_acctbal', aa, ba FROM j WHERE aa IS DISTINCT FROM ba)
SELECT s_suppkey, "column", round(l, 4) AS left_value, round(r, 4) AS right_value, NULL::VARCHAR AS left_text,
  NULL::VARCHAR AS right_text FROM d
UNION ALL SELECT s_suppkey, 's_name', NULL, NULL, an2, bn2 FROM j WHERE an2 IS DISTINCT FROM bn2"""
)
def table_difference(spark, folder):
    s = table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    changed = s.withColumns(
        {
            "s_suppkey": F.when(F.col("s_nationkey") != 7, k).otherwise(-100000000 - k),
            "s_acctbal": F.when(k % 4 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")),
            "s_nationkey": F.when(k % 5 != 0, F.col("s_nationkey")),
        }
    )
    own = s.withColumn("s_suppkey", F.when(F.col("s_acctbal") > 500, k).otherwise(-k))
    out = table_diff(own, changed, ["s_suppkey"])
    is_text = F.col("column") == "s_name"
    out = out.select(
        "s_suppkey",
        "column",
        F.when(~is_text, F.col("left_value")).cast("double").alias("left_value"),
        F.when(~is_text, F.col("right_value")).cast("double").alias("right_value"),
        F.when(is_text, F.col("left_value")).alias("left_text"),
        F.when(is_text, F.col("right_value")).alias("right_text"),
    )
    return rounded(out, 4)


_ANTI = """SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderpriority END AS prio FROM orders
WHERE o_orderkey % 8 = 0 OR o_orderpriority NOT IN ('1-URGENT', '5-LOW')"""


def _with_missing_priority(spark, folder):
    prio = F.when(F.col("o_orderkey") % 8 != 0, F.col("o_orderpriority")).alias("prio")
    return table(spark, folder, "orders").select("o_orderkey", prio)


@query(_ANTI)
def anti_sites(spark, folder):
    return drop_members(_with_missing_priority(spark, folder), "prio", ["1-URGENT", "5-LOW"])


@query(_ANTI)
def anti_sites_table(spark, folder):
    orders = table(spark, folder, "orders")
    members = orders.filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    members = members.select(F.col("o_orderpriority").alias("prio")).distinct()
    return anti_members(_with_missing_priority(spark, folder), members, "prio")


@query(
    """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'"""
)
def half_open_period(spark, folder):
    p = parse_periods(_PERIODS)[0]
    out = between(table(spark, folder, "orders"), "o_orderdate", p.start, p.end)
    return out.select("o_orderkey", "o_totalprice")


_FOLD_ROWS = """WITH f(fold, s, e) AS (VALUES ('fold_1', TIMESTAMP '1998-01-01', TIMESTAMP '1999-01-01'),
  ('fold_2', TIMESTAMP '1999-01-01', TIMESTAMP '2000-01-01'),
  ('fold_3', TIMESTAMP '2000-02-29', TIMESTAMP '2001-01-01')),
x AS (SELECT o_orderkey, o_orderpriority, fold, CASE
    WHEN o_orderdate >= s AND o_orderdate < e AND o_orderpriority <> '5-LOW' THEN 'test'
    WHEN o_orderdate < s THEN 'train' END AS role FROM orders CROSS JOIN f)
"""


@query(_FOLD_ROWS + "SELECT o_orderkey, fold, role FROM x WHERE role IS NOT NULL")
def oot_folds(spark, folder):
    out = assign_folds(
        table(spark, folder, "orders"),
        parse_periods(_PERIODS),
        "o_orderdate",
        "o_orderpriority",
        ["5-LOW"],
    )
    return out.select("o_orderkey", "fold", "role")


@query(_FOLD_ROWS + "SELECT fold, role, count(*) AS n FROM x WHERE role IS NOT NULL GROUP BY ALL")
def oot_fold_sizes(spark, folder):
    out = assign_folds(
        table(spark, folder, "orders"),
        parse_periods(_PERIODS),
        "o_orderdate",
        "o_orderpriority",
        ["5-LOW"],
    )
    return fold_sizes(out)


@query(
    _FOLD_ROWS
    + """SELECT o_orderkey, fold, role FROM x WHERE role IS NOT NULL AND fold = 'fold_2'"""
)
def oot_fold_tables(spark, folder):
    """Train and test tables of one period, joined again by UNION ALL."""
    p = parse_periods(_PERIODS)[1]
    train, test = fold_tables(
        table(spark, folder, "orders"), p, "o_orderdate", "o_orderpriority", ["5-LOW"]
    )
    both = train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))
    return both.select("o_orderkey", F.lit(p.fold).alias("fold"), "role")


@query(
    """WITH f(fold, s, v, e) AS (VALUES
  ('fold_1', TIMESTAMP '1998-01-01', TIMESTAMP '1997-01-01', TIMESTAMP '1999-01-01'),
  ('fold_2', TIMESTAMP '1999-01-01', TIMESTAMP '1998-01-01', TIMESTAMP '2000-01-01'),
  ('fold_3', TIMESTAMP '2000-02-29', TIMESTAMP '1999-02-28', TIMESTAMP '2001-01-01')),
x AS (SELECT o_orderkey, fold, CASE WHEN o_orderdate >= s AND o_orderdate < e THEN 'test'
  WHEN o_orderdate >= v AND o_orderdate < s THEN 'validation' WHEN o_orderdate < v THEN 'train' END AS role
  FROM orders CROSS JOIN f) SELECT * FROM x WHERE role IS NOT NULL"""
)
def nested_folds(spark, folder):
    orders = table(spark, folder, "orders")
    out = assign_folds(orders, parse_periods(_PERIODS), "o_orderdate", nested=True)
    return out.select("o_orderkey", "fold", "role")


@query(
    """SELECT o_orderkey, CASE WHEN (o_orderkey * 7919) % 1000 / 1000.0 < 0.8 THEN 'train' ELSE 'test' END AS role
FROM orders"""
)
def key_split(spark, folder):
    """Hold-out split from the key; modulus instead of the hash, so that SQL can follow."""
    draw = F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / 1000.0
    orders = table(spark, folder, "orders")
    return split_by_key(orders, ["o_orderkey"], 0.8, draw=draw).select("o_orderkey", "role")


@query()
def hash_split(spark, folder):
    """Hold-out split by hash of the key: shares per role."""
    out = split_by_key(table(spark, folder, "orders"), ["o_orderkey"], 0.8, 42)
    return out.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


_SPANS = """s AS (SELECT event_type AS season, ts AS opens, ts + to_minutes(CAST(pow(1 + event_id % 11, 6) AS BIGINT)) AS closes
  FROM events WHERE event_id % 40 = 0)"""


def _spans(spark, folder):
    """Overlapping intervals of a minute to three years."""
    minutes = "cast(pow(1 + event_id % 11, 6) as int)"
    events = table(spark, folder, "events").filter("event_id % 40 = 0")
    return events.selectExpr("event_type as season", "ts as opens", f"timestampadd(MINUTE, {minutes}, ts) as closes")


@query(
    "WITH "
    + _SPANS
    + """ SELECT event_id, ts, count(opens) AS covering FROM events LEFT JOIN s ON ts BETWEEN opens AND closes GROUP BY event_id, ts"""
)
def interval_counts(spark, folder):
    """How many intervals hold each row's time."""
    rows = table(spark, folder, "events").select("event_id", "ts")
    return count_covering(rows, _spans(spark, folder), "ts", "opens", "closes")


@query(
    "WITH "
    + _SPANS
    + """ SELECT event_id, event_type AS season, count(opens) AS covering FROM events LEFT JOIN s
  ON ts BETWEEN opens AND closes AND season = event_type GROUP BY event_id, event_type"""
)
def interval_counts_by_key(spark, folder):
    """The same for intervals of the row's own season, over many small time ranges."""
    rows = table(spark, folder, "events").selectExpr("event_id", "event_type as season", "ts")
    spans = _spans(spark, folder)
    return count_covering(rows, spans, "ts", "opens", "closes", ["season"], range_rows=100).drop("ts")
