"""The ordering experiment on the orders table: cost is the price in cents, a hit is a finished order."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.jobs.base import table
from graphmill.operators import order as ops
from graphmill.registry import query

ROWS_SQL = "o AS (SELECT o_orderkey AS number, (round(o_totalprice * 100))::BIGINT AS cost, (o_orderstatus = 'F')::INT AS hit, left(o_orderpriority, 1)::INT AS priority FROM orders)"
NAMED = (
    f"WITH {ROWS_SQL}, named AS (SELECT *, 'by number' AS order_name, 0 AS rank FROM o UNION ALL SELECT *, 'priority', priority FROM o UNION ALL SELECT *, 'oracle', 1 - hit FROM o), "
    "curve AS (SELECT *, row_number() OVER w AS position, (sum(cost) OVER w)::BIGINT AS cum_cost, (sum(hit) OVER w)::BIGINT AS cum_hit FROM named WINDOW w AS (PARTITION BY order_name ORDER BY rank, number))"
)


def rows(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("number"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"), (F.col("o_orderstatus") == "F").cast("int").alias("hit"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"))


def curves(spark, sf):
    """Each order's rows, dealt by rank and ranges of numbers."""
    part = F.floor(F.col("number") / 10_000)
    wide = F.lit(1 << 40)
    named = ops.orders(rows(spark, sf), {"by number": (F.lit(0), part), "priority": (F.col("priority"), F.col("priority") * wide + part), "oracle": (1 - F.col("hit"), (1 - F.col("hit")) * wide + part)})
    return ops.cumulative(named, ["order_name"], F.col("coarse"), ["rank", "number"], {"cum_cost": "cost", "cum_hit": "hit"})


@query("w01_priority_orders", f"{NAMED} SELECT order_name, number, position FROM curve")
def w01(spark, sf):
    return curves(spark, sf).select("order_name", "number", "position")


@query("w02_cumulative", f"{NAMED} SELECT order_name, number, cum_cost, cum_hit FROM curve")
def w02(spark, sf):
    return curves(spark, sf).select("order_name", "number", "cum_cost", "cum_hit")


REACH = ", t AS (SELECT order_name, ceil(max(cum_hit) * {f}) AS wanted FROM curve GROUP BY 1), reach AS (SELECT c.order_name, min(cum_cost) AS cost_at, min(position) AS count_at FROM curve c JOIN t USING (order_name) WHERE cum_hit >= wanted GROUP BY 1)"


@query("w03_first_reach", f"{NAMED}{REACH.format(f='0.9::DOUBLE')} SELECT order_name, cost_at, count_at FROM reach")
def w03(spark, sf):
    return ops.first_reach(curves(spark, sf), ["order_name"], 0.9)


PERMS = 20
RANDOM = (
    f"WITH {ROWS_SQL}, p AS (SELECT o.*, r.perm, md5(r.perm || ':' || o.number) AS key FROM o CROSS JOIN (SELECT unnest(range({PERMS})) AS perm) r), "
    "curve AS (SELECT *, row_number() OVER w AS position, (sum(cost) OVER w)::BIGINT AS cum_cost, (sum(hit) OVER w)::BIGINT AS cum_hit FROM p WINDOW w AS (PARTITION BY perm ORDER BY key))"
)


def _median_sql(f):
    return f"""SELECT {f}::DOUBLE AS frac, median(c) AS median_cost, median(n)::DOUBLE AS median_count FROM (SELECT c.perm, min(cum_cost) AS c, min(position) AS n FROM curve c
    JOIN (SELECT perm, ceil(max(cum_hit) * {f}::DOUBLE) AS wanted FROM curve GROUP BY 1) t USING (perm) WHERE cum_hit >= wanted GROUP BY 1)"""


@query("w04_random_baseline", f"{RANDOM} {_median_sql(0.5)} UNION ALL {_median_sql(0.9)}")
def w04(spark, sf):
    return ops.random_baseline(rows(spark, sf), PERMS, [0.5, 0.9])


POINTS = 50


def _total(spark, sf):
    """The whole cost: one number."""
    return F.lit(rows(spark, sf).agg(F.sum("cost")).first()[0])


@query(
    "w05_discovery_curve",
    f"""{RANDOM}, cell AS (SELECT perm, (ceil(cum_cost * {POINTS} / (SELECT sum(cost) FROM o)::DOUBLE))::INT AS point, max(cum_hit) AS top FROM curve GROUP BY 1, 2),
    grid AS (SELECT perm, point FROM (SELECT unnest(range({PERMS})) AS perm) CROSS JOIN (SELECT unnest(range({POINTS + 1})) AS point)),
    v AS (SELECT g.perm, g.point, coalesce(max(c.top) OVER (PARTITION BY g.perm ORDER BY g.point), 0) AS value FROM grid g LEFT JOIN cell c ON c.perm = g.perm AND c.point = g.point)
    SELECT point, round(avg(value), 6) AS mean_hits, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95 FROM v GROUP BY point""",
)
def w05(spark, sf):
    out = ops.discovery_curve(rows(spark, sf), PERMS, POINTS, _total(spark, sf))
    return out.select("point", *[F.round(c, 6).alias(c) for c in ("mean_hits", "p05", "p95")])


@query("w06_speedups", f"{NAMED}{REACH.format(f='0.5::DOUBLE')} SELECT order_name, round((SELECT cost_at FROM reach WHERE order_name = 'by number') / cost_at::DOUBLE, 6) AS speedup FROM reach")
def w06(spark, sf):
    out = ops.speedups(ops.first_reach(curves(spark, sf), ["order_name"], 0.5), "by number")
    return out.select("order_name", F.round("speedup", 6).alias("speedup"))


@query("w07_top_counts", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 8")
def w07(spark, sf):
    from graphmill.operators.relate import top_counts

    return top_counts(table(spark, sf, "orders"), "o_custkey", 8)


@query(
    "j09_asof_interpolation",
    f"""{NAMED}, tot AS (SELECT sum(cost)::DOUBLE AS total FROM o), grid AS (SELECT order_name, point, point * total / {POINTS} AS at FROM (SELECT DISTINCT order_name FROM curve) CROSS JOIN (SELECT unnest(range({POINTS + 1})) AS point) CROSS JOIN tot),
    a AS (SELECT g.order_name, g.point, g.at, max(c.cum_cost) FILTER (c.cum_cost <= g.at) AS x0, min(c.cum_cost) FILTER (c.cum_cost > g.at) AS x1 FROM grid g JOIN curve c USING (order_name) GROUP BY 1, 2, 3)
    SELECT a.order_name, a.point, round(CASE WHEN x0 IS NULL THEN 0 WHEN x1 IS NULL THEN p.cum_hit ELSE p.cum_hit + (q.cum_hit - p.cum_hit) * (a.at - x0) / (x1 - x0) END::DOUBLE, 4) AS value
    FROM a LEFT JOIN curve p ON p.order_name = a.order_name AND p.cum_cost = a.x0 LEFT JOIN curve q ON q.order_name = a.order_name AND q.cum_cost = a.x1""",
)
def j09(spark, sf):
    out = ops.interpolated(curves(spark, sf), ["order_name"], POINTS, _total(spark, sf))
    return out.select("order_name", "point", F.round("value", 4).alias("value"))
