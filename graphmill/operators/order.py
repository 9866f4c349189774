"""Orders of work, cumulative cost and hits, random baselines and discovery curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def cumulative(rows: DataFrame, group: list[str], bucket: Column, order: list[str | Column], sums: dict[str, str], position: str = "position") -> DataFrame:
    """Running sums (``new name: column``) and positions within each group, in order. ``bucket`` is a coarse function
    that never falls along the order: windows run within a bucket, and the few bucket totals are summed up apart, so
    no task gets a whole group."""
    rows = rows.withColumn("bucket", bucket)
    totals = rows.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("b_rows"), *[F.sum(c).alias(f"b_{name}") for name, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "bucket", F.coalesce(F.sum("b_rows").over(before), F.lit(0)).alias("o_rows"), *[F.coalesce(F.sum(f"b_{name}").over(before), F.lit(0)).alias(f"o_{name}") for name in sums])
    inside = Window.partitionBy(*group, "bucket").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(offsets, [*group, "bucket"])
    out = out.withColumn(position, F.col("o_rows") + F.row_number().over(inside))
    for name, c in sums.items():
        out = out.withColumn(name, F.col(f"o_{name}") + F.sum(c).over(running))
    return out.drop("bucket", "o_rows", *[f"o_{name}" for name in sums])


def orders(rows: DataFrame, specs: dict[str, tuple[Column, Column]], number: str = "number") -> DataFrame:
    """Each row once for each named order: ``order_name, rank`` (what it is ordered by, before the number) and
    ``coarse`` (a function of the rank and the number that never falls along the order)."""
    entries = F.array(*[F.struct(F.lit(name).alias("order_name"), rank.cast("long").alias("rank"), coarse.cast("long").alias("coarse")) for name, (rank, coarse) in specs.items()])
    return rows.withColumn("o", F.explode(entries)).select(*rows.columns, "o.*")


def first_reach(curves: DataFrame, group: list[str], frac: float, cost: str = "cum_cost", hit: str = "cum_hit") -> DataFrame:
    """``cost_at, count_at``: cumulative cost and position at the first row with the share ``frac`` of all hits."""
    totals = curves.groupBy(*group).agg(F.ceil(F.max(hit) * F.lit(frac)).alias("wanted"))
    reached = curves.join(F.broadcast(totals), group).filter(F.col(hit) >= F.col("wanted"))
    return reached.groupBy(*group).agg(F.min_by(cost, "position").alias("cost_at"), F.min("position").alias("count_at"))


def permuted(rows: DataFrame, perms: int, number: str = "number", cost: str = "cost", hit: str = "hit") -> DataFrame:
    """Running sums over ``perms`` seeded orders: that of the MD5 of ``perm:number``. As many leading digits of the key
    make a bucket as keep buckets near 65,536 rows, so that no window grows with the data."""
    digits = max(2, math.ceil(math.log(max(rows.count(), 1) / 65536, 16)))
    key = F.md5(F.concat_ws(":", F.col("perm").cast("string"), F.col(number).cast("string")))
    spread = rows.select(number, cost, hit).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1)))).withColumn("key", key)
    return cumulative(spread, ["perm"], F.left("key", F.lit(digits)), ["key"], {"cum_cost": cost, "cum_hit": hit})


def random_baseline(rows: DataFrame, perms: int, fracs: list[float], number: str = "number", cost: str = "cost", hit: str = "hit") -> DataFrame:
    """Medians over the permutations of what ``first_reach`` finds, for each share. All orders have the same number of
    hits, so one pass over the curves serves all shares."""
    total = rows.agg(F.sum(hit).alias("all_hits"))  # one row
    curves = permuted(rows, perms, number, cost, hit).crossJoin(F.broadcast(total))
    at = F.struct("position", "cum_cost")
    firsts = curves.groupBy("perm").agg(*[F.min(F.when(F.col("cum_hit") >= F.ceil(F.col("all_hits") * F.lit(frac)), at)).alias(f"first_{k}") for k, frac in enumerate(fracs)])
    medians = [F.struct(F.lit(frac).alias("frac"), F.median(f"first_{k}.cum_cost").alias("median_cost"), F.median(f"first_{k}.position").alias("median_count")) for k, frac in enumerate(fracs)]
    return firsts.agg(F.array(*medians).alias("medians")).select(F.inline("medians"))


def steps_on_grid(curves: DataFrame, group: list[str], points: int, total: Column, x: str = "cum_cost", y: str = "cum_hit") -> DataFrame:
    """``group, point, value``: the last y whose x is at most ``point / points`` of the total; 0 before the first, and
    held after the last. Rows are reduced to one for each grid cell before any window."""
    cell = F.ceil(F.col(x) * points / total)
    cells = curves.groupBy(*group, cell.cast("int").alias("point")).agg(F.max(y).alias("top"))
    grid = curves.select(*group).distinct().withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points))))
    last = Window.partitionBy(*group).orderBy("point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(cells, [*group, "point"], "left").select(*group, "point", F.coalesce(F.max("top").over(last), F.lit(0)).alias("value"))


def interpolated(curves: DataFrame, group: list[str], points: int, total: Column, x: str = "cum_cost", y: str = "cum_hit") -> DataFrame:
    """As ``steps_on_grid`` but linear between the neighbouring rows of the curve: 0 left of the first, the last value
    right of the last. Only the first and the last row of each grid cell are needed."""
    cell = F.ceil(F.col(x) * points / total).cast("int")
    cells = curves.groupBy(*group, cell.alias("point")).agg(F.min(F.struct(x, y)).alias("low"), F.max(F.struct(x, y)).alias("high"))
    grid = curves.select(*group, total.alias("total")).distinct().withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points))))
    back = Window.partitionBy(*group).orderBy("point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*group).orderBy("point").rowsBetween(1, Window.unboundedFollowing)
    rows = grid.join(cells, [*group, "point"], "left").withColumn("a", F.last("high", ignorenulls=True).over(back)).withColumn("b", F.first("low", ignorenulls=True).over(ahead))
    at = F.col("point") * F.col("total") / points
    a, b = F.col("a"), F.col("b")
    line = a[y] + (b[y] - a[y]) * (at - a[x]) / (b[x] - a[x])
    return rows.select(*group, "point", F.when(a.isNull(), 0.0).when(b.isNull(), a[y].cast("double")).otherwise(line).alias("value"))


def discovery_curve(rows: DataFrame, perms: int, points: int, total: Column, **names: str) -> DataFrame:
    """Mean and the 5th and 95th percentile of hits over the permutations, on the grid of cost."""
    values = steps_on_grid(permuted(rows, perms, **names), ["perm"], points, total)
    return values.groupBy("point").agg(F.avg("value").alias("mean_hits"), F.percentile("value", F.lit(0.05)).alias("p05"), F.percentile("value", F.lit(0.95)).alias("p95"))


def speedups(reached: DataFrame, base: str, value: str = "cost_at") -> DataFrame:
    """``order_name, speedup``: the base order's value over each order's."""
    other = reached.filter(F.col("order_name") == base).select(F.col(value).alias("base"))
    return reached.crossJoin(F.broadcast(other)).select("order_name", (F.col("base") / F.col(value)).alias("speedup"))
