"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.scratch import scratch, written

__all__ = ["bounded", "fold", "scratch", "table", "text_of", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str | Column, n: int) -> Column:
    """The split that the queries' contracts fix: crc32 of the id as text, modulo ``n`` (null id: fold 0)."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def bounded(rows: DataFrame, label_col: str, bounds: dict, totals: dict, salt: str, id_col: str = "id") -> DataFrame:
    """Of the rows of each class of ``label_col`` the ``bounds[class]`` of least hash of the id (all of a class that has
    no more). ``totals``: rows of each class. Other classes go.

    Rows whose hash is far beyond what the bound can reach, by a rate of 63 bits that no total can round to nothing, go
    first; the rest, some twice the bound, are ranked within their class.
    """
    bounds = {y: n for y, n in bounds.items() if totals.get(y)}
    if not bounds:
        return rows.limit(0)
    top = (1 << 63) - 1
    limit = F.create_map(*[F.lit(v) for y, n in bounds.items() for v in (y, min(top, top * (2 * n + 200) // totals[y]))])
    most = F.create_map(*[F.lit(v) for y, n in bounds.items() for v in (y, n)])
    label, hashed = F.col(label_col), F.xxhash64(F.col(id_col), F.lit(salt)).bitwiseAND(F.lit(top))
    near = rows.filter(label.isin(*bounds)).filter(hashed <= limit[label]).withColumn("_hash", hashed)
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(label_col).orderBy("_hash", id_col)))
    return ranked.filter(F.col("_rank") <= most[label]).drop("_hash", "_rank")
