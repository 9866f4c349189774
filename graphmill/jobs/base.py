"""Corpora derived from the star-schema tables, and the same in SQL.

Graphs of nine vertices: the lines of four neighbouring orders, an edge between the remainders of part and supplier.
The run log is the event stream: a user's events are runs on one of 25 graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.graph6 import g6_encode
from graphmill.operators.corpus import band_filter

N = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    """An edge for each line; edges repeat."""
    u, v = F.col("l_partkey") % n, F.col("l_suppkey") % n
    rows = table(spark, sf_dir, "lineitem").filter(u != v)
    return rows.select(F.floor(F.col("l_orderkey") / 4).alias("graph_number"), F.least(u, v).alias("i"), F.greatest(u, v).alias("j"))


def edges(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    return lines(spark, sf_dir, n).distinct()


def graphs(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    return g6_encode(lines(spark, sf_dir, n), n)


def band(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    return band_filter(graphs(spark, sf_dir, n))


def spread(graphs: DataFrame) -> DataFrame:
    """Over all cores: graphs are short rows, which would be put together in a few tasks, and much work each."""
    spark = graphs.sparkSession
    return graphs.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "done").when(kind == "signup", "unconfirmed").when(kind == "error", "error").otherwise("timeout")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") * 25 + F.col("event_id") % 25).alias("graph_number"), F.col("event_id").alias("line_no"), status.alias("status"), F.col("value").alias("seconds"), k.alias("k"))
    rows = rows.withColumn("depth_zzp", F.when(F.col("status").isin("done", "unconfirmed") & (F.col("k") % 5 != 0), N - F.col("k") % 3))
    rows = rows.withColumn("decided_by", F.when((F.col("status") == "done") & (F.col("k") % 5 == 0), "negative_h").when(F.col("depth_zzp").isNotNull(), "depth_ZZp"))
    return rows.withColumn("depth", F.when((F.col("status") == "done") & (F.col("k") % 4 == 1), N - F.col("k") % 2))


EDGES = """edges AS (
  SELECT DISTINCT l_orderkey // 4 AS g, least(l_partkey % 9, l_suppkey % 9) AS i, greatest(l_partkey % 9, l_suppkey % 9) AS j
  FROM lineitem WHERE l_partkey % 9 <> l_suppkey % 9)"""

TEXTS = (
    EDGES
    + """, bits AS (SELECT g, sum(1::BIGINT << (35 - (j * (j - 1) // 2 + i))::INT)::BIGINT AS b, count(*) AS m FROM edges GROUP BY g),
texts AS (SELECT g, m, 'H' || """
    + " || ".join(f"chr((63 + ((b >> {s}) & 63))::INT)" for s in range(30, -1, -6))
    + " AS graph6 FROM bits)"
)

ADJ = (
    TEXTS
    + """, ends AS (SELECT g, i AS v, j AS w FROM edges UNION ALL SELECT g, j, i FROM edges),
adj AS (SELECT t.g, r.v, coalesce(bit_or(1::BIGINT << e.w::INT), 0)::BIGINT AS a
  FROM texts t CROSS JOIN (SELECT unnest(range(9)) AS v) r LEFT JOIN ends e ON e.g = t.g AND e.v = r.v GROUP BY t.g, r.v)"""
)

#: Subsets of the vertices of the graphs that meet the cheap band conditions, and then the band itself.
BAND = (
    ADJ
    + """, cheap AS (SELECT a.g FROM adj a JOIN bits b USING (g) WHERE b.m BETWEEN 10 AND 27 GROUP BY a.g HAVING min(bit_count(a.a)) >= 2),
sub0 AS (SELECT a.g, r.s, bit_count(r.s)::INT AS pc, (sum(bit_count(a.a & r.s)) // 2)::INT AS e, min(bit_count(a.a & r.s))::INT AS dmin,
    max(bit_count(a.a & r.s))::INT AS dmax, bit_or(a.a)::BIGINT AS near
  FROM adj a JOIN cheap c USING (g) JOIN (SELECT unnest(range(1, 512)) AS s) r ON (r.s >> a.v::INT) & 1 = 1 GROUP BY a.g, r.s),
cut0 AS (SELECT x.g, x.s, (b.m - x.e - y.e)::INT AS cut FROM sub0 x JOIN sub0 y ON y.g = x.g AND y.s = 511 - x.s JOIN bits b ON b.g = x.g),
band AS (SELECT c.g, t.graph6, t.m, max(cut)::INT AS best_cut, min(cut)::INT AS least_cut FROM cut0 c JOIN texts t USING (g) GROUP BY c.g, t.graph6, t.m HAVING min(cut) >= 1 AND max(cut) < t.m),
sub AS (SELECT s.* FROM sub0 s JOIN band USING (g)),
cuts AS (SELECT c.* FROM cut0 c JOIN band USING (g))"""
)

#: Simple cycles of the band's graphs: one row for each vertex set, with how many cycles run through exactly it.
CYCLES = (
    BAND
    + """, bend AS (SELECT e.* FROM ends e JOIN band USING (g)),
walk AS (
  SELECT DISTINCT g, v AS start, v AS at, 1::BIGINT << v::INT AS s, 1 AS len FROM bend
  UNION ALL
  SELECT w.g, w.start, e.w, w.s | (1::BIGINT << e.w::INT), w.len + 1 FROM walk w JOIN bend e ON e.g = w.g AND e.v = w.at
  WHERE e.w > w.start AND (w.s >> e.w::INT) & 1 = 0),
cyc AS (SELECT w.g, w.s, w.len, count(*) // 2 AS c FROM walk w JOIN bend e ON e.g = w.g AND e.v = w.at AND e.w = w.start WHERE w.len >= 3 GROUP BY w.g, w.s, w.len),
chordless AS (SELECT c.g, c.s, c.len FROM cyc c JOIN sub USING (g, s) WHERE sub.e = c.len),
oddc AS (SELECT c.g, c.s, c.len, c.s | sub.near AS closed FROM chordless c JOIN sub USING (g, s) WHERE c.len % 2 = 1),
pairs AS (SELECT x.g, x.s AS a, y.s AS b, x.len AS la, y.len AS lb FROM oddc x JOIN oddc y ON x.g = y.g AND x.s < y.s AND x.closed & y.s = 0)"""
)

RUNS = """runs AS (
  SELECT *, CASE WHEN status IN ('done', 'unconfirmed') AND k % 5 <> 0 THEN 9 - k % 3 END AS depth_zzp,
    CASE WHEN status = 'done' AND k % 5 = 0 THEN 'negative_h' WHEN status IN ('done', 'unconfirmed') AND k % 5 <> 0 THEN 'depth_ZZp' END AS decided_by,
    CASE WHEN status = 'done' AND k % 4 = 1 THEN 9 - k % 2 END AS depth
  FROM (SELECT user_id * 25 + event_id % 25 AS graph_number, event_id AS line_no,
    CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'unconfirmed' WHEN 'error' THEN 'error' ELSE 'timeout' END AS status,
    value AS seconds, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""

VERDICT = """CASE WHEN depth_zzp = 9 THEN 1 WHEN decided_by = 'negative_h' THEN 0 WHEN depth IS NOT NULL THEN (depth = 9)::INT END AS is_cm,
CASE WHEN depth_zzp = 9 THEN 'depth_ZZp_eq_n' WHEN decided_by = 'negative_h' THEN 'negative_h' WHEN depth IS NOT NULL THEN 'depth_QQ'
  WHEN depth_zzp IS NOT NULL THEN 'screen_ZZp' END AS verdict"""

BEST = RUNS + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_number
  ORDER BY (status IN ('done', 'unconfirmed')) DESC, line_no DESC) AS rn FROM runs) WHERE rn = 1)"""


def at_eight(sql: str) -> str:
    """The SQL of the corpus with eight vertices: 28 bits of a graph's text, followed by two that are 0."""
    chars = lambda top: " || ".join(f"chr((63 + ((b >> {k}) & 63))::INT)" for k in range(top, -1, -6))
    for nine, eight in (("% 9", "% 8"), ("range(9)", "range(8)"), ("range(1, 512)", "range(1, 256)"), ("511 - x.s", "255 - x.s"), ("(35 - (", "(29 - ("), ("'H' || " + chars(30), "'G' || " + chars(24)), ("BETWEEN 10 AND 27", "BETWEEN 9 AND 19")):
        assert nine in sql
        sql = sql.replace(nine, eight)
    return sql
