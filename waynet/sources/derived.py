"""Graph, point and preference tables derived from the driver's tables, each repeatable in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


def road_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, cost, weight: chains of points with shortcuts all along, both directions."""
    p = points(spark, sf_dir)
    i = F.col("vec_id")
    ends = F.filter(F.array(F.when(i % 50 != 49, i + 1), F.when(i % 11 == 0, i + 17)), lambda t: t.isNotNull())
    pairs = p.select(i.alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(ends).alias("b"))
    q = p.select(i.alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    cost = (1 + F.floor(100 * F.sqrt(dx * dx + dy * dy))).cast("int")
    edges = pairs.join(q, "b").select("a", "b", cost.alias("cost"), (1 + F.least("a", "b") % 3).cast("int").alias("weight"))
    one = edges.select(F.col("a").alias("source"), F.col("b").alias("target"), "cost", "weight")
    return one.unionByName(edges.select(F.col("b").alias("source"), F.col("a").alias("target"), "cost", "weight"))


def city_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, x, y, k, size: a crossing for each part, COLUMNS to a row, whose ids say nothing of their places."""
    k = F.col("p_partkey") - 1
    return table(spark, sf_dir, "part").select(_scattered(k).alias("node"), (k % COLUMNS).cast("double").alias("x"), F.floor(k / COLUMNS).cast("double").alias("y"), k.alias("k"), F.col("p_size").alias("size"))


def _scattered(k):
    return k * 2654435761 % 4294967296


def city_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, cost, weight: streets from each crossing to those beside it and below it, both directions."""
    n = city_nodes(spark, sf_dir)
    ends = F.filter(F.array(F.when(F.col("k") % COLUMNS != COLUMNS - 1, F.col("k") + 1), F.col("k") + COLUMNS), lambda t: t.isNotNull())
    pairs = n.select("k", F.col("node").alias("a"), F.col("size"), F.explode(ends).alias("other"))
    edges = pairs.join(n.select(F.col("k").alias("other"), F.col("node").alias("b")), "other")
    cost = (5 + (F.col("size") * 7 + F.col("other")) % 40).cast("int").alias("cost")
    edges = edges.select("a", "b", cost, (F.col("size") % 4).cast("int").alias("weight"))
    return edges.select(F.col("a").alias("source"), F.col("b").alias("target"), "cost", "weight").unionByName(edges.select(F.col("b").alias("source"), F.col("a").alias("target"), "cost", "weight"))


#: Crossings of a row of the city.
COLUMNS = 50

#: SQL of the same tables.
SQL = {
    "city": """cn AS (SELECT (p_partkey - 1) * 2654435761 % 4294967296 AS node, (p_partkey - 1) % 50 AS x, (p_partkey - 1) // 50 AS y, p_partkey - 1 AS k, p_size FROM part),
        ce AS (SELECT a.node AS a, b.node AS b, CAST(5 + (a.p_size * 7 + b.k) % 40 AS INT) AS cost, CAST(a.p_size % 4 AS INT) AS weight FROM cn a JOIN cn b ON b.k = a.k + 1 AND a.k % 50 <> 49
            UNION ALL SELECT a.node, b.node, CAST(5 + (a.p_size * 7 + b.k) % 40 AS INT), CAST(a.p_size % 4 AS INT) FROM cn a JOIN cn b ON b.k = a.k + 50),
        city AS (SELECT a AS source, b AS target, cost, weight FROM ce UNION ALL SELECT b, a, cost, weight FROM ce)""",
    "points": "points AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)",
    "road": """e0 AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(1 + floor(100 * sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))) AS INT) AS cost,
            CAST(1 + least(a.vec_id, b.vec_id) % 3 AS INT) AS weight FROM points a JOIN points b
            ON b.vec_id = a.vec_id + 1 AND a.vec_id % 50 <> 49
            UNION ALL SELECT a.vec_id, b.vec_id, CAST(1 + floor(100 * sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))) AS INT), CAST(1 + least(a.vec_id, b.vec_id) % 3 AS INT) FROM points a JOIN points b ON b.vec_id = a.vec_id + 17 AND a.vec_id % 11 = 0),
        arcs AS (SELECT a AS source, b AS target, cost, weight FROM e0 UNION ALL SELECT b, a, cost, weight FROM e0)""",
}
