"""Nearest nodes by the quadtree against brute force, with a dense place and far points."""

import numpy as np
from pyspark.sql import functions as F

from waynet.operators import quadtree, spatial


def brute(points, nodes, k, radius=None):
    out = []
    for i, x, y in points:
        d2 = sorted(((x - a) * (x - a) + (y - b) * (y - b), n) for n, a, b in nodes)
        out += [(i, n, d, r + 1) for r, (d, n) in enumerate(d2[:k]) if radius is None or d <= radius * radius]
    return sorted(out)


def test_nearest_few_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    city = [(n, float(x), float(y)) for n, (x, y) in enumerate(rng.normal(50, 0.01, (300, 2)))]
    wide = [(1000 + n, float(x), float(y)) for n, (x, y) in enumerate(rng.integers(0, 100, (60, 2)))]
    same = [(2000 + n, 7.0, 7.0) for n in range(40)]
    nodes = city + wide + same
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-400, 500, (40, 2)))] + [(100 + i, x, y) for i, (_, x, y) in enumerate(city[:10] + same[:2])] + [(200, 50.0, 50.0)]
    p = spark.createDataFrame([*points, (900, None, 1.0), (901, float("nan"), 1.0)], "id long, x double, y double")
    n = spark.createDataFrame([*nodes, (5000, None, 1.0)], "node_id long, x double, y double")
    tree = quadtree.quadtree(n.where("x IS NOT NULL"), 8)
    assert tree.nodes.count() == len(nodes) and len(tree.levels) > 4
    crowded = tree.nodes.groupBy("level", "code").count().where("count > 8").collect()
    assert [r["count"] for r in crowded] == [40]
    usable = p.where("id < 900")
    for k, radius in ((3, None), (500, 0.02)):
        found = quadtree.nearest_of_tree(usable, tree, k, radius)
        assert sorted((r["id"], r["node_id"], r["d2"], r["rank"]) for r in found.collect()) == brute(points, nodes, k, radius)
    nearest = {r["id"]: r["node_id"] for r in spatial.nearest(p, n).collect()}
    assert nearest == {**{i: m for i, m, _, _ in brute(points, nodes, 1)}, 900: None, 901: None}
    assert spatial.within_radius(p, n.limit(0), 3.0, 2).count() == 0 == spatial.within_radius(p.limit(0), n, 3.0, 2).count()


def test_far_points_and_a_dense_city_are_dealt_evenly(spark):
    """30,000 points far from a city of 5,000 nodes: what is compared at a time stays small, and far from all pairs."""
    nodes = spark.range(5_000).select(F.col("id").alias("node_id"), (F.rand(1) * 0.01).alias("x"), (F.rand(2) * 0.01).alias("y"))
    points = spark.range(30_000).select("id", (1000 + F.rand(3)).alias("x"), (1000 + F.rand(4)).alias("y"))
    tree = quadtree.quadtree(nodes)
    assert tree.nodes.groupBy("level", "code").count().agg(F.max("count")).first()[0] <= quadtree.LEAF
    found = quadtree.nearest_of_tree(points, tree)
    assert found.count() == 30_000
    corner = tree.nodes.agg(F.max_by("node_id", F.col("nx") + F.col("ny"))).first()[0]
    assert found.where(F.col("node_id") == corner).count() > 15_000
    met = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert met and not any("Cartesian" in line for line in met)
