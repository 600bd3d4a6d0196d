"""Polygons as inside and touched tiles, against ray casting over whole rings."""

import math
import random
import time

from pyspark.sql import functions as F

from waynet.operators import spatial, tiles

POLYGONS = "poly_id long, ring array<struct<x:double,y:double>>"


def _inside(x, y, ring):
    pairs = zip(ring, ring[1:] + ring[:1])
    return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in pairs) % 2 == 1


def _star(rng, x, y, radius, corners):
    turns = [2 * math.pi * k / corners for k in range(corners)]
    return [(x + r * math.cos(t), y + r * math.sin(t)) for t in turns for r in [radius * rng.uniform(0.3, 1)]]


def test_tiles_equal_ray_casting(spark):
    """Stars of 3 to 400 corners, from a part of a tile to 200 tiles wide, one ring closed, corners and borders on the tiles' lines."""
    rng = random.Random(4)
    rings = [_star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3), r, n) for r, n in ((0.05, 3), (0.3, 9), (1.0, 40), (2.5, 400), (10.0, 60))]
    rings += [[(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (0.0, 1.0), (0.0, 0.0)], [(-1.0, -1.0), (2.0, -1.0)], []]
    points = [(k, rng.uniform(-4, 4), rng.uniform(-4, 4)) for k in range(1500)] + [(2000 + k, k % 7 / 4 - 0.25, k // 7 / 4 - 0.25) for k in range(49)]
    want = {(i, p) for i, x, y in points for p, ring in enumerate(rings) if _inside(x, y, ring)}
    polygons = spark.createDataFrame([*enumerate(rings), (99, None)], POLYGONS)
    placed = spark.createDataFrame([*points, (5000, None, 0.0), (5001, float("nan"), 0.0)], "id long, x double, y double")
    found = [tuple(r) for r in spatial.points_in_polygons(placed, polygons, 0.1).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert spatial.points_in_polygons(placed, polygons.limit(0), 0.1).isEmpty() and spatial.points_in_polygons(placed.limit(0), polygons, 0.1).isEmpty()


def test_large_polygons_have_few_tiles_and_short_pieces(spark):
    """A ring of 4000 corners: no more tiles than the bound, most inside without any edge, and no tile holds much of the ring."""
    ring = [(100 * math.cos(t), 100 * math.sin(t)) for t in (2 * math.pi * k / 4000 for k in range(4000))]
    made = tiles.polygon_tiles(spark.createDataFrame([(1, ring)], POLYGONS), 0.001)
    got = made.agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("inside"), F.max(F.size("edges")).alias("most"), F.max("level").alias("level")).first()
    assert got["n"] <= (tiles.SIDE + 2) ** 2 and got["inside"] > got["n"] / 2 and got["level"] == 13 and got["most"] < 800


def test_rings_of_an_expression_take_time_by_their_corners(spark):
    """A ring of 6000 corners that the plan makes by an expression of an array; made anew for every corner it takes minutes."""
    turn = lambda i: 2 * F.pi() * i / F.size("sizes")
    ring = F.transform("sizes", lambda s, i: F.struct(((1 + s / 1e6) * F.cos(turn(i))).alias("x"), ((1 + s / 1e6) * F.sin(turn(i))).alias("y")))
    sizes = spark.range(6000).groupBy((F.col("id") % 1).alias("poly_id")).agg(F.sort_array(F.collect_list("id")).alias("sizes"))
    began = time.time()
    assert tiles.polygon_tiles(sizes.select("poly_id", ring.alias("ring")), 0.1).count() > 300
    assert time.time() - began < 30


def test_equal_rings_are_tested_once(spark, monkeypatch):
    """300 polygons of two rings: tiles are made for two, rows for all."""
    cut_up, plain = [], spatial.polygon_tiles

    def counted(polygons, size):
        cut_up.append(polygons.count())
        return plain(polygons, size)

    monkeypatch.setattr(spatial, "polygon_tiles", counted)
    rings = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]]
    polygons = spark.createDataFrame([(k, rings[k % 2]) for k in range(300)], POLYGONS)
    points = spark.createDataFrame([(7, 0.5, 0.25), (8, 3.0, 1.0)], "id long, x double, y double")
    found = sorted(tuple(r) for r in spatial.points_in_polygons(points, polygons, 0.5).collect())
    assert found == [(7, k) for k in range(300)] + [(8, k) for k in range(1, 300, 2)]
    assert cut_up == [2]


def test_grid_without_forest_points(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    towns = spark.createDataFrame([(1, square(0.0, 1.0)), (2, square(5.0, 5.1))], POLYGONS).withColumn("inhabitants", F.lit(90.0))
    forest = spark.createDataFrame([(7, square(-1.0, 0.6))], POLYGONS)
    got = {(r["poly_id"], round(r["x"], 3), round(r["y"], 3)): r["population"] for r in spatial.population_grid(towns, 0.25, without=forest).collect()}
    corners = [(x, y) for x in (0.25, 0.5, 0.75) for y in (0.25, 0.5, 0.75) if x > 0.6 or y > 0.6]
    assert got == {(2, 5.0, 5.0): 90.0} | {(1, x, y): 18.0 for x, y in corners}


def test_tiles_hold_only_what_touches_them_and_are_not_broadcast(spark):
    """A zigzag of 6000 corners between two radii, on tiles' lines too: each edge is in the few tiles that it touches, and points are as by ray casting."""
    rng = random.Random(11)
    reach = [0.15 + rng.randrange(50) / 250 for _ in range(6000)]
    ring = [(r * math.cos(t), r * math.sin(t)) for k, r in enumerate(reach) for t in [2 * math.pi * k / 6000]]
    square = [(k % 2 * 0.04, k / 40) for k in range(9)] + [(-0.2, 0.2), (-0.2, 0.0)]
    polygons = spark.createDataFrame([(1, ring), (2, square)], POLYGONS)
    made = tiles.polygon_tiles(polygons, 0.02).cache()
    assert made.where("poly_id = 1").agg(F.sum(F.size("edges"))).first()[0] < 5 * len(ring)
    points = [(k, rng.uniform(-0.4, 0.4), rng.uniform(-0.4, 0.4)) for k in range(400)] + [(1000 + k, *rng.choice(ring)) for k in range(60)] + [(2000 + k, k % 11 / 50 - 0.1, k // 11 / 40) for k in range(99)]
    found = tiles.points_in_tiles(spark.createDataFrame(points, "id long, x double, y double"), made, 0.02)
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, p) for i, x, y in points for p, own in ((1, ring), (2, square)) if _inside(x, y, own))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
