"""Graphs of polylines with official classes: an arc for each pair of vertices, or for each road."""

import pytest

from waynet.operators import graph

DDL = "pos long, fid long, x double, y double, way_class int, wert int"
#: A road of three vertices, a lone vertex, a large road, one that goes over the first's way again, and the first road's number once more.
ROWS = [(10, 1, 0.0, 0.0, 87003, 1), (11, 1, 3.0, 4.0, 87003, 2), (12, 1, 6.0, 8.0, 87003, 3), (20, 2, 9.0, 9.0, 87003, 4), (30, 3, 0.0, 0.0, 164005, 5), (31, 3, 6.0, 8.0, 164005, 6),
        (40, 4, 3.0, 4.0, 87003, 7), (41, 4, 0.0, 0.0, 87003, 8), (42, 4, 3.0, 4.0, 87003, 9), (50, 1, 6.0, 8.0, 87003, 0), (51, 1, 6.0, 9.0, 87003, 0)]


def test_vertices_pair_by_pair(spark):
    nodes, arcs = graph.vertex_graph(spark.createDataFrame(ROWS, DDL), 5)
    assert sorted(map(tuple, nodes.collect())) == [(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 6.0, 8.0), (3, 6.0, 9.0)]
    found = sorted((r["source"], r["target"], r["fid"], round(r["cost"], 6)) for r in arcs.collect())
    cost = lambda m: round(m / (5 / 3.6), 6)
    there = [(0, 1, 1, cost(5)), (1, 2, 1, cost(5)), (0, 2, 3, cost(10)), (0, 1, 4, cost(5)), (2, 3, 1, cost(1))]
    assert found == sorted(there + [(b, a, f, c) for a, b, f, c in there])


def test_roads_whole(spark):
    rows = spark.createDataFrame(ROWS, DDL)
    nodes, arcs = graph.feature_graph(rows, 5, "way_class", "wert")
    # The large road is left out; the lone vertex is a road to itself; the fourth ends where it began, at a node of its own.
    place = {r["node"]: (r["x"], r["y"]) for r in nodes.collect()}
    assert place == {0: (0.0, 0.0), 1: (6.0, 8.0), 2: (9.0, 9.0), 3: (3.0, 4.0), 4: (6.0, 9.0)}
    found = sorted((r["source"], r["target"], r["fid"], round(r["cost"] * 5 / 3.6, 6), r["weight"]) for r in arcs.collect())
    there = [(0, 1, 1, 10.0, 3), (2, 2, 2, 0.0, 4), (3, 3, 4, 10.0, 9), (1, 4, 1, 1.0, 0)]
    assert found == sorted(there + [(b, a, *rest) for a, b, *rest in there])
    assert graph.feature_graph(rows, 50, "way_class")[1].where("fid = 3 and weight = -1").count() == 2
    assert graph.feature_graph(rows, 5)[1].where("fid = 3").count() == 2  # without classes all are walked


def test_parallel_arcs_leave_the_least(spark):
    """The way of the first road that the fourth goes again is kept once."""
    arcs = graph.vertex_graph(spark.createDataFrame(ROWS, DDL), 50)[1]
    pairs = arcs.select("source", "target").distinct().count()
    least = graph.least_arcs(arcs.selectExpr("source", "target", "cost", "fid as weight")).collect()
    assert len(least) == pairs < arcs.count()


def test_an_unknown_class_is_an_error_and_no_rows_give_no_graph(spark):
    with pytest.raises(Exception, match="unknown way class"):
        graph.vertex_graph(spark.createDataFrame([(1, 1, 0.0, 0.0, 1, 0), (2, 1, 1.0, 0.0, 1, 0)], DDL), 5)[1].collect()
    for part in (*graph.vertex_graph(spark.createDataFrame([], DDL), 5), *graph.feature_graph(spark.createDataFrame([], DDL), 5)):
        assert part.count() == 0
