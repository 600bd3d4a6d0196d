"""Files in and out, and prototype models on small graphs."""

import pytest
from pyspark.sql import functions as F

from waynet.functions import speeds
from waynet.operators import graph, models
from waynet.plans.iterate import running_total
from waynet.sources import sinks, text


def test_graph_file(spark, tmp_path):
    path = tmp_path / "graph.txt"
    path.write_text("3\n3\n0.5 1.5\n1 2 9\n2.5 3\n0 1 10.1\n1 2 5.5 7\n2 0 4.2\n")
    nodes, arcs = text.read_graph(spark, str(path))
    assert [tuple(r) for r in nodes.orderBy("node_id").collect()] == [(0, 0.5, 1.5), (1, 1.0, 2.0), (2, 2.5, 3.0)]
    assert [tuple(r) for r in arcs.orderBy("arc_id").collect()] == [(0, 0, 1, 10, 1), (1, 1, 2, 5, 7), (2, 2, 0, 4, 1)]


def test_column_file(spark, tmp_path):
    path = tmp_path / "columns.txt"
    path.write_text("3.2   1 5\n 1.9 2  6\n\n1 3\t7 8\n")
    rows = text.read_columns(spark, str(path), ["a", "b", "c"], "int").orderBy("pos").collect()
    assert [tuple(r)[1:] for r in rows] == [(3, 1, 5), (1, 2, 6), (1, 3, 7)]


def test_graph_string(spark):
    arcs = text.graph_from_string(spark, "[3,4,{(1,3)},{(2,3),(0,3)},{(1,3)}]")
    assert sorted(tuple(r) for r in arcs.collect()) == [(0, 1, 3), (1, 0, 3), (1, 2, 3), (2, 1, 3)]


def test_osm_file(spark, tmp_path):
    path = tmp_path / "map.osm"
    path.write_text('<osm><node id="1" lat="48.0" lon="7.5"/><node id="2" lat="48.5" lon="7.0"/><way id="9"><nd ref="1"/><nd ref="2"/><tag k="highway" v="track"/></way></osm>')
    nodes, ways = text.read_osm(spark, str(path))
    assert sorted(tuple(r) for r in nodes.collect()) == [(1, 48.0, 7.5), (2, 48.5, 7.0)]
    assert [(r["way_id"], r["nds"], r["tags"]) for r in ways.collect()] == [(9, [1, 2], {"highway": "track"})]


def test_lines_are_written_in_order(spark, tmp_path):
    rows = spark.range(500).select((499 - F.col("id")).alias("pos")).repartition(5)
    sinks.write_lines(rows, ["pos"], F.col("pos"), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "".join(f"{i}\n" for i in range(500))


def test_running_total(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(6)
    out = running_total(rows, ["k"], F.col("k"), "before").collect()
    assert len(out) == 1000 and all(r["before"] == r["k"] * (r["k"] - 1) // 2 for r in out)


def test_running_total_orders_rows_once(spark):
    """Rows are dealt out once, by range; what follows neither deals them again nor holds a range in a window. The row before may lie in an earlier range."""
    rows = spark.range(3000).select((F.col("id") * 7 % 3000).alias("k"), F.struct((F.col("id") * 7 % 3000).alias("own")).alias("was")).repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small ranges become one
    try:
        out = running_total(rows, ["k"], F.lit(1), "at", "was")
        found = sorted((r["k"], r["at"], r["was"] and r["was"]["own"]) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found == [(k, k, k - 1 if k else None) for k in range(3000)]
    wide = plan[plan.index("MapInArrow") : plan.index("BroadcastExchange")]
    assert "Window" not in wide and "Exchange" not in wide
    assert running_total(rows.limit(0), ["k"], F.lit(1), "at", "was").count() == 0


def test_unknown_class_is_an_error(spark):
    with pytest.raises(Exception, match="unknown way class 5"):
        spark.range(5, 6).select(speeds.class_speed(F.col("id").cast("int"), F.lit(30))).collect()


def test_even_arc_weights(spark):
    # A line 0-1-2 with entries at both ends: from 0 over (0,1) to 2 and over (1,2) to 2, and back from 2.
    arcs = spark.createDataFrame([(0, 1, 3), (1, 0, 3), (1, 2, 4), (2, 1, 4)], "source long, target long, cost int")
    entries = spark.createDataFrame([(0, 100.0), (2, 60.0)], "node long, population double")
    out = {(r["source"], r["target"]): r["value"] for r in models.even_arc_weights(arcs, entries, 7).collect()}
    assert out == {(0, 1): 50.0, (1, 2): 50.0, (1, 0): 30.0, (2, 1): 30.0}
    assert models.even_arc_weights(arcs, entries, 6).count() == 0


def test_forbidden_arcs(spark):
    arcs = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (0, 2, 9)], "source long, target long, cost int")
    seeds, barred = spark.createDataFrame([("a", 0)], "search_id string, node long"), spark.createDataFrame([("a", 1, 2)], "search_id string, source long, target long")
    out = graph.shortest_paths(arcs, seeds, 20, forbidden=barred)
    assert {r["node"]: r["cost"] for r in out.collect()} == {0: 0, 1: 1, 2: 9}
