"""Hand-checked values of searches, contraction, models and preferences. Graphs and results are fixed values (ids X1 to X18 of FIXTURES.md)."""

import collections
import heapq
import random

import pytest
from pyspark.sql import functions as F

from waynet.functions import geo, speeds
from waynet.operators import graph, models, osm, raster, spatial
from waynet.sources import sinks, text

#: Fixed values.
X1 = "[8,10,{(6,1)(2,5)(5,1)},{},{(3,1)},{(4,1)},{(1,1)},{(1,12)(7,1)},{(7,2)},{(1,8)}]"
X3 = "[3,3,{(1,3)(2,4)},{(2,5)},{}]"
X4 = "[3,6,{(1,1)(2,7)},{(0,1)(2,5)},{(0,7)(1,5)}]"
X5 = "[3,4,{(1,3)},{(2,3),(0,3)},{(1,3)}]"
X7 = [(0, 7), (0, 8), (0, 10), (1, 3), (1, 10), (2, 9), (2, 9), (2, 4), (5, 9), (7, 8)]
X9 = [(0, 1, 10), (1, 3, 5), (3, 2, 6), (2, 4, 9), (2, 5, 9), (2, 6, 9)]
X12 = "[4,10,{(1,600)(2,700)(3,700)},{(0,600)(3,600)},{(0,700)(3,1100)},{(0,700)(1,600)(2,1100)}]"
X12_VALUES = {(0, 1): 121.89, (0, 2): 117.298, (0, 3): 312.039, (1, 3): 217.877, (2, 3): 213.285}
X13 = "[4,10,{(1,600)(2,900)(3,700)},{(0,600)(3,600)},{(0,900)(3,900)},{(0,700)(1,600)(2,900)}]"
X13_VALUES = {(0, 1): 34.7042, (1, 0): 34.1061, (0, 2): 23.5551, (2, 0): 24.3775, (0, 3): 100, (3, 0): 100, (1, 3): 34.1061, (3, 1): 34.7042, (2, 3): 24.3775, (3, 2): 23.5551}
X15 = [(15.0, 0.5), (30.0, 0.25), (60.0, 0.2), (120.0, 0.05)]


def search(spark, string, start, limit=1000, **rules):
    seeds = spark.createDataFrame([("a", start)], "search_id string, node long")
    out = graph.shortest_paths(text.graph_from_string(spark, string), seeds, limit, **rules).collect()
    return {r["node"]: (r["cost"], r["parent"]) for r in out}


@pytest.mark.parametrize("cell", [2, 4096])
def test_least_costs_and_parents(spark, cell):
    found = search(spark, X1, 0, cell=cell)
    assert found[1][0] == 8
    way = [1]
    while way[-1] != 0:
        way.append(found[way[-1]][1])
    assert way == [1, 4, 3, 2, 0]
    assert search(spark, X3, 0, cell=cell)[2][0] == 4
    assert search(spark, X4, 2, cell=cell)[0][1] == 1
    assert set(search(spark, X5, 0, 4, cell=cell)) == {0, 1} and set(search(spark, X5, 2, 4, cell=cell)) == {1, 2}


def test_searches_that_start_elsewhere_or_ignore_a_node(spark):
    assert search(spark, X3, 1) == {1: (0, 1), 2: (5, 1)}
    assert search(spark, X4, 0)[2] == (6, 1)
    ignored = spark.createDataFrame([("a", 1)], "search_id string, node long")
    assert search(spark, X4, 0, ignore=ignored)[2] == (7, 0)


def test_cells_change_no_search(spark):
    rng = random.Random(3)
    edges = [(a, b, rng.randint(1, 9)) for a, b in (rng.sample(range(60), 2) for _ in range(110))]
    near = collections.defaultdict(list)
    for a, b, c in edges:
        near[a].append((b, c))
    arcs = spark.createDataFrame(edges, "source long, target long, cost int")
    seeds = spark.createDataFrame([(k, k) for k in range(0, 60, 7)], "search_id long, node long")
    expected = {}
    for s in range(0, 60, 7):
        todo = [(0, s)]
        while todo:
            c, a = heapq.heappop(todo)
            if (s, a) not in expected:
                expected[s, a] = c
                for b, more in near[a]:
                    if c + more <= 25:
                        heapq.heappush(todo, (c + more, b))
    for cell in (3, 1000):
        out = {(r["search_id"], r["node"]): r["cost"] for r in graph.shortest_paths(arcs, seeds, 25, cell=cell).collect()}
        assert out == expected


def test_offsets(spark):
    nodes = spark.range(8).withColumnRenamed("id", "node")
    arcs = spark.createDataFrame([(s, t, 1) for s, t in X7], "source long, target long, cost int")
    assert [r["first_arc"] for r in graph.offsets(nodes, arcs).orderBy("node").collect()] == [0, 3, 5, 8, 8, 8, 9, 9]


def tree(spark, edges, extra=()):
    both = [a for k, (s, t, c) in enumerate(edges) for a in ((2 * k, s, t, c, 1), (2 * k + 1, t, s, c + dict(extra).get(k, 0), 1))]
    return spark.createDataFrame(both, "arc_id long, source long, target long, cost int, weight int")


def test_contraction_of_a_tree(spark):
    nodes, arcs = spark.range(7).withColumnRenamed("id", "node"), tree(spark, X9)
    out = {(r["source"], r["target"]): r for r in graph.contract_chains(nodes, arcs, F.lit(False)).collect()}
    assert len(out) == 8 and out[0, 2]["cost"] == out[2, 0]["cost"] == 21
    assert out[0, 2]["represented"] == [0, 2, 4] and out[2, 0]["represented"] == [5, 3, 1]
    out = {(r["source"], r["target"]): r for r in graph.contract_chains(nodes, arcs, F.col("node").isin(3, 4, 6)).collect()}
    assert len(out) == 10 and out[0, 3]["cost"] == 15 and out[0, 3]["represented"] == [0, 2]


def test_contraction_keeps_each_directions_cost_and_undoes(spark):
    nodes, arcs = spark.range(7).withColumnRenamed("id", "node"), tree(spark, X9, {1: 100}.items())
    small = graph.contract_chains(nodes, arcs, F.lit(False))
    out = {(r["source"], r["target"]): r["cost"] for r in small.collect()}
    assert out[0, 2] == 21 and out[2, 0] == 121
    assert sorted(map(tuple, graph.undo_contraction(small, arcs).collect())) == sorted(map(tuple, arcs.collect()))


def test_contraction_of_a_triangle_keeps_parallel_arcs(spark):
    nodes, arcs = spark.range(5).withColumnRenamed("id", "node"), tree(spark, [(0, 1, 5), (0, 2, 10), (1, 2, 10), (2, 3, 1), (2, 4, 1)])
    out = graph.contract_chains(nodes, arcs, F.col("node") == 1).where("source = 1 AND target = 2").collect()
    assert sorted(r["cost"] for r in out) == [10, 15]


#: The preferences of X12 and X13.
SECONDS = [(800.0, 0.5), (3000.0, 0.5)]


def test_flooding(spark):
    arcs = text.graph_from_string(spark, X12).withColumn("weight", F.lit(1))
    entries = spark.createDataFrame([(0, 100.0), (3, 200.0)], "node long, population double")
    out = {(r["source"], r["target"]): r["value"] for r in models.flooding(arcs, entries, SECONDS, 3000).collect()}
    assert out == pytest.approx({**X12_VALUES, **{(t, s): v for (s, t), v in X12_VALUES.items()}}, rel=1e-5)


def test_via_edge(spark):
    arcs = text.graph_from_string(spark, X13).withColumn("weight", F.lit(1))
    entries = spark.createDataFrame([(0, 100.0), (3, 100.0)], "node long, population double")
    out = {(r["source"], r["target"]): r["value"] for r in models.via_edge(arcs, entries, SECONDS, 5000).collect()}
    assert out == pytest.approx(X13_VALUES, rel=1e-5)


def test_models_on_a_line(spark):
    """X14: no entries, nobody at them, and a limit that nothing is within, give 0; else all arcs are above 0."""
    line = text.graph_from_string(spark, "[4,6,{(1,600)},{(0,600)(2,600)},{(1,600)(3,600)},{(2,600)}]").withColumn("weight", F.lit(1))
    prefs = [(900.0, 0.5), (7200.0, 0.5)]
    for model, enough in ((models.flooding, 7200), (models.via_edge, 7200)):
        for rows, limit, above in (([], enough, False), ([(0, 0.0), (3, 0.0)], enough, False), ([(0, 10.0), (3, 20.0)], enough, True)):
            entries = spark.createDataFrame(rows, "node long, population double")
            out = [r["value"] for r in model(line, entries, prefs, limit).collect()]
            assert len(out) == 6 and all((v > 0) == above for v in out)


def test_preferences():
    geo.check_preferences(X15)
    for bad in ([(15.0, 0.5), (15.0, 0.2)], [(15.0, 1.2)], [(15.0, 0.75), (30.0, 0.5)]):
        with pytest.raises(ValueError):
            geo.check_preferences(bad)


def test_shares(spark):
    get = lambda c: spark.range(1).select(c).first()[0]
    assert get(geo.share_of(F.lit(20), X15)) == 0.25 and get(geo.share_of(F.lit(120), X15)) == 0.05
    suffix = geo.suffix_prefs(X15)
    assert get(geo.share_of(F.lit(16), suffix)) == pytest.approx(0.5) and get(geo.share_of(F.lit(61), suffix)) == pytest.approx(0.05)
    with pytest.raises(Exception, match="beyond the last bound"):
        get(geo.bucket(F.lit(121), [b for b, _ in X15]))


def test_contributions(spark):
    rows = [(0, k, v) for k, v in enumerate((1.0, 2.0, 5.0, 0.0))] + [(1, k, v) for k, v in enumerate((0.1, 0.5, 0.5, 0.5))]
    out = models.normalize_contributions(spark.createDataFrame(rows, "entry long, element long, value double"))
    assert {(r["entry"], r["element"]): r["value"] for r in out.collect()} == pytest.approx({**{(0, k): v for k, v in enumerate((0.2, 0.4, 1, 0))}, **{(1, k): v for k, v in enumerate((0.2, 1, 1, 1))}})


def test_counter_arcs_must_be_as_many(spark):
    arcs = spark.createDataFrame([(0, 1, 1, 1), (0, 1, 2, 1), (1, 0, 1, 1)], "source long, target long, cost int, weight int")
    with pytest.raises(Exception, match="no counter arc for 0->1"):
        graph.counter_arcs(arcs).collect()


def test_attractiveness_is_the_same_with_and_without_contraction_of_values_at_entries(spark):
    """Contraction keeps costs between the nodes left, and every original arc gets its new arc's value."""
    edges = [(0, 1, 3), (1, 2, 4), (2, 3, 5), (3, 4, 2), (2, 5, 6), (5, 6, 1)]
    nodes, arcs = spark.range(7).withColumnRenamed("id", "node"), tree(spark, edges)
    entries = spark.createDataFrame([(0, 10.0), (4, 20.0), (6, 30.0)], "node long, population double")
    for approach in models.APPROACHES:
        out = {r["element"]: r["value"] for r in models.edge_attractiveness(nodes, arcs, entries, [(1.0, 0.5), (2.0, 0.5)], approach).collect()}
        assert set(out) == set(range(12)) and all(v > 0 for v in out.values())
        assert out[0] == out[2] and out[1] == out[3] and out[4] == out[6] and out[8] == out[10]
    with pytest.raises(ValueError):
        models.edge_attractiveness(nodes, arcs, entries, [(1.0, 0.5)], 2)


def test_nearest_ends_without_nodes_and_without_coordinates(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1e6, 1e6)], "id long, x double, y double")
    nodes = spark.createDataFrame([(7, 3.0, 4.0)], "node_id long, x double, y double")
    assert {r["id"]: r["node_id"] for r in spatial.nearest(points, nodes).collect()} == {1: 7, 2: None, 3: None, 4: 7}
    assert {r["node_id"] for r in spatial.nearest(points, nodes.limit(0)).collect()} == {None}


def test_a_polygon_without_inner_points_keeps_its_people(spark):
    rows = [(1, 50.0, [(0.0, 0.0), (0.1, 0.0), (0.0, 0.1)]), (2, 60.0, [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)])]
    polygons = spark.createDataFrame(rows, "poly_id long, inhabitants double, ring array<struct<x:double,y:double>>")
    out = spatial.population_grid(polygons, 1.0).collect()
    assert sorted(tuple(r) for r in out) == [(1, 0.0, 0.0, 50.0), *((2, x, y, 15.0) for x in (1.0, 2.0) for y in (1.0, 2.0))]
    forest = spark.createDataFrame([(9, 0.0, [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)])], polygons.schema)
    assert sorted(tuple(r)[:3] for r in spatial.population_grid(polygons, 1.0, without=forest).where("poly_id = 2").collect()) == [(2, 1.0, 2.0), (2, 2.0, 1.0), (2, 2.0, 2.0)]
    assert spatial.population_grid(polygons, resolution=2).where("poly_id = 2").count() == 4


def test_hulls_hold_all_points(spark):
    rng = random.Random(1)
    rows = [(k % 3, round(rng.random(), 2), round(rng.random(), 2)) for k in range(300)]
    hulls = collections.defaultdict(list)
    for r in spatial.convex_hulls(spark.createDataFrame(rows, "key long, x double, y double")).orderBy("key", "n").collect():
        hulls[r["key"]].append((r["x"], r["y"]))
    for key, corners in hulls.items():
        own = {(x, y) for k, x, y in rows if k == key}
        assert set(corners) <= own
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-12 for x, y in own)


def test_ways_of_a_relation_are_put_in_order(spark):
    members = spark.createDataFrame([(1, k, w) for k, w in enumerate((10, 11, 12, 13))], "relation_id long, pos long, way_id long")
    ways = spark.createDataFrame([(10, [1, 2, 3]), (11, [5, 4, 1]), (12, [5, 6, 3])], "way_id long, nds array<long>")
    out = [r["nds"] for r in spatial.order_ways(members, ways).orderBy("pos").collect()]
    assert out[3] is None
    assert all(a[-1] == b[0] for a, b in zip(out[:3], out[1:3])) and {tuple(sorted(n)) for n in out[:3]} == {(1, 2, 3), (1, 4, 5), (3, 5, 6)}


def test_polylines_share_nodes(spark):
    rows = [(0, 7, 0.0, 0.0, 1, 1), (1, 7, 1.0, 0.0, 5, 2), (2, 8, 1.0, 0.0, 1, 1), (3, 8, 0.5, 0.5, 1, 1), (4, 8, 0.0, 1.0, 4, 3)]
    nodes, arcs = graph.polylines_to_graph(spark.createDataFrame(rows, "pos long, fid long, x double, y double, cost int, weight int"))
    assert sorted(tuple(r) for r in nodes.collect()) == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)]
    assert sorted(tuple(r) for r in arcs.collect()) == [(0, 0, 1, 5, 2, 7), (1, 1, 0, 5, 2, 7), (2, 1, 2, 4, 3, 8), (3, 2, 1, 4, 3, 8)]


def test_osm_extract(spark, tmp_path):
    path = tmp_path / "map.osm"
    path.write_text('<osm><node id="1" lat="1" lon="1"/><node id="2" lat="1" lon="2"><tag k="amenity" v="bench"/></node><way id="9"><nd ref="1"/><nd ref="2"/><tag k="historic" v="castle"/></way>'
                    '<relation id="5"><member type="way" ref="9" role="outer"/><member type="node" ref="1" role="label"/><tag k="landuse" v="forest"/></relation>'
                    '<relation id="6"><member type="way" ref="9" role="outer"/><tag k="type" v="boundary"/><tag k="name" v="A"/></relation></osm>')
    kept = osm.relevant_relations(text.read_osm_relations(spark, str(path))).collect()
    assert [(r["relation_id"], r["forest"], [tuple(m) for m in r["members"]]) for r in kept] == [(5, True, [("way", 9, "outer")])]
    tagged = text.read_osm_nodes(spark, str(path)).select(F.col("node_id").alias("osm_id"), F.explode("tags")).unionByName(text.read_osm(spark, str(path))[1].select(F.col("way_id").alias("osm_id"), F.explode("tags")))
    out = osm.poi_categories(tagged, text.read_osm(spark, str(path))[1])
    assert {r["node_id"]: r["category"] for r in out.collect()} == {1: 3, 2: 3}


def test_rasters_are_stored_and_read_by_level(spark, tmp_path):
    heat = spark.createDataFrame([("a", 1.0, 1.0, 2.0), ("b", 3.0, 1.0, 5.0), ("a", 9.0, 9.0, 1.0)], "dataset string, lat double, lon double, heat double")
    levels = None
    for name in ("a", "b"):
        own = raster.pyramid(heat.where(F.col("dataset") == name), 1.0, 1.0, 3).withColumn("dataset", F.lit(name))
        levels = own if levels is None else levels.unionByName(own)
    raster.save_pyramids(levels, str(tmp_path / "p"))
    assert raster.load_raster(spark, str(tmp_path / "p"), "a", 2).agg(F.sum("heat")).first()[0] == 3.0


def test_sinks(spark, tmp_path):
    values = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "pos long, value double")
    entries, lots = sinks.split_positions(values, 2)
    assert entries.count() == 2 and [tuple(r) for r in lots.collect()] == [(0, 3.0)]
    arcs = spark.createDataFrame([(1, 5.0, 6.0, 2, 0), (1, 7.0, 8.0, 1, 1), (2, 1.0, 2.0, 0, 2)], "target long, lat double, lon double, type int, pos long")
    assert [tuple(r) for r in sinks.target_points(arcs, 3, 1).collect()] == [(1, '{"lat":5.0,"lon":6.0,"count":1}')]
    sinks.write_by_level(spark.createDataFrame([(4, "x"), (6, "y")], "admin_level int, name string"), str(tmp_path / "areas"))
    assert {p.name for p in (tmp_path / "areas").glob("admin_level=*")} == {"admin_level=4", "admin_level=6"}
    nodes = spark.range(3).withColumnRenamed("id", "node")
    assert text.graph_to_string(nodes, text.graph_from_string(spark, X5)).first()[0] == "[3,4,{(1,3)},{(0,3),(2,3)},{(1,3)}]"


def test_sums_are_observed_on_the_way(spark):
    people = spark.createDataFrame([(1, 60.0, 10.0), (2, 20.0, 9.0)], "entry long, walking double, cycling double")
    frame, seen = models.observed(people, "shares", walking="walking", cycling="cycling")
    assert frame.where("entry = 1").count() == 1
    assert seen.get == {"rows": 2, "walking": 80.0, "cycling": 19.0}
    assert models.observed_gaps(seen, {"walking": 0.8, "cycling": 0.1}, 100.0) == {"walking": False, "cycling": True}


def test_polygons_of_shuffled_and_turned_ways(spark):
    """A ring of three ways in any order, one of them turned, and a second ring, are two polygons."""
    ways = spark.createDataFrame([(1, [1, 2, 3]), (2, [5, 4, 3]), (3, [5, 6, 1]), (4, [20, 21, 22, 20]), (9, [])], "way_id long, nds array<long>")
    members = spark.createDataFrame([(7, 0, 1), (7, 1, 4), (7, 2, 3), (7, 3, 2), (7, 4, 99)], "relation_id long, pos int, way_id long")
    rings = [r["nds"] for r in spatial.assembled_polygons(members, ways).orderBy("polygon").collect()]
    closed = [sorted(set(n)) for n in rings]
    assert sorted(closed) == [[1, 2, 3, 4, 5, 6], [20, 21, 22]] and all(n[0] == n[-1] for n in rings)


def test_translated_ids_are_written_and_read_again(spark, tmp_path):
    nodes = spark.createDataFrame([(-9, 1.5, 2.5, {"a": "b"}), (30, 3.0, 4.0, {}), (7, 5.0, 6.0, {})], "node_id long, lat double, lon double, tags map<string,string>")
    ways = spark.createDataFrame([(5, [30, -9, 7, 30], {"Objektname": "Wald", "x": "y"}), (2, [7], {"highway": "path"})], "way_id long, nds array<long>, tags map<string,string>")
    moved = sinks.translate_ids(nodes, ways, 100)
    sinks.write_osm(*moved, str(tmp_path / "osm"))
    back_nodes, back_ways = text.read_osm_nodes(spark, f"{tmp_path}/osm/nodes"), text.read_osm(spark, f"{tmp_path}/osm/*")[1]
    assert {(r["node_id"], r["lat"], r["lon"], *r["tags"].items()) for r in back_nodes.collect()} == {(100, 1.5, 2.5, ("a", "b")), (101, 5.0, 6.0), (102, 3.0, 4.0)}
    assert {r["way_id"]: (r["nds"], r["tags"]) for r in back_ways.collect()} == {101: ([102, 100, 101, 102], {"x": "y", "landuse": "forest"}), 100: ([101], {"highway": "path"})}
    with pytest.raises(Exception, match="no node 30"):
        sinks.translate_ids(nodes.where("node_id < 30"), ways, 0)[1].collect()


def test_speeds_by_tags(spark):
    rows = spark.createDataFrame([(1, {"highway": "path"}), (2, {"highway": "moon"}), (3, {"KLASSE": "87004"}), (4, {"KLASSE": "x"}), (5, {}), (6, {"highway": "steps", "KLASSE": "90001"})], "k int, tags map<string,string>")
    assert {r["k"]: r["s"] for r in rows.select("k", speeds.tag_speed(F.col("tags")).alias("s")).collect()} == {1: 5, 2: None, 3: 25, 4: None, 5: None, 6: 3}


def test_walkers_leave_out_large_roads(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 164001), (1, 1, 3.0, 4.0, 164001), (2, 0, 0.0, 0.0, 90005), (2, 1, 0.0, 36.0, 90005)], "fid long, pos int, x double, y double, klasse int")
    cost = lambda most, **named: {r["fid"]: round(r["cost"], 6) for r in graph.road_segments(v, most, **named).collect()}
    assert cost(speeds.WALKING_SPEED, way_class="klasse") == {2: 25.92}
    assert cost(36, way_class="klasse") == {1: 0.5, 2: 3.6}
    assert cost(36) == {1: 3.6, 2: 25.92}
