"""Queries of the operators over the driver's tables, and the same in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.functions import geo, speeds
from waynet.operators import contraction as contracting
from waynet.operators import graph, heat_tiles, models, osm, raster, search, spatial, walks
from waynet.plans import extract
from waynet.plans.iterate import new_folder
from waynet.sources import scan, sinks
from waynet.sources.derived import COLUMNS, SQL, city_arcs, city_nodes, points, road_arcs, table

PREFS = [(60.0, 0.5), (150.0, 0.3), (300.0, 0.2)]
LIMIT = 150
#: Nodes of a cell in these queries, so that their searches cross many borders.
CELL = 32
_WITH = f"WITH {SQL['points']}, {SQL['road']}"
_REC = f"WITH RECURSIVE {SQL['points']}, {SQL['road']}"
_DIST = f"""w AS (SELECT vec_id AS search_id, vec_id AS node, 0 AS cost FROM points WHERE vec_id % 25 = 0
    UNION SELECT w.search_id, a.target, w.cost + a.cost FROM w JOIN arcs a ON a.source = w.node WHERE w.cost + a.cost <= {LIMIT}),
    dist AS (SELECT search_id, node, min(cost) AS cost FROM w GROUP BY ALL)"""
_SUFFIX = "CASE WHEN {0} <= 60 THEN 1.0 WHEN {0} <= 150 THEN 0.5 WHEN {0} <= 300 THEN 0.2 ELSE 0.0 END"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where("vec_id % 25 = 0").select(F.col("vec_id").alias("node"), (F.col("vec_id") + 100.0).alias("population"))


def _nodes(spark, d):
    return points(spark, d).select(F.col("vec_id").alias("node"))


def _zones(spark, d):
    """A zone for each supplier, of four corners."""
    k = F.col("s_suppkey")
    x, y, w, h = ((k * 37 % 80) / F.lit(100.0) - 0.4, (k * 53 % 80) / F.lit(100.0) - 0.4, (k % 7) / F.lit(100.0) + 0.05, (k % 5) / F.lit(100.0) + 0.05)
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    own = table(spark, d, "supplier").select(k.alias("poly_id"), (k % 50 + 100).cast("double").alias("inhabitants"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    x, y, w, h = (F.col(c) for c in "xywh")
    return own.select("poly_id", "inhabitants", F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h / 2)).alias("ring"))


def _lines(spark, d):
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fid"), pos.alias("pos"), (F.col("l_partkey") % 97).cast("double").alias("x"), (F.col("l_suppkey") % 89).cast("double").alias("y"))


def _heat(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("dataset"), (F.col("user_id") % 90 + 0.25).alias("lat"), (F.col("event_id") % 170 + 0.75).alias("lon"), F.floor(F.col("value")).cast("double").alias("heat"))


def _levels_sql(levels):
    """Tables r12, r11 and so on of the raster at each level, each made of the one before."""
    metres = lambda a, b, c, e: f"2 * 6371000.785 * asin(sqrt(sin((radians({c})-radians({a}))/2)*sin((radians({c})-radians({a}))/2) + cos(radians({a}))*cos(radians({c}))*sin((radians({e})-radians({b}))/2)*sin((radians({e})-radians({b}))/2)))"
    parts, before = ["b AS (SELECT dataset, min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e FROM heat GROUP BY dataset)"], "heat"
    for zoom, south, _, north, _, rows in levels:
        step = f"'{(north - south) / (rows - 1)!r}'::DOUBLE"
        parts.append(f"f{zoom} AS (SELECT *, CASE WHEN ceil((n - s + {step}) / {step}) > 1 THEN (n - s) / (ceil((n - s + {step}) / {step}) - 1) ELSE {step} END AS f FROM b)")
        parts.append(f"h{zoom} AS (SELECT *, ({metres('n', '0.0::DOUBLE', '(n - f)', '0.0::DOUBLE')}) / ({metres('n', '0.0::DOUBLE', 'n', '1.0::DOUBLE')}) AS h FROM f{zoom})")
        parts.append(f"e{zoom} AS (SELECT dataset, f, h, (floor(s / f) - 0.5::DOUBLE) * f AS a0, (floor(w / h) - 0.5::DOUBLE) * h AS o0, n + 0.5::DOUBLE * f AS a1, e + 0.5::DOUBLE * h AS o1 FROM h{zoom})")
        parts.append(f"""c{zoom} AS (SELECT dataset, floor((lat + 0.5::DOUBLE * f - a0) / f) AS la, floor((lon + 0.5::DOUBLE * h - o0) / h) AS lo, a0, o0, e{zoom}.f AS f, (o1 - o0) / ceil((o1 - o0) / h) AS width, heat
            FROM (SELECT dataset, lat, lon, heat FROM {before}) p JOIN e{zoom} USING (dataset) WHERE lat >= a0 AND lat <= a1 AND lon >= o0 AND lon < o1)""")
        parts.append(f"r{zoom} AS (SELECT dataset, a0 + la * f AS lat, o0 + lo * width AS lon, sum(heat) AS heat, f AS step FROM c{zoom} GROUP BY dataset, la, lo, a0, o0, f, width HAVING sum(heat) > 0)")
        before = f"r{zoom}"
    return ", ".join(parts)


_ROAD_ROWS = f"""s(i, class, speed) AS (VALUES {", ".join(str((i, *x)) for i, x in enumerate(speeds.CLASS_SPEEDS.items()))}),
        r AS (SELECT l_orderkey AS fid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p, (l_partkey % 97)::DOUBLE AS x, (l_suppkey % 89)::DOUBLE AS y FROM lineitem),
        v AS (SELECT fid * 1000 + p AS pos, p, fid, x, y, class, speed FROM r JOIN s ON s.i = fid % {len(speeds.CLASS_SPEEDS)})"""
_HEAT = "heat AS (SELECT event_type AS dataset, user_id % 90 + 0.25::DOUBLE AS lat, event_id % 170 + 0.75::DOUBLE AS lon, floor(value)::DOUBLE AS heat FROM events)"


def flooding(spark, d):
    out = models.flooding(road_arcs(spark, d), _entries(spark, d), PREFS, 2 * LIMIT, cell=CELL)
    return out.select("source", "target", F.round("value", 6).alias("value"))


def sssp(spark, d):
    seeds = points(spark, d).where("vec_id % 25 = 0").select(F.col("vec_id").alias("search_id"), F.col("vec_id").alias("node"))
    return graph.shortest_paths(road_arcs(spark, d), seeds, LIMIT, cell=CELL).select("search_id", "node", "cost")


def city_paths(spark, d):
    cells = search.place_cells(city_nodes(spark, d).select("node", "x", "y"), CELL)
    seeds = city_nodes(spark, d).where("k % 97 = 0").select(F.col("k").alias("search_id"), "node")
    return graph.shortest_paths(city_arcs(spark, d), seeds, LIMIT, cells=cells)


def city_flooding(spark, d):
    nodes = city_nodes(spark, d)
    cells = search.place_cells(nodes.select("node", "x", "y"), CELL)
    homes = nodes.where("k % 97 = 0").select("node", (F.col("k") % 50 + 1.0).alias("population"))
    out = models.flooding(city_arcs(spark, d), homes, PREFS, 2 * LIMIT, cells=cells)
    return out.select("source", "target", F.round("value", 6).alias("value"))


def _crossings(spark, d):
    """Crossings with coordinates in degrees."""
    return city_nodes(spark, d).select("node", (49 + F.col("y") * 1e-4).alias("lat"), (7 + F.col("x") * 1e-4).alias("lon"))


def city_contraction(spark, d):
    keep = city_nodes(spark, d).where("k % 97 = 0")
    return contracting.contract_cheap(city_arcs(spark, d), 25, keep)[0].select("source", "target", F.col("cost").cast("int").alias("cost"))


def city_undo(spark, d):
    keep = city_nodes(spark, d).where("k % 97 = 0")
    small, shortcuts = contracting.contract_cheap(city_arcs(spark, d), 25, keep)
    return contracting.undo(small, shortcuts, "cost")


def city_clusters(spark, d):
    arcs = city_arcs(spark, d)
    label = graph.cut(contracting.clusters(_crossings(spark, d), arcs))
    border = contracting.border_nodes(label, arcs).withColumn("border", F.lit(True))
    return label.join(border, "node", "left").select("node", "cluster", F.coalesce("border", F.lit(False)).alias("border"))


def cluster_contraction(spark, d):
    return contracting.contract_clusters(_crossings(spark, d), city_arcs(spark, d))[0].select("source", "target", "cost")


def pruned_walkways(spark, d):
    arcs, entries = road_arcs(spark, d), _entries(spark, d).select("node")
    targets = _nodes(spark, d).where("node % 5 = 0")
    found = walks.walkways(arcs, entries, targets, LIMIT, 2, distance_to_border(spark, d), allowed=F.col("weight") > 0)
    return found.select(F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "cost")


def walkway_bins(spark, d):
    arcs, entries = road_arcs(spark, d), _entries(spark, d).select("node")
    targets = _nodes(spark, d).where("node % 5 = 0")
    found = walks.walkways(arcs, entries, targets, 60, 3, once=False)
    return walks.length_bins(found.select(F.element_at("path", 1).alias("start"), "cost"))


def entry_distances(spark, d):
    e = _entries(spark, d)
    dist = graph.shortest_paths(road_arcs(spark, d), e.select(F.col("node").alias("search_id"), "node"), 4 * LIMIT, cell=CELL)
    return dist.join(e.select("node"), "node", "left_semi").where("search_id <= node").select(F.col("search_id").alias("a"), F.col("node").alias("b"), "cost")


def distance_to_border(spark, d):
    seeds = points(spark, d).where("vec_id % 25 = 0").select(F.lit(0).alias("search_id"), F.col("vec_id").alias("node"))
    return graph.shortest_paths(road_arcs(spark, d), seeds, LIMIT, cell=CELL).select("node", "cost")


def components(spark, d):
    return graph.connected_components(_nodes(spark, d), road_arcs(spark, d))


def component_sizes(spark, d):
    return components(spark, d).groupBy("component").count().withColumnRenamed("count", "n")


def largest_component(spark, d):
    label = components(spark, d)
    return graph.restrict(road_arcs(spark, d), graph.largest_component(label))


def via_edge(spark, d):
    return models.via_edge(road_arcs(spark, d), _entries(spark, d), PREFS, 2 * LIMIT, CELL).select("source", "target", F.round("value", 6).alias("value"))


def contraction(spark, d):
    return graph.contract_chains(_nodes(spark, d), road_arcs(spark, d), F.col("node") % 25 == 0)


def walkways(spark, d):
    targets = _nodes(spark, d).where("node % 5 = 0")
    return graph.walkways(road_arcs(spark, d), _entries(spark, d).select("node"), targets, 100, 3).select(F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "cost")


def offsets(spark, d):
    return graph.offsets(_nodes(spark, d), road_arcs(spark, d)).withColumn("first_arc", F.col("first_arc").cast("long"))


def least_arcs(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (1000000 + F.col("l_partkey")).alias("target"), F.floor("l_quantity").cast("int").alias("cost"))
    return graph.least_arcs(rows)


def counter_arcs(spark, d):
    return graph.counter_arcs(road_arcs(spark, d))


def node_weights(spark, d):
    return models.node_weights(road_arcs(spark, d))


def segments(spark, d):
    return graph.polylines_to_segments(_lines(spark, d)).withColumn("length", F.round("length", 6))


def nearest_nodes(spark, d):
    p = points(spark, d)
    nodes = p.where("vec_id % 3 = 0").select(F.col("vec_id").alias("node_id"), "x", "y")
    return spatial.nearest(p.select(F.col("vec_id").alias("id"), "x", "y"), nodes).select("id", "node_id")


def nearest_three_within(spark, d):
    p = points(spark, d)
    nodes = p.select(F.col("vec_id").alias("node_id"), "x", "y")
    return spatial.within_radius(p.select(F.col("vec_id").alias("id"), "x", "y"), nodes, 0.1, 3).select("id", "node_id", "rank")


def points_in_zones(spark, d):
    return spatial.points_in_polygons(points(spark, d).select(F.col("vec_id").alias("id"), "x", "y"), _zones(spark, d), 0.1)


def _streets(spark, d):
    """A way for each street of the city, from a crossing to the one beside it or below it."""
    n = city_nodes(spark, d)
    ends = F.array(F.struct((2 * F.col("k")).alias("way_id"), F.when(F.col("k") % COLUMNS != COLUMNS - 1, F.col("k") + 1).alias("other")), F.struct((2 * F.col("k") + 1).alias("way_id"), (F.col("k") + COLUMNS).alias("other")))
    ways = n.select("node", "size", F.explode(ends).alias("e")).select("node", "size", "e.*").join(n.select(F.col("k").alias("other"), F.col("node").alias("b")), "other")
    kind = F.when(F.col("size") % 3 == 0, "track").when(F.col("size") % 3 == 1, "residential").otherwise("corridor")
    return ways.select("way_id", F.array("node", "b").alias("nds"), F.create_map(F.lit("highway"), kind).alias("tags"))


def map_extract(spark, d):
    """The city as a map with forests of five streets by three, whose rings come in two ways, the second turned round."""
    n = city_nodes(spark, d)
    bench = F.when(F.col("size") == 1, F.create_map(F.lit("amenity"), F.lit("bench"))).otherwise(F.create_map().cast("map<string,string>"))
    nodes = n.select(F.col("node").alias("node_id"), (F.col("y") / 8).alias("lat"), (F.col("x") / 8).alias("lon"), bench.alias("tags"))
    corner = lambda by, name: n.select((F.col("k") - by).alias("k"), F.col("node").alias(name))
    woods = n.where("x % 10 = 2 AND y % 4 = 0").select("k", F.col("node").alias("c0"))
    for by, name in ((5, "c1"), (3 * COLUMNS + 5, "c2"), (3 * COLUMNS, "c3")):
        woods = woods.join(corner(by, name), "k")
    halves = F.array(F.struct(F.lit(0).alias("half"), F.array("c0", "c1", "c2").alias("nds")), F.struct(F.lit(1).alias("half"), F.array("c0", "c3", "c2").alias("nds")))
    way_id = lambda half: -2 * F.col("k") - 1 - half
    borders = woods.select("k", F.explode(halves).alias("h")).select(way_id(F.col("h.half")).alias("way_id"), "h.nds", F.create_map().cast("map<string,string>").alias("tags"))
    member = lambda half: F.struct(F.lit("way").alias("type"), way_id(half).alias("ref"), F.lit("outer").alias("role"))
    relations = woods.select(F.col("k").alias("relation_id"), F.array(member(0), member(1)).alias("members"), F.create_map(F.lit("natural"), F.lit("wood")).alias("tags"))
    found = extract.extract_map(nodes, _streets(spark, d).unionByName(borders), relations, size=0.5)
    return found.nodes.join(found.pois.select("node", "category"), "node", "left").select("node", "node_id", "flag", "category")


def scanned_roads(spark, d):
    """The city written as OSM XML, read by bytes, with the whole-second costs of cars."""
    nodes = city_nodes(spark, d).select(F.col("node").alias("node_id"), (F.col("y") / 1000 + F.col("size") / 100000).alias("lat"), (F.col("x") / 1000).alias("lon"), F.create_map().cast("map<string,string>").alias("tags"))
    path = new_folder(spark, "scanned")
    sinks.write_osm(nodes, _streets(spark, d), path)
    found, ways = scan.scan_osm(spark, f"{path}/*")
    arcs = scan.whole_second_arcs(found, ways, "car")
    a, b = (found.select(F.col("node").alias(c), F.col("node_id").alias(f"{c}_id")) for c in ("source", "target"))
    return arcs.join(a, "source").join(b, "target").select("source_id", "target_id", "cost")


def _districts(spark, d):
    """Eight districts around the middle, with a corner for every eighth part as far out as its size says."""
    k = F.col("p_partkey") - 1
    sizes = table(spark, d, "part").groupBy((k % 8).alias("poly_id")).agg(F.sort_array(F.collect_list(F.struct(F.floor(k / 8).alias("k"), F.col("p_size").alias("size")))).alias("sizes"))
    turn = lambda i: 2 * F.pi() * i / F.size("sizes")
    reach = lambda s: 0.15 + s["size"] / F.lit(250.0)
    x, y = (F.col("poly_id") % 3 - 1) * F.lit(0.15), (F.floor(F.col("poly_id") / 3) - 1) * F.lit(0.15)
    return sizes.select("poly_id", F.transform("sizes", lambda s, i: F.struct((x + reach(s) * F.cos(turn(i))).alias("x"), (y + reach(s) * F.sin(turn(i))).alias("y"))).alias("ring"))


def points_in_districts(spark, d):
    return spatial.points_in_polygons(points(spark, d).select(F.col("vec_id").alias("id"), "x", "y"), _districts(spark, d), 0.02)


def population_grid(spark, d):
    return spatial.population_grid(_zones(spark, d), 0.03).select("poly_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "population")))


def hulls(spark, d):
    p = points(spark, d).select((F.col("vec_id") % 5).alias("key"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
    return spatial.convex_hulls(p)


def distances(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 90).cast("double").alias("lat"), (F.col("c_custkey") % 180).cast("double").alias("lon"))
    metres = geo.great_circle(F.col("lat"), F.col("lon"), F.col("lat") / 2, F.col("lon") / 3)
    return c.select("c_custkey", F.round(metres, 2).alias("metres"), F.round(geo.travel_seconds(metres, F.lit(50.0), F.lit(30.0)), 2).alias("seconds"))


def preference_lookup(spark, d):
    o = road_arcs(spark, d).select("source", "target", "cost")
    return o.select("source", "target", geo.share_of(F.col("cost"), PREFS).alias("share"), geo.share_of(F.col("cost"), geo.suffix_prefs(PREFS)).alias("suffix"), geo.bucket(F.col("cost"), [b for b, _ in PREFS]).cast("int").alias("bucket"))


def entry_popularity(spark, d):
    seeds = _entries(spark, d).select(F.col("node").alias("search_id"), "node")
    found = graph.shortest_paths(road_arcs(spark, d), seeds, int(PREFS[-1][0]), cell=CELL)
    dist = found.select(F.col("search_id").alias("entry"), F.col("node").alias("pop"), F.col("cost"))
    people = points(spark, d).select(F.col("vec_id").alias("pop"), (F.col("vec_id") % 7 + 1.0).alias("population"))
    return models.entry_popularity(dist, people, PREFS, 0.5).withColumn("popularity", F.round("popularity", 6))


def parking_population(spark, d):
    lots = table(spark, d, "supplier").select("s_suppkey", (1 + F.col("s_suppkey") % 5).cast("double").alias("rank"))
    return models.distribute_by_rank(lots, 1000.0).select("s_suppkey", F.round("population", 6).alias("population"))


def normalized(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("entry"), F.col("o_orderkey").alias("element"), F.col("o_totalprice").alias("value"))
    return models.normalize_contributions(c).withColumn("value", F.round("value", 6))


def node_heat(spark, d):
    arcs = road_arcs(spark, d).withColumn("heat", F.col("cost").cast("double"))
    return raster.node_heat(arcs, points(spark, d).select(F.col("vec_id").alias("node"), (F.col("vec_id") % 4).alias("flag")))


def heat_raster(spark, d):
    return raster.rasterize(_heat(spark, d), 2.0, 3.0)


def heat_pyramid(spark, d):
    return raster.pyramid(_heat(spark, d), 2.0, 3.0, 4)


def heat_extract(spark, d):
    return raster.extract(_heat(spark, d), 10.25, 20.75, 30.25, 60.75)


def heat_bounds(spark, d):
    return raster.bounds(_heat(spark, d))


def heat_median(spark, d):
    return raster.upper_median(_heat(spark, d), "dataset", "heat")


def heat_answer(spark, d):
    return raster.answer(raster.extract(_heat(spark, d), 10.25, 20.75, 20.25, 40.75).distinct())


_KINDS = [*speeds.OSM_SPEEDS, "ferry"]


def way_speeds(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (1 + F.col("o_orderkey") % len(_KINDS)).cast("int"))
    ways = table(spark, d, "orders").select("o_orderkey", kind.alias("kind"))
    return ways.select("o_orderkey", "kind", speeds.way_type_id(F.col("kind")).alias("type_id"), *(speeds.way_speed(F.col("kind"), p).alias(p) for p in speeds.PROFILES))


def class_speeds(spark, d):
    classes = list(speeds.CLASS_SPEEDS)
    of = F.element_at(F.array(*map(F.lit, classes)), (1 + F.col("o_orderkey") % len(classes)).cast("int"))
    ways = table(spark, d, "orders").select("o_orderkey", of.alias("class"))
    return ways.select("o_orderkey", "class", speeds.class_speed(F.col("class"), F.lit(90)).alias("speed"), speeds.is_road(F.col("class"), speeds.LARGE_ROADS).alias("large"), speeds.is_road(F.col("class"), speeds.SMALL_ROADS).alias("small"))


def merged_popularity(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entry"))
    walking, cycling = (s.select("entry", (F.col("entry") % k).cast("double").alias("popularity")) for k in (7, 3))
    key = F.col("c_custkey")
    people = table(spark, d, "customer").select(key.alias("pop"), (key % 11 + 1).cast("double").alias("population"), (key % 2 == 0).alias("walks"), (key % 3 == 0).alias("cycles"))
    return models.merge_popularity(walking, cycling, people, 0.25, 0.125, 0.5).withColumn("popularity", F.round("popularity", 6))


def even_split(spark, d):
    reach = table(spark, d, "orders").select(F.col("o_custkey").alias("pop"), (F.col("o_orderkey") % 50).alias("entry")).distinct()
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("pop"))
    return models.split_evenly(reach, points, 280000.0).withColumn("population", F.round("population", 6))


def even_arc_weights(spark, d):
    return models.even_arc_weights(road_arcs(spark, d), _entries(spark, d), 2 * LIMIT, CELL).withColumn("value", F.round("value", 6))


def expanded_results(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    results = o.select(key.alias("pos"), key.alias("label"), F.when(F.col("o_custkey") % 3 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("value"))
    represented = o.select(key.alias("label"), F.array(key % 900, F.col("o_custkey") % 900).alias("ids"))
    return sinks.expand_results(results, represented)


def last_feature(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target"), F.col("l_orderkey").alias("fid"), F.struct("l_orderkey", "l_linenumber").alias("pos"))
    return sinks.last_feature(rows)


def feature_weights(spark, d):
    arcs = table(spark, d, "orders").select(F.col("o_custkey").alias("fid"), F.col("o_totalprice").alias("value"))
    features = table(spark, d, "customer").select(F.col("c_custkey").alias("fid"), "c_name")
    return sinks.feature_weights(features, arcs).withColumn("value", F.round("value", 2))


def arc_lines(spark, d):
    arcs = road_arcs(spark, d).withColumn("pos", F.col("target"))
    return sinks.arc_lines(arcs, ["source", "target", "cost"])


def relation_polygons(spark, d):
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("relation_id"), pos.alias("pos"), F.col("l_suppkey").alias("way_id"))
    w = F.col("s_suppkey")
    ways = table(spark, d, "supplier").where(w % 10 != 0).select(w.alias("way_id"), F.array(w % 2, w + 10, w % 3).alias("nds"))
    return spatial.relation_polygons(members, ways).withColumn("nds", F.array_join(F.col("nds").cast("array<string>"), "-"))


def shuffled_rings(spark, d):
    """Rings of 5000 ways, a way for each order, whose members come in an order of their own and every third way turned."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    follows = F.when((k % 5000 == 4999) | (k == F.lit(last)), k - k % 5000).otherwise(k + 1)
    ways = orders.select(k.alias("way_id"), F.when(k % 3 == 0, F.array(follows, -k - 1, k)).otherwise(F.array(k, -k - 1, follows)).alias("nds"))
    members = orders.select(F.floor(k / 5000).alias("relation_id"), (k * 48271 % 2147483647).alias("pos"), k.alias("way_id"))
    text = F.md5(F.array_join(F.col("nds").cast("array<string>"), "-").cast("binary"))
    return spatial.assembled_polygons(members, ways).select("relation_id", "polygon", F.size("nds").alias("n"), F.get("nds", F.lit(0)).alias("first"), text.alias("nodes_md5"))


MINUTES = [(0.5, 0.5), (1.0, 0.3)]


def popularity(spark, d):
    e = _entries(spark, d)
    entries = e.select((F.col("node") / 25).cast("long").alias("pos"), "node")
    people = points(spark, d).select(F.col("vec_id").alias("pop"), F.col("vec_id").alias("node"), (F.col("vec_id") % 7 + 1.0).alias("population"))
    lots = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), (F.col("n_nationkey") % 4).cast("double").alias("rank"))
    return models.popularity(road_arcs(spark, d), entries, people, lots, MINUTES, cell=CELL).withColumn("population", F.round("population", 6))


def edge_attractiveness(spark, d):
    arcs = graph.running_total(road_arcs(spark, d), ["source", "target"], F.lit(1), "arc_id")
    return models.edge_attractiveness(_nodes(spark, d), arcs, _entries(spark, d), [(m * 5, s) for m, s in MINUTES], 0).withColumn("value", F.round("value", 6))


def graph_of_lines(spark, d):
    rows = _lines(spark, d).select((F.col("fid") * 1000 + F.col("pos")).alias("pos"), "fid", "x", "y", (F.col("fid") % 50 + 1).alias("cost"), (F.col("fid") % 3).alias("weight"))
    return graph.polylines_to_graph(rows)[1]


def _classified(spark, d):
    return points(spark, d).select(F.col("vec_id").alias("node"), F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0).alias("flag"))


def entry_classes(spark, d):
    return osm.classify_entries(_classified(spark, d), road_arcs(spark, d))


_KEYS = ["amenity", "tourism", "historic", "historic", "natural", "shop"]
_VALUES = ["bar", "viewpoint", "castle", "memorial", "peak", "bakery"]


def poi_categories(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_custkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (1 + k % len(values)).cast("int"))
    tagged = o.select((F.col("o_orderkey") % 2000).alias("osm_id"), pick(_KEYS).alias("key"), pick(_VALUES).alias("value"))
    s = F.col("s_suppkey")
    ways = table(spark, d, "supplier").select(s.alias("way_id"), F.array(s + 3000, s + 3001).alias("nds"))
    return osm.poi_categories(tagged, ways)


def way_edges(spark, d):
    l = _lines(spark, d).groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("pos", "y"))).alias("v"))
    ways = l.select(F.col("fid").alias("way_id"), F.transform("v", lambda x: x["y"].cast("long")).alias("nds"))
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") % 80).cast("double").alias("lat"), (F.col("s_suppkey") % 70).cast("double").alias("lon"))
    return graph.way_arcs(ways, nodes, F.lit(50.0)).select("way_id", "pos", "source", "target", F.round("metres", 2).alias("metres"), F.round("seconds", 2).alias("seconds"))


def road_costs(spark, d):
    """Roads of walkers, who leave out the large ones."""
    classes = list(speeds.CLASS_SPEEDS)
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    of = F.element_at(F.array(*map(F.lit, classes)), (1 + F.col("l_orderkey") % len(classes)).cast("int"))
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fid"), pos.alias("pos"), (F.col("l_partkey") % 97).cast("double").alias("x"), (F.col("l_suppkey") % 89).cast("double").alias("y"), of.alias("klasse"), F.col("l_linenumber").alias("wert"))
    out = graph.road_segments(v, speeds.WALKING_SPEED, "klasse", "wert")
    return out.select("fid", "x0", "y0", "x1", "y1", F.round("cost", 5).alias("cost"), "weight")


def _road_rows(spark, d):
    """Vertices of all roads in one order, with an official class each."""
    classes = list(speeds.CLASS_SPEEDS)
    of = F.element_at(F.array(*map(F.lit, classes)), (1 + F.col("fid") % len(classes)).cast("int"))
    return _lines(spark, d).select((F.col("fid") * 1000 + F.col("pos")).alias("pos"), "fid", "x", "y", of.alias("way_class"), (F.col("pos") % 5).alias("wert"))


def vertex_graph(spark, d):
    return graph.vertex_graph(_road_rows(spark, d), 50)[1].withColumn("cost", F.round("cost", 5))


def feature_graph(spark, d):
    """Roads of walkers: one with a large class is left out."""
    return graph.feature_graph(_road_rows(spark, d), speeds.WALKING_SPEED, "way_class", "wert")[1].withColumn("cost", F.round("cost", 5))


def translated_ids(spark, d):
    l = _lines(spark, d).groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("pos", "y"))).alias("v"))
    ways = l.select(F.col("fid").alias("way_id"), F.transform("v", lambda x: (7 * x["y"] + 5).cast("long")).alias("nds"), F.create_map(F.lit("Objektname"), F.when(F.col("fid") % 2 == 0, "Wald").otherwise("Weg")).alias("tags"))
    nodes = ways.select(F.explode("nds").alias("node_id")).distinct()
    moved = sinks.translate_ids(nodes, ways, 1000)[1]
    return moved.select("way_id", F.array_join(F.col("nds").cast("array<string>"), "-").alias("nds"), F.to_json("tags").alias("tags"))


def box_raster(spark, d):
    out = raster.rasterize_box(_heat(spark, d), 10.25, 20.75, 60.25, 120.75, 48)
    return out.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "heat")


#: What a map shows at each zoom: zoom, south, west, north, east, raster rows.
ZOOMS = [(12, 0.0, 0.0, 50.0, 60.0, 48), (11, 0.0, 0.0, 60.0, 80.0, 24), (10, 0.0, 0.0, 80.0, 160.0, 12)]


def heat_levels(spark, d):
    out = heat_tiles.zoom_rasters(_heat(spark, d), ZOOMS)
    return out.select("dataset", "zoom", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "heat")


def heat_pages(spark, d):
    """A map's request for the first dataset at a zoom beyond the finest, answered from stored tiles of all datasets."""
    path, first = new_folder(spark, "heat-tiles"), _heat(spark, d).agg(F.min("dataset")).first()[0]
    heat_tiles.save_tiles(heat_tiles.zoom_rasters(_heat(spark, d), ZOOMS), path)
    return heat_tiles.pages(heat_tiles.request(spark, path, first, 14, (10.1, 20.1, 60.1, 150.1)))


def middle_heat(spark, d):
    e = _heat(spark, d)
    return raster.middle_heat(e, ["lat", "lon", "heat"])


def zone_of_point(spark, d):
    return spatial.last_polygon(points(spark, d).select(F.col("vec_id").alias("id"), "x", "y"), _zones(spark, d), 0.1)


def kept_components(spark, d):
    return graph.filter_components(components(spark, d), 100)


def cheap_nodes(spark, d):
    return graph.cheap_nodes(road_arcs(spark, d), 15)


def population_arcs(spark, d):
    near = nearest_nodes(spark, d)
    return osm.join_population(near, road_arcs(spark, d), F.lit(100_000))


def graph_file(spark, d):
    nodes = points(spark, d).select(F.col("vec_id").alias("node"), F.round("x", 4).cast("string").alias("x"))
    return sinks.graph_lines(nodes, road_arcs(spark, d).withColumn("pos", F.col("target")), ["node"], ["source", "target", "cost"])


QUERIES = {f.__name__: f for f in (road_costs, translated_ids, pruned_walkways, walkway_bins, city_paths, city_flooding, city_contraction, city_undo, city_clusters, cluster_contraction, popularity, edge_attractiveness, graph_of_lines, entry_classes, poi_categories, way_edges, box_raster, heat_levels, heat_pages, middle_heat, zone_of_point, kept_components, cheap_nodes, population_arcs, graph_file, flooding, sssp, entry_distances, distance_to_border, components, component_sizes, largest_component, via_edge, contraction, walkways, offsets, least_arcs, counter_arcs, node_weights, segments, nearest_nodes, nearest_three_within, points_in_zones, points_in_districts, map_extract, scanned_roads, population_grid, hulls, distances, preference_lookup, entry_popularity, parking_population, normalized, node_heat, heat_raster, heat_pyramid, heat_extract, heat_bounds, heat_median, heat_answer, way_speeds, class_speeds, merged_popularity, even_split, even_arc_weights, expanded_results, last_feature, feature_weights, arc_lines, relation_polygons, shuffled_rings, vertex_graph, feature_graph)}

_BOTH = "bb AS (SELECT source, target FROM arcs), r AS (SELECT vec_id AS node, vec_id AS reached FROM points UNION SELECT r.node, bb.target FROM r JOIN bb ON bb.source = r.reached), comp AS (SELECT node, min(reached) AS component FROM r GROUP BY node)"


def _distances(limit: int, seeds: str = "vec_id % 25 = 0") -> str:
    """SQL of the least costs from the seeds to all points within the limit."""
    return f"""w AS (SELECT vec_id AS search_id, vec_id AS node, 0 AS cost FROM points WHERE {seeds}
    UNION SELECT w.search_id, a.target, w.cost + a.cost FROM w JOIN arcs a ON a.source = w.node WHERE w.cost + a.cost <= {limit}),
    dist AS (SELECT search_id, node, min(cost) AS cost FROM w GROUP BY ALL)"""


#: Edges of the zones.
_EDGES = """zone AS (SELECT s_suppkey AS poly_id, (s_suppkey % 50 + 100)::DOUBLE AS inhabitants, (s_suppkey * 37 % 80) / 100.0::DOUBLE - 0.4::DOUBLE AS x, (s_suppkey * 53 % 80) / 100.0::DOUBLE - 0.4::DOUBLE AS y,
        (s_suppkey % 7) / 100.0::DOUBLE + 0.05::DOUBLE AS w, (s_suppkey % 5) / 100.0::DOUBLE + 0.05::DOUBLE AS h FROM supplier),
    edges(poly_id, ax, ay, bx, "by") AS (SELECT poly_id, x, y, x + w, y FROM zone UNION ALL SELECT poly_id, x + w, y, x + w, y + h FROM zone
        UNION ALL SELECT poly_id, x + w, y + h, x, y + h / 2 FROM zone UNION ALL SELECT poly_id, x, y + h / 2, x, y FROM zone)"""
_CROSSES = '(ay > y) <> ("by" > y) AND x < (bx - ax) * (y - ay) / ("by" - ay) + ax'
_IN_ZONES = f"{_EDGES}, hit AS (SELECT vec_id AS id, poly_id FROM points JOIN edges ON {_CROSSES} GROUP BY 1, 2 HAVING count(*) % 2 = 1)"

_CITY = f"""WITH RECURSIVE {SQL['city']}, w AS (SELECT k AS search_id, node, 0 AS cost FROM cn WHERE k % 97 = 0
        UNION SELECT w.search_id, a.target, w.cost + a.cost FROM w JOIN city a ON a.source = w.node WHERE w.cost + a.cost <= {LIMIT}),
    dist AS MATERIALIZED (SELECT search_id, node, min(cost) AS cost FROM w GROUP BY ALL)"""

def _away(barred: str) -> str:
    """SQL of the least costs from x to the entries, for the ends of all arcs, x first, on ways that aren't barred."""
    return f"""one AS (SELECT source, target, min(cost)::INT AS cost, max(weight) AS weight FROM arcs GROUP BY ALL),
    a AS (SELECT source AS x, target AS y, source AS node, 0::INT AS cost FROM one
        UNION SELECT a.x, a.y, o.target, (a.cost + o.cost)::INT FROM a JOIN one o ON o.source = a.node WHERE a.cost + o.cost <= {2 * LIMIT} AND {barred}),
    away AS MATERIALIZED (SELECT x, y, node, min(cost) AS cost FROM a WHERE node % 25 = 0 GROUP BY ALL)"""


ORACLES = {
    "via_edge": f"""{_REC}, {_away('o.target <> a.y')},
    w AS (SELECT vec_id AS search_id, vec_id AS node, 0 AS cost FROM points WHERE vec_id % 25 = 0
        UNION SELECT w.search_id, o.target, w.cost + o.cost FROM w JOIN one o ON o.source = w.node WHERE w.cost + o.cost <= {2 * LIMIT}),
    direct AS (SELECT search_id, node, min(cost) AS cost FROM w WHERE node % 25 = 0 GROUP BY ALL),
    met AS (SELECT o.source, o.target, o.weight, b.node AS b, f.node AS f, f.cost AS cost_f, b.cost + o.cost + f.cost AS way FROM one o JOIN away b ON b.x = o.source AND b.y = o.target JOIN away f ON f.x = o.target AND f.y = o.source
        WHERE o.weight > 0 AND b.cost + o.cost + f.cost <= {2 * LIMIT}),
    v AS (SELECT source, target, b, sum(met.weight * ({_SUFFIX.format('way')})::DOUBLE * CASE WHEN b = f THEN 60 / (cost_f + 60)::DOUBLE ELSE (direct.cost + 60) / (way + 60)::DOUBLE END) AS v FROM met LEFT JOIN direct ON search_id = b AND node = f GROUP BY ALL),
    n AS (SELECT source, target, b, v / max(v) OVER (PARTITION BY b) AS v FROM v WHERE v > 0),
    t AS (SELECT source, target, sum(v * (b + 100.0::DOUBLE)) AS v FROM n GROUP BY ALL)
    SELECT one.source, one.target, round(coalesce(t.v, 0), 6) AS value FROM one LEFT JOIN t ON t.source = one.source AND t.target = one.target WHERE one.weight > 0""",
    "even_arc_weights": f"""{_REC}, {_away('NOT (a.node = a.x AND o.target = a.y) AND NOT (a.node = a.y AND o.target = a.x)')},
    trips AS (SELECT o.source, o.target, b.node AS entry, count(*) AS k FROM one o JOIN away b ON b.x = o.source AND b.y = o.target JOIN away f ON f.x = o.target AND f.y = o.source WHERE b.cost + o.cost + f.cost <= {2 * LIMIT} GROUP BY ALL),
    n AS (SELECT entry, sum(k) AS n FROM trips GROUP BY entry)
    SELECT source, target, round(sum(k * ((trips.entry + 100.0::DOUBLE) / n.n::DOUBLE)), 6) AS value FROM trips JOIN n ON n.entry = trips.entry GROUP BY source, target""",
    "city_paths": f"""{_CITY}, b AS (SELECT d.search_id, d.node, d.cost, p.node AS parent, row_number() OVER (PARTITION BY d.search_id, d.node ORDER BY p.cost, p.node) AS r
            FROM dist d JOIN city a ON a.target = d.node JOIN dist p ON p.search_id = d.search_id AND p.node = a.source AND p.cost + a.cost = d.cost WHERE d.cost > 0)
        SELECT search_id, node, cost::BIGINT AS cost, parent FROM b WHERE r = 1 UNION ALL SELECT search_id, node, 0, node FROM dist WHERE cost = 0""",
    "city_contraction": f"""WITH RECURSIVE {SQL['city']}, cheap AS (SELECT node FROM (SELECT source AS node, cost FROM city UNION ALL SELECT target, cost FROM city) GROUP BY node HAVING max(cost) <= 25),
            chosen AS (SELECT node FROM cheap WHERE node NOT IN (SELECT node FROM cn WHERE k % 97 = 0)),
            w AS (SELECT source, target AS node, cost FROM city WHERE source NOT IN (SELECT node FROM chosen)
                UNION SELECT w.source, a.target, w.cost + a.cost FROM w JOIN chosen c ON c.node = w.node JOIN city a ON a.source = w.node WHERE w.cost + a.cost <= 400)
        SELECT source, node AS target, min(cost) AS cost FROM w WHERE source <> node AND node NOT IN (SELECT node FROM chosen) GROUP BY source, node""",
    "walkways": f"""{_REC}, w AS (SELECT [vec_id] AS path, 0::BIGINT AS cost FROM points WHERE vec_id % 25 = 0
            UNION ALL SELECT list_append(path, a.target), w.cost + a.cost FROM w JOIN arcs a ON a.source = path[-1] WHERE w.cost < 100 AND NOT list_contains(path[-3:], a.target))
        SELECT array_to_string(path, '-') AS path, cost FROM w WHERE len(path) > 1 AND path[-1] % 5 = 0""",
    "walkway_bins": f"""{_REC}, w AS (SELECT vec_id AS start, [vec_id] AS path, 0::BIGINT AS cost FROM points WHERE vec_id % 25 = 0
            UNION ALL SELECT start, list_append(path, a.target), w.cost + a.cost FROM w JOIN (SELECT source, target, min(cost) AS cost FROM arcs GROUP BY ALL) a ON a.source = path[-1] WHERE w.cost < 60 AND NOT list_contains(path[-3:], a.target)),
            k AS (SELECT start, cost FROM w WHERE len(path) > 1 AND path[-1] % 5 = 0), r AS (SELECT start, min(cost) AS low, max(cost) AS high FROM k GROUP BY start HAVING count(*) >= 2)
        SELECT k.start, CASE WHEN high > low THEN floor((high - cost) * 49 / (high - low))::INT ELSE 0 END AS bin, count(*) AS n FROM k JOIN r ON r.start = k.start GROUP BY ALL""",
    "city_flooding": f"""{_CITY}, nw AS (SELECT node, max(weight) AS weight FROM (SELECT source AS node, weight FROM city UNION ALL SELECT target, weight FROM city) GROUP BY node),
        c AS (SELECT search_id, dist.node, weight * ({_SUFFIX.format('2 * greatest(cost, 1)')}) / (greatest(cost, 1) + 60.0) AS v FROM dist JOIN nw ON nw.node = dist.node),
        n AS (SELECT search_id, node, v / max(v) OVER (PARTITION BY search_id) AS v FROM c WHERE v <> 0),
        t AS (SELECT node, sum(v * (search_id % 50 + 1.0::DOUBLE)) AS v FROM n GROUP BY node)
        SELECT source, target, round(coalesce(s.v, 0) + coalesce(u.v, 0), 6) AS value FROM city LEFT JOIN t s ON s.node = source LEFT JOIN t u ON u.node = target""",
    "flooding": f"""{_REC}, {_DIST}, nw AS (SELECT node, max(weight) AS weight FROM (SELECT source AS node, weight FROM arcs UNION ALL SELECT target, weight FROM arcs) GROUP BY node),
        c AS (SELECT search_id, dist.node, weight * ({_SUFFIX.format('2 * greatest(cost, 1)')}) / (greatest(cost, 1) + 60.0) AS v FROM dist JOIN nw ON nw.node = dist.node),
        n AS (SELECT search_id, node, v / max(v) OVER (PARTITION BY search_id) AS v FROM c WHERE v <> 0),
        t AS (SELECT node, sum(v * (search_id + 100.0::DOUBLE)) AS v FROM n GROUP BY node)
        SELECT source, target, round(coalesce(s.v, 0) + coalesce(u.v, 0), 6) AS value FROM arcs LEFT JOIN t s ON s.node = source LEFT JOIN t u ON u.node = target""",
    "sssp": f"{_REC}, {_DIST} SELECT search_id, node, cost::BIGINT AS cost FROM dist",
    "distance_to_border": f"{_REC}, {_DIST} SELECT node, min(cost)::BIGINT AS cost FROM dist GROUP BY node",
    "components": f"{_REC}, {_BOTH} SELECT node, component FROM comp",
    "component_sizes": f"{_REC}, {_BOTH} SELECT component, count(*) AS n FROM comp GROUP BY component",
    "offsets": f"{_WITH} SELECT vec_id AS node, (SELECT count(*) FROM arcs WHERE source < vec_id) AS first_arc FROM points",
    "least_arcs": "SELECT l_suppkey AS source, 1000000 + l_partkey AS target, min(floor(l_quantity)::INT) AS cost FROM lineitem GROUP BY 1, 2",
    "counter_arcs": f"""{_WITH}, k AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY cost, weight) AS rank FROM arcs)
        SELECT a.source, a.target, a.rank::INT AS rank, a.cost, b.cost AS back_cost FROM k a JOIN k b ON a.source = b.target AND a.target = b.source AND a.rank = b.rank""",
    "node_weights": f"{_WITH} SELECT node, max(weight) AS weight FROM (SELECT source AS node, weight FROM arcs UNION ALL SELECT target, weight FROM arcs) GROUP BY node",
    "road_costs": f"""WITH s(i, class, speed) AS (VALUES {", ".join(str((i, *x)) for i, x in enumerate(speeds.CLASS_SPEEDS.items()))}),
        v AS (SELECT l_orderkey AS fid, l_linenumber AS wert, row_number() OVER w AS pos, (l_partkey % 97)::DOUBLE AS x, (l_suppkey % 89)::DOUBLE AS y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
        t AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM v WINDOW w AS (PARTITION BY fid ORDER BY pos)),
        g AS (SELECT fid, arg_min(x, pos) AS x0, arg_min(y, pos) AS y0, arg_max(x, pos) AS x1, arg_max(y, pos) AS y1, coalesce(sum(step), 0) AS length, arg_max(wert, pos) AS weight FROM t GROUP BY fid)
        SELECT fid, x0, y0, x1, y1, round(length / (least(speed, 5) / 3.6::DOUBLE), 5) AS cost, weight FROM g JOIN s ON s.i = fid % {len(speeds.CLASS_SPEEDS)} WHERE class NOT BETWEEN 164001 AND 164011""",
    "vertex_graph": f"""WITH {_ROAD_ROWS}, p AS (SELECT pos, fid, class AS way_class, speed, lag(x) OVER w AS x0, lag(y) OVER w AS y0, x AS x1, y AS y1 FROM v WINDOW w AS (PARTITION BY fid ORDER BY pos)),
        l AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS metres FROM p WHERE x0 IS NOT NULL),
        e AS (SELECT x0 AS x, y0 AS y, 2 * pos AS seen FROM l UNION ALL SELECT x1, y1, 2 * pos + 1 FROM l),
        n AS (SELECT x, y, row_number() OVER (ORDER BY min(seen)) - 1 AS node FROM e GROUP BY x, y),
        t AS (SELECT s.node AS source, t.node AS target, fid, way_class, metres / (least(speed, 50) / 3.6::DOUBLE) AS cost FROM l JOIN n s ON s.x = x0 AND s.y = y0 JOIN n t ON t.x = x1 AND t.y = y1)
        SELECT source, target, fid, way_class, round(cost, 5) AS cost FROM (SELECT * FROM t UNION SELECT target, source, fid, way_class, cost FROM t)""",
    "feature_graph": f"""WITH {_ROAD_ROWS}, w AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM v WHERE class NOT BETWEEN 164001 AND 164011 WINDOW w AS (PARTITION BY fid ORDER BY pos)),
        l AS (SELECT fid, arg_min(x, pos) AS x0, arg_min(y, pos) AS y0, arg_max(x, pos) AS x1, arg_max(y, pos) AS y1, coalesce(sum(step), 0) / (any_value(least(speed, 5)) / 3.6::DOUBLE) AS cost, arg_max(p % 5, pos) AS weight FROM w GROUP BY fid),
        e AS (SELECT x0 AS x, y0 AS y, 2 * fid AS seen FROM l UNION ALL SELECT x1, y1, 2 * fid + 1 FROM l),
        n AS (SELECT x, y, row_number() OVER (ORDER BY min(seen)) - 1 AS node FROM e GROUP BY x, y),
        t AS (SELECT s.node AS source, t.node AS target, fid, round(cost, 5) AS cost, weight FROM l JOIN n s ON s.x = x0 AND s.y = y0 JOIN n t ON t.x = x1 AND t.y = y1)
        SELECT * FROM t UNION ALL SELECT target, source, fid, cost, weight FROM t""",
    "translated_ids": """WITH v AS (SELECT l_orderkey AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_suppkey % 89 AS n FROM lineitem),
        r AS (SELECT w, pos, 999 + dense_rank() OVER (ORDER BY n) AS id FROM v), k AS (SELECT w, string_agg(id::VARCHAR, '-' ORDER BY pos) AS nds FROM r GROUP BY w)
        SELECT row_number() OVER (ORDER BY w) - 1 + 1000 AS way_id, nds, CASE WHEN w % 2 = 0 THEN '{"landuse":"forest"}' ELSE '{"Objektname":"Weg"}' END AS tags FROM k""",
    "segments": """WITH v AS (SELECT l_orderkey AS fid, row_number() OVER w AS pos, (l_partkey % 97)::DOUBLE AS x, (l_suppkey % 89)::DOUBLE AS y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
        s AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM v WINDOW w AS (PARTITION BY fid ORDER BY pos))
        SELECT fid, arg_min(x, pos) AS x0, arg_min(y, pos) AS y0, arg_max(x, pos) AS x1, arg_max(y, pos) AS y1, round(coalesce(sum(step), 0), 6) AS length FROM s GROUP BY fid""",
    "nearest_nodes": f"""WITH {SQL['points']}, r AS (SELECT a.vec_id AS id, b.vec_id AS node_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.vec_id) AS k
        FROM points a, points b WHERE b.vec_id % 3 = 0) SELECT id, node_id FROM r WHERE k = 1""",
    "nearest_three_within": f"""WITH {SQL['points']}, r AS (SELECT a.vec_id AS id, b.vec_id AS node_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.vec_id) AS rank
        FROM points a, points b WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 0.1::DOUBLE * 0.1::DOUBLE) SELECT id, node_id, rank::INT AS rank FROM r WHERE rank <= 3""",
    "distances": """WITH c AS (SELECT c_custkey, radians((c_custkey % 90)::DOUBLE) AS p, radians((c_custkey % 90)::DOUBLE / 2) AS q, radians((c_custkey % 180)::DOUBLE) AS a, radians((c_custkey % 180)::DOUBLE / 3) AS b FROM customer),
        m AS (SELECT c_custkey, 2 * 6371000.785 * asin(sqrt(sin((q-p)/2)*sin((q-p)/2) + cos(p)*cos(q)*sin((b-a)/2)*sin((b-a)/2))) AS m FROM c)
        SELECT c_custkey, round(m, 2) AS metres, round(m / (30.0::DOUBLE / 3.6::DOUBLE), 2) AS seconds FROM m""",
    "preference_lookup": f"""{_WITH} SELECT source, target, CASE WHEN cost <= 60 THEN 0.5::DOUBLE WHEN cost <= 150 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS share,
        CASE WHEN cost <= 60 THEN 1.0::DOUBLE WHEN cost <= 150 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS suffix, (cost > 60)::INT + (cost > 150)::INT + (cost > 300)::INT AS bucket FROM arcs""",
    "parking_population": "SELECT s_suppkey, round(1000.0::DOUBLE * (1 + s_suppkey % 5) / sum(1 + s_suppkey % 5) OVER (), 6) AS population FROM supplier",
    "normalized": "SELECT o_custkey AS entry, o_orderkey AS element, round(CASE WHEN max(o_totalprice) OVER w > 0 THEN o_totalprice / max(o_totalprice) OVER w ELSE o_totalprice END, 6) AS value FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    "node_heat": f"{_WITH}, h AS (SELECT source AS node, cost FROM arcs WHERE source < target UNION ALL SELECT target, cost FROM arcs WHERE source < target) SELECT node, sum(cost)::DOUBLE AS heat FROM h WHERE node % 4 <> 0 GROUP BY node HAVING sum(cost) <> 0",
    "heat_raster": f"WITH {_HEAT} SELECT floor(lat / 2 + 0.5)::BIGINT AS by, floor(lon / 3 + 0.5)::BIGINT AS bx, sum(heat) AS heat FROM heat GROUP BY 1, 2 HAVING sum(heat) > 0",
    "heat_pyramid": f"""WITH RECURSIVE {_HEAT}, f AS (SELECT floor(lat / 2 + 0.5)::BIGINT AS by, floor(lon / 3 + 0.5)::BIGINT AS bx, sum(heat) AS heat FROM heat GROUP BY 1, 2 HAVING sum(heat) > 0)
        SELECT (3 - k)::INT AS zoom, floor(f."by" / (1 << k))::BIGINT AS by, floor(bx / (1 << k))::BIGINT AS bx, sum(heat) AS heat FROM f, (VALUES (0), (1), (2), (3)) z(k) GROUP BY 1, 2, 3""",
    "heat_extract": f"WITH {_HEAT} SELECT * FROM heat WHERE lat BETWEEN 10.25 AND 30.25 AND lon BETWEEN 20.75 AND 60.75",
    "heat_bounds": f"WITH {_HEAT} SELECT dataset, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM heat GROUP BY ROLLUP (dataset)",
    "heat_median": f"WITH {_HEAT}, r AS (SELECT dataset, heat, row_number() OVER (PARTITION BY dataset ORDER BY heat) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM heat WHERE heat > 0) SELECT dataset, heat AS median FROM r WHERE r = n // 2 + 1",
    "way_speeds": f"""WITH s(i, kind, osm, car, walking, road) AS (VALUES {", ".join(str((i, k, *(p.get(k, 0) for p in speeds.PROFILES.values()))) for i, k in enumerate(_KINDS))})
        SELECT o_orderkey, kind, CASE WHEN kind <> 'ferry' THEN i END AS type_id, osm, car, walking, road FROM orders JOIN s ON i = o_orderkey % {len(_KINDS)}""",
    "class_speeds": f"""WITH s(i, class, speed) AS (VALUES {", ".join(str((i, *x)) for i, x in enumerate(speeds.CLASS_SPEEDS.items()))})
        SELECT o_orderkey, class, least(speed, 90) AS speed, class >= 164001 AS large, class < 164001 AND class <> 88001 AS small FROM orders JOIN s ON i = o_orderkey % {len(speeds.CLASS_SPEEDS)}""",
    "merged_popularity": """WITH p AS (SELECT c_custkey AS k, (c_custkey % 11 + 1)::DOUBLE AS n FROM customer),
        u AS (SELECT sum(n * ((k % 2 <> 0)::INT * 0.25::DOUBLE + (k % 3 <> 0)::INT * 0.125::DOUBLE)) AS unmapped, sum(n) * 0.5::DOUBLE AS car FROM p),
        b AS (SELECT s_suppkey AS entry, (s_suppkey % 7 + s_suppkey % 3)::DOUBLE AS own FROM supplier)
        SELECT entry, round(own + own / sum(own) OVER () * 0.5::DOUBLE * unmapped, 6) AS popularity, floor(car + 0.5::DOUBLE * unmapped)::BIGINT AS car_population FROM b, u""",
    "even_split": """WITH r AS (SELECT DISTINCT o_custkey AS pop, o_orderkey % 50 AS entry FROM orders), n AS (SELECT pop, count(*) AS n FROM r GROUP BY pop)
        SELECT entry, round(sum(280000::DOUBLE / (SELECT count(*) FROM customer) / n), 6) AS population FROM r JOIN n USING (pop) GROUP BY entry""",
    "expanded_results": """WITH e AS (SELECT o_orderkey AS pos, unnest([o_orderkey % 900, o_custkey % 900]) AS element, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_totalprice END AS value FROM orders),
        v AS (SELECT element, arg_max(value, pos) AS value FROM e WHERE value > 0 GROUP BY element)
        SELECT range AS element, coalesce(value, 0) AS value FROM range((SELECT max(element) + 1 FROM e)) LEFT JOIN v ON element = range""",
    "last_feature": "SELECT l_suppkey AS source, l_partkey % 50 AS target, max(l_orderkey) AS fid FROM lineitem GROUP BY 1, 2",
    "feature_weights": "SELECT c_custkey AS fid, c_name, round(sum(o_totalprice), 2) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
    "arc_lines": f"{_WITH}, k AS (SELECT *, row_number() OVER (ORDER BY source, target) - 1 AS arc_id FROM arcs) SELECT arc_id, concat_ws(' ', source, target, cost, arc_id) AS line FROM k",
    "shuffled_rings": """WITH w AS (SELECT o_orderkey AS k, o_orderkey // 5000 AS r, o_orderkey % 5000 AS i, o_orderkey * 48271 % 2147483647 AS pos FROM orders),
        s AS (SELECT r, arg_min(i, pos) AS i0, count(*) AS m, arg_min(k % 3 = 0, pos) AS turned FROM w GROUP BY r),
        t AS (SELECT w.r, i0, m, turned, CASE WHEN turned THEN (i0 - i + m) % m ELSE (i - i0 + m) % m END AS rank, k, r * 5000 + (i + 1) % m AS k1 FROM w JOIN s USING (r)),
        n AS (SELECT r, rank, CASE WHEN turned THEN concat(k1, '-', -k - 1, '-', k) ELSE concat(k, '-', -k - 1, '-', k1) END AS part, CASE WHEN turned THEN k1 ELSE k END AS head FROM t)
        SELECT r AS relation_id, 0 AS polygon, (3 * count(*))::INT AS n, arg_min(head, rank) AS first, md5(string_agg(part, '-' ORDER BY rank)) AS nodes_md5 FROM n GROUP BY r""",
    "relation_polygons": """WITH m AS (SELECT l_orderkey AS r, l_suppkey AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
        k AS (SELECT *, CASE WHEN w % 10 <> 0 THEN w % 3 END AS last FROM m), b AS (SELECT *, lag(last) OVER (PARTITION BY r ORDER BY pos) AS before FROM k),
        p AS (SELECT *, sum(CASE WHEN w % 2 = before THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY pos) AS part FROM b WHERE w % 10 <> 0),
        g AS (SELECT r, part, string_agg(concat_ws('-', w % 2, w + 10, w % 3), '-' ORDER BY pos) AS nds FROM p GROUP BY r, part)
        SELECT r AS relation_id, (row_number() OVER (PARTITION BY r ORDER BY part) - 1)::INT AS polygon, nds FROM g""",
    "entry_distances": f"{_REC}, {_distances(600)} SELECT search_id AS a, node AS b, cost::BIGINT AS cost FROM dist WHERE node % 25 = 0 AND search_id <= node",
    "largest_component": f"""{_REC}, {_BOTH}, best AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
        ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM comp JOIN best USING (component))
        SELECT s.id AS source, t.id AS target, cost, weight FROM arcs JOIN ids s ON s.node = source JOIN ids t ON t.node = target""",
    "points_in_zones": f"WITH {SQL['points']}, {_IN_ZONES} SELECT id, poly_id FROM hit",
    "map_extract": f"""WITH {SQL['city']}, street AS (SELECT a, b FROM ce JOIN cn ON cn.node = ce.a WHERE p_size % 3 <> 2),
        wood AS (SELECT x, y FROM cn WHERE x % 10 = 2 AND y % 4 = 0 AND k + 155 < (SELECT count(*) FROM cn)),
        used AS (SELECT a AS node FROM street UNION SELECT b FROM street UNION SELECT node FROM cn WHERE p_size = 1),
        own AS (SELECT cn.node, p_size, EXISTS (SELECT 1 FROM wood w WHERE cn.x >= w.x AND cn.x < w.x + 5 AND cn.y >= w.y AND cn.y < w.y + 3) AS inside FROM cn JOIN used USING (node)),
        arc AS (SELECT a AS s, b AS t FROM street UNION ALL SELECT b, a FROM street)
        SELECT CAST(row_number() OVER (ORDER BY node) - 1 AS BIGINT) AS node, node AS node_id, CASE WHEN inside THEN 1
            WHEN node IN (SELECT s FROM arc JOIN own o ON o.node = t WHERE o.inside) THEN 2 ELSE 0 END AS flag, CASE WHEN p_size = 1 THEN 2 END AS category FROM own""",
    "scanned_roads": f"""WITH {SQL['city']}, placed AS (SELECT node, p_size, radians((y / 1000.0::DOUBLE + p_size / 100000.0::DOUBLE)::FLOAT::DOUBLE) AS lat, radians((x / 1000.0::DOUBLE)::FLOAT::DOUBLE) AS lon FROM cn),
        step AS (SELECT a.node AS a, b.node AS b, CAST(ceil(floor(2 * 6371000.785 * asin(sqrt(sin((b.lat - a.lat) / 2) * sin((b.lat - a.lat) / 2) + cos(a.lat) * cos(b.lat) * sin((b.lon - a.lon) / 2) * sin((b.lon - a.lon) / 2)))) * 3.6::DOUBLE / 30) AS BIGINT) AS cost
            FROM ce JOIN placed a ON a.node = ce.a JOIN placed b ON b.node = ce.b WHERE a.p_size % 3 = 1)
        SELECT a AS source_id, b AS target_id, cost FROM step UNION ALL SELECT b, a, cost FROM step""",
    "points_in_districts": f"""WITH {SQL['points']}, corner AS (SELECT (p_partkey - 1) % 8 AS poly_id, (p_partkey - 1) // 8 AS k, 0.15::DOUBLE + p_size / 250.0::DOUBLE AS reach, count(*) OVER (PARTITION BY (p_partkey - 1) % 8) AS n FROM part),
        placed AS (SELECT poly_id, k, n, (poly_id % 3 - 1) * 0.15::DOUBLE + reach * cos(2 * pi() * k / n) AS x, (poly_id // 3 - 1) * 0.15::DOUBLE + reach * sin(2 * pi() * k / n) AS y FROM corner),
        edges(poly_id, ax, ay, bx, "by") AS (SELECT a.poly_id, a.x, a.y, b.x, b.y FROM placed a JOIN placed b ON b.poly_id = a.poly_id AND b.k = (a.k + 1) % a.n)
        SELECT vec_id AS id, poly_id FROM points JOIN edges ON {_CROSSES} GROUP BY 1, 2 HAVING count(*) % 2 = 1""",
    "zone_of_point": f"WITH {SQL['points']}, {_IN_ZONES} SELECT id, max(poly_id) AS poly_id FROM hit GROUP BY id",
    "population_grid": f"""WITH {_EDGES}, box AS (SELECT poly_id, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM edges GROUP BY poly_id),
        g AS (SELECT poly_id, x0 + i * 0.03::DOUBLE AS x, y0 + j * 0.03::DOUBLE AS y FROM box, range(1, 100) a(i), range(1, 100) b(j)
            WHERE i <= ceil((x1 - x0) / 0.03::DOUBLE) - 1 AND j <= ceil((y1 - y0) / 0.03::DOUBLE) - 1),
        k AS (SELECT g.poly_id, x, y FROM g JOIN edges e ON e.poly_id = g.poly_id AND {_CROSSES} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
        every AS (SELECT poly_id, x, y FROM k UNION ALL SELECT poly_id, x0, y0 FROM box WHERE poly_id NOT IN (SELECT poly_id FROM k))
        SELECT every.poly_id, round(every.x, 6) + 0.0::DOUBLE AS x, round(every.y, 6) + 0.0::DOUBLE AS y, round(inhabitants / count(*) OVER (PARTITION BY every.poly_id), 6) AS population FROM every JOIN zone ON zone.poly_id = every.poly_id""",
    "heat_answer": f"""WITH {_HEAT}, e AS (SELECT DISTINCT * FROM heat WHERE lat BETWEEN 10.25 AND 20.25 AND lon BETWEEN 20.75 AND 40.75)
        SELECT dataset, count(*) AS n, max(heat) AS max, string_agg(format('{{:.7f}},{{:.7f}},{{:.1f}}', lat, lon, heat), ';' ORDER BY lat, lon, format('{{:.7f}},{{:.7f}},{{:.1f}}', lat, lon, heat)) AS points FROM e GROUP BY dataset""",
    "entry_popularity": f"""{_REC}, {_distances(300)}, n AS (SELECT search_id AS entry, node AS pop, cost, CASE WHEN cost <= 60 THEN 0 WHEN cost <= 150 THEN 1 ELSE 2 END AS b, CASE WHEN cost <= 60 THEN 60 WHEN cost <= 150 THEN 150 ELSE 300 END AS bound FROM dist),
        l AS (SELECT *, sum(bound) OVER (PARTITION BY pop) AS total FROM n),
        r AS (SELECT entry, sum(CASE WHEN bound < total THEN 1 - bound::DOUBLE / total::DOUBLE ELSE 1.0::DOUBLE / ((b + 1) * (b + 1)) END * ({_SUFFIX.format("cost")})::DOUBLE * (pop % 7 + 1)) AS raw FROM l WHERE cost < 300 GROUP BY entry)
        SELECT entry, round(raw * (SELECT sum(pop % 7 + 1) * 0.5::DOUBLE FROM (SELECT DISTINCT pop FROM n)) / sum(raw) OVER (), 6) AS popularity FROM r""",
    "popularity": f"""{_REC}, {_distances(240)}, p AS (SELECT search_id AS entry, node AS pop, cost::BIGINT AS cost, (node % 7 + 1)::DOUBLE AS people FROM dist),
        f AS (SELECT *, (cost > 120)::INT AS bb, (cost > 30)::INT AS wb FROM p),
        bt AS (SELECT pop, sum(CASE bb WHEN 0 THEN 120 ELSE 240 END) AS total FROM f GROUP BY pop),
        wt AS (SELECT pop, sum(CASE wb WHEN 0 THEN 30 ELSE 60 END) AS total FROM f WHERE cost <= 60 GROUP BY pop),
        bn AS (SELECT pop, bb, count(*) AS n FROM f GROUP BY pop, bb),
        bl AS (SELECT pop, bb, CASE WHEN wt.total IS NULL THEN n::DOUBLE WHEN (bb + 1) * 120 < bt.total THEN 1 - (bb + 1) * 120::DOUBLE / bt.total::DOUBLE ELSE 1.0::DOUBLE / ((bb + 1) * (bb + 1)) END AS likely FROM bn JOIN bt USING (pop) LEFT JOIN wt USING (pop)),
        cycle AS (SELECT entry, f.pop, people, likely * (CASE f.bb WHEN 0 THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END) * people AS part FROM f JOIN bl ON bl.pop = f.pop AND bl.bb = f.bb),
        walk AS (SELECT entry, pop, people, (CASE WHEN (wb + 1) * 30 < total THEN 1 - (wb + 1) * 30::DOUBLE / total::DOUBLE ELSE 1.0::DOUBLE / ((wb + 1) * (wb + 1)) END) * (CASE wb WHEN 0 THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END) * people AS part FROM f JOIN wt USING (pop) WHERE cost < 60),
        sc AS (SELECT (SELECT sum(people) FROM (SELECT DISTINCT pop, people FROM walk)) * (71::DOUBLE / 124) AS gw, (SELECT sum(people) FROM (SELECT DISTINCT pop, people FROM cycle)) * (13::DOUBLE / 124) AS gc,
            (SELECT sum(part) FROM walk) AS rw, (SELECT sum(part) FROM cycle) AS rc, (SELECT sum(vec_id % 7 + 1)::DOUBLE FROM points) AS whole),
        own AS (SELECT vec_id AS entry, coalesce((SELECT sum(part) FROM walk WHERE entry = vec_id), 0) * gw / rw + coalesce((SELECT sum(part) FROM cycle WHERE entry = vec_id), 0) * gc / rc AS own FROM points, sc WHERE vec_id % 25 = 0),
        m AS (SELECT gw + gc AS mapped, whole * (84::DOUBLE / 124) - gw - gc AS unmapped, 40::DOUBLE / 124 AS car, whole FROM sc),
        e AS (SELECT (entry / 25)::BIGINT AS pos, own + own / mapped * (1 - car) * unmapped AS population FROM own, m),
        c AS (SELECT floor(car * whole + car * unmapped) AS cars FROM m)
        SELECT pos, round(population, 6) AS population FROM e UNION ALL
        SELECT n_nationkey + (SELECT count(*) FROM e), round(cars * (n_nationkey % 4)::DOUBLE / (SELECT sum(n_nationkey % 4) FROM nation)::DOUBLE, 6) FROM nation, c""",
    "graph_of_lines": """WITH v AS (SELECT l_orderkey AS fid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, (l_partkey % 97)::DOUBLE AS x, (l_suppkey % 89)::DOUBLE AS y FROM lineitem),
        l AS (SELECT fid, arg_min(x, pos) AS x0, arg_min(y, pos) AS y0, arg_max(x, pos) AS x1, arg_max(y, pos) AS y1 FROM v GROUP BY fid),
        e AS (SELECT x0 AS x, y0 AS y, 2 * fid AS seen FROM l UNION ALL SELECT x1, y1, 2 * fid + 1 FROM l),
        n AS (SELECT x, y, row_number() OVER (ORDER BY min(seen)) - 1 AS node FROM e GROUP BY x, y),
        d AS (SELECT s.node AS s, t.node AS t, fid FROM l JOIN n s ON s.x = x0 AND s.y = y0 JOIN n t ON t.x = x1 AND t.y = y1),
        b AS (SELECT s AS source, t AS target, fid, 2 * fid AS place FROM d UNION ALL SELECT t, s, fid, 2 * fid + 1 FROM d)
        SELECT row_number() OVER (ORDER BY source, target, place) - 1 AS arc_id, source, target, (fid % 50 + 1)::INT AS cost, (fid % 3)::INT AS weight, fid FROM b""",
    "entry_classes": f"""{_WITH}, c AS (SELECT vec_id AS node, (vec_id % 3 = 0)::INT AS flag FROM points)
        SELECT node, CASE WHEN flag = 0 AND EXISTS (SELECT 1 FROM arcs WHERE source = node AND target % 3 = 0) THEN 2 ELSE flag END::INT AS flag FROM c""",
    "poi_categories": """WITH t AS (SELECT o_orderkey % 2000 AS osm_id, o_custkey % 6 AS k FROM orders), r AS (SELECT osm_id, max(CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END) AS category FROM t WHERE k < 5 GROUP BY osm_id),
        s AS (SELECT unnest([s_suppkey + 3000, s_suppkey + 3001]) AS node_id, category FROM r JOIN supplier ON s_suppkey = osm_id UNION ALL SELECT osm_id, category FROM r WHERE osm_id NOT IN (SELECT s_suppkey FROM supplier))
        SELECT node_id, max(category)::INT AS category FROM s GROUP BY node_id""",
    "way_edges": """WITH v AS (SELECT l_orderkey AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p, l_suppkey % 89 AS n FROM lineitem),
        e AS (SELECT w, p - 1 AS pos, n AS a, lead(n) OVER (PARTITION BY w ORDER BY p) AS b FROM v),
        s AS (SELECT s_suppkey AS k, radians((s_suppkey % 80)::DOUBLE) AS lat, radians((s_suppkey % 70)::DOUBLE) AS lon FROM supplier),
        m AS (SELECT w, pos, a, b, 2 * 6371000.785 * asin(sqrt(sin((t.lat-f.lat)/2)*sin((t.lat-f.lat)/2) + cos(f.lat)*cos(t.lat)*sin((t.lon-f.lon)/2)*sin((t.lon-f.lon)/2))) AS m FROM e JOIN s f ON f.k = a JOIN s t ON t.k = b)
        SELECT w AS way_id, pos::INT AS pos, a AS source, b AS target, round(m, 2) AS metres, round(m / (50.0::DOUBLE / 3.6::DOUBLE), 2) AS seconds FROM m
        UNION ALL SELECT w, pos::INT, b, a, round(m, 2), round(m / (50.0::DOUBLE / 3.6::DOUBLE), 2) FROM m""",
    "box_raster": f"""WITH {_HEAT}, k AS (SELECT 50.0::DOUBLE / 47.0::DOUBLE AS f), g AS (SELECT f, radians(f) / (2 * asin(cos(radians(60.25::DOUBLE)) * sin(radians(1.0::DOUBLE) / 2))) AS h FROM k),
        b AS (SELECT f, h, (floor(10.25::DOUBLE / f) - 0.5::DOUBLE) * f AS a0, (floor(20.75::DOUBLE / h) - 0.5::DOUBLE) * h AS o0, 60.25::DOUBLE + 0.5::DOUBLE * f AS a1, 120.75::DOUBLE + 0.5::DOUBLE * h AS o1 FROM g),
        c AS (SELECT floor((lat + 0.5::DOUBLE * f - a0) / f) AS la, floor((lon + 0.5::DOUBLE * h - o0) / h) AS lo, a0, o0, f, (o1 - o0) / ceil((o1 - o0) / h) AS width, heat FROM heat, b WHERE lat >= a0 AND lat <= a1 AND lon >= o0 AND lon < o1)
        SELECT round(a0 + la * f, 6) AS lat, round(o0 + lo * width, 6) AS lon, sum(heat) AS heat FROM c GROUP BY la, lo, a0, o0, f, width HAVING sum(heat) > 0""",
    "heat_levels": f"WITH {_HEAT}, {_levels_sql(ZOOMS)} " + " UNION ALL ".join(f"SELECT dataset, {z[0]} AS zoom, round(lat, 6) AS lat, round(lon, 6) AS lon, heat FROM r{z[0]}" for z in ZOOMS),
    "heat_pages": f"""WITH {_HEAT}, {_levels_sql(ZOOMS[:1])}, p AS (SELECT dataset, 12 AS zoom, floor(lat / (step * 256))::BIGINT AS ty, floor(lon / (step * 256))::BIGINT AS tx, lat, lon, format('{{:.7f}},{{:.7f}},{{:.1f}}', lat, lon, heat) AS t
        FROM r12 WHERE dataset = (SELECT min(dataset) FROM heat) AND lat BETWEEN 10.1 AND 60.1 AND lon BETWEEN 20.1 AND 150.1)
        SELECT dataset, zoom, ty, tx, count(*) AS n, string_agg(t, ';' ORDER BY lat, lon, t) AS points FROM p GROUP BY dataset, zoom, ty, tx""",
    "middle_heat": f"WITH {_HEAT}, r AS (SELECT dataset, heat, row_number() OVER (PARTITION BY dataset ORDER BY lat, lon, heat) - 1 AS r, count(*) OVER (PARTITION BY dataset) AS n FROM heat) SELECT dataset, heat AS max FROM r WHERE r = n // 2",
    "kept_components": f"{_REC}, {_BOTH} SELECT node, component, count(*) OVER (PARTITION BY component) >= 100 AS kept FROM comp",
    "cheap_nodes": f"{_WITH} SELECT node FROM (SELECT source AS node, cost FROM arcs UNION ALL SELECT target, cost FROM arcs) GROUP BY node HAVING max(cost) <= 15",
    "population_arcs": f"""WITH {SQL['points']}, {SQL['road']}, r AS (SELECT a.vec_id AS id, b.vec_id AS node_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.vec_id) AS k
        FROM points a, points b WHERE b.vec_id % 3 = 0) SELECT source::BIGINT AS source, target::BIGINT AS target, cost FROM arcs UNION ALL SELECT node_id, 100000 + id, 0 FROM r WHERE k = 1""",
    "graph_file": f"""{_WITH}, k AS (SELECT *, row_number() OVER (ORDER BY source, target) - 1 AS arc_id FROM arcs)
        SELECT 0 AS part, 0::BIGINT AS at, (SELECT count(*) FROM points)::VARCHAR AS line UNION ALL SELECT 0, 1, (SELECT count(*) FROM arcs)::VARCHAR
        UNION ALL SELECT 1, vec_id, vec_id::VARCHAR FROM points UNION ALL SELECT 2, arc_id, concat_ws(' ', source, target, cost, arc_id) FROM k""",
}
