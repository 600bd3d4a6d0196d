"""A map file to the tables that the models need: roads, forests, areas, points of interest and entries to forests."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waynet.functions.geo import is_forest
from waynet.functions.speeds import way_speed, way_type_id
from waynet.operators import graph, osm, spatial
from waynet.plans.iterate import cut, running_total
from waynet.sources import text
from waynet.sources.sinks import xyrf


@dataclass
class MapExtract:
    """nodes (node, node_id, lat, lon, flag) of roads, flag 1 in a forest, 2 at an entry to one, else 0, and of points of interest off the roads;
    arcs (source, target, metres, seconds, type) between numbers of nodes; forests and areas (poly_id; of, id, role, polygon; ring of x, y), areas with their tags;
    pois (node, node_id, category).
    """

    nodes: DataFrame
    arcs: DataFrame
    forests: DataFrame
    areas: DataFrame
    pois: DataFrame


def relation_rings(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """relation_id, role, polygon and nds: the rings of the outer and of the inner ways of relations (relation_id, members)."""
    members = relations.select("relation_id", F.posexplode("members").alias("pos", "m")).select(F.concat_ws(" ", "relation_id", "m.role").alias("relation_id"), "pos", F.col("m.ref").alias("way_id"))
    rings = spatial.assembled_polygons(members, ways)
    part = lambda k: F.split_part("relation_id", F.lit(" "), F.lit(k))
    return rings.select(part(1).cast("bigint").alias("relation_id"), part(2).alias("role"), "polygon", "nds")


def _placed(rings: DataFrame, nodes: DataFrame) -> DataFrame:
    """rings (key, nds) with their places instead, x the longitude; nodes that aren't there are left out."""
    found = osm.resolve_polygons(rings.withColumnRenamed("key", "poly_id"), nodes).withColumnRenamed("poly_id", "key")
    return found.select("key", F.transform("ring", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("ring"))


def in_forests(nodes: DataFrame, forests: DataFrame, size: float) -> DataFrame:
    """node_id of the nodes (node_id, lat, lon) in an outer ring of a forest but in none of the inner rings."""
    points = nodes.select(F.col("node_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    hit = spatial.points_in_polygons(points, forests.select(F.struct("role", "poly_id").alias("poly_id"), "ring"), size)
    inner = F.max(F.col("poly_id.role") == "inner")
    return hit.groupBy(F.col("id").alias("node_id")).agg(inner.alias("inner")).where("NOT inner").select("node_id")


def extract_map(nodes: DataFrame, ways: DataFrame, relations: DataFrame, max_speed: int = 130, size: float = 0.01) -> MapExtract:
    """The extract of a map's nodes (node_id, lat, lon, tags), ways (way_id, nds, tags) and relations (relation_id, members, tags).

    Roads are ways of a known kind; those faster than max_speed km/h count as that fast. A forest is a way with its tag, or the rings of a relation; ways of a relation that are
    missing leave a gap, where a new ring begins. Nodes are numbered by id. `size` are degrees of the tiles that forests are cut into.
    """
    kind = F.try_element_at("tags", F.lit("highway"))
    roads = ways.where(way_type_id(kind).isNotNull())
    speed = F.least(way_speed(kind), F.lit(max_speed))
    steps = cut(graph.way_arcs(roads, nodes, F.when(speed > 0, speed)))
    # Nodes and ways are numbered apart, so a node may have a way's id.
    own = osm.poi_categories(nodes.select(F.col("node_id").alias("osm_id"), F.explode("tags")), ways.limit(0))
    along = osm.poi_categories(ways.select(F.col("way_id").alias("osm_id"), F.explode("tags")), ways)
    rated = own.unionByName(along).groupBy("node_id").agg(F.max("category").alias("category"))
    on_roads = osm.highway_nodes(nodes.select("node_id", "lat", "lon"), steps)
    kept = cut(osm.node_indices(osm.with_missing(on_roads, nodes.select("node_id", "lat", "lon"), rated), "node_id"))
    typed = steps.join(roads.select("way_id", way_type_id(kind).alias("type")), "way_id")
    arcs = osm.resolve_arcs(typed, kept).select("source", "target", "metres", "seconds", "type")

    relevant = osm.relevant_relations(relations)
    rings = relation_rings(relevant, ways).join(relevant.select("relation_id", "forest", "tags"), "relation_id")
    simple = ways.where(is_forest(F.col("tags")) & way_type_id(kind).isNull() & (F.size("nds") > 2)).select(F.struct(F.lit("way").alias("of"), F.col("way_id").alias("id"), F.lit("outer").alias("role"), F.lit(0).cast("bigint").alias("polygon")).alias("key"), "nds")
    own = F.struct(F.lit("relation").alias("of"), F.col("relation_id").alias("id"), "role", F.col("polygon").cast("bigint").alias("polygon")).alias("key")
    forests = cut(_placed(rings.where("forest").select(own, "nds").unionByName(simple), nodes))
    forests = forests.select("key.*", "ring", F.to_json("key").alias("poly_id"))
    areas = _placed(rings.where("NOT forest").select(own, "nds"), nodes).select("key.*", "ring", F.to_json("key").alias("poly_id"))
    areas = areas.join(relevant.select(F.col("relation_id").alias("id"), "tags"), "id")

    inside = in_forests(kept, forests, size).withColumn("flag", F.lit(1))
    flagged = kept.join(inside, "node_id", "left").select(F.col("index").alias("node"), "node_id", "lat", "lon", F.coalesce("flag", F.lit(0)).alias("flag"))
    classified = osm.classify_entries(flagged, arcs)
    pois = rated.join(kept.select("node_id", F.col("index").alias("node")), "node_id").select("node", "node_id", "category")
    return MapExtract(classified.select("node", "node_id", "lat", "lon", "flag"), arcs, forests, areas, pois)


def read_map(spark: SparkSession, path: str, max_speed: int = 130, size: float = 0.01) -> MapExtract:
    """extract_map of an OSM XML file."""
    _, ways = text.read_osm(spark, path)
    return extract_map(text.read_osm_nodes(spark, path), ways, text.read_osm_relations(spark, path), max_speed, size)


def community_rows(areas: DataFrame) -> DataFrame:
    """admin_level, name, ring, wiki and osm: areas with the addresses of their article (null without one) and of their relation, to be written by level."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    return areas.select(tag("admin_level").alias("admin_level"), tag("name").alias("name"), "poly_id", "ring", osm.wiki_link(tag("wikipedia")).alias("wiki"), F.concat(F.lit("https://www.openstreetmap.org/relation/"), F.col("id").cast("string")).alias("osm"))


def match_entries(entries: DataFrame, parking: DataFrame, road: DataFrame, forest: DataFrame) -> DataFrame:
    """pos, x, y, r, f: entries (id, x, y), then parking lots (id, x, y), each in order of their ids, with the nearest nodes (node_id, x, y) of both graphs.

    Parking lots have no node of the forest and get -1.
    """
    both = entries.select(F.lit(0).alias("kind"), "id", "x", "y").unionByName(parking.select(F.lit(1).alias("kind"), "id", "x", "y"))
    placed = cut(running_total(both, ["kind", "id", "x", "y"], F.lit(1), "pos"))
    points = placed.select(F.col("pos").alias("id"), "x", "y", "kind")
    return xyrf(placed, spatial.nearest(points, road), spatial.nearest(points.where("kind = 0"), forest))
