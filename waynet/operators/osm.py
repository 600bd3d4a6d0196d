"""Map extracts: which relations and points matter, ids to places, entries to forests, points of interest."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waynet.functions.geo import has_tag, is_forest, is_point_of_interest, poi_category
from waynet.plans.iterate import running_total


def relevant_relations(relations: DataFrame) -> DataFrame:
    """relation_id, members, tags and forest of forests, and of boundaries with a name and an admin_level; outer and inner ways only."""
    tags = F.col("tags")
    boundary = has_tag(tags, "type", "boundary") & F.array_contains(F.map_keys(tags), "name") & F.array_contains(F.map_keys(tags), "admin_level")
    ways = F.filter("members", lambda m: (m["type"] == "way") & m["role"].isin("outer", "inner"))
    return relations.withColumns({"forest": is_forest(tags), "members": ways}).where(F.col("forest") | F.coalesce(boundary, F.lit(False)))


def node_indices(nodes: DataFrame, order: str) -> DataFrame:
    """nodes with `index`, their place from 0 in that order."""
    return running_total(nodes, [order], F.lit(1), "index")


def highway_nodes(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """The nodes (node_id, ...) that an arc (source, target) touches."""
    used = arcs.select(F.col("source").alias("node_id")).unionByName(arcs.select(F.col("target").alias("node_id"))).distinct()
    return nodes.join(used, "node_id", "left_semi")


def resolve_arcs(arcs: DataFrame, indexed: DataFrame) -> DataFrame:
    """arcs with source and target as indices; those whose ends aren't among the nodes go."""
    s, t = (indexed.select(F.col("node_id").alias(c), F.col("index").alias(f"{c}_index")) for c in ("source", "target"))
    found = arcs.join(s, "source").join(t, "target")
    return found.drop("source", "target").withColumnsRenamed({"source_index": "source", "target_index": "target"})


def resolve_polygons(polygons: DataFrame, nodes: DataFrame) -> DataFrame:
    """poly_id and ring, the places (lat, lon) of the nds of polygons (poly_id, nds) in order."""
    placed = polygons.select("poly_id", F.posexplode("nds").alias("pos", "node_id")).join(nodes.select("node_id", "lat", "lon"), "node_id")
    ring = F.sort_array(F.collect_list(F.struct("pos", "lat", "lon")))
    return placed.groupBy("poly_id").agg(F.transform(ring, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("ring"))


def classify_entries(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """nodes (node, flag) with flag 2 where a node of flag 0 has an arc to one of flag 1."""
    s, t = nodes.where("flag = 0").select(F.col("node").alias("source")), nodes.where("flag = 1").select(F.col("node").alias("target"))
    entries = arcs.join(s, "source", "left_semi").join(t, "target", "left_semi").select(F.col("source").alias("node"), F.lit(2).alias("entry")).distinct()
    return nodes.join(entries, "node", "left").withColumn("flag", F.coalesce("entry", F.col("flag")).cast(nodes.schema["flag"].dataType)).drop("entry")


def within_forest(pois: DataFrame, nodes: DataFrame) -> DataFrame:
    """The points of interest (node, ...) whose node has a flag other than 0."""
    return pois.join(nodes.where("flag <> 0").select("node"), "node", "left_semi")


def poi_categories(tagged: DataFrame, ways: DataFrame) -> DataFrame:
    """node_id and its highest category; tagged are (osm_id, key, value) of nodes, or of ways (way_id, nds), whose nodes they mark."""
    rated = tagged.where(is_point_of_interest(F.col("key"), F.col("value"))).groupBy("osm_id").agg(F.max(poi_category(F.col("key"), F.col("value"))).alias("category"))
    spread = rated.join(ways.select(F.col("way_id").alias("osm_id"), "nds"), "osm_id").select(F.explode("nds").alias("node_id"), "category")
    own = rated.join(ways.select(F.col("way_id").alias("osm_id")), "osm_id", "left_anti").select(F.col("osm_id").alias("node_id"), "category")
    return own.unionByName(spread).groupBy("node_id").agg(F.max("category").alias("category"))


def with_missing(nodes: DataFrame, extra: DataFrame, wanted: DataFrame) -> DataFrame:
    """nodes and, of extra, those that wanted (node_id) names and nodes lack."""
    lacking = wanted.select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_anti")
    return nodes.unionByName(extra.join(lacking, "node_id", "left_semi").select(*nodes.columns))


def match_coordinates(entries: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries (x, y, ...) with the node of exactly the same place, and those that none has."""
    return entries.join(nodes.select("node", "x", "y"), ["x", "y"]), entries.join(nodes.select("x", "y"), ["x", "y"], "left_anti")


def join_population(nearest: DataFrame, arcs: DataFrame, first_id: Column) -> DataFrame:
    """arcs and, for every point (id, node_id), an arc of cost 0 from its node to a new node, first_id + id."""
    new = nearest.select(F.col("node_id").cast("long").alias("source"), (first_id + F.col("id")).cast("long").alias("target"), F.lit(0).alias("cost"))
    return arcs.select(F.col("source").cast("long"), F.col("target").cast("long"), "cost").unionByName(new)


def wiki_link(value: Column) -> Column:
    """The address of an article given as language:title."""
    return F.when(value.contains(":"), F.concat(F.lit("https://"), F.substring_index(value, ":", 1), F.lit(".wikipedia.org/wiki/"), F.replace(F.regexp_replace(value, "^[^:]*:", ""), F.lit(" "), F.lit("_"))))
