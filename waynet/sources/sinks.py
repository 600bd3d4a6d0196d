"""Results as tables for writing, and ordered text files where another program wants them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waynet.plans.iterate import running_total


def write_lines(rows: DataFrame, order: list[str], line: Column, path: str) -> None:
    """One line a row; part files follow the order, read one after the other."""
    rows.orderBy(*order).select(line.cast("string").alias("value")).write.text(path)


def arc_lines(arcs: DataFrame, columns: list[str]) -> DataFrame:
    """arc_id and the line of each arc: the columns given, then the running number by (source, pos)."""
    return running_total(arcs, ["source", "pos"], F.lit(1), "arc_id").select("arc_id", F.concat_ws(" ", *columns, "arc_id").alias("line"))


def last_feature(arcs: DataFrame) -> DataFrame:
    """source, target and fid of the last of parallel arcs (source, target, fid, pos)."""
    return arcs.groupBy("source", "target").agg(F.max_by("fid", "pos").alias("fid"))


def expand_results(results: DataFrame, represented: DataFrame) -> DataFrame:
    """element and value of all original arcs from 0 to the largest id.

    results (pos, label, value) are of simplified arcs, represented (label, ids) says which they stand for. Of
    several values above 0 the one of the last pos counts; without one, 0.
    """
    most = represented.select(F.max(F.array_max("ids"))).first()[0]
    found = results.where("value > 0").join(represented, "label").select("pos", "value", F.explode("ids").alias("element"))
    found = found.groupBy("element").agg(F.max_by("value", "pos").alias("value"))
    elements = results.sparkSession.range(0 if most is None else most + 1).withColumnRenamed("id", "element")
    return elements.join(found, "element", "left").select("element", F.coalesce("value", F.lit(0.0)).alias("value"))


def feature_weights(features: DataFrame, arcs: DataFrame) -> DataFrame:
    """features with the summed value of all their arcs (fid, value), both directions; null where none has one (a miss)."""
    return features.join(arcs.groupBy("fid").agg(F.sum("value").alias("value")), "fid", "left")


def split_positions(values: DataFrame, first_parking: int) -> tuple[DataFrame, DataFrame]:
    """Values (pos, value) of entries, and those of parking lots with their places from 0."""
    lots = values.where(F.col("pos") >= first_parking).withColumn("pos", F.col("pos") - first_parking)
    return values.where(F.col("pos") < first_parking), lots


def write_by_level(areas: DataFrame, path: str, level: str = "admin_level") -> None:
    areas.write.partitionBy(level).parquet(path)


def target_points(arcs: DataFrame, kinds: int, most: int | None = None) -> DataFrame:
    """Each target node once, by its first arc (target, lat, lon, type, pos), as JSON with count = kinds - type; the first `most` by pos, if given."""
    first = arcs.groupBy("target").agg(F.min_by(F.struct("lat", "lon", (F.lit(kinds) - F.col("type")).alias("count")), "pos").alias("p"), F.min("pos").alias("pos"))
    first = first if most is None else first.orderBy("pos").limit(most)
    return first.select("target", F.to_json("p").alias("json"))


def graph_lines(nodes: DataFrame, arcs: DataFrame, node_columns: list[str], arc_columns: list[str]) -> DataFrame:
    """part, at and line of a graph file: the numbers of nodes and arcs, the nodes by node, the arcs by source and pos with their number."""
    counts = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(arcs.agg(F.count(F.lit(1)).alias("m")))  # one row
    head = counts.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n").cast("string").alias("line")), F.struct(F.lit(1).cast("long").alias("at"), F.col("m").cast("string").alias("line")))).alias("h")).select(F.lit(0).alias("part"), "h.*")
    body = nodes.select(F.lit(1).alias("part"), F.col("node").cast("long").alias("at"), F.concat_ws(" ", *node_columns).alias("line"))
    tail = arc_lines(arcs, arc_columns).select(F.lit(2).alias("part"), F.col("arc_id").alias("at"), "line")
    return head.unionByName(body).unionByName(tail)


def xyrf(entries: DataFrame, road: DataFrame, forest: DataFrame) -> DataFrame:
    """pos, x, y, r, f of entries (pos, x, y) with the nearest road node (id, node_id) and forest node; parking lots have no forest node and get -1."""
    r, f = (d.select(F.col("id").alias("pos"), F.col("node_id").alias(n)) for d, n in ((road, "r"), (forest, "f")))
    return entries.select("pos", "x", "y").join(r, "pos").join(f, "pos", "left").select("pos", "x", "y", "r", F.coalesce("f", F.lit(-1)).alias("f"))


def poi_lines(pois: DataFrame) -> DataFrame:
    """index and line (index, osm_id, category) of points of interest, to be written by index."""
    return pois.select("index", F.concat_ws(" ", "index", "osm_id", "category").alias("line"))


def polygon_lines(polygons: DataFrame) -> DataFrame:
    """poly_id and the ring as one line of JSON."""
    return polygons.select("poly_id", F.to_json("ring").alias("line"))


def dense_ids(rows: DataFrame, key: str, shift: int) -> DataFrame:
    """key and new_id: the distinct keys numbered densely from `shift` in their order."""
    return running_total(rows.select(key).distinct(), [key], F.lit(1), "new_id").select(key, (F.col("new_id") + shift).alias("new_id"))


def translate_ids(nodes: DataFrame, ways: DataFrame, shift: int) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, ...) and ways (way_id, nds, tags) with ids numbered densely from shift, each kind in the order of its ids.

    Refs follow in their order; one to a node that isn't there is an error. A way of the object name `Wald` becomes a forest.
    """
    node_ids, way_ids = dense_ids(nodes, "node_id", shift), dense_ids(ways, "way_id", shift)
    refs = ways.select("way_id", F.posexplode("nds").alias("at", "node_id")).join(node_ids, "node_id", "left")
    found = F.when(F.col("new_id").isNull(), F.raise_error(F.concat(F.lit("no node "), F.col("node_id").cast("string"))).cast("long")).otherwise(F.col("new_id"))
    told = refs.withColumn("found", found).groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("at", "found"))).alias("refs"))
    wood = F.coalesce(F.try_element_at("tags", F.lit("Objektname")) == "Wald", F.lit(False))
    as_forest = F.map_concat(F.map_filter("tags", lambda k, v: ~k.isin("Objektname", "landuse")), F.create_map(F.lit("landuse"), F.lit("forest")))
    new_ways = ways.join(way_ids, "way_id").join(told, "way_id", "left").select(
        F.col("new_id").alias("way_id"), F.coalesce(F.transform("refs", lambda r: r["found"]), F.array().cast("array<bigint>")).alias("nds"), F.when(wood, as_forest).otherwise(F.col("tags")).alias("tags")
    )
    return nodes.join(node_ids, "node_id").drop("node_id").withColumnRenamed("new_id", "node_id").select(*nodes.columns), new_ways


def write_osm(nodes: DataFrame, ways: DataFrame, path: str) -> None:
    """nodes (node_id, lat, lon, tags) and ways (way_id, nds, tags) as OSM XML in path/nodes and path/ways, for read_osm of path/*."""
    tags = F.transform(F.map_entries("tags"), lambda t: F.struct(t["key"].alias("_k"), t["value"].alias("_v")))
    points = nodes.select(F.col("node_id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), tags.alias("tag"))
    lines = ways.select(F.col("way_id").alias("_id"), F.transform("nds", lambda n: F.struct(n.alias("_ref"), F.lit(None).cast("string").alias("_VALUE"))).alias("nd"), tags.alias("tag"))
    for rows, kind in ((points, "node"), (lines, "way")):
        rows.write.format("xml").option("rootTag", "osm").option("rowTag", kind).save(f"{path}/{kind}s")
