"""Readers of the text formats: column tables, graphs and graph strings. Places become explicit columns."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.functions.geo import check_preferences
from waynet.plans.iterate import running_total


def lines(spark: SparkSession, path: str) -> DataFrame:
    """pos and value of every line, in file order; the running place is summed over partitions."""
    raw = spark.read.text(path).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    counts = raw.groupBy("part").count()
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return raw.join(before, "part").select((F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("pos"), "value")


def fields(value: Column) -> Column:
    return F.split(F.trim(value), r"\s+")


def read_columns(spark: SparkSession, path: str, names: list[str], kind: str = "double") -> DataFrame:
    """A table of white-space separated numbers; int cuts decimals off. Further columns are ignored."""
    parts = fields(F.col("value"))
    return lines(spark, path).where(F.trim("value") != "").select("pos", *(F.get(parts, F.lit(i)).cast("double").cast(kind).alias(n) for i, n in enumerate(names)))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, x, y) and arcs (arc_id, source, target, cost, weight) of a graph file with two header lines."""
    all_lines = lines(spark, path).select("pos", fields(F.col("value")).alias("f"))
    n, m = (all_lines.where(F.col("pos") == k).select(F.get("f", F.lit(0)).try_cast("long").alias(c)) for k, c in ((0, "n"), (1, "m")))
    body = all_lines.where("pos > 1").crossJoin(n).crossJoin(m)  # one row each
    get = lambda i, kind: F.get("f", F.lit(i)).cast("double").cast(kind)
    nodes = body.where("pos < n + 2").select((F.col("pos") - 2).alias("node_id"), get(0, "double").alias("x"), get(1, "double").alias("y"))
    arcs = body.where("pos >= n + 2 AND pos < n + m + 2").select(
        (F.col("pos") - F.col("n") - 2).alias("arc_id"), get(0, "int").alias("source"), get(1, "int").alias("target"), get(2, "int").alias("cost"), F.coalesce(get(3, "int"), F.lit(1)).alias("weight")
    )
    return nodes, arcs


def graph_from_string(spark: SparkSession, text: str) -> DataFrame:
    """source, target, cost of `[nodes,arcs,{(target,cost)...},...]`."""
    groups = spark.range(1).select(F.posexplode(F.regexp_extract_all(F.lit(text), F.lit(r"\{([^}]*)\}"), F.lit(1))).alias("source", "g"))
    arcs = groups.select("source", F.explode(F.regexp_extract_all("g", F.lit(r"\([^)]*\)"), F.lit(0))).alias("a"))
    return arcs.select("source", F.regexp_extract("a", r"\((\d+),", 1).cast("int").alias("target"), F.regexp_extract("a", r",(\d+)", 1).cast("int").alias("cost"))


def _tags(column: str) -> Column:
    none = F.array().cast("array<struct<_k:string,_v:string>>")
    return F.map_from_entries(F.transform(F.coalesce(column, none), lambda t: F.struct(t["_k"], t["_v"])))


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, lat, lon) and ways (way_id, nds, tags) of an OSM XML file."""
    ways = spark.read.format("xml").option("rowTag", "way").schema("_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>").load(path)
    return read_osm_nodes(spark, path).drop("tags"), ways.select(F.col("_id").alias("way_id"), F.transform("nd", lambda n: n["_ref"]).alias("nds"), _tags("tag").alias("tags"))


def read_osm_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id, lat, lon and tags."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lat double, _lon double, tag array<struct<_k:string,_v:string>>").load(path)
    return nodes.select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags("tag").alias("tags"))


def read_osm_relations(spark: SparkSession, path: str) -> DataFrame:
    """relation_id, members array of (type, ref, role), and tags."""
    schema = "_id long, member array<struct<_type:string,_ref:long,_role:string>>, tag array<struct<_k:string,_v:string>>"
    raw = spark.read.format("xml").option("rowTag", "relation").schema(schema).load(path)
    members = F.transform(F.coalesce("member", F.array().cast("array<struct<_type:string,_ref:long,_role:string>>")), lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    return raw.select(F.col("_id").alias("relation_id"), members.alias("members"), _tags("tag").alias("tags"))


def read_heat_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node, lat, lon, flag), the lines of four fields, and edges (edge, source, target), those of three; both numbered from 0 in file order."""
    split = lines(spark, path).select("pos", fields(F.col("value")).alias("f"))
    get = lambda i, kind: F.get("f", F.lit(i)).cast("double").cast(kind)
    nodes = running_total(split.where(F.size("f") == 4), ["pos"], F.lit(1), "node")
    edges = running_total(split.where(F.size("f") == 3), ["pos"], F.lit(1), "edge")
    return nodes.select("node", get(0, "double").alias("lat"), get(1, "double").alias("lon"), get(3, "int").alias("flag")), edges.select("edge", get(0, "long").alias("source"), get(1, "long").alias("target"))


def read_preferences(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """The (bound in minutes, share) pairs of a preference file, checked; a handful of rows."""
    rows = read_columns(spark, path, ["bound", "share"]).orderBy("pos").collect()
    prefs = [(r["bound"], r["share"]) for r in rows]
    check_preferences(prefs)
    return prefs


def graph_to_string(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """One row, text: the graph string that graph_from_string() reads; for small graphs, as in tests."""
    own = arcs.groupBy(F.col("source").alias("node")).agg(F.sort_array(F.collect_list(F.struct("target", "cost"))).alias("a"))
    pair = lambda x: F.concat(F.lit("("), x["target"].cast("string"), F.lit(","), x["cost"].cast("string"), F.lit(")"))
    groups = nodes.select("node").join(own, "node", "left").select("node", F.concat(F.lit("{"), F.array_join(F.transform(F.coalesce("a", F.array().cast("array<struct<target:bigint,cost:bigint>>")), pair), ","), F.lit("}")).alias("g"), F.coalesce(F.size("a"), F.lit(0)).alias("n"))
    whole = groups.agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("arcs"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "g"))), lambda x: x["g"]), ",").alias("g"))
    return whole.select(F.format_string("[%d,%d,%s]", "nodes", "arcs", "g").alias("text"))
