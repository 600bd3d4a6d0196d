"""An OSM file read as the texts between its `<`, split by bytes like any text file, for files that aren't well-formed XML.

Spark cuts the file into blocks and each block begins anew at a `<`. What lies in a block belongs to the last way that opens in it,
or, before the first, to the one still open where an earlier block ends; one row a block tells that.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.functions.geo import great_circle
from waynet.functions.speeds import way_speed
from waynet.plans.iterate import cut, running_total

#: Where an element stands: file, first byte of its block, and its place in the block.
PLACE = ["file", "block", "at"]


def _attribute(name: str) -> Column:
    return F.regexp_extract("value", rf'(?:^|\s){name}="([^"]*)"', 1)


def scan_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at and value of the nodes, ways, refs and kinds of ways, and of what ends a way, all without their `<`."""
    raw = spark.read.option("lineSep", "<").text(path)
    placed = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return placed.where(F.col("value").rlike(r'^(node\s|way\s|relation\s|nd\s|/way|tag k="highway" v=")'))


def scan_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node, node_id, lat, lon) and ways (way_id, nds, way_type) of the elements of files, whatever stands around these.

    Nodes are numbered in file order; of nodes of one id the first counts. A way's type is its last, null without one, and a way without refs has an
    empty list. Ways of equal ids stay apart. Coordinates have single precision. A number that can't be read is an error.
    """
    elements = cut(scan_elements(spark, path))
    first = F.min(F.struct(*PLACE, _attribute("lat").cast("float").cast("double").alias("lat"), _attribute("lon").cast("float").cast("double").alias("lon"))).alias("n")
    nodes = elements.where(F.col("value").startswith("node")).groupBy(_attribute("id").cast("long").alias("node_id")).agg(first)
    nodes = running_total(nodes.select("node_id", "n.*"), PLACE, F.lit(1), "node").select("node", "node_id", "lat", "lon")

    opens = F.when(F.col("value").startswith("way"), F.struct(*PLACE, _attribute("id").cast("long").alias("way_id")))
    ends = F.col("value").rlike("^(node|relation|/way)")
    # What is open: a way's place, or a row that says none is.
    turn = F.when(opens.isNotNull() | ends, F.struct(opens.alias("way")))
    turned = elements.withColumn("turn", turn)
    block = turned.where("turn IS NOT NULL").groupBy("file", "block").agg(F.max_by("turn", "at").alias("last"))
    every = elements.select("file", "block").distinct().join(block, ["file", "block"], "left")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = every.select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    so_far = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = turned.withColumn("own", F.last("turn", ignorenulls=True).over(so_far)).join(before, ["file", "block"]).select(*PLACE, "value", F.coalesce("own", "before")["way"].alias("way")).where("way IS NOT NULL")
    ref = F.when(F.col("value").startswith("nd"), F.struct("block", "at", _attribute("ref").cast("long").alias("ref")))
    kind = F.when(F.col("value").startswith("tag"), F.struct("block", "at", _attribute("v").alias("v")))
    ways = held.groupBy("way").agg(F.sort_array(F.collect_list(ref)).alias("refs"), F.max(kind)["v"].alias("way_type"))
    return nodes, ways.select("way.way_id", F.transform("refs", lambda r: r["ref"]).alias("nds"), "way_type")


def whole_second_arcs(nodes: DataFrame, ways: DataFrame, profile: str) -> DataFrame:
    """source, target and cost of both arcs between consecutive nodes of the ways that the profile uses, in numbers of nodes.

    The cost is whole metres at the profile's speed, in seconds rounded up. A ref to a node that isn't there is an error.
    """
    speed = F.coalesce(way_speed(F.col("way_type"), profile), F.lit(0))
    pairs = F.transform(F.slice("nds", F.lit(1), F.greatest(F.size("nds") - 1, F.lit(0))), lambda n, i: F.struct(n.alias("a"), F.get("nds", i + 1).alias("b")))
    steps = ways.withColumn("speed", speed).where("speed > 0").select("speed", F.explode(pairs).alias("p")).select("speed", "p.*")
    for end in ("a", "b"):
        steps = steps.join(nodes.select(F.col("node_id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("node", "lat", "lon"))), end, "left")
    missing = F.when(F.col("a_node").isNull(), F.col("a")).when(F.col("b_node").isNull(), F.col("b"))
    metres = F.floor(great_circle(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    seconds = F.when(missing.isNotNull(), F.raise_error(F.concat(F.lit("no node "), missing.cast("string"))).cast("long")).otherwise(F.ceil(metres * 3.6 / F.col("speed")))
    there = cut(steps.select(F.col("a_node").alias("source"), F.col("b_node").alias("target"), seconds.alias("cost")))
    return there.unionByName(there.select(F.col("target").alias("source"), F.col("source").alias("target"), "cost"))
