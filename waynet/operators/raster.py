"""Heat maps: heat of nodes, rasters, pyramids, extracts and answers."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waynet.functions.geo import great_circle
from waynet.plans.iterate import cut, running_total


def node_heat(arcs: DataFrame, flags: DataFrame) -> DataFrame:
    """node and heat: each edge (once, source below target) adds its heat to its flagged ends; zeros go."""
    one = arcs.where("source < target")
    ends = one.select(F.col("source").alias("node"), "heat").unionByName(one.select(F.col("target").alias("node"), "heat"))
    return ends.join(flags.where("flag <> 0"), "node").groupBy("node").agg(F.sum("heat").alias("heat")).where("heat <> 0")


def rasterize(heat: DataFrame, lat_step: float, lon_step: float) -> DataFrame:
    """by, bx and the summed heat of the cells of (lat, lon, heat); only cells above 0."""
    cell = lambda v, step: F.floor(F.col(v) / step + 0.5).cast("long")
    return heat.groupBy(cell("lat", lat_step).alias("by"), cell("lon", lon_step).alias("bx")).agg(F.sum("heat").alias("heat")).where("heat > 0")


def longitude_step(lat_step: Column, north: Column) -> Column:
    """Degrees of longitude that are as wide at latitude `north` as lat_step degrees of latitude are high below it."""
    zero = F.lit(0.0)
    return great_circle(north, zero, north - lat_step, zero) / great_circle(north, zero, north, F.lit(1.0))


def rasterize_box(heat: DataFrame, south: float, west: float, north: float, east: float, rows: int) -> DataFrame:
    """lat, lon and summed heat of the raster points near the points of a box, in `rows` rows; only sums above 0.

    Rows are (north - south) / (rows - 1) apart, and start half a step before the multiple of it at or below south; columns
    alike, with the step that is as wide at the north. A point counts for the last raster point half a step or more before it.
    """
    height = F.lit((north - south) / (rows - 1))
    size = heat.sparkSession.range(1).select(height.alias("lat_step"), longitude_step(height, F.lit(north)).alias("lon_step"))
    ends = size.select("*", *((((F.floor(F.lit(low) / F.col(f"{c}_step")) - 0.5) * F.col(f"{c}_step")).alias(f"{c}_start")) for c, low in (("lat", south), ("lon", west))), *((F.lit(high) + 0.5 * F.col(f"{c}_step")).alias(f"{c}_end") for c, high in (("lat", north), ("lon", east))))
    near = heat.crossJoin(ends).where((F.col("lat") >= F.col("lat_start")) & (F.col("lat") <= F.col("lat_end")) & (F.col("lon") >= F.col("lon_start")) & (F.col("lon") < F.col("lon_end")))  # one row
    cells = [F.floor((F.col(c) + 0.5 * F.col(f"{c}_step") - F.col(f"{c}_start")) / F.col(f"{c}_step")).cast("long").alias(f"{c}_cell") for c in ("lat", "lon")]
    width = (F.col("lon_end") - F.col("lon_start")) / F.ceil((F.col("lon_end") - F.col("lon_start")) / F.col("lon_step"))
    summed = near.groupBy(*cells, "lat_start", "lat_step", "lon_start", width.alias("width")).agg(F.sum("heat").alias("heat")).where("heat > 0")
    return summed.select((F.col("lat_start") + F.col("lat_cell") * F.col("lat_step")).alias("lat"), (F.col("lon_start") + F.col("lon_cell") * F.col("width")).alias("lon"), "heat")


def save_pyramids(levels: DataFrame, path: str) -> None:
    """Writes rasters (dataset, zoom, by, bx, heat), a folder for each dataset and zoom, rows of a folder by place."""
    levels.repartition("dataset", "zoom", F.floor(F.col("by") / 256)).sortWithinPartitions("dataset", "zoom", "by", "bx").write.partitionBy("dataset", "zoom").parquet(path)


def load_raster(spark: SparkSession, path: str, dataset: str, zoom: int) -> DataFrame:
    """One dataset's raster at a zoom level; other folders aren't read."""
    return spark.read.parquet(path).where((F.col("dataset") == dataset) & (F.col("zoom") == zoom))


def middle_heat(heat: DataFrame, order: list[str]) -> DataFrame:
    """dataset and max: the heat of the middle row (n / 2) in the order given, which needs no sorting by heat."""
    ranked = cut(running_total(heat, ["dataset", *order], F.lit(1), "at"))
    whole = ranked.groupBy(F.col("dataset").alias("_key")).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_all"))
    found = ranked.join(F.broadcast(whole), F.col("dataset").eqNullSafe(F.col("_key")))
    return found.where(F.col("at") == F.col("_first") + F.floor(F.col("_all") / 2)).select("dataset", F.col("heat").alias("max"))


def colour_scale(most: Column, zoom: Column) -> Column:
    """The heat that gets the hottest colour at a zoom level."""
    return most * F.sqrt(F.greatest(F.lit(1), zoom - 11))


def pyramid(heat: DataFrame, lat_step: float, lon_step: float, levels: int) -> DataFrame:
    """zoom, by, bx, heat: from the finest level on, each level is made of the one before at double the step."""
    level, out = rasterize(heat, lat_step, lon_step), None
    for zoom in range(levels - 1, -1, -1):
        own = level.withColumn("zoom", F.lit(zoom))
        out = own if out is None else out.unionByName(own)
        level = level.groupBy(F.floor(F.col("by") / 2).cast("long").alias("by"), F.floor(F.col("bx") / 2).cast("long").alias("bx")).agg(F.sum("heat").alias("heat"))
    return out.select("zoom", "by", "bx", "heat")


def extract(heat: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return heat.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def bounds(heat: DataFrame) -> DataFrame:
    """Bounds of every dataset, and of all (dataset null)."""
    return heat.rollup("dataset").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Element n/2 of the ascending values above 0 of each key.

    Equal values are counted first. Counts before a value come from all keys' sorted values at once, less those of the
    keys before, so no task holds a key.
    """
    counts = rows.where(F.col(value) > 0).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = cut(running_total(counts, [key, value], F.col("n"), "before"))
    whole = ranked.groupBy(F.col(key).alias("_key")).agg(F.min("before").alias("_first"), F.sum("n").alias("_all"))
    place = F.col("_first") + F.floor(F.col("_all") / 2)
    found = ranked.join(F.broadcast(whole), F.col(key).eqNullSafe(F.col("_key")))
    return found.where((F.col("before") <= place) & (place < F.col("before") + F.col("n"))).select(key, F.col(value).alias("median"))


def answer(heat: DataFrame) -> DataFrame:
    """dataset, count, max and the points as text, sorted by latitude and longitude."""
    text = F.format_string("%.7f,%.7f,%.1f", "lat", "lon", "heat")
    points = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lat", "lon", text.alias("t")))), lambda p: p["t"]), ";")
    return heat.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.max("heat").alias("max"), points.alias("points"))
