"""Stored heat maps: rasters of all zoom levels, kept as tiles, and requests that read few of them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waynet.operators.raster import longitude_step, middle_heat
from waynet.plans.iterate import cut

#: Raster rows that a tile is high. A degree of longitude has no more columns than one of latitude rows, so a tile has about its square at most.
TILE = 256
#: Boxes of datasets that are broadcast, 9 numbers each; more of them meet the points in a shuffle.
BROADCAST_BOXES = 50_000
#: Parts of a dataset's points in that shuffle.
SALTS = 64

_POINTS = "lat double, lon double, heat double, lat_step double, tx long, dataset string, zoom int, ty long"


def rasterize_boxes(heat: DataFrame, boxes: DataFrame) -> DataFrame:
    """dataset, lat, lon, heat, lat_step: raster points near each dataset's box (dataset, south, west, north, east, lat_step).

    As in `rasterize_box`, with the step given. Points without a place, of no box or outside it go, as do sums up to 0.
    """
    ends = boxes.withColumn("lon_step", longitude_step(F.col("lat_step"), F.col("north")))
    for c, low, high in (("lat", "south", "north"), ("lon", "west", "east")):
        step = F.col(f"{c}_step")
        ends = ends.withColumns({f"{c}_start": (F.floor(F.col(low) / step) - 0.5) * step, f"{c}_end": F.col(high) + 0.5 * step})
    ends = cut(ends.select("dataset", *(f"{c}_{part}" for c in ("lat", "lon") for part in ("step", "start", "end"))))
    points = heat.select("dataset", "lat", "lon", "heat")
    if ends.count() <= BROADCAST_BOXES:
        met = points.join(F.broadcast(ends), "dataset")
    else:
        salted = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = points.withColumn("salt", F.pmod(F.xxhash64("lat", "lon"), F.lit(SALTS)).cast("int")).join(salted, ["dataset", "salt"])
    near = met.where((F.col("lat") >= F.col("lat_start")) & (F.col("lat") <= F.col("lat_end")) & (F.col("lon") >= F.col("lon_start")) & (F.col("lon") < F.col("lon_end")))
    cells = [F.floor((F.col(c) + 0.5 * F.col(f"{c}_step") - F.col(f"{c}_start")) / F.col(f"{c}_step")).cast("long").alias(f"{c}_cell") for c in ("lat", "lon")]
    width = (F.col("lon_end") - F.col("lon_start")) / F.ceil((F.col("lon_end") - F.col("lon_start")) / F.col("lon_step"))
    summed = near.groupBy("dataset", *cells, "lat_start", "lat_step", "lon_start", width.alias("width")).agg(F.sum("heat").alias("heat")).where("heat > 0")
    return summed.select("dataset", (F.col("lat_start") + F.col("lat_cell") * F.col("lat_step")).alias("lat"), (F.col("lon_start") + F.col("lon_cell") * F.col("width")).alias("lon"), "heat", "lat_step")


def zoom_rasters(heat: DataFrame, levels: list[tuple[int, float, float, float, float, int]]) -> DataFrame:
    """dataset, zoom, lat, lon, heat, lat_step of heat (dataset, lat, lon, heat) at each level (zoom, south, west, north, east, rows).

    A level's box is what a map shows at that zoom, in so many raster rows. Every level covers all of a dataset, in the number
    of rows that the box's step asks for, and is made of the next finer level's raster; the finest is made of the points.
    A dataset on one latitude has the box's own step. Rows without a dataset or a place take no part.
    """
    if not levels or len({z for z, *_ in levels}) < len(levels):
        raise ValueError("one box for each zoom level")
    level = heat.where("dataset IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    extents = cut(level.groupBy("dataset").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east")))
    out = None
    for zoom, south, _, north, _, rows in sorted(levels, reverse=True):
        step, height = F.lit((north - south) / (rows - 1)), F.col("north") - F.col("south")
        count = F.ceil((height + step) / step)
        boxes = extents.withColumn("lat_step", F.when(count > 1, height / (count - 1)).otherwise(step))
        level = cut(rasterize_boxes(level, boxes))
        own = level.select("dataset", F.lit(zoom).alias("zoom"), "lat", "lon", "heat", "lat_step")
        out = own if out is None else out.unionByName(own)
    return out


def _tile(value: str):
    return F.floor(F.col(value) / (F.col("lat_step") * TILE)).cast("long")


def save_tiles(rasters: DataFrame, path: str) -> None:
    """Writes rasters (dataset, zoom, lat, lon, heat, lat_step) as points, tiles and levels.

    Points lie in a folder for each dataset, zoom and row of tiles, by tile and place, so a request's folders and row groups
    follow from its box. A tile has its number of points, largest heat and bounds; a level these and the heat of its middle point, which scales colours.
    """
    tiled = rasters.select("lat", "lon", "heat", "lat_step", _tile("lon").alias("tx"), F.col("dataset").cast("string").alias("dataset"), F.col("zoom").cast("int").alias("zoom"), _tile("lat").alias("ty"))
    placed = tiled.repartitionByRange("dataset", "zoom", "ty", "tx").sortWithinPartitions("dataset", "zoom", "ty", "tx", "lat", "lon")
    placed.write.partitionBy("dataset", "zoom", "ty").parquet(f"{path}/points")
    points = _points(rasters.sparkSession, path)
    numbers = [F.count(F.lit(1)).alias("n"), F.max("heat").alias("hottest"), *(f(c).alias(n) for n, f, c in (("south", F.min, "lat"), ("west", F.min, "lon"), ("north", F.max, "lat"), ("east", F.max, "lon")))]
    points.groupBy("dataset", "zoom", "ty", "tx", "lat_step").agg(*numbers).write.parquet(f"{path}/tiles")
    tiles = rasters.sparkSession.read.parquet(f"{path}/tiles")
    whole = tiles.groupBy("dataset", "zoom", "lat_step").agg(F.sum("n").alias("n"), F.max("hottest").alias("hottest"), F.min("south").alias("south"), F.min("west").alias("west"), F.max("north").alias("north"), F.max("east").alias("east"))
    middle = middle_heat(points.select(F.struct("dataset", "zoom").alias("dataset"), "lat", "lon", "heat"), ["lat", "lon"])
    whole.join(middle.select("dataset.*", "max"), ["dataset", "zoom"]).write.parquet(f"{path}/levels")


def _points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_POINTS).parquet(f"{path}/points")


def stored_level(spark: SparkSession, path: str, dataset: str, zoom: int) -> dict | None:
    """The stored level of a dataset for a zoom, the least or greatest one for a zoom beyond; None for an unknown dataset."""
    known = spark.read.parquet(f"{path}/levels").where(F.col("dataset") == dataset)
    found = known.orderBy(F.abs(F.col("zoom") - zoom), "zoom").first()
    return found.asDict() if found else None


def tiles_of(spark: SparkSession, path: str, dataset: str, zoom: int, box: tuple[float, float, float, float]) -> DataFrame:
    """The statistics of tiles that a request meets: those whose bounds meet the box (south, west, north, east)."""
    south, west, north, east = box
    level = stored_level(spark, path, dataset, zoom)
    tiles = spark.read.parquet(f"{path}/tiles")
    own = tiles.where((F.col("dataset") == dataset) & (F.col("zoom") == level["zoom"])) if level else tiles.limit(0)
    return own.where((F.col("north") >= south) & (F.col("south") <= north) & (F.col("east") >= west) & (F.col("west") <= east))


def request(spark: SparkSession, path: str, dataset: str, zoom: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """dataset, zoom, ty, tx, lat, lon, heat of a dataset's stored points in a box (south, west, north, east), bounds included.

    No box stands for all. A zoom that isn't stored is the nearest that is. An unknown dataset has no points.
    """
    level = stored_level(spark, path, dataset, zoom)
    points = _points(spark, path).select("dataset", "zoom", "ty", "tx", "lat", "lon", "heat")
    if level is None:
        return points.limit(0)
    own = points.where((F.col("dataset") == dataset) & (F.col("zoom") == level["zoom"]))
    if box is None:
        return own
    size = level["lat_step"] * TILE
    for tile, place, low, high in (("ty", "lat", box[0], box[2]), ("tx", "lon", box[1], box[3])):
        own = own.where(F.col(tile).between(int(low // size) - 1, int(high // size) + 1) & F.col(place).between(low, high))
    return own


def pages(found: DataFrame) -> DataFrame:
    """dataset, zoom, ty, tx, n, points: a request's points as text, a row for each tile, by latitude and longitude in it.

    A page is as large as a tile at most, and no order of all points is needed.
    """
    text = F.format_string("%.7f,%.7f,%.1f", "lat", "lon", "heat")
    points = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lat", "lon", text.alias("t")))), lambda p: p["t"]), ";")
    return found.groupBy("dataset", "zoom", "ty", "tx").agg(F.count(F.lit(1)).alias("n"), points.alias("points"))


def header(spark: SparkSession, path: str, dataset: str, zoom: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """dataset, zoom, datacount, max and radius of a request's answer: its points, the level's middle heat, half its step.

    Without a box the count comes from the level's statistics and no point is read.
    """
    level = stored_level(spark, path, dataset, zoom)
    ddl = "dataset string, zoom int, datacount long, max double, radius double"
    if level is None:
        return spark.createDataFrame([], ddl)
    fixed = [F.lit(dataset).alias("dataset"), F.lit(level["zoom"]).alias("zoom")], [F.lit(level["max"]).alias("max"), F.lit(level["lat_step"] / 2).alias("radius")]
    if box is None:
        return spark.range(1).select(*fixed[0], F.lit(level["n"]).alias("datacount"), *fixed[1])
    return request(spark, path, dataset, zoom, box).agg(F.count(F.lit(1)).alias("datacount")).select(*fixed[0], "datacount", *fixed[1])
