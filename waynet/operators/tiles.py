"""Points in polygons by tiles: each polygon is cut into tiles that lie inside it and tiles that its border touches.

A point in an inside tile needs no test. One in a touched tile is tested by ray casting against the edges of that tile alone. Of the edges to its
right in the same row of tiles it is only known whether they are even in number: each counts the more by as many of its ends as lie
above the point. Where both edges of a corner are right of the tile, the corner counts twice, which changes nothing; so what is
left are the corners above the whole row, one number, and the corners in the row from which one edge leads into the tile. So whole rings never travel, and no tile
holds more than what touches it. Tiles of a
polygon are twice as wide as often as it takes for SIDE of them to span it, so no polygon has more than about SIDE * SIDE tiles.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tiles along a polygon's longer side, and the part of a tile by which edges count for the tiles beside theirs.
SIDE, MARGIN = 32, 1e-9


def width(size: float, level: Column) -> Column:
    return F.lit(float(size)) * F.pow(F.lit(2.0), level)


def _tile(v: Column, wide: Column) -> Column:
    return F.floor(v / wide).cast("long")


def polygon_tiles(polygons: DataFrame, size: float) -> DataFrame:
    """poly_id, level, cx, cy, inside, passed, flips, edges: the tiles of polygons (poly_id, ring array of x, y) that aren't wholly outside.

    Tiles of a level are size * 2 ** level wide. `edges` are those that touch a tile; a ray that leaves the tile meets an odd number of the others
    if `passed` and the `flips` (y of corners) above it are odd in sum. A ring may repeat its first corner; one without an area has no inside, a null or empty one no tiles.
    """
    # The corners beside each are arrays of their own: a lambda that looks into the ring may have the ring made anew for every corner.
    corners = F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    others = F.greatest(F.size("ring") - 1, F.lit(0))
    following = F.concat(F.slice(corners, F.lit(2), others), F.slice(corners, F.lit(1), F.lit(1)))
    before = F.concat(F.slice(corners, F.greatest(F.size("ring"), F.lit(1)), F.lit(1)), F.slice(corners, F.lit(1), others))
    edges = F.zip_with(corners, following, lambda p, n: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), n["x"].alias("bx"), n["y"].alias("by")))
    ring = F.zip_with(edges, before, lambda e, p: F.struct(e.alias("e"), F.struct(p["x"].alias("ax"), p["y"].alias("ay"), e["ax"].alias("bx"), e["ay"].alias("by")).alias("d")))
    box = [f(F.col(f"ring.{c}").cast("array<double>")).alias(f"{c}{k}") for c in ("x", "y") for k, f in enumerate((F.array_min, F.array_max))]
    whole = polygons.select("poly_id", ring.alias("ring"), *box)
    level = F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / (size * SIDE)))).cast("int")
    whole = whole.withColumn("level", level).withColumn("wide", width(size, F.col("level")))
    wide, pad = F.col("wide"), F.col("wide") * MARGIN
    whole = whole.withColumns({"first": _tile(F.col("x0") - pad, wide), "last": _tile(F.col("x1") + pad, wide)})
    place = ["poly_id", "level", "cy"]
    edges = whole.select("poly_id", "level", "wide", "first", "last", F.explode("ring").alias("r")).select("poly_id", "level", "wide", "first", "last", "r.e", "r.d")
    # Twice the margin, so that both edges of a corner have all rows that the corner lies in.
    rows = F.sequence(_tile(F.least("e.ay", "e.by") - 2 * pad, wide), _tile(F.greatest("e.ay", "e.by") + 2 * pad, wide))
    banded = edges.withColumn("cy", F.explode(rows))
    bottom, top = F.col("cy") * wide - pad, (F.col("cy") + 1) * wide + pad

    def span(e: str) -> tuple[Column, Column]:
        """The first and last tile of an edge in the row: from where it enters to where it leaves; a level one is there with its whole length."""
        ax, ay, bx, by = (F.col(f"{e}.{c}") for c in ("ax", "ay", "bx", "by"))
        low, high = F.least(ay, by), F.greatest(ay, by)
        x = [F.when(high > low, ax + (bx - ax) * ((y - ay) / (by - ay))) for y in (F.least(F.greatest(low, bottom), high), F.greatest(F.least(high, top), low))]
        return _tile(F.coalesce(F.least(*x), F.least(ax, bx)) - pad, wide), _tile(F.coalesce(F.greatest(*x), F.greatest(ax, bx)) + pad, wide)

    start, end = span("e")
    above = lambda y: (y >= top).cast("int")
    banded = banded.select(
        *place, "e", F.greatest(start, "first").alias("from"), F.least(end, "last").alias("to"), F.greatest(span("d")[0], "first").alias("from_d"), "first",
        ((above(F.col("e.ay")) + above(F.col("e.by"))) % 2).alias("odd"), ((F.col("e.ay") > bottom) & (F.col("e.ay") < top)).alias("here"),
    )
    met = lambda cx, touches, flips, odd: F.struct(cx.alias("cx"), F.lit(touches).alias("touches"), F.lit(flips).alias("flips"), F.lit(odd).alias("odd"))
    run = lambda low, high, *kind: F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda cx: met(cx, *kind))).otherwise(F.array().cast("array<struct<cx:bigint,touches:boolean,flips:boolean,odd:int>>"))
    low, high = F.least("from", "from_d"), F.greatest("from", "from_d") - 1
    parts = F.concat(
        run(F.col("from"), F.col("to"), True, False, 0),
        run(low, F.when(F.col("here"), high).otherwise(low - 1), False, True, 0),
        run(F.col("from") - 1, F.when((F.col("odd") == 1) & (F.col("from") > F.col("first")), F.col("from") - 1).otherwise(F.col("from") - 2), False, False, 1),
    )
    # Every tile of the box, as one that nothing touches may be inside.
    boxes = whole.select("poly_id", "level", F.explode(F.sequence("first", "last")).alias("cx"), F.sequence(_tile(F.col("y0") - pad, wide), _tile(F.col("y1") + pad, wide)).alias("rows"))
    every = boxes.select("poly_id", "level", F.explode("rows").alias("cy"), "cx", F.lit(False).alias("touches"), F.lit(False).alias("flips"), F.lit(0).alias("odd"), F.lit(None).cast(banded.schema["e"].dataType).alias("e"))
    each = banded.select(*place, "e", F.explode(parts).alias("p")).select(*place, "p.*", "e")
    tiles = each.unionByName(every).groupBy(*place, "cx").agg(F.max("touches").alias("touched"), F.sum("odd").alias("odd"), F.collect_list(F.when(F.col("flips"), F.col("e.ay"))).alias("flips"), F.collect_list(F.when(F.col("touches"), F.col("e"))).alias("edges"))
    passed = F.sum("odd").over(Window.partitionBy(*place).orderBy(F.desc("cx"))) % 2
    kept = tiles.withColumn("passed", passed).where(F.col("touched") | (F.col("passed") == 1))
    return kept.select("poly_id", "level", "cx", "cy", (~F.col("touched")).alias("inside"), "passed", "flips", F.when(F.col("touched"), F.col("edges")).alias("edges"))


def in_tile(x: Column, y: Column) -> Column:
    """Whether a point of a row of polygon_tiles lies in its polygon, by the rule of inside_ring."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    beyond = F.col("passed") + F.size(F.filter("flips", lambda corner: corner > y))
    return F.col("inside") | ((beyond + F.size(F.filter("edges", crosses))) % 2 == 1)


def on_tiles(points: DataFrame, size: float, level: Column) -> DataFrame:
    """points (x, y, ...) with level, cx and cy of their tiles; those without a place go."""
    x, y, wide = F.col("x").cast("double"), F.col("y").cast("double"), width(size, F.col("level"))
    placed = points.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).withColumn("level", level)
    return placed.withColumns({"cx": _tile(x, wide), "cy": _tile(y, wide)})


def points_in_tiles(points: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """id, poly_id of points (id, x, y) inside the polygons of the tiles; a point meets one tile of each level and polygon."""
    levels = tiles.agg(F.array_sort(F.collect_set("level")).alias("levels"))  # one row of some tens of numbers
    leveled = points.select("id", "x", "y").crossJoin(F.broadcast(levels))
    placed = on_tiles(leveled, size, F.explode("levels"))
    # Spark takes tiles for smaller than they are, and would send all of them through the driver.
    return placed.join(tiles.hint("merge"), ["level", "cx", "cy"]).where(in_tile(F.col("x"), F.col("y"))).select("id", "poly_id")
