"""The nearest nodes of points by an adaptive quadtree, as joins of a level with the next.

Cells are split into sixteen, two cuts of each side, until none holds more than LEAF nodes. All points go down the tree together: at each level a point keeps
the cells that can still hold one of its nearest nodes, by the boxes of the nodes in them and the bound that the counts of nearer cells
give. So a dense city costs more levels, not larger cells, and a far point goes straight to the few leaves it needs.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.operators.search import CURVE_BITS, curve_place
from waynet.plans.iterate import cut

#: Nodes of a leaf, points of a leaf that are compared together, bits of the curve that one level splits by, and levels whose
#: cells are few enough to be broadcast: 16 to that power.
LEAF, TOGETHER, SPLIT_BITS, FEW_LEVELS = 64, 4096, 4, 3
MOST_LEVELS = 2 * CURVE_BITS // SPLIT_BITS


@dataclass
class Quadtree:
    """cells by level (code, parent, n, x0, y0, x1, y1, leaf), and nodes (node_id, nx, ny, level, code) in their leaves."""

    levels: list[DataFrame]
    nodes: DataFrame


def quadtree(nodes: DataFrame, most: int = LEAF) -> Quadtree:
    """The tree of nodes (node_id, x, y), all with coordinates. Nodes of one place share a leaf, however many they are."""
    box = nodes.agg(*(F.coalesce(f(F.col(c).cast("double")), F.lit(0.0)) for f in (F.min, F.max) for c in ("x", "y"))).first()
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    rest = cut(nodes.select("node_id", x.alias("nx"), y.alias("ny"), curve_place(x, y, tuple(box)).alias("along")))
    levels, placed = [], []
    for level in range(MOST_LEVELS + 1):
        code = F.shiftright("along", SPLIT_BITS * (MOST_LEVELS - level))
        cells = rest.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("nx").alias("x0"), F.min("ny").alias("y0"), F.max("nx").alias("x1"), F.max("ny").alias("y1"))
        leaf = (F.col("n") <= most) | ((F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))) | F.lit(level == MOST_LEVELS)
        cells = cut(cells.select("code", F.shiftright("code", SPLIT_BITS).alias("parent"), "n", "x0", "y0", "x1", "y1", leaf.alias("leaf")))
        levels.append(cells)
        told = rest.withColumn("code", code).join(cells.select("code", "leaf"), "code")
        placed.append(told.where("leaf").select("node_id", "nx", "ny", F.lit(level).alias("level"), "code"))
        if cells.where("NOT leaf").isEmpty():
            break
        rest = cut(told.where("NOT leaf").select("node_id", "nx", "ny", "along"))
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    return Quadtree(levels, cut(every))


def _square(x: Column, y: Column) -> Column:
    return x * x + y * y


def _toward(cells: DataFrame) -> DataFrame:
    """The least and the most squared distance from (x, y) to what a cell's box may hold."""
    near = [F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0)) for c in ("x", "y")]
    far = [F.greatest(F.abs(F.col(c) - F.col(f"{c}0")), F.abs(F.col(c) - F.col(f"{c}1"))) for c in ("x", "y")]
    return cells.withColumns({"least": _square(*near), "farthest": _square(*far)})


def nearest_of_tree(points: DataFrame, tree: Quadtree, k: int = 1, radius: float | None = None) -> DataFrame:
    """id, node_id, d2, rank of the k nearest nodes of every point (id, x, y), ties by node_id; within the radius (inclusive), if there is one."""
    kept = ["id", "x", "y", "level", "code", "n", "leaf", "least", "farthest"]
    start = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    front = _toward(start.crossJoin(F.broadcast(tree.levels[0].drop("parent")))).withColumn("level", F.lit(0)).select(*kept)  # one row
    for level, cells in enumerate(tree.levels[1:], 1):
        below = cells if level > FEW_LEVELS else F.broadcast(cells)
        opened = front.where("NOT leaf").select("id", "x", "y", F.col("code").alias("parent")).join(below, "parent")
        every = front.where("leaf").unionByName(_toward(opened).withColumn("level", F.lit(level)).select(*kept))
        near_first = Window.partitionBy("id").orderBy("farthest", "level", "code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = every.withColumn("enough", F.when(F.sum("n").over(near_first) >= k, F.col("farthest")))
        bound = F.min("enough").over(Window.partitionBy("id"))
        front = cut(counted.withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("least") <= F.col("bound"))).select(*kept))
    if radius is not None:
        front = front.where(F.col("least") <= radius * radius)
    # Leaves that many points need are compared in parts.
    parts = front.groupBy("level", "code").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    seats = front.join(parts, ["level", "code"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("id", "x", "y", "level", "code", "part")
    nodes = tree.nodes.join(parts, ["level", "code"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    d2 = _square(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
    met = seats.join(nodes, ["level", "code", "part"]).select("id", "node_id", d2.alias("d2"))
    met = met if radius is None else met.where(F.col("d2") <= radius * radius)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "node_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_nodes(points: DataFrame, nodes: DataFrame, k: int = 1, radius: float | None = None, most: int = LEAF) -> DataFrame:
    """nearest_of_tree of the nodes (node_id, x, y); points and nodes without coordinates take no part."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return nearest_of_tree(points.where(known("x") & known("y")), quadtree(nodes.where(known("x") & known("y")), most), k, radius)
