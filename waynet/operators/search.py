"""Bounded shortest paths over cells of a graph, and over an overlay of the cells' borders.

Nodes lie in cells, and every REGION cells with numbers in a row in a region. A way enters a cell at one node and leaves it by
an arc into another cell; the overlay has, for every node where ways enter, the least cost to every node where they
enter the next cell. A search settles its own cell, then walks the overlay region by region, and at the end settles the
cells it entered, each once. So only borders travel between rounds, and rounds count borders of regions, not arcs.

An overlay pays where cells have few borders. Where it would have more arcs than the graph, as with small cells on a grid,
a search settles regions by the arcs themselves: in as many rounds, without the overlay and a pass over the entered cells.
"""

import heapq
import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waynet.plans.iterate import cut, running_total

#: Nodes of a cell, cells of a region, and starting rows of a cell that one group settles.
CELL, REGION, GROUP_ROWS = 4096, 16, 4096
#: Bits of a place on each axis of the curve that puts nodes in order.
CURVE_BITS = 20


@dataclass
class Network:
    """Arcs (group, source, target, cost, target_cell, via, more) by cell, the same between borders by region, and how nodes find their cell."""

    arcs: DataFrame
    cells: DataFrame | None
    size: int
    limit: int | None = None

    @cached_property
    def over(self) -> DataFrame:
        enters = self.arcs.where("group <> target_cell").select(F.col("target_cell").alias("group"), F.col("target").alias("node")).distinct()
        ddl = "cell long, source long, target long, cost long, target_cell long, via long, more long"
        crossed = self.arcs.groupBy("group").cogroup(enters.groupBy("group")).applyInPandas(_crossings(self.limit), ddl)
        return cut(crossed.withColumn("group", F.floor(F.col("cell") / REGION).cast("long")).drop("cell"))

    @cached_property
    def pays(self) -> bool:
        """Whether an overlay, of all ways from where a cell is entered to where it is left, has no more arcs than the graph."""
        across = self.arcs.where("group <> target_cell")
        enters = across.select(F.col("target_cell").alias("group"), "target").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("enters"))
        exits = across.select("group", "target").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("exits"))
        most = enters.join(exits, "group").agg(F.coalesce(F.sum(F.col("enters") * F.col("exits")), F.lit(0))).first()[0]
        return most <= self.arcs.count()

    def placed(self, df: DataFrame, node: str, cell: str) -> DataFrame:
        return with_cell(df, node, cell, self.cells, self.size)


def with_cell(df: DataFrame, node: str, cell: str, cells: DataFrame | None, size: int) -> DataFrame:
    """df with the cell of a node: by the table (node, cell), -1 for others, or without one by runs of `size` ids."""
    if cells is None:
        return df.withColumn(cell, F.floor(F.col(node) / size).cast("long"))
    found = cells.select(F.col("node").cast("long").alias(node), F.col("cell").cast("long").alias(cell))
    return df.join(found, node, "left").withColumn(cell, F.coalesce(cell, F.lit(-1).cast("long")))


def _spread(v: Column) -> Column:
    """The bits of a number of up to 32 bits, each with a zero before it."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def curve_place(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """The place of a point on the Z curve over a box (least x, least y, most x, most y)."""
    steps = (1 << CURVE_BITS) - 1
    axis = lambda v, low, high: F.floor((v - F.lit(low)) / F.lit((high - low) or 1.0) * F.lit(float(steps))).cast("long")
    return _spread(axis(x, box[0], box[2])).bitwiseOR(F.shiftleft(_spread(axis(y, box[1], box[3])), 1))


def _near_square(*sides: float) -> list[float]:
    """The sides of a box, the shorter one doubled until it is over half of the longer, so that the box keeps its place on the curve."""
    most = max(sides)
    doubled = lambda v: v * 2.0 ** math.floor(math.log2(min(most / v, 2.0**CURVE_BITS)))
    return [doubled(v) if v > 0 and math.isfinite(most) else v for v in sides]


def place_cells(nodes: DataFrame, size: int = CELL) -> DataFrame:
    """node and cell of nodes (node, x, y): runs of `size` nodes along the Z curve, so cells are compact and none is larger.

    Nodes of one place follow each other by id; those without coordinates come first.
    """
    xy = nodes.select(F.col("node").cast("long").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropDuplicates(["node"])
    west, south, east, north = xy.agg(*(F.coalesce(f(c), F.lit(0.0)) for f in (F.min, F.max) for c in ("x", "y"))).first()
    width, height = _near_square(east - west, north - south)  # or cells of a long strip would be long strips
    along = xy.select("node", curve_place(F.col("x"), F.col("y"), (west, south, west + width, south + height)).alias("along"))
    return running_total(along, ["along", "node"], F.lit(1), "place").select("node", F.floor(F.col("place") / size).cast("long").alias("cell"))


def _by_cell(arcs: DataFrame, cells: DataFrame | None, size: int) -> DataFrame:
    least = arcs.groupBy(*(F.col(c).cast("long").alias(c) for c in ("source", "target"))).agg(F.min("cost").cast("long").alias("cost"))
    both = with_cell(with_cell(least, "source", "group", cells, size), "target", "target_cell", cells, size)
    return cut(both.select("group", "source", "target", "cost", "target_cell", F.col("source").alias("via"), F.lit(0).cast("long").alias("more")))


def network(arcs: DataFrame, cells: DataFrame | None = None, size: int = CELL, limit: int | None = None) -> Network:
    """Arcs (source, target, cost) by cell; the overlay of their borders, for searches up to the limit, is made when it is first used."""
    return Network(_by_cell(arcs, cells, size), cells, size, limit)


def _crossings(limit: int | None):
    """The least costs from each node where ways enter a cell to each node where they enter the next."""

    def crossings(arcs: pd.DataFrame, enters: pd.DataFrame) -> pd.DataFrame:
        inner, outer = {}, {}
        for s, t, c, here, there in zip(*(arcs[k].tolist() for k in ("source", "target", "cost", "group", "target_cell"))):
            (inner if here == there else outer).setdefault(s, []).append((t, c, there))
        out, cell = [], int(enters["group"].iloc[0]) if len(enters) else 0
        for start in enters["node"].tolist() if outer else ():
            todo, done, best = [(0, start)], set(), {}
            while todo:
                cost, node = heapq.heappop(todo)
                if node in done:
                    continue
                done.add(node)
                for target, more, there in outer.get(node, ()):
                    way = (cost + more, cost, node, there)
                    if target not in best or way < best[target]:
                        best[target] = way
                for target, more, _ in inner.get(node, ()):
                    if target not in done and (limit is None or cost + more <= limit):
                        heapq.heappush(todo, (cost + more, target))
            out += [(cell, start, target, cost, there, via, more) for target, (cost, more, via, there) in best.items() if limit is None or cost <= limit]
        return pd.DataFrame(out, columns=["cell", "source", "target", "cost", "target_cell", "via", "more"])

    return crossings


def _settler(limit: int, per: int, keep: str):
    """Settles a group of `per` cells: Dijkstra's search from its starting rows, for each search; nodes outside are reached but not passed.

    keep says which nodes come back: those `inside` the group, those reached `across` its border, or `both`.
    """

    def settle(rows: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        group = rows["group"].iloc[0]
        near: dict[int, list[tuple]] = {}
        for s, *arc in zip(*(arcs[k].tolist() for k in ("source", "target", "cost", "target_cell", "via", "more"))):
            near.setdefault(s, []).append(tuple(arc))
        codes, names = pd.factorize(rows["search_id"])
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order])) + 1
        starts = list(zip(*(rows[k].tolist() for k in ("cost", "parent_cost", "parent", "node", "cell"))))
        out = []
        for own in np.split(order, cuts):
            search, ignored, barred = names[codes[own[0]]], (), ()
            if "ignored" in rows:
                first = rows.iloc[own[0]]
                ignored = () if first["ignored"] is None else set(first["ignored"])
                barred = () if first["barred"] is None else {(x["source"], x["target"]) for x in first["barred"]}
            todo = [starts[k] for k in own]
            heapq.heapify(todo)
            done = set()
            while todo:
                cost, before, parent, node, cell = heapq.heappop(todo)
                if node in done:
                    continue
                done.add(node)
                across = cell // per != group
                if keep == "both" or across == (keep == "across"):
                    out.append((search, node, cost, before, parent, cell, across))
                if across:
                    continue
                for target, more, its_cell, via, late in near.get(node, ()):
                    if target in done or cost + more > limit or (ignored and target in ignored) or (barred and (via, target) in barred):
                        continue
                    heapq.heappush(todo, (cost + more, cost + late, via, target, its_cell))
        return pd.DataFrame(out, columns=["search_id", "node", "cost", "parent_cost", "parent", "cell", "across"])

    return settle


def _settled(rows: DataFrame, arcs: DataFrame, limit: int, per: int, keep: str) -> DataFrame:
    """The rows of every group settled with the group's arcs; rows of one search stay together, and many searches share a copy of the arcs."""
    kind = rows.schema["search_id"].dataType.simpleString()
    rows = rows.withColumn("group", F.floor(F.col("cell") / per).cast("long"))
    parts = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("parts"))
    dealt = rows.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("search_id"), F.col("parts"))).drop("parts")
    wanted = dealt.select("group", "part").distinct()
    around = arcs.join(wanted, "group").select(F.col("group").alias("of_group"), F.col("part").alias("of_part"), "source", "target", "cost", "target_cell", "via", "more")
    ddl = f"search_id {kind}, node long, cost long, parent_cost long, parent long, cell long, across boolean"
    return dealt.groupBy("group", "part").cogroup(around.groupBy("of_group", "of_part")).applyInPandas(_settler(limit, per, keep), ddl)


def _rounds(start: DataFrame, arcs: DataFrame, limit: int, per: int, rules: DataFrame | None = None) -> tuple[DataFrame, int]:
    """What is reached from the starting rows, group by group, and the number of rounds it took."""
    state = ["search_id", "node", "cost", "parent_cost", "parent", "cell"]
    dist, rounds = cut(start.select(*state, F.lit(True).alias("fresh"))), 0
    while True:
        fresh = dist.where("fresh").select(*state)
        reach = _settled(fresh if rules is None else fresh.join(rules, "search_id"), arcs, limit, per, "both")
        both = dist.select(*state, F.lit(False).alias("across"), F.col("cost").alias("had")).unionByName(reach.withColumn("had", F.lit(None).cast("long")))
        best = both.groupBy("search_id", "node").agg(F.min(F.struct("cost", "parent_cost", "parent", "cell", "across")).alias("b"), F.min("had").alias("had"))
        improved = F.col("had").isNull() | (F.col("b.cost") < F.col("had"))
        dist, rounds = cut(best.select("search_id", "node", "b.*", (improved & F.col("b.across")).alias("fresh")).select(*state, "fresh")), rounds + 1
        if dist.where("fresh").isEmpty():
            return dist.select(*state), rounds


def search(net: Network, seeds: DataFrame, limit: int) -> DataFrame:
    """search_id, node, cost, parent of all nodes within the limit (inclusive) of each search's seeds (search_id, node).

    Of equal costs the parent that was settled first stays, of those the least.
    """
    start = cut(_starts(net, seeds))
    if not net.pays:
        by_region = net.arcs.withColumn("group", F.floor(F.col("group") / REGION).cast("long"))
        return _rounds(start, by_region, limit, REGION)[0].select("search_id", "node", "cost", "parent")
    left = _settled(start, net.arcs, limit, 1, "across").groupBy("search_id", "node").agg(F.min(F.struct("cost", "parent_cost", "parent", "cell")).alias("b"))
    left = cut(left.select("search_id", "node", "b.*"))
    entered = start
    if not left.isEmpty():
        entered = start.unionByName(_rounds(left, net.over, limit, REGION)[0])
    return cut(_settled(entered, net.arcs, limit, 1, "inside").select("search_id", "node", "cost", "parent"))


def _starts(net: Network, seeds: DataFrame) -> DataFrame:
    own = net.placed(seeds.select("search_id", F.col("node").cast("long")).distinct(), "node", "cell")
    return own.select("search_id", "node", F.lit(0).cast("long").alias("cost"), F.lit(-1).cast("long").alias("parent_cost"), F.col("node").alias("parent"), "cell")


def search_with_bars(net: Network, seeds: DataFrame, limit: int, ignore: DataFrame | None = None, forbidden: DataFrame | None = None) -> DataFrame:
    """As search, where `ignore` (search_id, node) names nodes that a search may not enter and `forbidden` (search_id, source, target) arcs that it may not use.

    The overlay knows no bars, so cells are settled round by round.
    """
    start = _starts(net, seeds)
    rules = start.select("search_id").distinct()
    arc = F.struct(*(F.col(c).cast("long").alias(c) for c in ("source", "target")))
    for name, bars, value, kind in (("ignored", ignore, F.col("node").cast("long"), "array<long>"), ("barred", forbidden, arc, "array<struct<source:long,target:long>>")):
        if bars is None:
            rules = rules.withColumn(name, F.lit(None).cast(kind))
        else:
            rules = rules.join(bars.select("search_id", value.alias("bar")).groupBy("search_id").agg(F.collect_set("bar").alias(name)), "search_id", "left")
    return _rounds(start, net.arcs, limit, 1, cut(rules))[0].select("search_id", "node", "cost", "parent")


def shortest_paths(arcs: DataFrame, seeds: DataFrame, limit: int, ignore: DataFrame | None = None, forbidden: DataFrame | None = None, cell: int = CELL, cells: DataFrame | None = None) -> DataFrame:
    """One search over arcs (source, target, cost): through the overlay, or round by round where nodes or arcs are barred.

    cells (node, cell) come from place_cells; without them runs of `cell` ids are cells, which suits ids that follow the roads.
    """
    if ignore is None and forbidden is None:
        return search(network(arcs, cells, cell, limit), seeds, limit)
    return search_with_bars(Network(_by_cell(arcs, cells, cell), cells, cell), seeds, limit, ignore, forbidden)
