"""Spatial joins: nearest node, top X within a radius, points in polygons, grids of points, hulls."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.operators.quadtree import nearest_nodes
from waynet.operators.tiles import in_tile, on_tiles, points_in_tiles, polygon_tiles
from waynet.plans.iterate import cut


#: Steps of a grid that a tile of its polygons is wide.
TILE_STEPS = 4
#: Ways of a relation that are put in order in one group; the ends of more ways are ranked, those of up to RANK_WAYS ways in one group, without their nodes.
GROUP_WAYS, RANK_WAYS = 4096, 1 << 17


def _cells(points: DataFrame, size: float, ring: int) -> DataFrame:
    around = F.sequence(F.lit(-ring), F.lit(ring))
    cx, cy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    return points.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumns({"cx": cx + F.col("dx"), "cy": cy + F.col("dy")}).drop("dx", "dy")


def within_radius(points: DataFrame, nodes: DataFrame, radius: float, most: int | None = None) -> DataFrame:
    """id, node_id, d2, rank: nodes within the radius (inclusive) of each point, the nearest first, ties by node_id; the first `most` of them.

    The first few come down a quadtree; without `most` all pairs within the radius meet in cells of that size.
    """
    if most is not None:
        return nearest_nodes(points.select("id", "x", "y"), nodes.select("node_id", "x", "y"), most, radius).select("id", "node_id", "d2", "rank")
    near = _cells(points, radius, 1).join(_cells(nodes.select("node_id", F.col("x"), F.col("y")), radius, 0).withColumnsRenamed({"x": "nx", "y": "ny"}), ["cx", "cy"])
    d2 = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    found = near.withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "node_id"))).select("id", "node_id", "d2", "rank")


def nearest(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, node_id, d2 of the nearest node of every point; both null for a point without coordinates, or without any node."""
    found = nearest_nodes(points.select("id", "x", "y"), nodes.select("node_id", "x", "y")).select("id", "node_id", "d2")
    return points.select("id").join(found, "id", "left").select("id", "node_id", "d2")


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """id, poly_id of points (id, x, y) inside polygons (poly_id, ring array of x, y), by tiles of that size; see `tiles`.

    Points are tested once against all polygons of equal rings, which get one set of tiles.
    """
    shapes = cut(polygons.groupBy("ring").agg(F.collect_list(F.struct("poly_id")).alias("own")).withColumn("shape", F.monotonically_increasing_id()))
    found = points_in_tiles(points, cut(polygon_tiles(shapes.select(F.col("shape").alias("poly_id"), "ring"), size)), size)
    return found.withColumnRenamed("poly_id", "shape").join(shapes.select("shape", F.explode("own").alias("own")), "shape").select("id", "own.poly_id")


def last_polygon(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """id and poly_id of the last polygon, by id, that holds a point; points in none have no row."""
    return points_in_polygons(points, polygons, size).groupBy("id").agg(F.max("poly_id").alias("poly_id"))


def population_grid(polygons: DataFrame, step: float | None = None, resolution: int | None = None, without: DataFrame | None = None) -> DataFrame:
    """poly_id, x, y, population: regular points inside each polygon (poly_id, inhabitants, ring), sharing its inhabitants evenly.

    Points start one step in from the box and end before it does. Either the step is given, or the resolution, the number of
    points on each side. Points in polygons of `without` go. A polygon without any point keeps the corner of its box.
    """
    if (step is None) == (resolution is None):
        raise ValueError("either step or resolution")
    size = TILE_STEPS * (step or 1.0)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = polygons.select("poly_id", "inhabitants", *(f(v).alias(n) for n, f, v in (("x0", F.array_min, xs), ("x1", F.array_max, xs), ("y0", F.array_min, ys), ("y1", F.array_max, ys))))
    for axis in ("x", "y"):
        extent = F.col(f"{axis}1") - F.col(f"{axis}0")
        own = F.lit(step) if resolution is None else extent / (resolution + 1)
        count = F.ceil(extent / own).cast("int") - 1 if resolution is None else F.lit(resolution)
        boxed = boxed.withColumn(f"s{axis}", own).withColumn(f"n{axis}", F.greatest(count, F.lit(0)))
    span = lambda n: F.filter(F.sequence(F.lit(0), F.col(n)), lambda k: k > 0)
    grid = boxed.withColumn("i", F.explode(span("nx"))).withColumn("j", F.explode(span("ny")))
    grid = grid.select("poly_id", (F.col("x0") + F.col("i") * F.col("sx")).alias("x"), (F.col("y0") + F.col("j") * F.col("sy")).alias("y"))
    own = cut(polygon_tiles(polygons, size))
    placed = on_tiles(grid.join(own.select("poly_id", "level").distinct(), "poly_id"), size, F.col("level"))
    grid = placed.join(own.hint("merge"), ["poly_id", "level", "cx", "cy"]).where(in_tile(F.col("x"), F.col("y"))).select("poly_id", "x", "y")
    if without is not None:
        named = grid.withColumn("id", F.struct("poly_id", "x", "y"))
        inside = points_in_polygons(named.select("id", "x", "y"), without, size)
        grid = named.join(inside.select("id").distinct(), "id", "left_anti").drop("id")
    empty = boxed.join(grid.select("poly_id").distinct(), "poly_id", "left_anti").select("poly_id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    grid = grid.select("poly_id", "x", "y").unionByName(empty)
    counts = grid.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, "poly_id").join(polygons.select("poly_id", "inhabitants"), "poly_id").select("poly_id", "x", "y", (F.col("inhabitants") / F.col("n")).alias("population"))


def convex_hulls(points: DataFrame) -> DataFrame:
    """key, n, x, y: corners of each key's hull in counter-clockwise order. Each cell's hull is taken before the key's."""

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        own = sorted(set(zip(pdf["x"], pdf["y"])))

        def chain(seq):
            out = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out

        corners = own if len(own) < 3 else chain(own)[:-1] + chain(own[::-1])[:-1]
        return pd.DataFrame([(pdf["key"].iloc[0], i, *c) for i, c in enumerate(corners)], columns=["key", "n", "x", "y"])

    ddl = "key long, n long, x double, y double"
    salted = points.select("key", "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(64)).alias("salt"))
    return salted.groupBy("key", "salt").applyInPandas(lambda p: hull(p), ddl).groupBy("key").applyInPandas(lambda p: hull(p), ddl)


def order_ways(members: DataFrame, ways: DataFrame) -> DataFrame:
    """relation_id, pos and nds of the ways of relations (relation_id, pos, way_id), in the order and direction in which their ends meet.

    A way follows that begins or, turned round, ends where the last one ended; of several the first by pos. Where none does the
    next by pos starts anew, and missing ways leave a row with null nds at the end. A pos names one member of its relation.
    """
    joined = _members(members, ways)
    missing = joined.where("nds IS NULL OR size(nds) = 0").select("relation_id", F.lit(None).cast("long").alias("start"), "pos", F.lit(None).cast("array<long>").alias("nds"))
    rows = _chains(joined).select("relation_id", "start", F.col("rank").alias("pos"), "nds").unionByName(missing)
    at = F.row_number().over(Window.partitionBy("relation_id").orderBy(F.col("start").asc_nulls_last(), "pos")) - 1
    return rows.select("relation_id", at.cast("long").alias("pos"), "nds")


def _members(members: DataFrame, ways: DataFrame) -> DataFrame:
    return cut(members.join(ways.select("way_id", "nds"), "way_id", "left").select("relation_id", F.col("pos").cast("long").alias("pos"), "nds"))


def _chains(joined: DataFrame) -> DataFrame:
    """relation_id, start, rank, nds: each way in its chain, named by the pos of the chain's first way; turned where need be.

    Relations of up to GROUP_WAYS ways are worked a group each. In larger ones the ways' ends are ranked, see `_ranked`, and
    only ways at forks, and open lines whose first way by pos lies within, are left to a group. The ends of up to RANK_WAYS ways
    are ranked in a group, which holds three numbers a way; those of more ways in rounds over all of them.
    """
    known = joined.where("size(nds) > 0")
    ends = [F.element_at("nds", i).isNull() for i in (1, -1)]
    large = known.groupBy("relation_id").agg(F.count(F.lit(1)).alias("n"), F.max(ends[0] | ends[1]).alias("unknown")).where((F.col("n") > GROUP_WAYS) & F.col("relation_id").isNotNull())
    large = cut(large.withColumn("by_group", (F.col("n") <= RANK_WAYS) & ~F.col("unknown")))
    most = {r["by_group"]: r["n"] for r in large.groupBy("by_group").agg(F.max("n").alias("n")).collect()}
    small, done = known.join(large, "relation_id", "left_anti"), []
    for by_group, n in most.items():
        own = known.join(large.where(F.col("by_group") == by_group), "relation_id", "left_semi")
        ranked, rest = _ordered(own, _chosen_in_groups(own)) if by_group else _ranked(own, n)
        small, done = small.unionByName(rest), [*done, ranked]
    out = _grouped(small)
    for ranked in done:
        out = out.unionByName(ranked)
    return out


def _grouped(known: DataFrame) -> DataFrame:
    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("pos")
        left, places = [list(n) for n in own["nds"]], list(own["pos"])
        by_end: dict[int, list[int]] = {}
        for k, nds in enumerate(left):
            for end in {nds[0], nds[-1]}:
                by_end.setdefault(end, []).append(k)
        used, out = set(), []
        for first in range(len(left)):
            if first in used:
                continue
            used.add(first)
            nds = left[first]
            if any(k not in used for k in by_end[nds[0]]) and not any(k not in used for k in by_end[nds[-1]]):
                nds = nds[::-1]
            rank = 0
            out.append((places[first], rank, nds))
            while follows := [k for k in by_end[nds[-1]] if k not in used]:
                used.add(follows[0])
                own_nds, rank = left[follows[0]], rank + 1
                nds = own_nds if own_nds[0] == nds[-1] else own_nds[::-1]
                out.append((places[first], rank, nds))
        return pd.DataFrame({"relation_id": pdf["relation_id"].iloc[0], "start": [o[0] for o in out], "rank": [o[1] for o in out], "nds": [o[2] for o in out]})

    kind = known.schema["relation_id"].dataType.simpleString()
    return known.groupBy("relation_id").applyInPandas(chain, f"relation_id {kind}, start long, rank long, nds array<long>")


def _ranked(known: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Chains of the rings, and of the open lines that begin with their first way by pos; the ways that are in neither.

    Each way is an item in both directions. Where just two ways meet, an item is followed by the other way's. By doubling its
    reach, an item learns the end of its line and the least pos on the way there, in as many rounds as `most` has bits.
    Items whose reach never ends go round.
    """
    both = F.array(*(F.struct(F.lit(d).alias("dir"), F.element_at("nds", i).alias("enters"), F.element_at("nds", -i).alias("leaves")) for d, i in ((0, 1), (1, -1))))
    items = known.select("relation_id", "pos", F.explode(both).alias("i")).select("relation_id", "pos", "i.*")
    end = F.struct("pos", "dir")
    nodes = items.groupBy("relation_id", F.col("enters").alias("leaves")).agg(F.count(F.lit(1)).alias("n"), F.min(end).alias("a"), F.max(end).alias("b"))
    linked = (F.col("n") == 2) & (F.col("a.pos") != F.col("b.pos"))
    other = F.when(F.col("a.pos") == F.col("pos"), F.col("b")).otherwise(F.col("a"))
    least = lambda where, steps: F.struct(F.col(f"{where}.pos").alias("pos"), F.col(f"{where}.dir").alias("dir"), (F.col(f"{where}.steps") + steps).alias("steps"))
    state = items.join(nodes, ["relation_id", "leaves"]).select("relation_id", "pos", "dir", F.when(linked, other).otherwise(end).alias("to"), linked.cast("long").alias("steps"), (F.col("n") > 2).alias("fork"), F.struct("pos", "dir", F.lit(0).cast("long").alias("steps")).alias("best"))
    rounds = most.bit_length()
    for _ in range(rounds):
        far = state.select("relation_id", F.struct("pos", "dir").alias("to"), F.col("to").alias("far_to"), F.col("steps").alias("far_steps"), F.col("fork").alias("far_fork"), F.col("best").alias("far"))
        met = state.join(far, ["relation_id", "to"])
        best = F.least(least("best", F.lit(0)), least("far", F.col("steps")))
        state = cut(met.select("relation_id", "pos", "dir", F.col("far_to").alias("to"), (F.col("steps") + F.col("far_steps")).alias("steps"), (F.col("fork") | F.col("far_fork")).alias("fork"), best.alias("best")))
    turned = state.select("relation_id", "pos", (1 - F.col("dir")).alias("dir"), F.col("to.pos").alias("start"), F.col("steps").alias("back"), F.col("fork").alias("fork_behind"), F.col("best.pos").alias("least_behind"))
    seen = state.join(turned, ["relation_id", "pos", "dir"])
    round_trip = F.lit(2**rounds)
    ring = (F.col("steps") == round_trip) & (F.col("best.dir") == 0)
    line = (F.col("steps") < round_trip) & ~F.col("fork") & ~F.col("fork_behind") & (F.least("best.pos", "least_behind") == F.col("start")) & ((F.col("steps") + F.col("back") > 0) | (F.col("dir") == 0))
    rank = F.when(~ring, F.col("back")).when(F.col("best.steps") == 0, -round_trip).otherwise(-F.col("best.steps"))
    chosen = cut(seen.where(ring | line).select("relation_id", "pos", "dir", F.when(ring, F.col("best.pos")).otherwise(F.col("start")).alias("start"), rank.alias("rank")))
    return _ordered(known, chosen)


def _ordered(known: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen ways (relation_id, pos, dir, start, rank) in their direction, and the others."""
    both = cut(known.join(chosen, ["relation_id", "pos"], "left"))
    nds = F.when(F.col("dir") == 1, F.reverse("nds")).otherwise(F.col("nds"))
    return both.where("dir IS NOT NULL").select("relation_id", "start", "rank", nds.alias("nds")), both.where("dir IS NULL").select("relation_id", "pos", "nds")


def _chosen_in_groups(known: DataFrame) -> DataFrame:
    """The ways that `_ranked` chooses, with their ranks, by the same doubling over a relation's ends in one group."""

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("pos")
        pos, n = own["pos"].to_numpy(), len(own)
        # Item 2 * way + dir, so items are in the order of pos and dir; an item's other direction differs in the last bit.
        enters = own[["first", "last"]].to_numpy().reshape(-1)
        item = np.arange(2 * n)
        order = np.argsort(enters, kind="stable")
        _, first, node, count = np.unique(enters[order], return_index=True, return_inverse=True, return_counts=True)
        at = np.empty(2 * n, np.int64)
        at[order] = node
        leaves = at[item ^ 1]
        a, b, met = order[first][leaves], order[first + count - 1][leaves], count[leaves]
        linked = (met == 2) & (a // 2 != b // 2)
        to = np.where(linked, np.where(a // 2 == item // 2, b, a), item)
        steps, fork, best, ahead = linked.astype(np.int64), met > 2, item, np.zeros(2 * n, np.int64)
        rounds = n.bit_length()
        for _ in range(rounds):
            far, after = best[to], steps + ahead[to]
            nearer = (far < best) | ((far == best) & (after < ahead))
            best, ahead = np.where(nearer, far, best), np.where(nearer, after, ahead)
            fork, steps, to = fork | fork[to], steps + steps[to], to[to]
        round_trip, back, start = 1 << rounds, steps[item ^ 1], to[item ^ 1]
        ring = (steps == round_trip) & (best % 2 == 0)
        least = np.minimum(best, best[item ^ 1]) // 2
        line = (steps < round_trip) & ~fork & ~fork[item ^ 1] & (least == start // 2) & ((steps + back > 0) | (item % 2 == 0))
        rank = np.where(~ring, back, np.where(ahead == 0, -round_trip, -ahead))
        kept = np.flatnonzero(ring | line)
        begins = np.where(ring, best, start) // 2
        return pd.DataFrame({"relation_id": pdf["relation_id"].iloc[0], "pos": pos[kept // 2], "dir": kept % 2, "start": pos[begins[kept]], "rank": rank[kept]})

    kind = known.schema["relation_id"].dataType.simpleString()
    ends = known.select("relation_id", "pos", F.element_at("nds", 1).alias("first"), F.element_at("nds", -1).alias("last"))
    return ends.groupBy("relation_id").applyInPandas(chosen, f"relation_id {kind}, pos long, dir int, start long, rank long")


def relation_polygons(members: DataFrame, ways: DataFrame) -> DataFrame:
    """relation_id, polygon (from 0) and nds: the nodes of a relation's ways (relation_id, pos, way_id) in the given order.

    A way that is missing or doesn't start where the last one ended starts a new polygon; those of up to two nodes go.
    """
    return _polygons(members.join(ways.where(F.size("nds") > 0), "way_id", "left"))


def assembled_polygons(members: DataFrame, ways: DataFrame) -> DataFrame:
    """relation_polygons of ways that are first put in the order and direction in which their ends meet: each chain is one."""
    return _numbered(_chains(_members(members, ways)), "start", "rank")


def _polygons(known: DataFrame) -> DataFrame:
    w = Window.partitionBy("relation_id").orderBy("pos")
    ends = known.withColumns({"before": F.lag(F.element_at("nds", -1)).over(w), "first": F.get("nds", F.lit(0))}).where("nds IS NOT NULL")
    starts = F.when(F.col("first") == F.col("before"), 0).otherwise(1)
    parts = ends.withColumn("part", F.sum(starts).over(w))
    return _numbered(parts, "part", "pos")


def _numbered(parts: DataFrame, part: str, pos: str) -> DataFrame:
    nds = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(pos, "nds"))), lambda p: p["nds"]))
    rings = parts.groupBy("relation_id", F.col(part).alias("part")).agg(nds.alias("nds")).where(F.size("nds") > 2)
    number = F.row_number().over(Window.partitionBy("relation_id").orderBy("part")) - 1
    return rings.select("relation_id", number.alias("polygon"), "nds")
