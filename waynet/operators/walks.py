"""Walks that start and end at entries, as a prefix tree: a table for each step, whose rows point to the walk they prolong.

A row holds the last nodes and a mask of 128 bits of the arcs behind it, of fixed size; whole paths are only made for the walks that are
returned. Whether an arc was used before is asked of the mask, and only where that says it may have been are
the pointers followed back.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waynet.plans.iterate import cut

#: Rows of one step beyond which a search is given up.
MOST_ROWS = 100_000_000
BINS = 50


def walk_tree(arcs: DataFrame, starts: DataFrame, targets: DataFrame | None, limit: int, depth: int = 2, border: DataFrame | None = None, once: bool = True, allowed: Column | None = None, most: int = MOST_ROWS) -> tuple[list[DataFrame], list[DataFrame]]:
    """(steps, ends): tables (id, parent, node, cost) of all walks by number of arcs, and the ids of those that end in targets (node), none of step 0.

    A walk goes on while its cost is below the limit, along arcs (source, target, cost) that `allowed`, a condition on the
    arcs' columns, holds for, to nodes that aren't among its last `depth`. Pruned, with all that prolongs them, are walks whose
    node is farther from the edge of the forest, by border (node, cost), than what the limit leaves, and if `once` walks that could go on
    along an arc they have used. A step of more than `most` rows is an error that says how many there were.
    """
    hops = arcs if allowed is None else arcs.where(allowed)
    hops = cut(hops.groupBy(*(F.col(c).cast("long").alias(c) for c in ("source", "target"))).agg(F.min("cost").cast("long").alias("more")))
    ends_at = None if targets is None else targets.select(F.col("node").cast("long").alias("node")).distinct()
    first = starts.select(F.col("node").cast("long").alias("node")).distinct()
    no_arc = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    front = cut(first.select(F.monotonically_increasing_id().alias("id"), F.lit(None).cast("long").alias("parent"), "node", F.lit(0).cast("long").alias("cost"), F.array("node").alias("tail"), no_arc.alias("mask")))
    steps, ends = [front], []
    while True:
        known = front
        if border is not None:
            left = border.select(F.col("node").cast("long").alias("node"), F.col("cost").alias("to_border"))
            known = front.join(left, "node").where(F.lit(limit) - F.col("cost") >= F.col("to_border"))
        place = F.pmod(F.xxhash64("source", "target"), F.lit(128))
        bits = F.array(*(F.when(F.floor(place / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long")) for k in (0, 1)))
        grown = known.where(F.col("cost") < limit).join(hops, F.col("node") == F.col("source")).where(~F.array_contains("tail", F.col("target"))).withColumn("bits", bits)
        seen = F.exists(F.zip_with("mask", "bits", lambda m, b: m.bitwiseAND(b) != 0), lambda x: x) if once else F.lit(False)
        grown = cut(grown.withColumn("seen", seen))
        doubted = grown.where("seen")
        if once and not doubted.isEmpty():
            bad = cut(_used_before(doubted, steps))
            known, grown = known.join(bad, "id", "left_anti"), grown.join(bad, "id", "left_anti")
        if len(steps) > 1:
            ends.append(cut((known if ends_at is None else known.join(ends_at, "node", "left_semi")).select("id")))
        tail = F.slice(F.concat("tail", F.array("target")), -F.least(F.lit(depth), F.size("tail") + 1), F.least(F.lit(depth), F.size("tail") + 1))
        mask = F.zip_with("mask", "bits", lambda m, b: m.bitwiseOR(b))
        front = cut(grown.select(F.monotonically_increasing_id().alias("new"), F.col("id").alias("parent"), F.col("target").alias("node"), (F.col("cost") + F.col("more")).alias("cost"), tail.alias("tail"), mask.alias("mask")).withColumnRenamed("new", "id"))
        count = front.count()
        if count > most:
            raise RuntimeError(f"{count} walks of {len(steps)} arcs, more than {most}")
        if not count:
            return [s.select("id", "parent", "node", "cost") for s in steps], ends
        steps.append(front)


def _used_before(doubted: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """id: walks of the last step that have used the arc (source, target), by following the pointers back all together."""
    back = doubted.select("id", "source", "target", F.col("node").alias("at"), F.col("parent").alias("before"))
    hits = []
    for step in reversed(steps[:-1]):
        own = step.select(F.col("id").alias("before"), F.col("node").alias("came_from"), F.col("parent").alias("earlier"))
        back = back.join(own, "before")
        hits.append(back.where((F.col("came_from") == F.col("source")) & (F.col("at") == F.col("target"))).select("id"))
        back = back.select("id", "source", "target", F.col("came_from").alias("at"), F.col("earlier").alias("before"))
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out.distinct()


def trace(steps: list[DataFrame], ends: list[DataFrame]) -> DataFrame:
    """path (array of nodes) and cost of the walks that ended, from the last step back, a join a step."""
    open_walks = None
    for k in range(len(steps) - 1, -1, -1):
        own = steps[k]
        if open_walks is not None:
            open_walks = open_walks.join(own.select("id", "parent", "node"), "id").select(F.col("parent").alias("id"), F.concat(F.array("node"), "rest").alias("rest"), "length")
        if 0 < k <= len(ends):
            ended = own.join(ends[k - 1], "id").select(F.col("parent").alias("id"), F.array("node").alias("rest"), F.col("cost").alias("length"))
            open_walks = ended if open_walks is None else cut(open_walks.unionByName(ended))
    if open_walks is None:
        return steps[0].limit(0).select(F.array("node").alias("path"), "cost")
    return open_walks.select(F.col("rest").alias("path"), F.col("length").alias("cost"))


def walkways(arcs: DataFrame, starts: DataFrame, targets: DataFrame | None, limit: int, depth: int = 2, border: DataFrame | None = None, once: bool = True, allowed: Column | None = None, most: int = MOST_ROWS) -> DataFrame:
    """path and cost of all walks from starts to targets: walk_tree, traced."""
    return trace(*walk_tree(arcs, starts, targets, limit, depth, border, once, allowed, most))


def length_bins(walks: DataFrame, bins: int = BINS) -> DataFrame:
    """start, bin, n: how many walks (start, cost) of each start fall in which part of its range of costs, the longest in bin 0.

    Starts of fewer than two walks have no row; where all are as long as each other, they are in bin 0.
    """
    ranges = walks.groupBy("start").agg(F.min("cost").alias("low"), F.max("cost").alias("high"), F.count(F.lit(1)).alias("all")).where(F.col("all") >= 2)
    part = F.when(F.col("high") > F.col("low"), F.floor((F.col("high") - F.col("cost")) * (bins - 1) / (F.col("high") - F.col("low")))).otherwise(0)
    return walks.join(ranges, "start").groupBy("start", part.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
