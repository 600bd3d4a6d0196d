"""Graphs as tables of arcs (source, target, cost, weight): building, searching, contracting."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.functions import speeds
from waynet.functions.geo import euclidean
from waynet.operators.search import shortest_paths as shortest_paths
from waynet.plans.iterate import cut, running_total


def connected_components(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """node and component, its least node; labels spread along arcs and jump to their own label each round."""
    label = cut(nodes.select("node").distinct().withColumn("component", F.col("node")))
    both = arcs.select("source", "target").unionByName(arcs.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    while True:
        near = both.join(label, F.col("target") == F.col("node")).groupBy(F.col("source").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        now = cut(step.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("root", "component")).alias("component")))
        label = now.select("node", "component")
        if now.where("old <> component").isEmpty():
            return label


def largest_component(label: DataFrame) -> DataFrame:
    """The nodes of the largest component; of equal ones the one with the least node."""
    best = label.groupBy("component").count().agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("component"))
    return label.join(best, "component").select("node")


def least_arcs(arcs: DataFrame) -> DataFrame:
    """source, target, cost: of parallel arcs the cheapest."""
    return arcs.groupBy("source", "target").agg(F.min("cost").alias("cost"))


def restrict(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The induced subgraph, its nodes renumbered densely from 0 in order."""
    ids = running_total(nodes.select("node"), ["node"], F.lit(1), "id")
    s, t = (ids.select(F.col("node").alias(c), F.col("id").alias(f"new_{c}")) for c in ("source", "target"))
    return arcs.join(s, "source").join(t, "target").select(F.col("new_source").alias("source"), F.col("new_target").alias("target"), "cost", "weight")


def offsets(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """node and the place of its first arc among arcs sorted by source."""
    counts = nodes.select("node").join(arcs.groupBy(F.col("source").alias("node")).count(), "node", "left")
    return running_total(counts, ["node"], F.coalesce("count", F.lit(0)), "first_arc").select("node", "first_arc")


def polylines_to_segments(vertices: DataFrame) -> DataFrame:
    """fid, first and last point and length of every polyline (fid, pos, x, y)."""
    w = Window.partitionBy("fid").orderBy("pos")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) * (F.col("x") - F.lag("x").over(w)) + (F.col("y") - F.lag("y").over(w)) * (F.col("y") - F.lag("y").over(w)))
    point, at = F.struct("x", "y"), F.col("pos")
    out = vertices.withColumn("step", step).groupBy("fid").agg(F.min_by(point, at).alias("a"), F.max_by(point, at).alias("b"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))
    return out.select("fid", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), "length")


def road_segments(vertices: DataFrame, most: float, way_class: str | None = None, weight: str | None = None) -> DataFrame:
    """fid, ends, length, cost in seconds and weight of roads (fid, pos, x, y in metres, and columns of class and weight), up to a speed in km/h.

    Class and weight are those of the last vertex; without a class all are pedestrian areas, without a weight it is -1.
    Walkers (speeds.WALKING_SPEED) leave out large roads.
    """
    last = lambda c, default: F.lit(default) if c is None else F.max_by(c, "pos")
    told = vertices.groupBy("fid").agg(last(way_class, speeds.PEDESTRIAN_AREA).alias("way_class"), last(weight, -1).alias("weight"))
    used = polylines_to_segments(vertices).join(told, "fid").where(speeds.is_walked(F.col("way_class"), most))
    cost = F.col("length") / (speeds.class_speed(F.col("way_class"), F.lit(most)) / 3.6)
    return used.select("fid", "x0", "y0", "x1", "y1", "length", cost.alias("cost"), "weight")


def counter_arcs(arcs: DataFrame) -> DataFrame:
    """Each arc a->b with the arc of the same rank of b->a; an error where they aren't as many."""
    ranked = arcs.withColumn("rank", F.row_number().over(Window.partitionBy("source", "target").orderBy("cost", "weight")))
    back = ranked.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("cost").alias("back_cost"), "rank")
    missing = F.raise_error(F.concat(F.lit("no counter arc for "), F.col("source").cast("string"), F.lit("->"), F.col("target").cast("string"))).cast(ranked.schema["cost"].dataType)
    return ranked.join(back, ["source", "target", "rank"], "left").select("source", "target", "rank", "cost", F.when(F.col("back_cost").isNull(), missing).otherwise(F.col("back_cost")).alias("back_cost"))


def _runs(rows: DataFrame, *kept: str) -> DataFrame:
    """rows (pos, fid, x, y and more) with `at`, their place by pos, `run`, their run of equal fids, and fid, x, y and what is kept of the row `before`; `new` is 1 for a run's first."""
    placed = running_total(rows.withColumn("before", F.struct("fid", "x", "y", *kept)), ["pos"], F.lit(1), "at", "before")
    change = placed.withColumn("new", (~F.col("fid").eqNullSafe(F.col("before.fid")) | (F.col("at") == 0)).cast("long"))
    return running_total(change, ["pos"], F.col("new"), "earlier").withColumn("run", F.col("earlier") + F.col("new"))


def _met_points(lines: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points a and b of lines as nodes (a, node), numbered from 0 by first appearance, a line's a before its b; (a, source) and (b, target) of these."""
    ends = lines.select("a", (2 * F.col(order)).alias("seen")).unionByName(lines.select(F.col("b").alias("a"), (2 * F.col(order) + 1).alias("seen")))
    nodes = cut(running_total(ends.groupBy("a").agg(F.min("seen").alias("seen")), ["seen"], F.lit(1), "node"))
    s, t = (nodes.select(F.col("a").alias(c), F.col("node").alias(n)) for c, n in (("a", "source"), ("b", "target")))
    return nodes, s, t


def _step() -> Column:
    """The distance from the row before in its run."""
    return F.when(F.col("new") == 0, euclidean(F.col("x"), F.col("y"), F.col("before.x"), F.col("before.y")))


def vertex_graph(rows: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """nodes (node, x, y) and arcs (source, target, fid, way_class, cost in seconds) of polylines (pos, fid, x, y in metres, way_class).

    Each pair of rows by pos with equal fids gives both arcs, once for each fid, class and length; a class unknown to
    `speeds.CLASS_SPEEDS` is an error, `most` the highest speed in km/h. Points with equal coordinates are one node,
    numbered from 0 by first appearance; a row without a neighbour of its fid gives none. `least_arcs` leaves one arc between two nodes.
    """
    runs = _runs(rows.select("pos", "fid", "x", "y", "way_class"), "way_class")
    pairs = cut(runs.where("new = 0").select("at", "fid", "before.way_class", F.struct("before.x", "before.y").alias("a"), F.struct("x", "y").alias("b"), _step().alias("metres")))
    nodes, s, t = _met_points(pairs, "at")
    there = pairs.join(s, "a").join(t, "b").select("source", "target", "fid", "way_class", "metres")
    both = there.unionByName(there.select(F.col("target").alias("source"), F.col("source").alias("target"), "fid", "way_class", "metres")).distinct()
    cost = F.col("metres") / (speeds.class_speed(F.col("way_class"), F.lit(most)) / 3.6)
    return nodes.select("node", "a.x", "a.y"), both.select("source", "target", "fid", "way_class", cost.alias("cost"))


def feature_graph(rows: DataFrame, most: float, way_class: str | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (node, x, y) and arcs (source, target, fid, cost in seconds, weight) of polylines (pos, fid, x, y in metres, and columns of class and weight).

    A run of equal fids by pos is a line from its first to its last point, with the class and weight of its last row, as in
    `road_segments`; walkers leave out rows of large roads, so runs beside these may meet. Every line gives both arcs.
    """
    named = rows.select("pos", "fid", "x", "y", (F.lit(speeds.PEDESTRIAN_AREA) if way_class is None else F.col(way_class)).alias("way_class"), (F.lit(-1) if weight is None else F.col(weight)).alias("weight"))
    runs = _runs(named.where(F.col("way_class").isNull() | speeds.is_walked(F.col("way_class"), most)))
    point, last = F.struct("x", "y"), lambda c: F.max_by(c, "at").alias(c)
    lines = cut(runs.groupBy("run").agg(F.min_by(point, "at").alias("a"), F.max_by(point, "at").alias("b"), F.coalesce(F.sum(_step()), F.lit(0.0)).alias("metres"), last("fid"), last("way_class"), last("weight")))
    nodes, s, t = _met_points(lines, "run")
    cost = F.col("metres") / (speeds.class_speed(F.col("way_class"), F.lit(most)) / 3.6)
    there = lines.join(s, "a").join(t, "b").select("source", "target", "fid", cost.alias("cost"), "weight")
    return nodes.select("node", "a.x", "a.y"), there.unionByName(there.select(F.col("target").alias("source"), F.col("source").alias("target"), "fid", "cost", "weight"))


def polylines_to_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node, x, y) and arcs (arc_id, source, target, cost, weight, fid) of polylines (pos, fid, x, y, cost, weight).

    A run of equal fids by pos is a line from its first to its last point; points with equal single-precision
    coordinates are one node, numbered from 0 by first appearance; every line gives both arcs, with cost and weight of its
    last row. Arcs are numbered from 0 by source, then by the order of the lines.
    """
    float32 = [F.col(c).cast("float").alias(c) for c in ("x", "y")]
    runs = _runs(rows.select("pos", "fid", *float32, "cost", "weight"))
    point = F.struct("x", "y")
    lines = cut(runs.groupBy("run").agg(F.first("fid").alias("fid"), F.min_by(point, "pos").alias("a"), F.max_by(point, "pos").alias("b"), F.max_by("cost", "pos").alias("cost"), F.max_by("weight", "pos").alias("weight")))
    nodes, s, t = _met_points(lines, "run")
    there = lines.join(s, "a").join(t, "b").select("source", "target", F.col("cost").cast("int").alias("cost"), F.col("weight").cast("int").alias("weight"), "fid", (2 * F.col("run")).alias("place"))
    both = there.unionByName(there.select(F.col("target").alias("source"), F.col("source").alias("target"), "cost", "weight", "fid", (F.col("place") + 1).alias("place")))
    arcs = running_total(both, ["source", "target", "place"], F.lit(1), "arc_id").select("arc_id", "source", "target", "cost", "weight", "fid")
    return nodes.select("node", "a.x", "a.y"), arcs


def way_arcs(ways: DataFrame, nodes: DataFrame, speed: Column) -> DataFrame:
    """source, target, metres, seconds of both arcs between the consecutive nodes of ways (way_id, nds, ...); speed in km/h may use the ways' columns.

    Nodes that aren't in nodes (node_id, lat, lon) part their way.
    """
    from waynet.functions.geo import great_circle

    pairs = ways.withColumn("speed", speed).select("way_id", "speed", F.posexplode(F.arrays_zip(F.slice("nds", F.lit(1), F.greatest(F.size("nds") - 1, F.lit(0))).alias("a"), F.slice("nds", F.lit(2), F.greatest(F.size("nds") - 1, F.lit(0))).alias("b"))).alias("pos", "p"))
    pairs = pairs.select("way_id", "pos", "speed", F.col("p").getField("a").alias("source"), F.col("p").getField("b").alias("target"))
    a, b = (nodes.select(F.col("node_id").alias(c), F.col("lat").alias(f"{c}_lat"), F.col("lon").alias(f"{c}_lon")) for c in ("source", "target"))
    found = pairs.join(a, "source").join(b, "target")
    metres = great_circle(F.col("source_lat"), F.col("source_lon"), F.col("target_lat"), F.col("target_lon"))
    there = found.select("way_id", "pos", "source", "target", metres.alias("metres"), (metres / (F.col("speed") / 3.6)).alias("seconds"))
    return there.unionByName(there.select("way_id", "pos", F.col("target").alias("source"), F.col("source").alias("target"), "metres", "seconds"))


def filter_components(label: DataFrame, least: int) -> DataFrame:
    """node, component and kept: whether the component has at least that many nodes."""
    sizes = label.groupBy("component").agg((F.count(F.lit(1)) >= least).alias("kept"))
    return label.join(sizes, "component").select("node", "component", "kept")


def remove_nodes(nodes: DataFrame, arcs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and arcs without the nodes of `gone` and the arcs that touch them."""
    s, t = gone.select(F.col("node").alias("source")), gone.select(F.col("node").alias("target"))
    return nodes.join(gone.select("node"), "node", "left_anti"), arcs.join(s, "source", "left_anti").join(t, "target", "left_anti")


def cheap_nodes(arcs: DataFrame, most: int) -> DataFrame:
    """node: those whose arcs, in and out, all cost at most so much, and which a threshold contraction takes out."""
    ends = arcs.select(F.col("source").alias("node"), "cost").unionByName(arcs.select(F.col("target").alias("node"), "cost"))
    return ends.groupBy("node").agg(F.max("cost").alias("c")).where(F.col("c") <= most).select("node")


def contract_chains(nodes: DataFrame, arcs: DataFrame, protected: Column) -> DataFrame:
    """Arcs (source, target, cost, weight, represented) after nodes with exactly two arcs are taken out.

    Costs add up along each direction, weights keep the most; represented are the ids of the arcs (arc_id) that an arc
    stands for, in order. Chains are components of such nodes. A chain whose ends hang on one outside node keeps its last
    node, a free cycle its last two. Needs arcs both ways.
    """
    if "arc_id" not in arcs.columns:
        arcs = running_total(arcs, ["source", "target", "cost", "weight"], F.lit(1), "arc_id")
    arcs = cut(arcs.select(*(F.col(c).cast("long") for c in ("arc_id", "source", "target", "cost")), "weight"))
    degree = arcs.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    inner = cut(nodes.select(F.col("node").cast("long")).where(~protected).join(degree.where("d = 2"), "node").select("node"))
    s, t = inner.select(F.col("node").alias("source")), inner.select(F.col("node").alias("target"))
    label = connected_components(inner, arcs.join(s, "source", "left_semi").join(t, "target", "left_semi"))
    tails = arcs.join(label.select(F.col("node").alias("source"), "component"), "source").join(t, "target", "left_anti")
    ends = tails.groupBy("component").agg(F.countDistinct("target").alias("outside"))
    last = label.groupBy("component").agg(F.max("node").alias("last"))
    second = label.join(last, "component").where("node < last").groupBy("component").agg(F.max("node").alias("second"))
    ranked = label.join(ends, "component", "left").join(last, "component").join(second, "component", "left")
    gone = F.when(F.col("outside").isNull(), (F.col("node") != F.col("last")) & (F.col("node") != F.coalesce("second", "last"))).when(F.col("outside") == 1, F.col("node") != F.col("last")).otherwise(True)
    gone = cut(ranked.where(gone).select("node"))
    s, t = gone.select(F.col("node").alias("source"), F.lit(True).alias("from_gone")), gone.select(F.col("node").alias("target"), F.lit(True).alias("to_gone"))
    marked = cut(arcs.join(s, "source", "left").join(t, "target", "left"))

    # Every arc out of a node that goes has one arc before it: the node's other neighbour's. Pointers to it double.
    before = marked.where("to_gone").select(F.col("target").alias("source"), F.col("source").alias("came_from"), F.col("arc_id").alias("pointer"))
    out = marked.where("from_gone").join(before, "source").where("came_from <> target").select("arc_id", "pointer", F.lit(1).cast("long").alias("place"))
    first = marked.where("from_gone IS NULL AND to_gone").select("arc_id", F.col("arc_id").alias("pointer"), F.lit(0).cast("long").alias("place"))
    found, open_rows = first, cut(out)
    not_first = open_rows.select(F.col("arc_id").alias("next"), F.lit(True).alias("goes_on"))
    while not open_rows.isEmpty():
        known = found.unionByName(open_rows).select(F.col("arc_id").alias("pointer"), F.col("pointer").alias("next"), F.col("place").alias("more"))
        jumped = open_rows.join(known, "pointer").select("arc_id", "next", (F.col("place") + F.col("more")).alias("place"))
        jumped = cut(jumped.join(not_first, "next", "left").select("arc_id", F.col("next").alias("pointer"), "place", "goes_on"))
        found = cut(found.unionByName(jumped.where("goes_on IS NULL").drop("goes_on")))
        open_rows = jumped.where("goes_on").drop("goes_on")
    chain = found.join(marked, "arc_id")
    end = F.max_by(F.struct("source", "target"), "place")
    step = F.sort_array(F.collect_list(F.struct("place", "arc_id")))
    new = chain.groupBy("pointer").agg(F.min_by("source", "place").alias("source"), end["target"].alias("target"), F.sum("cost").alias("cost"), F.max("weight").alias("weight"), F.transform(step, lambda x: x["arc_id"]).alias("represented"))
    kept = marked.where("from_gone IS NULL AND to_gone IS NULL").select("source", "target", "cost", "weight", F.array("arc_id").alias("represented"))
    return kept.unionByName(new.select("source", "target", "cost", "weight", "represented"))


def undo_contraction(contracted: DataFrame, arcs: DataFrame) -> DataFrame:
    """The arcs (arc_id, source, target, cost, weight) that contracted ones represent."""
    return contracted.select(F.explode("represented").alias("arc_id")).distinct().join(arcs, "arc_id")


def walkways(arcs: DataFrame, starts: DataFrame, targets: DataFrame, limit: int, depth: int) -> DataFrame:
    """path and cost of walks from all starts that end in targets: no node repeats among the last `depth`; steps go on while the cost is below the limit."""
    front = cut(starts.select(F.array(F.col("node").cast("long")).alias("path"), F.lit(0).cast("long").alias("cost")))
    done = front.limit(0)
    while not front.isEmpty():
        front = cut(_grow(front, arcs, limit, depth))
        ends = front.join(targets.select(F.col("node").alias("end")), F.element_at("path", -1) == F.col("end"), "left_semi")
        done = done.unionByName(ends)
    return done


def _grow(front: DataFrame, arcs: DataFrame, limit: int, depth: int) -> DataFrame:
    hops = arcs.select("source", F.col("target").cast("long").alias("target"), F.col("cost").alias("arc_cost"))
    last = F.slice("path", F.greatest(F.size("path") - depth + 1, F.lit(1)), F.lit(depth))
    grown = front.where(F.col("cost") < limit).join(hops, F.element_at("path", -1) == F.col("source")).where(~F.array_contains(last, F.col("target")))
    return grown.select(F.concat("path", F.array("target")).alias("path"), (F.col("cost") + F.col("arc_cost")).alias("cost"))
