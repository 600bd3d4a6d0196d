"""Contracting chosen nodes of a graph, undoing it, and clusters of close nodes.

An arc between two nodes that stay stands for the least way between them that passes contracted nodes only, so distances
between the nodes that stay don't change, whatever the order. Nodes go in rounds: in each, those that come before all chosen
nodes beside them, by the number of shortcuts they need and a hash, which leaves no two neighbours in a round. A shortcut
names its two parts, which are older, so it is a tree as deep as there were rounds. Nodes inside of clusters only have arcs to nodes of
their own cluster, so the rounds of each cluster go in a group, many clusters in one; only clusters of very many such nodes take rounds over tables.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waynet.functions.geo import EARTH_RADIUS
from waynet.operators.graph import connected_components
from waynet.plans.iterate import cut

_ID = "struct<round:int,source:bigint,target:bigint>"
#: Fixed values, in metres: arcs shorter than this merge clusters whose centroids are closer than that.
INTRA_CLUSTER, INTER_CLUSTER = 15.0, 50.0
#: Nodes of the components that one group merges.
PACK_NODES = 4096


def _arc_id(made: Column) -> Column:
    return F.struct(made.cast("int").alias("round"), F.col("source"), F.col("target"))


def contract_nodes(arcs: DataFrame, chosen: DataFrame, most_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """(contracted, shortcuts): arcs without the chosen nodes (node), and what each shortcut was made of.

    contracted is (id, source, target, cost, parts), parts the number of arcs it stands for; of parallel arcs the cheapest counts, and arcs
    from a node to itself go. shortcuts is (id, first, second, first_parts). An arc of the given graph has the round 0 in
    its id. More than most_rounds rounds are an error.
    """
    least = arcs.where("source <> target").groupBy(*(F.col(c).cast("long").alias(c) for c in ("source", "target"))).agg(F.min("cost").alias("cost"))
    nothing = F.lit(None).cast(_ID)
    given = least.select("source", "target", "cost", F.lit(0).alias("new"), F.lit(1).cast("long").alias("parts"), nothing.alias("first"), nothing.alias("second"), _arc_id(F.lit(0)).alias("id"), F.lit(0).cast("long").alias("first_parts"))
    left = cut(chosen.select(F.col("node").cast("long").alias("node")).distinct())
    every, made = cut(_beside(given, left)), 0
    # Arcs between nodes that stay take no part in the rounds; parallel ones meet at the end, where the older of equal costs stays.
    own, fixed = every.where("live"), every.where("NOT live")
    shortcuts = every.limit(0).select("id", "first", "second", "first_parts")
    while not left.isEmpty():
        made += 1
        if made > most_rounds:
            raise RuntimeError(f"nodes are left after {most_rounds} rounds")
        gone = cut(_apart(own, left, made))
        out = gone.select(F.col("node").alias("source")).join(own, "source").select(F.col("source").alias("via"), F.col("target").alias("b"), F.col("id").alias("second"), F.col("cost").alias("cost_b"), F.col("parts").alias("parts_b"))
        into = gone.select(F.col("node").alias("target")).join(own, "target").select(F.col("target").alias("via"), F.col("source").alias("a"), F.col("id").alias("first"), F.col("cost").alias("cost_a"), F.col("parts").alias("parts_a"))
        ways = into.join(out, "via").where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target"), (F.col("cost_a") + F.col("cost_b")).alias("cost"), "first", "second", F.col("parts_a").alias("first_parts"), (F.col("parts_a") + F.col("parts_b")).alias("parts"))
        stays = own.join(gone.select(F.col("node").alias("source")), "source", "left_anti").join(gone.select(F.col("node").alias("target")), "target", "left_anti")
        every = stays.select("source", "target", "cost", F.lit(0).alias("new"), "parts", "id", nothing.alias("first"), nothing.alias("second"), F.lit(0).cast("long").alias("first_parts"))
        every = every.unionByName(ways.withColumns({"new": F.lit(1), "id": _arc_id(F.lit(made))}))
        best = every.groupBy("source", "target").agg(F.min(F.struct("cost", "new", "parts", "first", "second", "id", "first_parts")).alias("b")).select("source", "target", "b.*")
        left = cut(left.join(gone, "node", "left_anti"))
        every = cut(_beside(best, left))
        shortcuts = shortcuts.unionByName(every.where("live AND new = 1").select("id", "first", "second", "first_parts"))
        own, fixed = every.where("live"), fixed.unionByName(every.where("NOT live"))
    shown = F.struct("cost", F.col("id.round").alias("round"), "parts", "first", "second", "id", "first_parts", "new")
    done = cut(fixed.groupBy("source", "target").agg(F.min(shown).alias("b")).select("source", "target", "b.*"))
    shortcuts = shortcuts.unionByName(done.where("new = 1").select("id", "first", "second", "first_parts"))
    return done.select("id", "source", "target", "cost", "parts"), cut(shortcuts)


def _beside(arcs: DataFrame, left: DataFrame) -> DataFrame:
    """arcs and whether they are live, with an end among the nodes of left."""
    s, t = (left.select(F.col("node").alias(c), F.lit(True).alias(f"of_{c}")) for c in ("source", "target"))
    return arcs.join(s, "source", "left").join(t, "target", "left").withColumn("live", F.coalesce("of_source", "of_target", F.lit(False))).drop("of_source", "of_target")


def _apart(arcs: DataFrame, left: DataFrame, made: int) -> DataFrame:
    """Nodes of left that come before all nodes of left beside them."""
    ends = arcs.select(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(arcs.select(F.col("target").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    degree = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    rank = F.struct(F.coalesce(F.col("out") * F.col("into"), F.lit(0)).alias("ways"), F.xxhash64("node", F.lit(made)).alias("hash"), F.col("node"))
    ranked = left.join(degree, "node", "left").select("node", rank.alias("rank"))
    s, t = ranked.select(F.col("node").alias("source"), F.col("rank").alias("own")), ranked.select(F.col("node").alias("target"), F.col("rank").alias("other"))
    beside = arcs.select("source", "target").join(s, "source").join(t, "target")
    beaten = beside.select(F.when(F.col("own") < F.col("other"), F.col("target")).otherwise(F.col("source")).alias("node")).distinct()
    return ranked.join(beaten, "node", "left_anti").select("node")


def represented_arcs(contracted: DataFrame, shortcuts: DataFrame) -> DataFrame:
    """id, place, source, target: the arcs of the given graph that each contracted arc stands for, in order from 0.

    All shortcuts are taken apart at once, and a part's place is known from the number of arcs before it; it takes as many rounds
    as shortcuts are nested.
    """
    pieces = contracted.select("id", F.lit(0).cast("long").alias("place"), F.col("id").alias("part"))
    done = pieces.limit(0)
    while True:
        pieces = cut(pieces)
        done = done.unionByName(pieces.where("part.round = 0"))
        nested = pieces.where("part.round > 0")
        if nested.isEmpty():
            return done.select("id", "place", "part.source", "part.target")
        both = nested.join(shortcuts.withColumnRenamed("id", "part"), "part")
        halves = F.array(F.struct(F.col("place"), F.col("first").alias("part")), F.struct((F.col("place") + F.col("first_parts")).alias("place"), F.col("second").alias("part")))
        pieces = both.select("id", F.explode(halves).alias("h")).select("id", "h.*")


def undo(contracted: DataFrame, shortcuts: DataFrame, value: str) -> DataFrame:
    """source, target, value: every arc that contracted ones stand for with their value; of several the most."""
    each = represented_arcs(contracted, shortcuts).join(contracted.select("id", value), "id")
    return each.groupBy("source", "target").agg(F.max(value).alias(value))


def contract_cheap(arcs: DataFrame, most: float, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """contract_nodes for all nodes whose arcs, in and out, cost at most so much, but those to keep (node)."""
    ends = arcs.select(F.col("source").alias("node"), "cost").unionByName(arcs.select(F.col("target").alias("node"), "cost"))
    cheap = ends.groupBy("node").agg(F.max("cost").alias("c")).where(F.col("c") <= most).select("node")
    return contract_nodes(arcs, cheap if keep is None else cheap.join(keep.select("node"), "node", "left_anti"))


def clusters(nodes: DataFrame, arcs: DataFrame, intra: float = INTRA_CLUSTER, inter: float = INTER_CLUSTER) -> DataFrame:
    """node and cluster, its least node, of nodes (node, lat, lon): clusters merge along arcs cheaper than intra, in order of cost, source and target.

    They merge if their centroids, each the mean of its nodes, are closer than inter metres when the arc's turn comes. Arcs count once,
    from the lesser node. Clusters of different components of cheap arcs never meet, so each component is worked whole, with others
    in a pack of some PACK_NODES nodes.
    """
    cheap = cut(arcs.where((F.col("cost") < intra) & (F.col("source") < F.col("target"))).groupBy(*(F.col(c).cast("long").alias(c) for c in ("source", "target"))).agg(F.min("cost").alias("cost")))
    cheap = cheap.select("source", "target", F.col("cost").cast("double").alias("cost"))
    places = nodes.select(F.col("node").cast("long").alias("node"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    touched = cheap.select(F.col("source").alias("node")).unionByName(cheap.select(F.col("target").alias("node"))).distinct()
    label = connected_components(touched, cheap)
    packs = label.count() // PACK_NODES + 1
    packed = label.select("node", F.pmod(F.xxhash64("component"), F.lit(packs)).alias("pack"))
    at = packed.join(places, "node").select("pack", "node", "lat", "lon")
    along = cheap.join(packed.withColumnRenamed("node", "source"), "source").select(F.col("pack").alias("of"), "source", "target", "cost")
    merged = at.groupBy("pack").cogroup(along.groupBy("of")).applyInPandas(_agglomerate(inter), "node long, cluster long")
    return places.select("node").join(merged, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def _agglomerate(inter: float):
    import math

    def metres(a: list[float], b: list[float]) -> float:
        p, q = math.radians(a[0]), math.radians(b[0])
        x, y = math.sin((q - p) / 2), math.sin((math.radians(b[1]) - math.radians(a[1])) / 2)
        return 2 * EARTH_RADIUS * math.asin(math.sqrt(x * x + math.cos(p) * math.cos(q) * y * y))

    def agglomerate(nodes: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        above = {n: n for n in nodes["node"].tolist()}
        middle = {n: [lat, lon] for n, lat, lon in zip(nodes["node"].tolist(), nodes["lat"].tolist(), nodes["lon"].tolist())}
        size = dict.fromkeys(above, 1)

        def of(n: int) -> int:
            while above[n] != n:
                above[n] = above[above[n]]
                n = above[n]
            return n

        for _, s, t in sorted(zip(arcs["cost"].tolist(), arcs["source"].tolist(), arcs["target"].tolist())):
            if s not in above or t not in above:
                continue
            a, b = of(s), of(t)
            if a != b and metres(middle[a], middle[b]) < inter:
                whole = size[a] + size[b]
                middle[a] = [size[a] / whole * p + size[b] / whole * q for p, q in zip(middle[a], middle[b])]
                size[a], above[b] = whole, a
        least: dict[int, int] = {}
        for n in above:
            least[of(n)] = min(n, least.get(of(n), n))
        return pd.DataFrame({"node": list(above), "cluster": [least[of(n)] for n in above]}, dtype="int64")

    return agglomerate


def border_nodes(label: DataFrame, arcs: DataFrame) -> DataFrame:
    """node: those with an arc to a node of another cluster (node, cluster)."""
    s, t = (label.select(F.col("node").alias(c), F.col("cluster").alias(f"{c}_cluster")) for c in ("source", "target"))
    return arcs.join(s, "source").join(t, "target").where("source_cluster <> target_cluster").select(F.col("source").alias("node")).distinct()


def contract_clusters(nodes: DataFrame, arcs: DataFrame, keep: DataFrame | None = None, intra: float = INTRA_CLUSTER, inter: float = INTER_CLUSTER) -> tuple[DataFrame, DataFrame]:
    """contract_nodes for the nodes inside of clusters, so only border nodes stay, and those to keep (node)."""
    label = cut(clusters(nodes, arcs, intra, inter))
    inner = label.join(border_nodes(label, arcs), "node", "left_anti")
    inner = cut(inner if keep is None else inner.join(keep.select("node"), "node", "left_anti"))
    large = inner.groupBy("cluster").count().where(F.col("count") > PACK_NODES).select("cluster")
    contracted, shortcuts = contract_nodes(arcs, inner.join(large, "cluster", "left_semi").select("node"))
    return _contract_within(contracted, shortcuts, inner.join(large, "cluster", "left_anti"))


def _contract_within(contracted: DataFrame, shortcuts: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """contract_nodes, continued, for nodes (node, cluster) without arcs to nodes of another cluster, some PACK_NODES of them in a group."""
    packed = inner.select("node", F.pmod(F.xxhash64("cluster"), F.lit(inner.count() // PACK_NODES + 1)).alias("pack"))
    s, t = (packed.select(F.col("node").alias(c), F.col("pack").alias(f"of_{c}")) for c in ("source", "target"))
    beside = cut(contracted.join(s, "source", "left").join(t, "target", "left").withColumn("pack", F.coalesce("of_source", "of_target")))
    flat = beside.where("pack IS NOT NULL").select("pack", "source", "target", "cost", "parts", F.col("id.round").alias("round"), F.col("of_source").isNotNull().alias("from_inner"), F.col("of_target").isNotNull().alias("to_inner"))
    parts = ", ".join(f"{p}_{c}" for p in ("first", "second") for c in ("round int", "source long", "target long"))
    made = cut(flat.groupBy("pack").applyInPandas(_eliminate, f"source long, target long, cost {flat.schema['cost'].dataType.simpleString()}, parts long, round int, {parts}, first_parts long, stays boolean"))
    old, new = beside.where("pack IS NULL").select("id", "source", "target", "cost", "parts"), made.where("stays").select(_arc_id(F.col("round")).alias("id"), "source", "target", "cost", "parts")
    shown = F.struct("cost", F.col("id.round").alias("round"), "parts", "id")
    done = old.unionByName(new).groupBy("source", "target").agg(F.min(shown).alias("b")).select("b.id", "source", "target", "b.cost", "b.parts")
    part = lambda p: F.struct(*(F.col(f"{p}_{c}").alias(c) for c in ("round", "source", "target"))).alias(p)
    own = made.where("first_round IS NOT NULL").select(_arc_id(F.col("round")).alias("id"), part("first"), part("second"), "first_parts").distinct()
    return cut(done), shortcuts.unionByName(own)


def _eliminate(arcs: pd.DataFrame) -> pd.DataFrame:
    """The arcs that stay, and every shortcut made, of a pack's arcs; rounds as those of contract_nodes."""
    known: dict[tuple[int, int], tuple] = {}  # (cost, parts, id, first, second, first_parts)
    into: dict[int, set[int]] = {}
    out: dict[int, set[int]] = {}
    left: set[int] = set()
    columns = ("source", "target", "cost", "parts", "round", "from_inner", "to_inner")
    for a, b, cost, parts, made, from_inner, to_inner in zip(*(arcs[c].tolist() for c in columns)):
        known[a, b] = (cost, parts, (made, a, b), None, None, 0)
        out.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)
        left.update(n for n, inside in ((a, from_inner), (b, to_inner)) if inside)
    made, gone = max((x[2][0] for x in known.values()), default=0), []
    while left:
        made += 1
        rank = {n: (len(into.get(n, ())) * len(out.get(n, ())), (n * 0x9E3779B97F4A7C15 + made * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) * 0x94D049BB133111EB >> 32 & (1 << 32) - 1, n) for n in left}
        apart = [n for n in left if all(rank[n] < rank[m] for m in (into.get(n, set()) | out.get(n, set())) & left)]
        fresh: set[tuple[int, int]] = set()
        for n in apart:
            ahead, behind = into.pop(n, set()), out.pop(n, set())
            for a in ahead:
                first = known[a, n]
                for b in behind - {a}:
                    second = known[n, b]
                    cost, earlier = first[0] + second[0], known.get((a, b))
                    if earlier is None or cost < earlier[0]:
                        known[a, b] = (cost, first[1] + second[1], (made, a, b), first[2], second[2], first[1])
                        out[a].add(b)
                        into[b].add(a)
                        fresh.add((a, b))
            for a in ahead:
                out[a].discard(n)
                del known[a, n]
            for b in behind:
                into[b].discard(n)
                del known[n, b]
        gone += [(k, known[k]) for k in fresh]
        left.difference_update(apart)
    rows = [(*k, x[0], x[1], x[2][0], *(x[3] or (None,) * 3), *(x[4] or (None,) * 3), x[5], stays) for stays, own in ((True, known.items()), (False, gone)) for k, x in own]
    names = ["source", "target", "cost", "parts", "round", *(f"{p}_{c}" for p in ("first", "second") for c in ("round", "source", "target")), "first_parts", "stays"]
    found = pd.DataFrame(rows, columns=names, dtype=object)
    return found
