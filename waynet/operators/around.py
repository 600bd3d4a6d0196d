"""Ways from all nodes to entries that avoid a neighbour or an arc, from one search for each entry.

The search gives an entry's tree of shortest ways and an interval for every node's subtree. A way from x to the entry that
may not pass y costs what the tree says unless y is an ancestor of x, which the intervals tell. Only then is it searched again: from x within
the part of the tree that hangs on what is barred, out to any node beyond, whose own way is known. The known
ways bound that search from below, so it leaves aside what can't become the best.
"""

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waynet.operators.search import CELL, shortest_paths


def reach_of_entries(arcs: DataFrame, entries: DataFrame, limit: int, cell: int = CELL, cells: DataFrame | None = None) -> DataFrame:
    """entry, node, cost, parent: the least cost from every node to each entry (node) within the limit, and the next node on the way."""
    back = arcs.select(F.col("target").alias("source"), F.col("source").alias("target"), "cost")
    found = shortest_paths(back, entries.select(F.col("node").alias("search_id"), "node").distinct(), limit, cell=cell, cells=cells)
    return found.select(F.col("search_id").cast("long").alias("entry"), "node", "cost", "parent")


def ways_around(arcs: DataFrame, pairs: DataFrame, reach: DataFrame, limit: int, barred: str) -> DataFrame:
    """entry, x, y, cost: the least cost from x to each entry within the limit that doesn't pass the node y, or the arc between x and y, for all pairs (x, y).

    barred is `node` or `arc`; reach is what reach_of_entries found with that limit. Rows of an entry, which are
    bounded by the limit, are worked together.
    """
    if barred not in ("node", "arc"):
        raise ValueError(f"nothing known to bar: {barred}")
    streets = arcs.select(F.col("source").cast("long").alias("x"), F.col("target").cast("long").alias("y"), F.col("cost").cast("long").alias("street"), F.lit(False).alias("asked"))
    asked = pairs.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.lit(None).cast("long").alias("street"), F.lit(True).alias("asked"))
    beside = streets.unionByName(asked).groupBy("x", "y").agg(F.min("street").alias("street"), F.max("asked").alias("asked"))
    rows = reach.join(beside.withColumnRenamed("x", "node"), "node", "left")
    return rows.groupBy("entry").applyInPandas(_around(limit, barred == "node"), "entry long, x long, y long, cost long")


def _intervals(root: int, parent: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(first, last) place in preorder of every node's subtree."""
    children: dict[int, list[int]] = {}
    for node, above in parent.items():
        if node != root:
            children.setdefault(above, []).append(node)
    first, out, stack = {}, {}, [(root, False)]
    while stack:
        node, ended = stack.pop()
        if ended:
            out[node] = first[node], len(first) - 1
        else:
            first[node] = len(first)
            stack.append((node, True))
            stack += [(child, False) for child in children.get(node, ())]
    return out


def _around(limit: int, whole_node: bool):
    def around(rows: pd.DataFrame) -> pd.DataFrame:
        entry = int(rows["entry"].iloc[0])
        known = dict(zip(rows["node"].tolist(), rows["cost"].tolist()))
        parent = dict(zip(rows["node"].tolist(), rows["parent"].tolist()))
        streets: dict[int, list[tuple[int, int]]] = {}
        paved = rows[rows["street"].notna()]
        for x, y, c in zip(paved["node"].tolist(), paved["y"].astype("int64").tolist(), paved["street"].astype("int64").tolist()):
            streets.setdefault(x, []).append((y, c))
        span = _intervals(entry, parent)

        def again(x: int, y: int) -> int | None:
            """The least cost from x to the entry out of the subtree of what is barred."""
            low, high = span[y] if whole_node else span[x]
            best, todo, done = limit + 1, [(known[x], 0, x)], set()
            while todo:
                least, cost, node = heapq.heappop(todo)
                if least >= best:
                    break
                if node in done:
                    continue
                done.add(node)
                for target, more in streets.get(node, ()):
                    if target not in known or target == y and (whole_node or node == x):
                        continue
                    way = cost + more + known[target]
                    if way >= best:
                        continue
                    if low <= span[target][0] <= high:
                        if target not in done:
                            heapq.heappush(todo, (way, cost + more, target))
                    else:
                        best = way
            return best if best <= limit else None

        out = []
        wanted = rows[rows["asked"].eq(True)]
        for x, y in zip(wanted["node"].tolist(), wanted["y"].astype("int64").tolist()):
            if whole_node:
                hit = x != y and y in span and span[y][0] <= span[x][0] <= span[y][1]
            else:
                hit = x != entry and parent[x] == y
            cost = again(x, y) if hit else known[x]
            if cost is not None:
                out.append((entry, x, y, cost))
        return pd.DataFrame(out, columns=["entry", "x", "y", "cost"])

    return around
