"""Searches over placed cells and their overlay against plain search."""

import collections
import heapq

import pytest
from pyspark.sql import functions as F

from waynet.operators import search
from waynet.plans.iterate import cut
from waynet.sources.derived import city_arcs, city_nodes

SF = "/root/testdata/sf0.01"
LIMIT, SIZE = 150, 32


@pytest.fixture(scope="module")
def city(spark):
    nodes, arcs = cut(city_nodes(spark, SF)), cut(city_arcs(spark, SF))
    cells = cut(search.place_cells(nodes.select("node", "x", "y"), SIZE))
    seeds = cut(nodes.where("k % 400 = 0").select(F.col("k").alias("search_id"), "node"))
    return nodes, arcs, cells, seeds


def plain(arcs, seeds, limit):
    near = collections.defaultdict(list)
    for r in arcs.collect():
        near[r["source"]].append((r["target"], r["cost"]))
    out = {}
    for r in seeds.collect():
        todo, done = [(0, -1, r["node"], r["node"])], {}
        while todo:
            cost, _, parent, node = heapq.heappop(todo)
            if node not in done:
                done[node] = cost, parent
                for target, more in near[node]:
                    if cost + more <= limit:
                        heapq.heappush(todo, (cost + more, cost, node, target))
        out |= {(r["search_id"], node): found for node, found in done.items()}
    return out


def found(df):
    return {(r["search_id"], r["node"]): (r["cost"], r["parent"]) for r in df.collect()}


def test_overlay_finds_costs_and_parents(city):
    _, arcs, cells, seeds = city
    assert found(search.shortest_paths(arcs, seeds, LIMIT, cells=cells)) == plain(arcs, seeds, LIMIT)


def test_cells_are_compact_and_share_the_arcs(city):
    nodes, arcs, cells, _ = city
    sizes = [r["count"] for r in cells.groupBy("cell").count().collect()]
    assert len(sizes) >= 50 and max(sizes) == SIZE and sum(sizes) == nodes.count()
    net = search.network(arcs, cells)
    counts = [r["count"] for r in net.arcs.groupBy("group").count().collect()]
    assert max(counts) <= sum(counts) / 16
    assert net.arcs.where("group <> target_cell").count() < 0.45 * sum(counts)  # by runs of these ids nearly all arcs leave their cell


def test_rounds_fall_against_cells_of_scattered_ids(city):
    _, arcs, cells, seeds = city
    rounds = {}
    for name, own, size in (("placed", cells, SIZE), ("ids", None, (1 << 32) // 63)):
        net = search.network(arcs, own, size, LIMIT)
        start = search._starts(net, seeds)
        plain_rounds, count = search._rounds(start, net.arcs, LIMIT, 1)
        left = search._settled(start, net.arcs, LIMIT, 1, "across")
        rounds[name] = count, 2 + search._rounds(left.drop("across"), net.over, LIMIT, search.REGION)[1]
        assert plain_rounds.count() == search.search(net, seeds, LIMIT).count()
    assert rounds["placed"][1] < rounds["placed"][0] < rounds["ids"][0]


def test_nodes_without_places_repeated_places_and_strangers(spark):
    nodes = spark.createDataFrame([(k, 1.0 if k < 9 else None, 1.0) for k in range(12)], "node long, x double, y double")
    cells = search.place_cells(nodes.unionByName(nodes), 4)
    assert sorted(r["count"] for r in cells.groupBy("cell").count().collect()) == [4, 4, 4]
    arcs = spark.createDataFrame([(k, k + 1, 2) for k in range(11)] + [(0, 1, 5)], "source long, target long, cost int")
    seeds = spark.createDataFrame([("a", 0), ("a", 0), ("b", 99), ("c", 5), ("c", 10)], "search_id string, node long")
    out = found(search.shortest_paths(arcs, seeds, 9, cells=cells))
    assert out == {("a", 0): (0, 0), **{("a", k): (2 * k, k - 1) for k in range(1, 5)}, ("b", 99): (0, 99), ("c", 5): (0, 5), ("c", 6): (2, 5), ("c", 7): (4, 6), ("c", 8): (6, 7), ("c", 9): (8, 8), ("c", 10): (0, 10), ("c", 11): (2, 10)}
    assert search.shortest_paths(arcs, seeds.limit(0), 9, cells=cells).count() == 0
    assert search.shortest_paths(arcs.limit(0), seeds, 9, cells=cells).count() == 4
    assert place_count(spark) == 0


def place_count(spark):
    return search.place_cells(spark.createDataFrame([], "node long, x double, y double"), 4).count()


def test_regions_are_settled_without_an_overlay_that_is_larger_than_the_graph(city, monkeypatch):
    _, arcs, cells, seeds = city
    expected = plain(arcs, seeds, LIMIT)
    net = search.network(arcs, cells, SIZE, LIMIT)
    assert found(search.search(net, seeds, LIMIT)) == expected
    assert "over" not in vars(net)
    monkeypatch.setattr(search.Network, "pays", True)
    net = search.network(arcs, cells, SIZE, LIMIT)
    assert found(search.search(net, seeds, LIMIT)) == expected
    assert vars(net)["over"].count() > net.arcs.count()


def test_the_overlay_is_made_where_cells_have_few_borders(spark):
    rows = [(k, k + 1, 2) for k in range(399)] + [(k + 1, k, 3) for k in range(399)]
    arcs = spark.createDataFrame(rows, "source long, target long, cost int")
    seeds = spark.createDataFrame([(k, k) for k in (0, 57, 200, 399)], "search_id long, node long")
    net = search.network(arcs, None, 8, 350)
    assert found(search.search(net, seeds, 350)) == plain(arcs, seeds, 350)
    assert "over" in vars(net)


def test_cells_of_a_long_strip_are_as_compact_as_those_of_a_square(spark):
    """8 columns of 4096 rows: cells of 16 nodes are 4 by 4, not parts of a column."""
    nodes = spark.range(1 << 15).select(F.col("id").alias("node"), (F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    spans = nodes.join(search.place_cells(nodes, 16), "node").groupBy("cell").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    assert max(spans.agg(F.percentile("w", F.lit(0.9)), F.percentile("h", F.lit(0.9))).first()) <= 7
