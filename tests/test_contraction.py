"""Contraction of chosen nodes and clusters against elimination one by one, and its undo."""

import collections
import heapq
import math
import random

import pytest

from waynet.functions.geo import EARTH_RADIUS
from waynet.operators import contraction


def graph_of(seed, n=30, m=34):
    rng = random.Random(seed)
    pairs = {tuple(rng.sample(range(n), 2)) for _ in range(m)}
    edges = [(a, b, rng.randint(1, 20)) for a, b in pairs] + [(b, a, rng.randint(1, 20)) for a, b in pairs if rng.random() < 0.7]
    return edges + [(4, 4, 1), (*edges[0][:2], 50)]


def least(edges):
    out = {}
    for a, b, c in edges:
        if a != b:
            out[a, b] = min(c, out.get((a, b), c))
    return out


def eliminated(edges, nodes):
    arcs = least(edges)
    for n in nodes:
        into = [(a, c) for (a, b), c in arcs.items() if b == n]
        out = [(b, c) for (a, b), c in arcs.items() if a == n]
        arcs = {k: c for k, c in arcs.items() if n not in k}
        for a, c in into:
            for b, more in out:
                if a != b:
                    arcs[a, b] = min(c + more, arcs.get((a, b), c + more))
    return arcs


def distances(arcs, start):
    todo, done = [(0, start)], {}
    while todo:
        c, a = heapq.heappop(todo)
        if a not in done:
            done[a] = c
            for (x, b), more in arcs.items():
                if x == a:
                    heapq.heappush(todo, (c + more, b))
    return done


@pytest.mark.parametrize("seed", [1])
def test_contraction_equals_elimination_and_undoes(spark, seed):
    edges = graph_of(seed)
    gone = [n for n in range(30) if n % 3]
    arcs = spark.createDataFrame(edges, "source long, target long, cost long")
    chosen = spark.createDataFrame([(n,) for n in [*gone, gone[0], 77]], "node long")
    small, shortcuts = contraction.contract_nodes(arcs, chosen)
    rows = small.collect()
    found = {(r["source"], r["target"]): r["cost"] for r in rows}
    assert found == eliminated(edges, gone) == eliminated(edges, gone[::-1])
    whole = least(edges)
    for n in range(0, 30, 3):
        far = distances(whole, n)
        assert {k: c for k, c in far.items() if k % 3 == 0} == distances(found, n)
    ways = collections.defaultdict(list)
    for r in contraction.represented_arcs(small, shortcuts).collect():
        ways[r["id"]["source"], r["id"]["target"]].append((r["place"], r["source"], r["target"]))
    assert set(ways) == set(found)
    for r in rows:
        way = sorted(ways[r["source"], r["target"]])
        assert [p for p, _, _ in way] == list(range(r["parts"]))
        assert way[0][1] == r["source"] and way[-1][2] == r["target"] and all(a[2] == b[1] for a, b in zip(way, way[1:]))
        assert sum(whole[a, b] for _, a, b in way) == r["cost"]
    values = {k: max(found[s] for s, way in ways.items() if any((a, b) == k for _, a, b in way)) for k in {(a, b) for way in ways.values() for _, a, b in way}}
    assert {(r["source"], r["target"]): r["cost"] for r in contraction.undo(small, shortcuts, "cost").collect()} == values


def test_nothing_chosen_and_everything_chosen(spark):
    arcs = spark.createDataFrame(graph_of(3), "source long, target long, cost long")
    none = spark.createDataFrame([], "node long")
    small, shortcuts = contraction.contract_nodes(arcs, none)
    assert {(r["source"], r["target"]): r["cost"] for r in small.collect()} == least(graph_of(3)) and shortcuts.count() == 0
    small, _ = contraction.contract_nodes(arcs, spark.range(30).withColumnRenamed("id", "node"))
    assert small.count() == 0
    with pytest.raises(RuntimeError):
        contraction.contract_nodes(arcs, spark.range(30).withColumnRenamed("id", "node"), 1)


def test_rounds_read_only_arcs_of_nodes_that_are_left(spark, monkeypatch):
    """A line of 40 nodes of which two go, one beside an arc that costs as much as the way through it."""
    read, plain = [], contraction._apart

    def apart(arcs, left, made):
        read.append(arcs.count())
        return plain(arcs, left, made)

    monkeypatch.setattr(contraction, "_apart", apart)
    edges = [(a, b, 1) for k in range(39) for a, b in ((k, k + 1), (k + 1, k))] + [(9, 11, 2)]
    arcs = spark.createDataFrame(edges, "source long, target long, cost long")
    small, shortcuts = contraction.contract_nodes(arcs, spark.createDataFrame([(10,), (11,)], "node long"))
    assert {(r["source"], r["target"]): r["cost"] for r in small.collect()} == eliminated(edges, [10, 11])
    assert read and max(read) <= 7
    known = {r["id"] for r in shortcuts.collect()}
    assert {r["id"] for r in small.collect() if r["id"]["round"]} <= known
    assert {p for r in shortcuts.collect() for p in (r["first"], r["second"]) if p["round"]} <= known


def sequential(nodes, edges, intra, inter):
    def metres(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        x, y = math.sin((q - p) / 2), math.sin((math.radians(b[1]) - math.radians(a[1])) / 2)
        return 2 * EARTH_RADIUS * math.asin(math.sqrt(x * x + math.cos(p) * math.cos(q) * y * y))

    own, middle, label = {n: {n} for n, _, _ in nodes}, {n: (a, b) for n, a, b in nodes}, {n: n for n, _, _ in nodes}
    for cost, a, b in sorted((c, a, b) for (a, b), c in least(edges).items() if a < b):
        if cost >= intra:
            break
        x, y = label[a], label[b]
        if x != y and metres(middle[x], middle[y]) < inter:
            m, n = len(own[x]), len(own[y])
            middle[x] = tuple(m / (m + n) * p + n / (m + n) * q for p, q in zip(middle[x], middle[y]))
            own[x] |= own.pop(y)
            for k in own[x]:
                label[k] = x
    return {n: min(members) for members in own.values() for n in members}


@pytest.mark.parametrize("seed", [5])
def test_clusters_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    edges = graph_of(seed)
    nodes = [(n, 49 + rng.random() * 0.001, 7 + rng.random() * 0.001) for n in range(32)]
    points, arcs = spark.createDataFrame(nodes, "node long, lat double, lon double"), spark.createDataFrame(edges, "source long, target long, cost long")
    expected = sequential(nodes, edges, 15.0, 50.0)
    label = contraction.clusters(points, arcs)
    assert {r["node"]: r["cluster"] for r in label.collect()} == expected
    border = {a for a, b, _ in edges if expected[a] != expected[b]}
    assert {r["node"] for r in contraction.border_nodes(label, arcs).collect()} == border
    small, _ = contraction.contract_clusters(points, arcs, spark.createDataFrame([(1,)], "node long"))
    assert {(r["source"], r["target"]): r["cost"] for r in small.collect()} == eliminated(edges, [n for n in range(32) if n not in border | {1}])


def test_golden_clusters(spark):
    """A triangle of close nodes beside a far one keeps its border node; a square of border nodes stays as it is."""
    both = lambda *edges: [(a, b, c) for x, y, c in edges for a, b in ((x, y), (y, x))]
    arcs = spark.createDataFrame(both((0, 1, 1), (0, 2, 1), (1, 2, 1), (2, 3, 5)), "source long, target long, cost long")
    points = spark.createDataFrame([(0, 0.0, 0.0001), (1, 0.0001, 0.0), (2, 0.0, 0.0), (3, 10.0, 0.0)], "node long, lat double, lon double")
    small, _ = contraction.contract_clusters(points, arcs)
    assert sorted((r["source"], r["target"], r["cost"]) for r in small.collect()) == [(2, 3, 5), (3, 2, 5)]
    square = both((0, 1, 1), (0, 2, 3), (1, 3, 3), (2, 3, 1))
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0001), (2, 1.0, 0.0), (3, 1.0, 0.0001)], "node long, lat double, lon double")
    small, _ = contraction.contract_clusters(points, spark.createDataFrame(square, "source long, target long, cost long"))
    assert sorted((r["source"], r["target"], r["cost"]) for r in small.collect()) == sorted(square)


def test_clusters_of_the_city_query(spark):
    from waynet.plans.queries import QUERIES
    from waynet.sources.derived import city_arcs, city_nodes

    sf = "/root/testdata/sf0.001"
    nodes = [(r["node"], 49 + r["y"] * 1e-4, 7 + r["x"] * 1e-4) for r in city_nodes(spark, sf).collect()]
    edges = [(r["source"], r["target"], r["cost"]) for r in city_arcs(spark, sf).collect()]
    expected = sequential(nodes, edges, 15.0, 50.0)
    border = {a for a, b, _ in edges if expected[a] != expected[b]}
    out = QUERIES["city_clusters"](spark, sf).collect()
    assert {r["node"]: (r["cluster"], r["border"]) for r in out} == {n: (c, n in border) for n, c in expected.items()}
    assert len(set(expected.values())) < len(expected)


@pytest.mark.parametrize("pack", [4096, 4, 1])
def test_clusters_are_contracted_in_groups(spark, monkeypatch, pack):
    """A grid of close nodes in several clusters: least ways and what they stand for, without rounds over tables unless a cluster is too large for a group."""
    rng = random.Random(7)
    spot = {k: (49 + k // 8 * 1e-4, 7 + k % 8 * 1e-4) for k in range(64)}
    edges = [(a, b, rng.randint(1, 9) if a // 32 == b // 32 else 40) for k in range(64) for n in (k + 1 if k % 8 < 7 else None, k + 8 if k < 56 else None) if n for a, b in ((k, n), (n, k))]
    points = spark.createDataFrame([(k, *p) for k, p in spot.items()], "node long, lat double, lon double")
    arcs = spark.createDataFrame(edges, "source long, target long, cost int")
    label = {r["node"]: r["cluster"] for r in contraction.clusters(points, arcs).collect()}
    inner = [n for n in label if all(label[b] == label[n] for a, b, _ in edges if a == n)]
    tables, plain = [], contraction._apart
    monkeypatch.setattr(contraction, "_apart", lambda *x: tables.append(1) or plain(*x))
    monkeypatch.setattr(contraction, "clusters", lambda *x: spark.createDataFrame(sorted(label.items()), "node long, cluster long"))
    monkeypatch.setattr(contraction, "PACK_NODES", pack)
    small, shortcuts = contraction.contract_clusters(points, arcs)
    rows = small.collect()
    assert {(r["source"], r["target"]): r["cost"] for r in rows} == eliminated(edges, inner) and len(rows) == len(eliminated(edges, inner))
    assert len(inner) > 8 and bool(tables) == (pack == 1 or any(sum(label[n] == c for n in inner) > pack for c in set(label.values())))
    whole, ways = least(edges), collections.defaultdict(list)
    for r in contraction.represented_arcs(small, shortcuts).collect():
        ways[r["id"]["source"], r["id"]["target"]].append((r["place"], r["source"], r["target"]))
    for r in rows:
        way = sorted(ways[r["source"], r["target"]])
        assert [p for p, _, _ in way] == list(range(r["parts"])) and sum(whole[a, b] for _, a, b in way) == r["cost"]
        assert way[0][1] == r["source"] and way[-1][2] == r["target"] and all(a[2] == b[1] for a, b in zip(way, way[1:]))
