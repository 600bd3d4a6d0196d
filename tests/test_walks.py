"""Walks as a prefix tree against plain enumeration with both prunes."""

import random

import pytest
from pyspark.sql import functions as F

from waynet.operators import walks
from waynet.plans.queries import LIMIT, QUERIES
from waynet.sources.derived import road_arcs

SF = "/root/testdata/sf0.001"


def enumerated(edges, starts, targets, limit, depth, border=None, once=True):
    near = {}
    for a, b, c in edges:
        near.setdefault(a, {})[b] = min(c, near.get(a, {}).get(b, c))
    front, out = [([n], 0) for n in sorted(set(starts))], []
    while front:
        grown = []
        for path, cost in front:
            if border is not None and (path[-1] not in border or limit - cost < border[path[-1]]):
                continue
            children = [(b, c) for b, c in near.get(path[-1], {}).items() if b not in path[-depth:]] if cost < limit else []
            used = set(zip(path, path[1:]))
            if once and any((path[-1], b) in used for b, _ in children):
                continue
            if len(path) > 1 and (targets is None or path[-1] in targets):
                out.append((path, cost))
            grown += [([*path, b], cost + c) for b, c in children]
        front = grown
    return sorted(out)


def rows(df):
    return sorted((list(r["path"]), r["cost"]) for r in df.collect())


def test_walks_equal_enumeration(spark):
    rng = random.Random(9)
    pairs = {tuple(rng.sample(range(9), 2)) for _ in range(12)}
    edges = [(a, b, c) for x, y in pairs for c in [rng.randint(2, 5)] for a, b in ((x, y), (y, x))] + [(0, 0, 1)]
    arcs = spark.createDataFrame([(*e, 1) for e in edges] + [(0, 8, 1, 0)], "source long, target long, cost int, weight int")
    node = lambda *n: spark.createDataFrame([(k,) for k in n], "node long")
    border = {n: n % 4 for n in range(8)}
    own = spark.createDataFrame(list(border.items()), "node long, cost long")
    for limit, depth, once, bound in ((17, 2, True, None), (17, 2, True, border), (11, 1, False, None)):
        found = walks.walkways(arcs, node(0, 3, 3), node(1, 3, 5), limit, depth, None if bound is None else own, once, F.col("weight") > 0)
        expected = enumerated(edges, [0, 3], {1, 3, 5}, limit, depth, bound, once)
        assert rows(found) == expected and expected
    assert len(enumerated(edges, [0, 3], {1, 3, 5}, 17, 2, None, False)) > len(enumerated(edges, [0, 3], {1, 3, 5}, 17, 2))
    assert rows(walks.walkways(arcs, node(0), node(77), 8)) == [] == rows(walks.walkways(arcs, node(), None, 8))
    with pytest.raises(RuntimeError, match="more than 5"):
        walks.walkways(arcs, node(0), None, 17, 1, once=False, most=5)


def test_query_of_pruned_walkways(spark):
    edges = [(r["source"], r["target"], r["cost"]) for r in road_arcs(spark, SF).collect()]
    border = {r["node"]: r["cost"] for r in QUERIES["distance_to_border"](spark, SF).collect()}
    entries = {n for n, c in border.items() if c == 0}
    expected = [("-".join(map(str, p)), c) for p, c in enumerated(edges, entries, {n for n in range(500) if n % 5 == 0}, LIMIT, 2, border)]
    assert sorted((r["path"], r["cost"]) for r in QUERIES["pruned_walkways"](spark, SF).collect()) == sorted(expected) and expected


def test_bins_of_few_and_equal_walks(spark):
    given = spark.createDataFrame([(1, 5), (2, 4), (2, 4), (3, 10), (3, 20), (3, 30)], "start long, cost long")
    assert sorted(map(tuple, walks.length_bins(given, 5).collect())) == [(2, 0, 2), (3, 0, 1), (3, 2, 1), (3, 4, 1)]
