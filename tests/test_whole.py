"""Queries without SQL against brute force in plain Python, over all points and arcs of the smallest tables."""

import collections
import heapq
import os

import pytest

from waynet.plans.queries import LIMIT, PREFS, QUERIES
from waynet.sources.derived import points, road_arcs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def net(spark):
    """All nodes, the least cost of every arc, its neighbours, and its weight."""
    nodes = sorted(r["vec_id"] for r in points(spark, SF).select("vec_id").collect())
    cost, weight, near = {}, {}, collections.defaultdict(list)
    for r in road_arcs(spark, SF).collect():
        key = r["source"], r["target"]
        cost[key], weight[key] = min(r["cost"], cost.get(key, r["cost"])), r["weight"]
    for a, b in cost:
        near[a].append(b)
    return nodes, cost, near, weight


def reached(net, start, limit, entered=lambda a, b: True):
    _, cost, near, _ = net
    best, todo = {}, [(0, start)]
    while todo:
        c, a = heapq.heappop(todo)
        if a in best:
            continue
        best[a] = c
        for b in near[a]:
            if c + cost[a, b] <= limit and entered(a, b):
                heapq.heappush(todo, (c + cost[a, b], b))
    return best


def suffix(cost):
    return sum(s for bound, s in PREFS if cost <= bound)


def test_entry_popularity_counts_all_buckets(spark, net):
    bounds = [b for b, _ in PREFS]
    bucket = lambda c: sum(c > b for b in bounds)
    paths = {e: reached(net, e, bounds[-1]) for e in net[0] if e % 25 == 0}
    assert {bucket(c) for found in paths.values() for c in found.values()} == {0, 1, 2}
    total = collections.Counter()
    for found in paths.values():
        for pop, c in found.items():
            total[pop] += bounds[bucket(c)]
    raw = collections.Counter()
    for e, found in paths.items():
        for pop, c in found.items():
            b = bucket(c)
            likely = 1 - bounds[b] / total[pop] if bounds[b] < total[pop] else 1 / (b + 1) ** 2
            raw[e] += likely * suffix(c) * (pop % 7 + 1) if c < bounds[-1] else 0
    scale = 0.5 * sum(pop % 7 + 1 for pop in total) / sum(raw.values())
    out = {r["entry"]: r["popularity"] for r in QUERIES["entry_popularity"](spark, SF).collect()}
    assert out == pytest.approx({e: v * scale for e, v in raw.items()}, abs=1e-5)


def test_via_edge_covers_all_arcs_and_entries(spark, net):
    nodes, cost, _, weight = net
    limit, entries = 2 * LIMIT, [n for n in nodes if n % 25 == 0]
    direct = {e: reached(net, e, limit) for e in entries}
    value = collections.Counter()
    for a, b in cost:
        back, forth = reached(net, a, limit, lambda _, n: n != b), reached(net, b, limit, lambda _, n: n != a)
        for e in entries:
            for f in entries:
                if e not in back or f not in forth or back[e] + cost[a, b] + forth[f] > limit:
                    continue
                way = back[e] + cost[a, b] + forth[f]
                gain = 60 / (forth[f] + 60) if e == f else (direct[e][f] + 60) / (way + 60) if f in direct[e] else 0
                value[e, (a, b)] += weight[a, b] * suffix(way) * gain
    most = collections.Counter()
    for (e, _), v in value.items():
        most[e] = max(most[e], v)
    expected = dict.fromkeys(cost, 0.0)
    for (e, arc), v in value.items():
        if most[e]:
            expected[arc] += v / most[e] * (e + 100)
    out = {(r["source"], r["target"]): r["value"] for r in QUERIES["via_edge"](spark, SF).collect()}
    assert out == pytest.approx(expected, abs=1e-5)


def test_even_arc_weights_cover_all_arcs_and_entries(spark, net):
    nodes, cost, _, _ = net
    limit, trips = 2 * LIMIT, collections.Counter()
    for a, b in cost:
        barred = lambda x, y: {x, y} != {a, b}  # noqa: B023, E731
        back, forth = reached(net, a, limit, barred), reached(net, b, limit, barred)
        for e in nodes[::25]:
            trips[e, (a, b)] += sum(e in back and f in forth and back[e] + cost[a, b] + forth[f] <= limit for f in nodes[::25])
    n, expected = collections.Counter(), collections.Counter()
    for (e, _), k in trips.items():
        n[e] += k
    for (e, arc), k in trips.items():
        if k:
            expected[arc] += k * (e + 100) / n[e]
    out = {(r["source"], r["target"]): r["value"] for r in QUERIES["even_arc_weights"](spark, SF).collect()}
    assert out == pytest.approx(dict(expected), abs=1e-5)


def test_walkways_start_from_all_entries(spark, net):
    nodes, cost, near, _ = net
    front, expected = [([n], 0) for n in nodes if n % 25 == 0], []
    while front:
        front = [([*p, b], c + cost[p[-1], b]) for p, c in front if c < 100 for b in near[p[-1]] if b not in p[-3:]]
        expected += [("-".join(map(str, p)), c) for p, c in front if p[-1] % 5 == 0]
    out = [(r["path"], r["cost"]) for r in QUERIES["walkways"](spark, SF).collect()]
    assert sorted(out) == sorted(expected)
