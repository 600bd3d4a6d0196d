"""Ways around a barred neighbour or arc, from the entries, against a search for each."""

import collections
import heapq
import random

import pytest

from waynet.operators.around import reach_of_entries, ways_around


@pytest.mark.parametrize("barred", ["node", "arc"])
def test_ways_around_equal_a_search_for_each_arc(spark, barred):
    rng = random.Random(7)
    pairs = {tuple(rng.sample(range(40), 2)) for _ in range(70)}
    edges = [(a, b, rng.randint(1, 9)) for a, b in pairs] + [(b, a, rng.randint(1, 9)) for a, b in pairs if rng.random() < 0.8] + [(3, 3, 2)]
    arcs = spark.createDataFrame([(*e, 1) for e in edges], "source long, target long, cost int, weight int")
    near = collections.defaultdict(dict)
    for a, b, c in edges:
        near[a][b] = min(c, near[a].get(b, c))
    entries, limit = [0, 5, 11, 30], 22
    asked = {(a, b) for a, b, _ in edges} | {(b, a) for a, b, _ in edges}
    expected = {}
    for x, y in asked:
        todo, done = [(0, x)], {}
        while todo:
            c, a = heapq.heappop(todo)
            if a in done:
                continue
            done[a] = c
            for b, more in near[a].items():
                allowed = b != y if barred == "node" else {a, b} != {x, y} or x == y
                if allowed and c + more <= limit:
                    heapq.heappush(todo, (c + more, b))
        expected |= {(e, x, y): done[e] for e in entries if e in done}
    reach = reach_of_entries(arcs, spark.createDataFrame([(e,) for e in entries * 2], "node long"), limit, 8)
    ways = ways_around(arcs, spark.createDataFrame(list(asked), "x long, y long"), reach, limit, barred)
    assert {(r["entry"], r["x"], r["y"]): r["cost"] for r in ways.collect()} == expected
    assert ways_around(arcs, spark.createDataFrame([], "x long, y long"), reach, limit, barred).count() == 0


def test_only_nodes_and_arcs_can_be_barred(spark):
    with pytest.raises(ValueError):
        ways_around(None, None, None, 1, "road")
