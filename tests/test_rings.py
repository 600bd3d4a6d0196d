"""Ways of relations put in order: by groups, and by ranking their ends."""

import random

import pytest

from waynet.operators import spatial


def in_order(ways):
    """The ways as they follow each other, one after the other; ways by their place."""
    left, out = dict(enumerate(ways)), []
    meets = lambda node: [k for k, n in sorted(left.items()) if node in (n[0], n[-1])]
    while left:
        k = min(left)
        nds = left.pop(k)
        if meets(nds[0]) and not meets(nds[-1]):
            nds = nds[::-1]
        out.append(nds)
        while follows := meets(nds[-1]):
            own = left.pop(follows[0])
            nds = own if own[0] == nds[-1] else own[::-1]
            out.append(nds)
    return out


def relations(seed):
    """Rings, lines and forks of several relations, members shuffled and half of the ways turned."""
    rng, node, found = random.Random(seed), iter(range(10**6)), {}
    for relation in range(12):
        ways = []
        for _ in range(rng.randint(1, 4)):
            ends = [next(node) for _ in range(rng.randint(1, 9))]
            ring = rng.random() < 0.6
            for a, b in zip(ends, ends[1:] + ends[:1]):
                if ring or b != ends[0]:
                    ways.append([a, next(node), b])
            if rng.random() < 0.3:
                ways.append([rng.choice(ends), next(node), next(node)])
            if rng.random() < 0.2:
                ways.append([n := rng.choice(ends), next(node), n])
        if not ways:
            ways.append([next(node), next(node)])
        rng.shuffle(ways)
        found[relation] = [w[::-1] if rng.random() < 0.5 else w for w in ways]
    return found


@pytest.mark.parametrize("most", [4096, 0, 5])
def test_order_is_that_of_one_way_after_the_other(spark, monkeypatch, most):
    monkeypatch.setattr(spatial, "GROUP_WAYS", most)
    known = relations(most + 1)
    ids = {(r, k): 1000 * r + k for r, ways in known.items() for k in range(len(ways))}
    members = spark.createDataFrame([(r, k, i) for (r, k), i in ids.items()] + [(0, 500, -1), (7, 501, -2)], "relation_id long, pos int, way_id long")
    ways = spark.createDataFrame([(i, known[r][k]) for (r, k), i in ids.items()] + [(-2, [])], "way_id long, nds array<long>")
    found = {}
    for row in spatial.order_ways(members, ways).orderBy("relation_id", "pos").collect():
        assert row["pos"] == len(found.setdefault(row["relation_id"], []))
        found[row["relation_id"]].append(row["nds"])
    expected = {r: in_order(ways) + [None] * (r in (0, 7)) for r, ways in known.items()}
    assert found == expected
    polygons = {}
    for row in spatial.assembled_polygons(members, ways).orderBy("relation_id", "polygon").collect():
        polygons.setdefault(row["relation_id"], []).append(row["nds"])
    for r, rows in expected.items():
        parts = []
        for nds in filter(None, rows):
            if parts and parts[-1][-1] == nds[0]:
                parts[-1] = parts[-1] + nds
            else:
                parts.append(list(nds))
        assert polygons.get(r, []) == [p for p in parts if len(p) > 2]


def test_a_large_ring_is_ranked_without_a_group(spark, monkeypatch):
    monkeypatch.setattr(spatial, "GROUP_WAYS", 100)
    n, rng = 700, random.Random(4)
    ways = [[k, n + k, (k + 1) % n] for k in range(n)]
    rng.shuffle(ways)
    ways = [w[::-1] if rng.random() < 0.5 else w for w in ways]
    joined = spark.createDataFrame([(1, k, w) for k, w in enumerate(ways)], "relation_id long, pos long, nds array<long>")
    ranked, rest = spatial._ranked(joined, n)
    assert rest.count() == 0
    assert [r["nds"] for r in ranked.orderBy("rank").collect()] == in_order(ways)
