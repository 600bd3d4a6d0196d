"""Ends of ways ranked in a group of a relation, and in rounds over all of them."""

import pytest

from tests.test_rings import in_order, relations
from waynet.operators import spatial


@pytest.mark.parametrize("most", [0, 6, 1 << 17])
def test_ends_are_ranked_in_groups_up_to_a_size(spark, monkeypatch, most):
    monkeypatch.setattr(spatial, "GROUP_WAYS", 0)
    monkeypatch.setattr(spatial, "RANK_WAYS", most)
    in_rounds, sizes = spatial._ranked, []
    monkeypatch.setattr(spatial, "_ranked", lambda known, n: sizes.append(n) or in_rounds(known, n))
    known = relations(3)
    rows = [(r, k, 1000 * r + k, w) for r, ways in known.items() for k, w in enumerate(ways)]
    members = spark.createDataFrame([x[:3] for x in rows], "relation_id long, pos int, way_id long")
    ways = spark.createDataFrame([x[2:] for x in rows], "way_id long, nds array<long>")
    found = {}
    for row in spatial.order_ways(members, ways).orderBy("relation_id", "pos").collect():
        found.setdefault(row["relation_id"], []).append(row["nds"])
    assert found == {r: in_order(own) for r, own in known.items()}
    assert sizes == [m for m in [max(map(len, known.values()))] if m > most]
