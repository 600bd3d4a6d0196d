"""The scan of OSM files by bytes: golden costs, and the same rows however the file is split."""

import random

import pytest

from waynet.sources import scan

STREET = (
    '<node id="42432091" lat="40.7163940" lon="-73.9845360"/><node id="42432093" lat="40.7166310" lon="-73.9853230"/><node id="42432094" lat="40.7168990" lon="-73.9862000"/>'
    '<way id="39662324"> <nd ref="42432094"/> <nd ref="42432093"/> <nd ref="42432091"/> <tag k="highway" v="residential"/> <tag k="name" v="Broome Street"/></way>'
)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("profile, costs", [("car", (9, 10)), ("walking", (52, 57))])
def test_golden_street(spark, tmp_path, profile, costs):
    (tmp_path / "street.osm").write_text(STREET)
    nodes, ways = scan.scan_osm(spark, str(tmp_path / "street.osm"))
    assert [(n, i) for n, i, *_ in _rows(nodes)] == [(0, 42432091), (1, 42432093), (2, 42432094)]
    a, b = costs
    assert _rows(scan.whole_second_arcs(nodes, ways, profile)) == [(0, 1, a), (1, 0, a), (1, 2, b), (2, 1, b)]


def test_rows_do_not_depend_on_the_splits(spark, tmp_path):
    """300 nodes, some tagged as crossings, 60 ways of up to 60 refs, relations between; splits of 100 bytes to the whole."""
    rng = random.Random(3)
    nodes, ways, body = [], [], ["<?xml version='1.0'?>\n<osm>\n"]
    for k in range(300):
        inner = '>\n<tag k="highway" v="crossing"/>\n</node>\n' if k % 7 == 0 else "/>\n"
        body.append(f'  <node id="{1000 - k}" lat="{k / 8}" lon="{-k / 16}"{inner}')
        nodes.append((k, 1000 - k, k / 8, -k / 16))
    for k in range(60):
        nds = [rng.randrange(701, 1001) for _ in range(rng.choice([0, 1, 2, 60]))]
        kind = rng.choice([None, "track", "residential", "proposed"])
        body.append(f'<way id="{k}">' + "".join(f'\n <nd ref="{n}"/>' for n in nds) + (f'<tag k="highway" v="old"/><tag k="highway" v="{kind}"/>' if kind else "") + "</way>")
        body.append('<relation id="5"><member ref="9"/><tag k="highway" v="track"/><nd ref="1"/></relation>' if k % 20 == 0 else "")
        ways.append((k, nds, kind))
    path = tmp_path / "map.osm"
    path.write_text("".join(body) + "</osm>")
    was = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (None, 997, 4000):
            if size:
                for c in was:
                    spark.conf.set(c, size if c.endswith("PartitionBytes") else 0)
            got_nodes, got_ways = scan.scan_osm(spark, str(path))
            assert _rows(got_nodes) == nodes
            assert sorted((tuple(r) for r in got_ways.collect()), key=lambda r: r[0]) == ways
            if size == 997:
                assert scan.scan_elements(spark, str(path)).select("block").distinct().count() > 20
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


def test_missing_nodes_are_an_error_and_empty_files_are_empty(spark, tmp_path):
    (tmp_path / "gap.osm").write_text(STREET.replace("42432093", "7", 1))
    with pytest.raises(Exception, match="no node 42432093"):
        scan.whole_second_arcs(*scan.scan_osm(spark, str(tmp_path / "gap.osm")), "car").count()
    (tmp_path / "none.osm").write_text("")
    nodes, ways = scan.scan_osm(spark, str(tmp_path / "none.osm"))
    assert nodes.isEmpty() and ways.isEmpty() and scan.whole_second_arcs(nodes, ways, "car").isEmpty()
