"""A map file end to end."""

import pytest
from pyspark.sql import functions as F

from waynet.plans import extract

#: The fixed sample: a track 5-6-7 that leaves a forest, whose ring isn't closed, and a relation whose ways are missing.
SAMPLE = """<osm version="0.6">
<node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="2"/><node id="3" lat="2" lon="0"/><node id="4" lat="2" lon="2"/>
<node id="5" lat="1" lon="1"/><node id="6" lat="1" lon="3"/><node id="7" lat="3" lon="1"/><node id="42" lat="3.5" lon="3.5"/>
<way id="90"><nd ref="5"/><nd ref="6"/><nd ref="7"/><tag k="highway" v="track"/></way>
<way id="91"><nd ref="1"/><nd ref="2"/><nd ref="4"/><nd ref="3"/><tag k="landuse" v="forest"/></way>
<relation id="3148652"><member type="way" ref="233853233" role="outer"/><member type="way" ref="84130213" role="inner"/><tag k="landuse" v="forest"/><tag k="type" v="multipolygon"/></relation>
</osm>"""

#: A forest of two ways, the second turned round, with a glade; an area around it; a bench off the roads; a road through all of it.
RINGS = """<osm version="0.6">
<node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="8"/><node id="3" lat="8" lon="8"/><node id="4" lat="8" lon="0"/>
<node id="11" lat="3" lon="3"/><node id="12" lat="3" lon="5"/><node id="13" lat="5" lon="5"/><node id="14" lat="5" lon="3"/>
<node id="21" lat="4" lon="1"/><node id="22" lat="4" lon="4"/><node id="23" lat="4" lon="9"/><node id="30" lat="6" lon="6"><tag k="amenity" v="bench"/></node>
<way id="50"><nd ref="1"/><nd ref="2"/><nd ref="3"/></way><way id="51"><nd ref="1"/><nd ref="4"/><nd ref="3"/></way>
<way id="52"><nd ref="11"/><nd ref="12"/><nd ref="13"/><nd ref="14"/><nd ref="11"/></way>
<way id="60"><nd ref="21"/><nd ref="22"/><nd ref="23"/><tag k="highway" v="path"/></way>
<way id="61"><nd ref="21"/><nd ref="23"/><tag k="highway" v="corridor"/></way>
<relation id="7"><member type="way" ref="50" role="outer"/><member type="way" ref="52" role="inner"/><member type="way" ref="51" role="outer"/><tag k="natural" v="wood"/></relation>
<relation id="8"><member type="way" ref="50" role="outer"/><member type="way" ref="51" role="outer"/><tag k="type" v="boundary"/><tag k="name" v="Hall"/><tag k="admin_level" v="8"/><tag k="wikipedia" v="de:Bad Hall"/></relation>
<relation id="9"><member type="way" ref="50" role="outer"/><tag k="type" v="boundary"/><tag k="name" v="no level"/></relation>
</osm>"""


def _read(spark, tmp_path, content):
    (tmp_path / "map.osm").write_text(content)
    return extract.read_map(spark, str(tmp_path / "map.osm"), size=0.5)


def test_sample(spark, tmp_path):
    got = _read(spark, tmp_path, SAMPLE)
    assert sorted((r["node"], r["node_id"], r["flag"]) for r in got.nodes.collect()) == [(0, 5, 1), (1, 6, 2), (2, 7, 0)]
    arcs = {(r["source"], r["target"]): r for r in got.arcs.collect()}
    assert set(arcs) == {(0, 1), (1, 0), (1, 2), (2, 1)}
    assert arcs[0, 1]["seconds"] == pytest.approx(arcs[0, 1]["metres"] / (30 / 3.6))
    assert [(r["of"], r["id"], len(r["ring"])) for r in got.forests.collect()] == [("way", 91, 4)]
    assert got.areas.isEmpty() and got.pois.isEmpty()


def test_rings_glades_areas_and_points(spark, tmp_path):
    got = _read(spark, tmp_path, RINGS)
    assert {r["node_id"]: r["flag"] for r in got.nodes.collect()} == {21: 1, 22: 2, 23: 0, 30: 1}
    assert {(r["id"], r["role"]): len(r["ring"]) for r in got.forests.collect()} == {(7, "outer"): 6, (7, "inner"): 5}
    rows = extract.community_rows(got.areas).collect()
    assert [(r["admin_level"], r["name"], r["wiki"], r["osm"]) for r in rows] == [("8", "Hall", "https://de.wikipedia.org/wiki/Bad_Hall", "https://www.openstreetmap.org/relation/8")]
    assert [(r["node"], r["node_id"], r["category"]) for r in got.pois.collect()] == [(3, 30, 2)]
    assert got.arcs.count() == 4


def test_a_node_with_the_id_of_a_way_keeps_its_category(spark, tmp_path):
    """Node 60, a bench off the roads, and way 60, the road; an artwork that is a way marks its nodes as before."""
    artwork = '<way id="70"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="tourism" v="artwork"/></way>'
    got = _read(spark, tmp_path, RINGS.replace('"30"', '"60"').replace("<relation", artwork + "<relation", 1))
    found = {r["node_id"]: r["category"] for r in got.pois.collect()}
    assert set(found) == {1, 2, 3, 60} and found[60] == 2


def test_entries_and_parking_meet_both_graphs(spark):
    at = lambda rows, key: spark.createDataFrame(rows, f"{key} long, x double, y double")
    entries, parking = at([(5, 0.0, 0.0), (3, 4.0, 0.0)], "id"), at([(1, 9.0, 9.0)], "id")
    road, forest = at([(10, 0.0, 1.0), (11, 8.0, 8.0)], "node_id"), at([(20, 4.0, 1.0), (21, 0.1, 0.0)], "node_id")
    got = sorted(tuple(r) for r in extract.match_entries(entries, parking, road, forest).collect())
    assert got == [(0, 4.0, 0.0, 10, 20), (1, 0.0, 0.0, 10, 21), (2, 9.0, 9.0, 11, -1)]


def test_empty_map(spark, tmp_path):
    got = _read(spark, tmp_path, "<osm></osm>")
    assert all(t.select(F.count(F.lit(1))).first()[0] == 0 for t in (got.nodes, got.arcs, got.forests, got.areas, got.pois))
