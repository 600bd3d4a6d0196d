"""Stored heat maps: rasters level by level, tiles, requests, pages."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waynet.operators import heat_tiles, raster

DDL = "dataset string, lat double, lon double, heat double"
LEVELS = [(9, 0.0, 0.0, 10.0, 10.0, 11), (10, 0.0, 0.0, 10.0, 10.0, 41), (11, 0.0, 0.0, 10.0, 10.0, 161)]


@pytest.fixture(scope="module")
def heat(spark):
    rng = np.random.default_rng(5)
    rows = [(name, float(a), float(o), float(h)) for name, n in (("a", 900), ("7", 300)) for a, o, h in zip(rng.uniform(40, 60, n), rng.uniform(-8, 9, n), rng.integers(1, 9, n))]
    return spark.createDataFrame([*rows, ("flat", 50.0, 3.0, 2.0), ("flat", 50.0, 4.0, 5.0), (None, 1.0, 1.0, 1.0), ("a", None, 1.0, 1.0)], DDL)


def level_by_hand(points, extent, step):
    """One raster, point by point."""
    south, west, north, east = extent
    count = math.ceil((north - south + step) / step)
    step = (north - south) / (count - 1) if count > 1 else step
    metres = lambda la, lo, lb, l2: 2 * math.asin(math.sqrt(math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(l2 - lo) / 2) ** 2))
    wide = metres(north, 0, north - step, 0) / metres(north, 0, north, 1)
    south0, west0 = (math.floor(south / step) - 0.5) * step, (math.floor(west / wide) - 0.5) * wide
    east1, out = east + 0.5 * wide, {}
    width = (east1 - west0) / math.ceil((east1 - west0) / wide)
    for lat, lon, h in points:
        if south0 <= lat <= north + 0.5 * step and west0 <= lon < east1:
            key = math.floor((lat + 0.5 * step - south0) / step), math.floor((lon + 0.5 * wide - west0) / wide)
            out[key] = out.get(key, 0.0) + h
    return [(south0 + y * step, west0 + x * width, h) for (y, x), h in out.items()], step


def test_each_level_is_made_of_the_finer_one(spark, heat):
    found = heat_tiles.zoom_rasters(heat, LEVELS).collect()
    for name in ("a", "7", "flat"):
        points = [(r["lat"], r["lon"], r["heat"]) for r in heat.collect() if r["dataset"] == name and r["lat"] is not None]
        extent = min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)
        for zoom, south, _, north, _, rows in reversed(LEVELS):
            points, step = level_by_hand(points, extent, (north - south) / (rows - 1))
            own = [r for r in found if r["dataset"] == name and r["zoom"] == zoom]
            assert {round(r["lat_step"], 9) for r in own} == {round(step, 9)}
            assert sorted((round(r["lat"], 6), round(r["lon"], 6), r["heat"]) for r in own) == sorted((round(a, 6), round(o, 6), h) for a, o, h in points)


def test_many_boxes_meet_by_a_shuffle(heat, monkeypatch):
    before = sorted(map(tuple, heat_tiles.zoom_rasters(heat, LEVELS[:1]).collect()))
    monkeypatch.setattr(heat_tiles, "BROADCAST_BOXES", 0)
    assert sorted(map(tuple, heat_tiles.zoom_rasters(heat, LEVELS[:1]).collect())) == before


def files_read(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_requests_read_the_files_of_their_box(spark, heat, tmp_path, monkeypatch):
    monkeypatch.setattr(heat_tiles, "TILE", 8)
    path = str(tmp_path / "tiles")
    rasters = heat_tiles.zoom_rasters(heat, LEVELS)
    heat_tiles.save_tiles(rasters, path)
    rows = rasters.collect()
    box = (47.0, -2.0, 48.0, 1.0)
    for name, zoom, stored in (("a", 11, 11), ("7", 10, 10), ("a", 3, 9), ("7", 30, 11)):
        own = [r for r in rows if r["dataset"] == name and r["zoom"] == stored]
        near = [r for r in own if box[0] <= r["lat"] <= box[2] and box[1] <= r["lon"] <= box[3]]
        found = heat_tiles.request(spark, path, name, zoom, box)
        assert sorted((r["lat"], r["lon"], r["heat"]) for r in found.collect()) == sorted((r["lat"], r["lon"], r["heat"]) for r in near)
        whole = heat_tiles.request(spark, path, name, zoom)
        assert whole.count() == len(own)
        head = heat_tiles.header(spark, path, name, zoom, box).first()
        middle = raster.middle_heat(spark.createDataFrame([(r["dataset"], r["lat"], r["lon"], r["heat"]) for r in own], DDL), ["lat", "lon"]).first()["max"]
        assert tuple(head) == (name, stored, len(near), middle, own[0]["lat_step"] / 2)
        assert heat_tiles.header(spark, path, name, zoom).first()["datacount"] == len(own)
        tiles = {(r["ty"], r["tx"]): r["n"] for r in heat_tiles.tiles_of(spark, path, name, zoom, box).collect()}
        assert {(r["ty"], r["tx"]) for r in found.collect()} <= set(tiles) and sum(tiles.values()) >= len(near)
    narrow, whole = heat_tiles.request(spark, path, "a", 11, box), heat_tiles.request(spark, path, "a", 11)
    everything = len(list((tmp_path / "tiles" / "points").rglob("*.parquet")))
    assert files_read(narrow) * 3 <= files_read(whole) < everything


def test_pages_hold_a_tile_each_in_order(spark, heat, tmp_path, monkeypatch):
    monkeypatch.setattr(heat_tiles, "TILE", 8)
    path = str(tmp_path / "tiles")
    heat_tiles.save_tiles(heat_tiles.zoom_rasters(heat, LEVELS[:2]), path)
    found = heat_tiles.request(spark, path, "a", 10)
    told = []
    for page in heat_tiles.pages(found).collect():
        points = [tuple(map(float, p.split(","))) for p in page["points"].split(";")]
        assert len(points) == page["n"] and [p[:2] for p in points] == sorted(p[:2] for p in points)
        told += points
    assert sorted(told) == sorted((round(r["lat"], 7), round(r["lon"], 7), round(r["heat"], 1)) for r in found.collect())


def test_unknown_datasets_and_empty_stores(spark, heat, tmp_path):
    heat_tiles.save_tiles(heat_tiles.zoom_rasters(heat, LEVELS[:1]), str(tmp_path / "a"))
    assert heat_tiles.request(spark, str(tmp_path / "a"), "none", 9).count() == 0
    assert heat_tiles.header(spark, str(tmp_path / "a"), "none", 9).count() == 0
    assert heat_tiles.tiles_of(spark, str(tmp_path / "a"), "none", 9, (0, 0, 90, 90)).count() == 0
    assert heat_tiles.zoom_rasters(heat.limit(0), LEVELS).count() == 0
    with pytest.raises(ValueError):
        heat_tiles.zoom_rasters(heat, [LEVELS[0], LEVELS[0]])


def test_points_without_heat_leave_no_raster(spark):
    none = spark.createDataFrame([("a", 1.0, 2.0, 0.0), ("a", 3.0, 2.0, None)], DDL)
    assert heat_tiles.zoom_rasters(none, LEVELS).agg(F.count(F.lit(1))).first()[0] == 0
