"""Speeds by kind of way, as column expressions over literal maps."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of OSM ways in the order of their ids, with km/h.
OSM_SPEEDS = {
    "motorway": 130, "motorway_link": 130, "trunk": 120, "trunk_link": 120, "primary": 120, "primary_link": 120,
    "secondary": 80, "secondary_link": 80, "tertiary": 80, "tertiary_link": 70, "unclassified": 50, "road": 50,
    "residential": 45, "living_street": 30, "service": 30, "track": 30, "path": 5, "unsurfaced": 30,
    "cycleway": 25, "bridleway": 5, "OTHER": 0, "footway": 5, "pedestrian": 5, "steps": 3,
}
#: km/h of cars, of walkers and of both on roads; kinds that are missing aren't used (0).
CAR_SPEEDS = {
    "motorway": 110, "trunk": 110, "primary": 70, "secondary": 60, "tertiary": 50, "motorway_link": 50, "trunk_link": 50,
    "primary_link": 50, "secondary_link": 50, "road": 40, "unclassified": 40, "residential": 30, "unsurfaced": 30,
    "living_street": 10, "service": 5,
}
_PATHS = {"track": 5, "footway": 5, "pedestrian": 5, "tertiary_link": 5, "path": 4, "steps": 3}
PROFILES = {
    "osm": OSM_SPEEDS,
    "car": CAR_SPEEDS,
    "walking": dict.fromkeys(CAR_SPEEDS, 5) | _PATHS,
    "road": CAR_SPEEDS | {"cycleway": 25, "bridleway": 5} | _PATHS,
}
#: km/h by official class of way, and the classes of large and of small roads.
CLASS_SPEEDS = {
    164001: 110, 164003: 70, 164005: 110, 164007: 70, 164009: 110, 164010: 70, 87001: 50, 87003: 5, 87004: 25, 88001: 25,
    89001: 25, 89002: 10, 90001: 110, 90003: 70, 90005: 110, 90007: 70, 90009: 110, 90010: 70, 90012: 50, 90014: 5,
    90015: 25, 90016: 25, 90017: 25, 90018: 10,
}
LARGE_ROADS = [(164001, 164011)]
SMALL_ROADS = [(87001, 87004), (89001, 89002), (90001, 90018)]


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain(*table.items()))), key)


def way_speed(way_type: Column, profile: str = "osm") -> Column:
    """km/h of a kind of way; 0 if the profile doesn't know it."""
    return F.coalesce(_lookup(PROFILES[profile], way_type), F.lit(0))


def way_type_id(way_type: Column) -> Column:
    """The place of a kind of way among OSM_SPEEDS, or null."""
    return _lookup({k: i for i, k in enumerate(OSM_SPEEDS)}, way_type)


def class_speed(way_class: Column, most: Column) -> Column:
    """km/h of an official class, at most `most`; an unknown class is an error."""
    known = _lookup(CLASS_SPEEDS, way_class)
    return F.when(known.isNotNull(), F.least(known, most)).otherwise(F.raise_error(F.concat(F.lit("unknown way class "), way_class.cast("string"))).cast("int"))


def is_road(way_class: Column, ranges: list[tuple[int, int]]) -> Column:
    found = F.lit(False)
    for first, last in ranges:
        found = found | way_class.between(first, last)
    return found


#: km/h of walkers, and the class of ways that name none (a pedestrian area).
WALKING_SPEED, PEDESTRIAN_AREA = 5, 87003


def tag_speed(tags: Column, profile: str = "osm") -> Column:
    """km/h by a way's tags: by its highway, else by its official class (KLASSE); null if it is no way for the profile."""
    by_kind = _lookup(PROFILES[profile], F.try_element_at(tags, F.lit("highway")))
    return F.coalesce(by_kind, _lookup(CLASS_SPEEDS, F.try_element_at(tags, F.lit("KLASSE")).try_cast("int")))


def is_walked(way_class: Column, most: float) -> Column:
    """Whether a way is used at that speed: walkers leave out large roads."""
    return ~(F.lit(most == WALKING_SPEED) & is_road(way_class, LARGE_ROADS))
