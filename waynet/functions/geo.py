"""Column expressions: distances, travel times, preference lookups, tag rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius in metres, and bounds of zoom levels.
EARTH_RADIUS = 6371000.785
LEAST_ZOOM, MOST_ZOOM = 5, 14
#: The tags of points of interest.
POI_TAGS = {
    "tourism": ["viewpoint", "attraction", "artwork", "picnic_site"],
    "natural": ["peak", "spring"],
    "amenity": ["place_of_worship", "restaurant", "bar", "shelter", "bench", "drinking_water", "bbq", "biergarten", "cafe", "fountain", "pub"],
    "leisure": ["playground", "miniature_golf", "nature_reserve", "swimming_pool", "water_park", "park", "garden"],
    "fireplace": ["yes"],
    "beer_garden": ["yes"],
    "man_made": ["tower", "bridge"],
    "historic": ["memorial", "castle"],
    "waterway": ["stream", "river", "riverbank"],
    "water": ["river", "lake"],
}


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    a, b = F.sin((q - p) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(a * a + F.cos(p) * F.cos(q) * b * b))


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def travel_seconds(metres: Column, speed: Column, most: Column) -> Column:
    """Seconds for a distance at the lesser of two speeds in km/h."""
    return metres / (F.least(speed, most) / 3.6)


def bucket(cost: Column, bounds: list[float]) -> Column:
    """The first bucket whose bound is not below the cost; past the last an error."""
    found = sum(((cost > b).cast("int") for b in bounds), F.lit(0))
    return F.when(found < len(bounds), found).otherwise(F.raise_error(F.lit("cost beyond the last bound")).cast("int"))


def share_of(cost: Column, prefs: list[tuple[float, float]]) -> Column:
    out = F.lit(None).cast("double")
    for bound, share in reversed(prefs):
        out = F.when(cost <= bound, F.lit(share)).otherwise(out)
    return out


def suffix_prefs(prefs: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Every bound with the sum of its and all later shares."""
    return [(b, sum(s for _, s in prefs[i:])) for i, (b, _) in enumerate(prefs)]


def check_preferences(prefs: list[tuple[float, float]]) -> None:
    """Bounds must ascend strictly, shares lie in 0 to 1 and sum to at most 1."""
    bounds = [b for b, _ in prefs]
    if any(a >= b for a, b in zip(bounds, bounds[1:])) or any(not 0 <= s <= 1 for _, s in prefs) or sum(s for _, s in prefs) >= 1.0000001:
        raise ValueError("invalid preferences")


def poi_category(key: Column, value: Column) -> Column:
    return F.when((key == "amenity") | (value == "viewpoint"), 2).when(value.isin("castle", "tower"), 3).otherwise(1)


def is_point_of_interest(key: Column, value: Column) -> Column:
    return F.concat_ws("=", key, value).isin([f"{k}={v}" for k, values in POI_TAGS.items() for v in values])


def has_tag(tags: Column, key: str, value: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)) == value, F.lit(False))


def is_forest(tags: Column) -> Column:
    return has_tag(tags, "landuse", "forest") | has_tag(tags, "natural", "wood")


def differ(a: Column, b: Column, part: float = 0.01) -> Column:
    """Whether b is off a by more than that part of a."""
    return F.abs(a - b) > F.abs(part * a)


def query_pairs(query: Column) -> Column:
    """The pairs of `a=b&c=d` as a map."""
    return F.str_to_map(query, F.lit("&"), F.lit("="))


def zoom_index(level: Column) -> Column:
    return F.least(F.greatest(level, F.lit(LEAST_ZOOM)), F.lit(MOST_ZOOM)) - LEAST_ZOOM


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over an array of (x, y)."""

    def crosses(p, i):
        q = F.get(ring, (i + 1) % F.size(ring))
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])

    return F.size(F.filter(ring, crosses)) % 2 == 1
