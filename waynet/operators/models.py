"""Popularity of entry points and attractiveness of path segments."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.functions.geo import bucket, check_preferences, share_of, suffix_prefs
from waynet.operators.around import reach_of_entries, ways_around
from waynet.operators.graph import contract_chains
from waynet.operators.search import CELL, shortest_paths
from waynet.plans.iterate import cut, running_total
from waynet.sources.sinks import expand_results

#: Cyclists reach this many times as far, and the parts of the people who cycle and walk.
BIKE_FACTOR, SHARE_CYCLING, SHARE_WALKING = 4, 13 / 124, 71 / 124


def normalize_contributions(contrib: DataFrame) -> DataFrame:
    """entry, element, value, each value divided by its entry's largest, if that is above 0."""
    most = F.max("value").over(Window.partitionBy("entry"))
    return contrib.select("entry", "element", F.when(most > 0, F.col("value") / most).otherwise(F.col("value")).alias("value"))


def distribute(contrib: DataFrame, populations: DataFrame, elements: DataFrame) -> DataFrame:
    """element and the sum of value times the entry's population; 0 where nothing contributes."""
    out = contrib.join(populations, "entry").groupBy("element").agg(F.sum(F.col("value") * F.col("population")).alias("total"))
    return elements.select("element").join(out, "element", "left").select("element", F.coalesce("total", F.lit(0.0)).alias("total"))


def node_weights(arcs: DataFrame) -> DataFrame:
    ends = arcs.select(F.col("source").alias("node"), "weight").unionByName(arcs.select(F.col("target").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.max("weight").alias("weight"))


def flooding(arcs: DataFrame, entries: DataFrame, prefs: list[tuple[float, float]], max_cost: int, cell: int = CELL, cells: DataFrame | None = None) -> DataFrame:
    """source, target, cost, weight, value: users spread from entries (node, population), weighed by node weight, time and share.

    Of repeated entries the one with the largest population counts.
    """
    check_preferences(prefs)
    entries = entries.groupBy("node").agg(F.max("population").alias("population"))
    seeds = entries.select(F.col("node").alias("search_id"), "node")
    reached = shortest_paths(arcs, seeds, int(max_cost) // 2, cell=cell, cells=cells).join(node_weights(arcs), "node")
    cost = F.greatest(F.col("cost"), F.lit(1))
    share = F.coalesce(share_of(2 * cost, suffix_prefs(prefs)), F.lit(0.0))
    contrib = reached.select(F.col("search_id").alias("entry"), F.col("node").alias("element"), (F.col("weight") * share / (cost + 60)).alias("value")).where("value <> 0")
    nodes = arcs.select(F.col("source").alias("element")).unionByName(arcs.select(F.col("target").alias("element"))).distinct()
    total = distribute(normalize_contributions(contrib), entries.select(F.col("node").alias("entry"), "population"), nodes)
    s, t = (total.select(F.col("element").alias(c), F.col("total").alias(f"{c}_value")) for c in ("source", "target"))
    return arcs.join(s, "source").join(t, "target").select("source", "target", "cost", "weight", (F.col("source_value") + F.col("target_value")).alias("value"))


def via_edge(arcs: DataFrame, entries: DataFrame, prefs: list[tuple[float, float]], max_cost: int, cell: int = CELL, cells: DataFrame | None = None) -> DataFrame:
    """source, target, value: users who walk from entry to entry over an arc, compared with the direct way. One search for each entry."""
    check_preferences(prefs)
    weighted = arcs.where("weight > 0").groupBy("source", "target").agg(F.min("cost").alias("cost"), F.max("weight").alias("weight"))
    keyed = cut(weighted.withColumn("search_id", F.concat_ws("-", "source", "target")))
    homes = entries.select("node", "population")
    reach = reach_of_entries(arcs, entries, int(max_cost), cell, cells)
    around = cut(ways_around(arcs, _both_ways(keyed), reach, int(max_cost), "node"))
    sides = [around.select(F.col("x").alias(a), F.col("y").alias(b), F.col("entry").alias(f"fep_{side}"), F.col("cost").alias(f"cost_{side}")) for side, a, b in (("b", "source", "target"), ("f", "target", "source"))]
    direct = reach.join(homes.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("fep_b"), F.col("entry").alias("fep_f"), F.col("cost").alias("direct"))
    met = keyed.join(sides[0], ["source", "target"]).join(sides[1], ["source", "target"]).withColumn("round", F.col("cost_b") + F.col("cost") + F.col("cost_f")).where(F.col("round") <= max_cost)
    met = met.join(direct, ["fep_b", "fep_f"], "left")
    share = F.coalesce(share_of(F.col("round"), suffix_prefs(prefs)), F.lit(0.0))
    gain = F.when(F.col("fep_b") == F.col("fep_f"), share * 60 / (F.col("cost_f") + 60)).otherwise(share * (F.col("direct") + 60) / (F.col("round") + 60))
    contrib = met.withColumn("value", F.col("weight") * gain).where("value > 0").groupBy(F.col("fep_b").alias("entry"), F.col("search_id").alias("element")).agg(F.sum("value").alias("value"))
    total = distribute(normalize_contributions(contrib), homes.withColumnRenamed("node", "entry"), keyed.select(F.col("search_id").alias("element")))
    return keyed.join(total, F.col("search_id") == F.col("element")).select("source", "target", F.col("total").alias("value"))


def _both_ways(arcs: DataFrame) -> DataFrame:
    """x, y: the ends of all arcs, in either order."""
    return arcs.select(F.col("source").alias("x"), F.col("target").alias("y")).unionByName(arcs.select(F.col("target").alias("x"), F.col("source").alias("y"))).distinct()


def entry_popularity(paths: DataFrame, population: DataFrame, prefs: list[tuple[float, float]], share: float, strict: bool = True) -> DataFrame:
    """entry and raw popularity from paths (entry, pop, cost) and population (pop, population), for one way of travel.

    Counts of entries per bucket give each point's likelihoods; past the first pass the last bound itself is out if strict.
    """
    bounds = [b for b, _ in prefs]
    near = paths.where(F.col("cost") <= bounds[-1]).withColumn("b", bucket(F.col("cost"), bounds))
    bound = F.element_at(F.array(*map(F.lit, bounds)), F.col("b") + 1)
    total = F.sum(bound).over(Window.partitionBy("pop"))
    likely = F.when(bound < total, 1 - bound / total).otherwise(1.0 / ((F.col("b") + 1) * (F.col("b") + 1)))
    suffix = F.element_at(F.array(*(F.lit(s) for _, s in suffix_prefs(prefs))), F.col("b") + 1)
    scored = near.withColumn("likely", likely).where(F.col("cost") < bounds[-1] if strict else F.lit(True))
    raw = scored.join(population, "pop").groupBy("entry").agg(F.sum(F.col("likely") * suffix * F.col("population")).alias("raw"))
    reached = population.join(near.select("pop").distinct(), "pop", "left_semi").agg((F.sum("population") * share).alias("goal"))
    scale = raw.agg(F.sum("raw").alias("all_raw")).crossJoin(reached)  # one row
    return raw.crossJoin(scale).select("entry", F.when(F.col("all_raw") > 0, F.col("raw") * F.col("goal") / F.col("all_raw")).otherwise(0.0).alias("popularity"))


def _mode(paths: DataFrame, population: DataFrame, bounds: list[int], suffix: list[float], strict: bool, gated: DataFrame | None = None) -> DataFrame:
    """entry, pop, part: what each reached point sends to an entry by one way of travel; points outside `gated` weigh by raw counts."""
    near = paths.where(F.col("cost") <= bounds[-1]).withColumn("b", bucket(F.col("cost"), [float(b) for b in bounds]))
    bound = F.element_at(F.array(*map(F.lit, bounds)), F.col("b") + 1)
    counts = near.groupBy("pop", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(bound).alias("own"))
    total = counts.groupBy("pop").agg(F.sum("own").alias("total"))
    likely = F.when(bound < F.col("total"), 1 - bound / F.col("total")).otherwise(1.0 / ((F.col("b") + 1) * (F.col("b") + 1)))
    counts = counts.join(total, "pop")
    if gated is not None:
        counts = counts.join(gated.select("pop", F.lit(True).alias("gate")), "pop", "left")
        likely = F.when(F.col("gate"), likely).otherwise(F.col("n").cast("double"))
    counts = counts.select("pop", "b", likely.alias("likely"))
    share = F.element_at(F.array(*map(F.lit, suffix)), F.col("b") + 1)
    kept = near.where(F.col("cost") < bounds[-1]) if strict else near
    return kept.join(counts, ["pop", "b"]).join(population, "pop").select("entry", "pop", (F.col("likely") * share * F.col("population")).alias("part"))


def popularity(arcs: DataFrame, entries: DataFrame, population: DataFrame, lots: DataFrame | None, minutes: list[tuple[float, float]], walking: float = SHARE_WALKING, cycling: float = SHARE_CYCLING, cell: int = CELL, cells: DataFrame | None = None) -> DataFrame:
    """pos and population of entries (pos, node), then of parking lots (pos, rank), whose places follow the entries'.

    population is (pop, node, population), minutes the preferences (bound in minutes of walking, share). Cyclists' bounds
    are BIKE_FACTOR times as far. Points that reach an entry on neither way are spread over the entries in proportion,
    less the part of those who drive; drivers are shared out over the lots by rank. A point whom nobody reaches walking
    weighs its entries by the plain counts of its buckets. Without anyone mapped an entry gets 0.
    """
    check_preferences(minutes)
    bounds, driving = [int(60 * m) for m, _ in minutes], 1 - walking - cycling
    far = [BIKE_FACTOR * b for b in bounds]
    suffix = [s for _, s in suffix_prefs(minutes)]
    found = shortest_paths(arcs, entries.select(F.col("pos").alias("search_id"), "node"), far[-1], cell=cell, cells=cells)
    paths = cut(found.join(population.select("pop", "node"), "node").select(F.col("search_id").alias("entry"), "pop", "cost"))
    people = population.select("pop", "population")
    afoot = paths.where(F.col("cost") <= bounds[-1]).select("pop").distinct()
    modes = []
    for share, own in ((walking, _mode(paths, people, bounds, suffix, True)), (cycling, _mode(paths, people, far, suffix, False, afoot))):
        own = cut(own)
        reached = own.select("pop").distinct()
        goal = people.join(reached, "pop", "left_semi").agg((F.coalesce(F.sum("population"), F.lit(0.0)) * share).alias("goal"))
        raw = own.groupBy("entry").agg(F.sum("part").alias("raw"))
        scale = raw.agg(F.sum("raw").alias("all_raw")).crossJoin(goal)  # one row
        scaled = raw.crossJoin(scale).select("entry", F.when(F.col("all_raw") > 0, F.col("raw") * F.col("goal") / F.col("all_raw")).otherwise(0.0).alias("popularity"))
        modes.append((scaled, reached))
    (walkers, walk_reach), (cyclists, cycle_reach) = modes
    told = people.join(walk_reach.withColumn("walks", F.lit(True)), "pop", "left").join(cycle_reach.withColumn("cycles", F.lit(True)), "pop", "left")
    told = told.select("pop", "population", F.coalesce("walks", F.lit(False)).alias("walks"), F.coalesce("cycles", F.lit(False)).alias("cycles"))
    every = entries.select(F.col("pos").alias("entry"), F.lit(0.0).alias("popularity"))
    merged = cut(merge_popularity(walkers.unionByName(every), cyclists, told, walking, cycling, driving))
    out = merged.select(F.col("entry").cast("long").alias("pos"), F.col("popularity").alias("population"))
    if lots is None:
        return out
    cars = merged.agg(F.max("car_population").alias("cars"), F.count(F.lit(1)).alias("n"))  # one row
    ranks = lots.agg(F.sum("rank").alias("ranks"))  # one row
    part = F.col("cars") * F.col("rank") / F.when(F.col("ranks") == 0, 1.0).otherwise(F.col("ranks"))
    return out.unionByName(lots.crossJoin(ranks).crossJoin(cars).select((F.col("pos") + F.col("n")).alias("pos"), part.alias("population")))


def quota_gaps(shares: dict[str, float], counted: dict[str, float], total: float, most: float = 0.01) -> dict[str, bool]:
    """For every group whether its count is off its share of the total by more than that part."""
    return {k: abs(total * s - counted[k]) > abs(most * total * s) for k, s in shares.items()}


def observed(df: DataFrame, name: str, **sums: str) -> tuple[DataFrame, Observation]:
    """df, and the sums of columns (and the number of rows, as `rows`) that pass through it, known once an action on it has run.

    Nothing is computed for them alone, so they serve to check a model's totals against the quotas.
    """
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(k) for k, c in sums.items())), seen


def observed_gaps(seen: Observation, shares: dict[str, float], total: float, most: float = 0.01) -> dict[str, bool]:
    """quota_gaps of what was observed."""
    return quota_gaps(shares, {k: seen.get[k] for k in shares}, total, most)


APPROACHES = {0: "flooding", 1: "via_edge"}


def edge_attractiveness(nodes: DataFrame, arcs: DataFrame, entries: DataFrame, minutes: list[tuple[float, float]], approach: int, contract: bool = True) -> DataFrame:
    """element (arc_id) and value of all arcs (arc_id, source, target, cost, weight), by flooding (0) or via edges (1).

    Chains between entries (node, population) are contracted first, the nodes left are numbered anew, and an arc's value
    goes to all arcs that it represents. The limit is the last bound of minutes.
    """
    if approach not in APPROACHES:
        raise ValueError(f"unknown approach {approach}")
    prefs = [(60 * m, s) for m, s in minutes]
    kept = [F.col(c).cast("long").alias(c) for c in ("source", "target", "cost")]
    if contract:
        known = entries.select(F.col("node").cast("long").alias("node"), F.lit(True).alias("is_entry")).distinct()
        told = cut(nodes.select(F.col("node").cast("long")).join(known, "node", "left"))
        small = contract_chains(told.select("node").join(known, "node", "left"), arcs, F.col("is_entry").isNotNull())
    else:
        small = arcs.select(*kept, "weight", F.array(F.col("arc_id").cast("long")).alias("represented"))
    small = cut(small)
    ids = running_total(small.select(F.col("source").alias("node")).unionByName(small.select(F.col("target").alias("node"))).distinct(), ["node"], F.lit(1), "id")
    s, t = (ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")) for c in ("source", "target"))
    small = cut(small.join(s, "source").join(t, "target").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "cost", "weight", "represented"))
    homes = entries.join(ids, "node").select(F.col("id").alias("node"), "population")
    model = flooding if approach == 0 else via_edge
    valued = model(small.select("source", "target", "cost", "weight"), homes, prefs, int(prefs[-1][0])).groupBy("source", "target").agg(F.max("value").alias("value"))
    results = small.join(valued, ["source", "target"], "left").select(F.element_at("represented", 1).alias("pos"), F.element_at("represented", 1).alias("label"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return expand_results(results, small.select(F.element_at("represented", 1).alias("label"), F.col("represented").alias("ids")))


def distribute_by_rank(lots: DataFrame, population: float) -> DataFrame:
    """Each lot's part of a population by its rank; a rank sum of 0 counts as 1."""
    total = lots.agg(F.sum("rank").alias("ranks"))  # one row
    return lots.crossJoin(total).withColumn("population", F.lit(population) * F.col("rank") / F.when(F.col("ranks") == 0, 1).otherwise(F.col("ranks"))).drop("ranks")


def merge_popularity(walking: DataFrame, cycling: DataFrame, people: DataFrame, share_walking: float, share_cycling: float, share_car: float) -> DataFrame:
    """entry and popularity of walkers and cyclists together, and the number of car users beside every row.

    walking and cycling are (entry, popularity), people (pop, population, walks, cycles) says who reaches an entry. Those
    who don't are unmapped: the share of cars takes its part of them, the rest is spread in proportion to what is mapped.
    """
    lost = F.col("population") * (F.when(F.col("walks"), 0.0).otherwise(share_walking) + F.when(F.col("cycles"), 0.0).otherwise(share_cycling))
    sums = people.agg(F.coalesce(F.sum(lost), F.lit(0.0)).alias("unmapped"), F.coalesce(F.sum("population") * share_car, F.lit(0.0)).alias("by_car"))
    both = walking.unionByName(cycling).groupBy("entry").agg(F.sum("popularity").alias("own"))
    mapped = both.agg(F.sum("own").alias("mapped"))
    extra = F.when(F.col("mapped") > 0, F.col("own") / F.col("mapped") * (1 - share_car) * F.col("unmapped")).otherwise(0.0)
    cars = (F.col("by_car") + share_car * F.col("unmapped")).cast("long")
    return both.crossJoin(sums).crossJoin(mapped).select("entry", (F.col("own") + extra).alias("popularity"), cars.alias("car_population"))  # one row each


def split_evenly(reach: DataFrame, points: DataFrame, total: float) -> DataFrame:
    """entry and population: every point's equal part of the total, split evenly over the entries it reaches (pop, entry)."""
    count = points.agg(F.count(F.lit(1)).alias("points"))  # one row
    sizes = reach.groupBy("pop").agg(F.count(F.lit(1)).alias("n"))
    part = reach.join(sizes, "pop").crossJoin(count)
    return part.groupBy("entry").agg(F.sum(F.lit(total) / F.col("points") / F.col("n")).alias("population"))


def even_arc_weights(arcs: DataFrame, entries: DataFrame, limit: int, cell: int = CELL, cells: DataFrame | None = None) -> DataFrame:
    """source, target, value: each entry's population split evenly over its feasible trips (exit, arc).

    A trip is feasible if the ways from the arc's ends to entry and exit, which may not use the arc, and the arc
    itself cost at most the limit. entries are (node, population); arcs without a trip have no row. One search for each entry.
    """
    one = arcs.groupBy("source", "target").agg(F.min("cost").alias("cost"))
    around = cut(ways_around(arcs, _both_ways(one), reach_of_entries(arcs, entries, limit, cell, cells), limit, "arc"))
    sides = [around.select(F.col("x").alias(a), F.col("y").alias(b), F.col("entry").alias(name), F.col("cost").alias(f"{name}_cost")) for name, a, b in (("entry", "source", "target"), ("exit", "target", "source"))]
    trips = one.join(sides[0], ["source", "target"]).join(sides[1], ["source", "target"]).where(F.col("entry_cost") + F.col("cost") + F.col("exit_cost") <= limit)
    per_arc = cut(trips.groupBy("entry", "source", "target").agg(F.count(F.lit(1)).alias("k")))
    counts = per_arc.groupBy("entry").agg(F.sum("k").alias("n"))
    parts = counts.join(entries.withColumnRenamed("node", "entry"), "entry").select("entry", (F.col("population") / F.col("n")).alias("part"))
    return per_arc.join(parts, "entry").groupBy("source", "target").agg(F.sum(F.col("k") * F.col("part")).alias("value"))
