"""N-gram Jaccard join, aware of sizes: small sets by subsets, large ones by inverted lists.

A text's set holds the hashes of its distinct word shingles. Two sets link when
100 * intersection >= THRESHOLD * union. Texts with equal sets are one node of the graph.

Light sets have at most `boundary` shingles. Two light sets of given sizes link exactly if they
share a subset of the least intersection size, so each enumerates its subsets of the fixed
sizes that its partners' sizes ask for, and equal subsets are links. Any pair with a larger set
is found in inverted lists of the sets' prefixes: in an order common to all sets, the first
n - ceil(n * t) + 1 shingles of both must meet. The boundary is the size at which keys to enumerate and places to
scan together cost least, by the sizes of the sets and the lengths of the lists that a bounded sample shows.

The order puts shingles that are common in a sample of documents last; it is about cost
alone, and any order gives every link. The sample is a fixed part of the table, so that the count from which a shingle is
common, and with it the length of the other lists, doesn't grow with the table. Short lists give candidate pairs, which
an exact bound on the prefixes thins out before full sets are compared. Long lists are worked
in blocks: a first pass compares within blocks, a second one whatever is outside a list's main
component with all of the list, once for all lists of one main component where that is less work. Only links that join
components leave a block, so no group's pairs are written out.

A null text, and one without words, has an empty set and links with nothing. Rows of one id are
one node. Equal texts need no comparison. Sets that more than their part of all rows share are
joined by a broadcast of a bounded size, so no task meets a large group of copies. An empty table gives an empty result.
Columns besides the id and the text are not read. A text is worked as a whole, in arrays some 40 times its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.llm.common import discard, is_hot, join_split, materialize, released, settings, slices, whole_text

WORDS, THRESHOLD = 4, 85
#: Least rows of the sample that tells common shingles and one in how many rows it has at least, the count from which one is common, and the most of them.
SAMPLE_ROWS, SAMPLE_PART, COMMON_FROM, MOST_COMMON = 20_000, 8, 3, 1 << 19
#: Texts of the sample whose shingles one group counts, and shingles that a task holds before it passes them on.
COUNTED_ROWS, HELD = 1000, 1 << 20
#: Rows of a list up to which its pairs are candidates, and rows of a block of longer ones.
SHORT_LIST, BLOCK_ROWS = 128, 128
#: Ids of documents to compare are broadcast up to this many (8 MB); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Rows that pass to Python at once; texts may be long.
ROWS_AT_ONCE = 1000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]  # A-Z as a-z
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return values, space


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes of a slice of texts; powers grow with the longest slice."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.values, self.space = _tables()
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = 1 << max(12, n.bit_length())
        step = np.full(size, _ODD)
        step[0] = 1
        self.powers = np.cumprod(step)
        step[1:] = np.uint64(pow(int(_ODD), -1, 1 << 64))
        self.inverse = np.cumprod(step)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(data)
        if n > len(self.powers):
            self._grow(n)
        solid = ~self.space[data]
        inner = np.ones(n + 1, bool)
        inner[offsets] = False
        starts = np.flatnonzero(solid & ~(np.concatenate(([False], solid[:-1])) & inner[:-1])) if n else np.zeros(0, np.int64)
        ends = np.flatnonzero(solid & ~(np.concatenate((solid[1:], [False])) & inner[1:])) + 1 if n else np.zeros(0, np.int64)
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.powers[:n], dtype=np.uint64)))
        word = _mixed((running[ends] - running[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        total = np.zeros(len(word), np.uint64)
        padded = np.concatenate((word, np.zeros(self.words, np.uint64)))
        for k in range(self.words):
            total = total * np.uint64(0xD6E8FEB86659FD93) + padded[k : k + len(word)]
        total = _mixed(total).view(np.int64)
        first = np.searchsorted(starts, offsets)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= self.words:
                out.append(np.unique(total[a : b - self.words + 1]))
            elif b > a:  # the whole sequence is one shingle, told from longer ones by its length
                h = np.array([b - a], np.uint64)
                for w in word[a:b]:
                    h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + w)
                out.append(h.view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
        return out


def least_overlap(s: int, t: int, threshold: int = THRESHOLD) -> int:
    """The least intersection of linked sets of s and t shingles."""
    return -(-threshold * (s + t) // (100 + threshold))


def prefix_size(s: int, threshold: int = THRESHOLD) -> int:
    return s - -(-threshold * s // 100) + 1


def subset_sizes(s: int, boundary: int, threshold: int = THRESHOLD) -> list[tuple[int, int, int]]:
    """(size of the smaller set, of the larger, of the subset) for all light partners of a set of s."""
    low, high = -(-threshold * s // 100), min(boundary, 100 * s // threshold)
    return [(min(s, t), max(s, t), least_overlap(s, t, threshold)) for t in range(max(1, low), high + 1)]


@lru_cache(256)
def _choices(s: int, o: int) -> np.ndarray:
    """All subsets of o of s places."""
    return np.array(list(combinations(range(s), o)))


def choose_boundary(sizes: dict[int, int], met: float, threshold: int = THRESHOLD, most: int = 16) -> int:
    """The boundary of least cost, for so many sets of each size and so many sets that a prefix shingle meets in its list.

    An enumerated key costs a row and the hashes of its shingles, a prefix shingle a row and half a row for each that it
    meets. Only sets that may have a partner above the boundary need a prefix.
    """

    def cost(boundary: int) -> float:
        keys = sum(n * comb(s, o) * (1 + o / 8) for s, n in sizes.items() if s <= boundary for _, _, o in subset_sizes(s, boundary, threshold))
        places = sum(n * prefix_size(s, threshold) * (1 + met / 2) for s, n in sizes.items() if 100 * s > threshold * boundary)
        return keys + places

    return min(range(most + 1), key=cost)


def _mark(h: np.ndarray) -> np.ndarray:
    """What of a shingle's hash tells whether it is common."""
    return (h.view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _common(rows: DataFrame) -> tuple[np.ndarray, dict[int, int], float]:
    """Of a sample: sorted marks of shingles that COMMON_FROM texts or more hold, sets by size, and sets that a shingle meets in a list of the whole table.

    Shingles are counted by ranges of their hashes, as arrays.
    """
    total = rows.count()
    share = min(1.0, max(SAMPLE_ROWS, total / SAMPLE_PART) / max(1, total))
    parts = max(32, int(share * total) // COUNTED_ROWS)
    unit = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 40)) / float(1 << 40)

    def dealt(sets: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(sets)
        key, n = np.unique((h.view(np.uint64) % np.uint64(parts) << np.uint64(32)) | _mark(h), return_counts=True)
        at = np.searchsorted(key, np.arange(1, parts, dtype=np.uint64) << np.uint64(32))
        size, m = np.unique([len(x) for x in sets], return_counts=True)
        value, n = [np.split(key.astype(np.uint32), at) + [size.astype(np.uint32)], np.split(n.astype(np.uint32), at) + [m.astype(np.uint32)]]
        return pa.RecordBatch.from_arrays([pa.array([*range(parts), -1], pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (value, n))], names=["part", "value", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held = Shingler(), []
        for _, data, offsets in slices(batches, "text"):
            held += shingler.sets(data, offsets)
            if sum(map(len, held)) >= HELD:
                yield dealt(held)
                held = []
        if held:
            yield dealt(held)

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        value, n = (np.concatenate([np.frombuffer(x, np.uint32) for x in pdf[c]]) for c in ("value", "n"))
        h, at = np.unique(value, return_inverse=True)
        n = np.bincount(at, weights=n, minlength=len(h)).astype(np.int64)
        if pdf["part"].iloc[0] < 0:
            return pd.DataFrame({"kind": "size", "h": h.astype(np.int64), "n": n})
        often = n >= COMMON_FROM
        rest = pd.DataFrame({"kind": ["met", "rare"], "h": 0, "n": [int((n * (n - 1))[~often].sum()), int(n[~often].sum())]})
        return pd.concat([pd.DataFrame({"kind": "h", "h": h[often].astype(np.int64), "n": n[often]}), rest])

    # Equal texts are one node of the graph, so they count once.
    sample = rows.where(unit < share).select("text").distinct().mapInArrow(released(counted), "part int, value binary, n binary")
    counts = materialize(sample.groupBy("part").applyInPandas(totals, "kind string, h bigint, n bigint"), "jaccard-sample")
    found = counts.where("kind = 'h'").orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toPandas()
    sizes = {r["h"]: r["n"] for r in counts.where("kind = 'size' AND h > 0").collect()}  # as many as sets of the sample have sizes
    short, rare = counts.select(F.sum(F.when(F.col("kind") == "met", F.col("n"))), F.sum(F.when(F.col("kind") == "rare", F.col("n")))).first()
    discard(rows.sparkSession, counts)
    return np.unique(found["h"].to_numpy(dtype=np.uint32)), sizes, min(float(SHORT_LIST), (short or 0) / max(1, rare or 0) / share)


def _is_common(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(own), bool)
    mark = _mark(own)
    return common[np.minimum(np.searchsorted(common, mark), len(common) - 1)] == mark


def _set_rows(rows: DataFrame, common, boundary: int) -> DataFrame:
    """doc_id, n, h1 and h2 (digest of the set), keys (subsets of a light set), prefix and n_common (of a set with heavy partners)."""
    shared = rows.sparkSession.sparkContext.broadcast(common)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("n_common", pa.int32())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known = Shingler(), shared.value
        for part, data, offsets in slices(batches, "text"):
            columns: list[list] = [[], [], [], [], [], []]
            for own in shingler.sets(data, offsets):
                s = len(own)
                u = own.view(np.uint64)
                keys, prefix, n_common = [], np.zeros(0, np.int64), 0
                if 0 < s <= boundary:
                    for low, high, o in subset_sizes(s, boundary):
                        chosen = u[_choices(s, o)]
                        h = np.full(len(chosen), low * 1000 + high, np.uint64)
                        for k in range(o):
                            h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + chosen[:, k])
                        keys += h.view(np.int64).tolist()
                if 100 * s > THRESHOLD * boundary:
                    p = prefix_size(s)
                    hot = _is_common(own, known)
                    prefix = np.concatenate((own[~hot][:p], own[hot][:p]))[:p]
                    n_common = max(0, p - int((~hot).sum()))
                for column, value in zip(columns, (s, int(np.bitwise_xor.reduce(_mixed(u)).view(np.int64)) if s else 0, int(_mixed(u * _ODD).sum(dtype=np.uint64).view(np.int64)) if s else 0, keys, prefix, n_common)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return rows.mapInArrow(released(made), "doc_id bigint, n int, h1 bigint, h2 bigint, keys array<bigint>, prefix array<bigint>, n_common int")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of edges (a, b): labels meet by large-star and small-star rounds."""
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = -1
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a node points to the least of the node and its neighbours.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: the smaller neighbours of a node, and itself, point to the least.
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = materialize(small, "edges")
        discard(edges.sparkSession, now)
        state = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now = small
        if tuple(state) == seen:
            break
        seen = tuple(state)
    label = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label.unionByName(label.select(F.col("component").alias("node"), "component").distinct())


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < THRESHOLD * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= THRESHOLD * (len(a) + len(b) - shared)


def _block_links(ids: np.ndarray, sets: list[np.ndarray], group: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows `first` and rows `second` that join different groups; groups merge as links are found."""
    group = group.copy()
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sizes = np.array([len(x) for x in sets])
    met = counts > 1  # other shingles can't be shared
    place, seen = np.cumsum(met) - 1, met[codes]
    holds = np.zeros((len(sets), int(met.sum())), np.float32)
    holds[np.repeat(np.arange(len(sets)), sizes)[seen], place[codes[seen]]] = 1
    out = []
    for i in first.tolist():
        js = second[(second != i) & (group[second] != group[i])]
        if not len(js):
            continue
        shared = holds[js] @ holds[i]
        for j in js[100 * shared >= THRESHOLD * (sizes[js] + sizes[i] - shared)].tolist():
            if group[i] != group[j]:
                out.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return out


def _compare(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Joining links of each group of rows (id, set, component, wanted): rows that are wanted against all of the group."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("wanted", ascending=False).drop_duplicates("id")
        wanted = np.flatnonzero(pdf["wanted"].to_numpy())
        sets = [np.asarray(s, np.int64) for s in pdf["set"]]
        found = _block_links(pdf["id"].to_numpy(), sets, pdf["component"].to_numpy(), wanted, np.arange(len(pdf))) if len(wanted) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return groups.groupBy(*keys).applyInPandas(links, "a bigint, b bigint")


def _full_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and whole set of the wanted ids."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part, data, offsets in slices(batches, "text"):
            sets = shingler.sets(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    ids = materialize(wanted.select(F.col("id").alias("doc_id")).distinct(), "jaccard-ids")
    chosen = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = materialize(chosen.mapInArrow(released(made), "id bigint, set array<bigint>"), "jaccard-sets")
    discard(rows.sparkSession, ids)
    return sets


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id, the least doc_id reachable by links."""
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS_AT_ONCE)}):
        return _joined(docs, id_col, text_col)


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    common, sizes, met = _common(rows)
    boundary = choose_boundary(sizes, met)
    known = materialize(_set_rows(rows, common, boundary), "jaccard-keys")
    digest = ["h1", "h2", "n"]
    nodes = known.groupBy(*digest).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m"))
    nodes = nodes.select(*digest, F.when(F.col("n") > 0, F.col("least")).alias("node"), is_hot(F.col("m"), known.count()).alias("hot"))
    nodes = materialize(nodes, "jaccard-digests")
    member = join_split(known.select("doc_id", *digest), nodes, nodes.where("hot"), digest).select("doc_id", "n", "node")
    member = materialize(member, "jaccard-members")
    own = known.join(member.where("doc_id = node").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    own = materialize(own.select(F.col("doc_id").alias("id"), "n", "keys", "prefix", "n_common"), "jaccard-nodes")
    discard(docs.sparkSession, known)

    # Light sets: an equal subset is a link; a key's sets hang on its least one.
    keyed = own.select("id", F.explode("keys").alias("key"))
    hub = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    light = keyed.join(hub, "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()

    # Heavy sets: inverted lists of prefixes. Those of common shingles are long lists from the start.
    n_rare = F.size("prefix") - F.col("n_common")
    rare = own.select("id", "n", F.explode(F.slice("prefix", F.lit(1), n_rare)).alias("key"))
    rare = rare.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("m > 1")
    rare = materialize(rare.select("key", "id", "n", "m"), "jaccard-lists")
    common = own.select("id", "n", F.explode(F.slice("prefix", n_rare + 1, F.col("n_common"))).alias("key"))
    sized = common.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    common = materialize(common.join(sized, "key").select("key", "id", "n", "m"), "jaccard-common")
    listed = rare.unionByName(common)
    prefix = F.col("n") - F.ceil(F.lit(THRESHOLD) * F.col("n") / 100) + 1
    short = listed.where(F.col("m") <= SHORT_LIST).withColumn("p", prefix.cast("int"))
    long_rows = listed.where(F.col("m") > SHORT_LIST)

    # Candidate pairs of short lists. If x's prefix ends first, all the pair share up to there is counted in
    # lists, and only x's remaining shingles may add to it; keys of long lists are granted to the pair.
    lists = short.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "n", "p"))).alias("l"))
    fits = lambda x, y: F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * THRESHOLD
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.filter(F.slice("l", i + 2, F.size("l")), lambda y: fits(x, y)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = lists.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("met")).select("pair.x", "pair.y", "met")
    granted = long_rows.groupBy("id").agg(F.count(F.lit(1)).alias("granted"))
    for side in ("x", "y"):
        pairs = pairs.join(granted.select(F.col("id").alias("g"), F.col("granted").alias(f"granted_{side}")), F.col(f"{side}.id") == F.col("g"), "left").drop("g")
    needed = F.ceil(F.lit(THRESHOLD) * (F.col("x.n") + F.col("y.n")) / (100 + THRESHOLD))
    may = F.col("met") + F.greatest(F.coalesce("granted_x", F.lit(0)) + F.col("x.n") - F.col("x.p"), F.coalesce("granted_y", F.lit(0)) + F.col("y.n") - F.col("y.p"))
    pairs = materialize(pairs.where(may >= needed).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), "jaccard-pairs")

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(long_rows.select("id"))
    sets = _full_sets(rows, ids)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            keep = [_linked(a[k].values.to_numpy(), b[k].values.to_numpy()) for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = both.select("a", "b", "set_a", "set_b").mapInArrow(released(verified), "a bigint, b bigint").unionByName(light)
    links = materialize(links, "jaccard-links")
    discard(docs.sparkSession, own, pairs)

    # Long lists, first pass: within blocks that a hash deals out, twice with different blocks.
    if not long_rows.isEmpty():
        # One list of each row is enough here: what stays apart meets in the second pass.
        one = long_rows.groupBy("id").agg(F.min(F.struct("key", "m")).alias("of")).select("id", "of.*", F.col("id").alias("component"))
        listed = one.join(sets, "id")
        blocks = [listed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.ceil(F.col("m") / BLOCK_ROWS)) * 2 + seed) for seed in (0, 1)]
        found = _compare(blocks[0].unionByName(blocks[1]).withColumn("wanted", F.lit(True)).drop("m"), ["key", "block"])
        links = materialize(links.unionByName(found), "jaccard-links")
        # Second pass: rows outside the list's main component against all rows of the list, block by block.
        label = _gathered(_labels(links, long_rows)).join(sets, "id")
        odd_blocks, all_blocks = F.ceil(F.col("n_odd") / BLOCK_ROWS).cast("int"), F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
        place = lambda seed, blocks: F.pmod(F.xxhash64(F.lit(seed), "id"), blocks).cast("int")
        wanted = label.where("odd").select("key", "id", "set", "component", place(3, odd_blocks).alias("i"), F.explode(F.sequence(F.lit(0), all_blocks - 1)).alias("j"), F.lit(True).alias("wanted"))
        against = label.select("key", "id", "set", "component", F.explode(F.sequence(F.lit(0), odd_blocks - 1)).alias("i"), place(4, all_blocks).alias("j"), F.lit(False).alias("wanted"))
        found = _compare(wanted.unionByName(against), ["key", "i", "j"])
        links = materialize(links.unionByName(found), "jaccard-links")
    discard(docs.sparkSession, sets, rare, common)

    label = components(links).select("node", "component")
    out = join_split(member.where(F.col("node").isNotNull()), label, nodes.where("hot AND node IS NOT NULL"), ["node"], "left")
    out = out.unionByName(member.where(F.col("node").isNull()).withColumn("component", F.lit(None).cast("bigint")))
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))


def _labels(links: DataFrame, long_rows: DataFrame) -> DataFrame:
    """key, id, m and component of the rows of long lists."""
    label = components(links)
    return long_rows.join(label, long_rows["id"] == label["node"], "left").select("key", "id", "m", F.coalesce("component", "id").alias("component"))


def _gathered(label: DataFrame) -> DataFrame:
    """key, id, component, odd, m and n_odd (rows, and odd ones, of the key) of the lists (key, id, m, component) with rows outside their main component.

    Lists of one main component, as those of one text's many near copies, are one list where comparing all their rows once is less than each list by itself.
    """
    parts = label.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("rows"), F.max("c").alias("most")).where("parts > 1")
    label = materialize(label.join(main, "key").select("key", "id", "component", "main", (F.col("component") != F.col("main")).alias("odd"), ((F.col("rows") - F.col("most")) * F.col("rows")).alias("cost"), (F.col("rows") - F.col("most")).alias("n_odd"), F.col("rows").alias("m")), "jaccard-odd")
    once = label.groupBy("main", "id").agg(F.max("odd").alias("odd")).groupBy("main").agg(F.count(F.lit(1)).alias("all_m"), F.count_if("odd").alias("all_odd"))
    apart = label.select("main", "key", "cost").distinct().groupBy("main").agg(F.sum("cost").alias("apart"))
    united = once.join(apart, "main").where("all_m * all_odd < apart")
    each = label.join(united, "main", "left")
    single = each.where("all_m IS NULL").select(F.lit(False).alias("united"), "key", "id", "component", "odd", "m", "n_odd")
    several = each.where("all_m IS NOT NULL").select(F.lit(True).alias("united"), F.col("main").alias("key"), "id", "component", "odd", F.col("all_m").alias("m"), F.col("all_odd").alias("n_odd")).dropDuplicates(["key", "id"])
    both = single.unionByName(several)
    return both.withColumn("key", F.struct("united", "key"))
