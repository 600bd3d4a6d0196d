"""Exact top-k search by inner product: term-at-a-time accumulation over all candidates, without an index that prunes.

Vectors are sparse rows of (term, weight), a term for each component that isn't 0, in whole numbers. Queries and candidates
are dealt to blocks by a hash, and every block of queries meets every block of candidates in a tile of its own, so neither side
is broadcast and no task holds more than two blocks. A tile turns its candidates into posting lists by term; each query row scatters
its weights times a list's into a dense array of scores, term after term; the k best of a tile are selected by a
partition of the array, and the tiles' best are merged. Scores are exact: they are kept as Python's whole numbers where
64 bits might not do, and one that doesn't fit a long is an error.

A vector that is null, or has a null or non-finite component, takes no part; one without components, or with zeros alone,
scores 0. Vectors of different lengths are compared as if the shorter had zeros. Ties go to the smaller id; a candidate
without an id comes after all others. A row is no candidate for a query of its own id. Candidates that repeat each take a rank
of their own; a query that repeats (id and vector alike) is answered once, one id with two vectors for each. An empty table, or one without
queries, gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.llm.common import materialize

#: Rows of a block of queries and of candidates, and queries whose score arrays are filled together.
QUERY_BLOCK, CANDIDATE_BLOCK, TOGETHER = 4096, 2048, 64
#: Partitions of tiles at most; beyond, a partition works on several tiles, one after the other.
MOST_PARTITIONS = 1 << 16


def whole_weights(vector: Column, scale: int) -> Column:
    """array of (term, weight) of the components, each floor(scale * component) as a double, that aren't 0."""

    def weight(x):
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) >= 2.0**63, F.raise_error(F.lit("a component passes 64 bits")).cast("bigint")).otherwise(F.floor(scaled))

    pairs = F.transform(vector, lambda x, i: F.struct(i.alias("term"), weight(x).alias("weight")))
    return F.filter(pairs, lambda p: p["weight"] != 0)


def sparse_rows(vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vector (terms and weights), copies: rows of one id and vector as one, with their number."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    valid = vectors.where(F.col(vector_col).isNotNull() & finite)
    rows = valid.select(F.col(id_col).cast("long").alias("id"), whole_weights(F.col(vector_col), scale).alias("vector"))
    return rows.groupBy("id", "vector").agg(F.count(F.lit(1)).alias("copies"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of every pair."""
    own = column.combine_chunks()
    flat, lengths = own.flatten(), pc.list_value_length(own).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(own)), lengths), flat.field("term").to_numpy(), flat.field("weight").to_numpy()


def _lists(terms: np.ndarray, *values: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """Posting lists: the values of every term, in order."""
    order = np.argsort(terms, kind="stable")
    found, starts = np.unique(terms[order], return_index=True)
    cuts = [np.split(v[order], starts[1:]) for v in values]
    return {int(t): own for t, *own in zip(found, *cuts)} if len(found) else {}


def _searcher(k: int):
    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        n = len(candidates)
        candidates = candidates.take(pc.sort_indices(candidates, [("id", "ascending")], null_placement="at_end"))
        ids, known = candidates["id"].combine_chunks(), n - candidates["id"].null_count
        ordered = pc.fill_null(ids, 0).to_numpy()[:known]
        query_ids = queries["id"].to_numpy()
        rows, terms, weights = _flat(candidates["vector"])
        q_rows, q_terms, q_weights = _flat(queries["vector"])
        most = [max(map(abs, (int(w.min()), int(w.max()))), default=0) if len(w) else 0 for w in (weights, q_weights)]
        longest = int(np.bincount(q_rows).max()) if len(q_rows) else 0
        kind = np.int64 if most[0] * most[1] * longest < 1 << 62 else object
        lists = _lists(terms, rows, weights.astype(kind))
        gone = np.iinfo(np.int64).min + 1 if kind is np.int64 else -(1 << 200)
        found = [[], [], []]
        for first in range(0, len(queries) if n else 0, TOGETHER):
            own = min(TOGETHER, len(queries) - first)
            here = slice(*np.searchsorted(q_rows, [first, first + own]))
            scores = np.zeros((n, own), kind)
            part = np.empty((n, own), kind)
            for term, (q, w) in _lists(q_terms[here], q_rows[here] - first, q_weights[here].astype(kind)).items():
                if term not in lists:
                    continue
                at, posted = lists[term]
                line = np.zeros(own, kind)
                line[q] = w
                if len(at) == n:
                    scores += np.multiply(posted[:, None], line[None, :], out=part)
                else:
                    scores[at] += posted[:, None] * line[None, :]
            low, high = (np.searchsorted(ordered, query_ids[first : first + own], side=side) for side in ("left", "right"))
            for q in np.flatnonzero(low < high):
                scores[low[q] : high[q], q] = gone
            least = np.partition(scores, n - k, axis=0)[n - k] if n > k else np.full(own, gone, kind)
            c, q = np.nonzero((scores >= least) & (scores > gone))
            value = scores[c, q].astype(np.int64)
            order = np.lexsort((c, -value, q))
            c, q, value = c[order], q[order], value[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            for out, v in zip(found, (q[keep] + first, c[keep], value[keep])):
                out.append(v)
        q, c, value = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in found)
        return pa.table({
            "query_id": queries["id"].take(pa.array(q)),
            "query": queries["query"].take(pa.array(q)),
            "vec_id": ids.take(pa.array(c)),
            "score": pa.array(value, pa.int64()),
            "copies": candidates["copies"].take(pa.array(c)),
        })

    return search


def top_k(rows: DataFrame, is_query: Column, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest scores of each of the rows (id, vector, copies) that is a query."""
    rows = materialize(rows, "topk-rows")
    queries = rows.where(is_query & F.col("id").isNotNull())
    counts = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(is_query & F.col("id").isNotNull()).alias("queries")).first()
    n_query, n_candidate = (max(1, -(-counts[c] // size)) for c, size in (("queries", query_block), ("all", candidate_block)))
    tiles = min(MOST_PARTITIONS, n_query * n_candidate)
    key = F.xxhash64("id", "vector")

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        seats = df.withColumn(own, F.pmod(key, F.lit(n_own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))
        return seats.repartition(tiles, "query_block", "candidate_block").groupBy("query_block", "candidate_block")

    asked = dealt(queries.select("id", key.alias("query"), "vector"), "query_block", n_query, "candidate_block", n_candidate)
    given = dealt(rows, "candidate_block", n_candidate, "query_block", n_query)
    best = asked.cogroup(given).applyInArrow(_searcher(k), "query_id long, query long, vec_id long, score long, copies long")
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
