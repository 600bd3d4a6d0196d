"""Target-distribution importance resampling over hashed n-grams, by a byte automaton that works on whole Arrow buffers.

A lookup table classifies every byte of a slice of texts, words begin and end where the class changes, and table-driven
crc32 states advance for all words of the slice at once; a pair's state goes on from its first word's. A feature
is a word or two neighbouring words, and its crc32 modulo BUCKETS its bucket. Counts of buckets over the whole corpus and the whole
target give each bucket a gain; a document's weight is the mean gain of its features. Gumbel noise from a hash of the id is added, and
the highest scores are drawn, which samples without replacement in proportion to the exponential of the weights.

Texts are read twice, once to count and once to weigh; a task hands on BUCKETS sums at most, and the gains that go to all tasks are
BUCKETS numbers. Ranks are running counts over ranges of scores, so no task orders all documents.

A null or empty text, or one without a word, has no features and weight 0; it isn't drawn if a word is asked for. A null id
hashes as an empty one and comes last among ties; rows that repeat are taken each for itself. Empty tables count
as no features, and an empty corpus gives an empty result. Other columns aren't read. A text may be of any length; a pass over one takes some 40 times its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waynet.llm.bytewords import LOWER, advance, runs
from waynet.llm.common import released, slices, whole_text
from waynet.plans.iterate import running_total

BUCKETS = 10_000
#: Bytes of words once A-Z are a-z: digits, letters and all of UTF-8 beyond ASCII.
WORD = np.zeros(256, bool)
WORD[ord("0") : ord("9") + 1] = WORD[ord("a") : ord("z") + 1] = WORD[128:] = True


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row and bucket of every word, row and bucket of every pair of neighbouring words) of a slice of texts."""
    low = LOWER[data]
    starts, ends, row = runs(WORD[low], offsets)
    state = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), low, starts, ends)
    pair = np.flatnonzero(row[1:] == row[:-1])
    blank = advance(state[pair], np.frombuffer(b" ", np.uint8), np.zeros(len(pair), np.int64), np.ones(len(pair), np.int64))
    both = advance(blank, low, starts[pair + 1], ends[pair + 1])
    return row, ~state % np.uint32(buckets), row[pair], ~both % np.uint32(buckets)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, how often its features occur in all texts; buckets without any have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in slices(batches, "text"):
            _, words, _, pairs = features(data, offsets, buckets)
            total += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    counted = docs.select(whole_text(text_col).alias("text")).mapInArrow(released(count), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket from the counts of corpus and target: floor(1000 ln of target's share over corpus's, both with one more a bucket)."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for side, counts in ((s, corpus), (t, target)):
        for r in counts.collect():  # at most `buckets` rows
            side[r["bucket"]] = r["n"]
    whole_s, whole_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * whole_s / ((a + 1) * whole_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean gain, 0 without features) of every row."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            row, words, pair_row, pairs = features(data, offsets, len(gain))
            n, at = rows.num_rows, np.concatenate([row, pair_row])
            n_words, n_features = np.bincount(row, minlength=n), np.bincount(at, minlength=n)
            total = np.bincount(at, gain[np.concatenate([words, pairs])].astype(float), n).astype(np.int64)  # whole numbers, exact to 2^53
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(v.astype(np.int64)) for v in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(released(weighed), f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the sha256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of all docs, weighed against the texts of target.

    Of the documents with at least least_words words the percent (rounded down) with the highest scores are drawn and
    ranked from 1, ties by the smaller id; the rank of the others is null.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets), buckets)
    scored = weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    able = F.col("n_words") >= least_words
    ordered = scored.withColumns({"_low": -F.col("score"), "_null": F.col("doc_id").isNull()})
    ranked = running_total(ordered, ["_low", "_null", "doc_id"], able.cast("long"), "earlier")
    drawn = ranked.agg((F.floor(F.count_if(able) * F.lit(percent) / 100)).alias("_drawn"))  # one row
    rank = F.when(able & (F.col("earlier") < F.col("_drawn")), F.col("earlier") + 1)
    return ranked.crossJoin(F.broadcast(drawn)).select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
