"""Language identification by bit-sliced Bloom filters of byte n-grams.

The filter's table has one bit per language in every slot. The AND of an n-gram's slots is
the set of languages that may contain it. Popcounts per language, less the false positives
that the filter's density lets expect, decide.

Null texts and texts without a letter are `und` with score 0; so is everything where no
labelled row exists. Ties go to the language that comes first by code point. Scores depend on the text alone, so repeated
rows are told alike. Columns besides id, text and language are not read. A text is worked as a whole, in arrays of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.llm.common import bounded_sample, released, slices, whole_text

#: Bytes of an n-gram; four make one unsigned 32-bit key.
N = 4
BITS = 21
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Bounds of the fit: labelled rows and n-grams of each language, and languages.
ROWS_PER_LANGUAGE, GRAMS_PER_LANGUAGE, MOST_LANGUAGES = 2000, 30_000, 4096


def _keys(data: np.ndarray) -> np.ndarray:
    padded = np.concatenate((data, np.zeros(N - 1, np.uint8))).astype(np.uint32)
    n = len(data)
    return padded[:n] | padded[1 : n + 1] << 8 | padded[2 : n + 2] << 16 | padded[3 : n + 3] << 24


def _slots(keys: np.ndarray) -> list[np.ndarray]:
    return [(keys * np.uint32(m)) >> np.uint32(32 - BITS) for m in MULTIPLIERS]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches, "text"):
        keys, inside = _keys(data), np.arange(len(data)) + N <= np.repeat(offsets[1:], np.diff(offsets))
        langs = np.array(rows.column("lang").to_pylist(), dtype=object)
        per_byte = np.repeat(np.arange(len(langs)), np.diff(offsets))
        for lang in sorted(set(langs)):
            grams, n = np.unique(keys[inside & (langs == lang)[per_byte]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class LanguageModel:
    """A bit-sliced Bloom filter: a slot has a language's bit set if the language has an n-gram there."""

    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        self.languages = languages
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.width = np.dtype(kind).itemsize * 8
        self.tables = [np.zeros(1 << BITS, kind) for _ in range(0, max(1, len(languages)), self.width)]
        for k, own in enumerate(grams):
            table, bit = self.tables[k // self.width], kind(1 << k % self.width)
            for slot in _slots(own.astype(np.uint32)):
                table[slot] |= bit
        density = [np.count_nonzero(self.tables[k // self.width] & kind(1 << k % self.width)) / (1 << BITS) for k in range(len(languages))]
        self.false_positive = np.array(density) ** len(MULTIPLIERS)

    def languages_of(self, keys: np.ndarray) -> list[np.ndarray]:
        """For every n-gram the bits of all languages that may contain it, a number for each `width` languages."""
        slots, out = _slots(keys), []
        for table in self.tables:
            found = table[slots[0]]
            for slot in slots[1:]:
                found &= table[slot]
            out.append(found)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language of every text, and its share of the corrected popcounts."""
        ends = np.maximum(offsets[1:] - (N - 1), offsets[:-1])
        found = self.languages_of(_keys(data))
        total = (ends - offsets[:-1]).astype(float)
        hits = np.empty((len(total), len(self.languages)))
        for k in range(len(self.languages)):
            own, bit = found[k // self.width], k % self.width
            running = np.concatenate(([0], np.cumsum((own >> own.dtype.type(bit)) & own.dtype.type(1), dtype=np.int64)))
            seen = running[ends] - running[offsets[:-1]]
            fp = self.false_positive[k]
            hits[:, k] = np.maximum(0, (seen - total * fp) / (1 - fp))
        best = hits.argmax(axis=1)
        mass = hits.sum(axis=1)
        return best, np.where(mass > 0, hits[np.arange(len(best)), best] / np.where(mass > 0, mass, 1), 1 / len(self.languages))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Counts the n-grams of a bounded sample of rows with a language; keeps the commonest of each language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if rows.select(lang_col).distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = bounded_sample(rows, lang_col, id_col, ROWS_PER_LANGUAGE, MOST_LANGUAGES)
    rows = rows.select(F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"))
    counts = rows.mapInArrow(released(_gram_counts), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= GRAMS_PER_LANGUAGE).select("lang", "gram").toPandas()
    languages = sorted(best["lang"].unique())
    return LanguageModel(languages, [best.loc[best["lang"] == x, "gram"].to_numpy() for x in languages]) if languages else None


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(whole_text(text_col)).alias("text"), lettered)
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, "und"], dtype=object)
        for rows, data, offsets in slices(batches, "text"):
            best, score = known.score(data, offsets)
            has = rows.column("lettered").to_numpy(zero_copy_only=False)
            best, score = np.where(has, best, len(names) - 1), np.where(has, score, 0.0)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(released(scored), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
