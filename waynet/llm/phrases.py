"""Phrase collocation mining: Apriori passes whose candidates are thinned by hashed bucket counts (PCY, DHP).

Texts are cut into pieces at punctuation and line ends and pieces into words. A pass over the texts counts phrases of one length exactly and,
in the same go, phrases of the next length by the bucket of a hash; buckets that reach the least count make a bitmap
for the next pass, and so do the phrases that reached it. Both bitmaps have BUCKETS bits at every size of input and are
all that is broadcast; a wrong hit in one only lets a phrase through to the exact count. The next pass counts a phrase exactly only if its bucket's bit
and the bits of both phrases inside it, one word shorter, are set. A task counts buckets up to the least count, beyond which it makes no
difference, and hands on a byte for each; tasks' bytes are added up by chunks of buckets.

Within a slice of texts words are numbers of an Arrow dictionary and phrases are pairs of numbers, so counts are exact; their texts are made for
distinct ones alone, and Spark adds them up by language and text. A phrase's best cut is found by joins of the
frequent phrases, in decimals of 38 digits. Ranks within a language are running counts over ranges of all phrases,
so a language may hold any share of them.

Null texts count as empty; a null language is `und`. Words are compared whole, in lower case of A-Z. Repeated rows count
again. Ties of scores go by count, then by the phrase's UTF-8 bytes. An empty table, or one without a frequent phrase, gives an
empty result. Other columns aren't read. A text may be of any length; a pass over one takes some 30 times its bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.llm.bytewords import LOWER, crc32, runs
from waynet.llm.common import byte_views, discard, materialize, released, whole_text
from waynet.plans.iterate import running_total

LEAST_COUNT, MOST_PHRASES = 10, 2000
#: Bits of a bitmap, as a power of two, and buckets of the chunks in which counts travel.
BUCKET_BITS, CHUNK = 24, 1 << 16
SLICE_BYTES = 1 << 22
PIECE_END, BLANK = np.zeros(256, bool), np.zeros(256, bool)
PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANK[list(b" \t")] = True
OUTSIDE = PIECE_END | BLANK

_PASS = "lang string, phrase string, n long, chunk int, counts binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Slice:
    """Words of a slice of texts: their numbers in a dictionary, languages, hashes, and which go on in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, lang_hash: np.ndarray):
        low = LOWER[data]
        outside = OUTSIDE[low]
        starts, ends, row = runs(~outside, offsets)
        borders = np.searchsorted(np.flatnonzero(PIECE_END[low]), starts)
        self.follows = (row[1:] == row[:-1]) & (borders[1:] == borders[:-1])
        ends_at = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_at.astype(np.int64)), pa.py_buffer(low[~outside]))
        coded = words.dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.lang = lang[row].astype(np.int64)
        for _, _, dictionary, places in byte_views(self.words, 1 << 62):
            crc = crc32(dictionary, places[:-1], places[1:]).astype(np.uint64)
            self.hash = _mix(crc[self.code] + lang_hash[self.lang])
        if not len(self.code):
            self.hash = np.zeros(0, np.uint64)

    def hashes(self, n: int) -> np.ndarray:
        """The hash of the n words from every place on; of no meaning where the piece ends before."""
        own = self.hash
        for k in range(1, n):
            own = _mix(own[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.hash[k:])
        return own

    def within(self, n: int) -> np.ndarray:
        """Whether the n words from every place on are of one piece."""
        own = np.ones(len(self.code), bool)
        for k in range(1, n):
            own = own[:-1] & self.follows[k - 1 :]
        return own

    def distinct(self, n: int, at: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(language, text, count) of the distinct phrases of n words that begin at those places."""
        key, size = self.lang[at], len(self.words) + 1
        for k in range(n):
            if k > 1:
                _, key = np.unique(key, return_inverse=True)
            key = key * size + self.code[at + k]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        parts = [self.words.take(pa.array(self.code[at[first] + k])) for k in range(n)]
        return self.lang[at[first]], pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0], count


class Bits:
    """A bitmap of hashes."""

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.shift = packed, np.uint64(64 - bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> self.shift
        return (self.packed[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _chunks(counts: np.ndarray, most: int) -> Iterator[tuple[int, bytes]]:
    for chunk, own in enumerate(np.minimum(counts, most).astype(np.uint8).reshape(-1, CHUNK)):
        if own.any():
            yield chunk, zlib.compress(own.tobytes(), 1)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        hashed = np.array([zlib.crc32(x.encode()) for x in names], np.uint64) << np.uint64(32)
        for first, end, data, offsets in byte_views(batch.column("text"), SLICE_BYTES):
            own = Slice(data, offsets, lang[first:end], hashed)
            own.names = langs.dictionary
            yield own


def _rows(lang: pa.Array, phrase: pa.Array, n: np.ndarray, chunks: list[tuple[int, bytes]]) -> pa.RecordBatch:
    none, more = len(chunks), len(n)
    columns = [
        pa.concat_arrays([lang.cast(pa.string()), pa.nulls(none, pa.string())]),
        pa.concat_arrays([phrase.cast(pa.string()), pa.nulls(none, pa.string())]),
        pa.concat_arrays([pa.array(n.astype(np.int64)), pa.nulls(none, pa.int64())]),
        pa.concat_arrays([pa.nulls(more, pa.int32()), pa.array([c for c, _ in chunks], pa.int32())]),
        pa.concat_arrays([pa.nulls(more, pa.binary()), pa.array([b for _, b in chunks], pa.binary())]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n", "chunk", "counts"])


def _pass(texts: DataFrame, length: int, longest: int, least: int, bits: int, shorter, buckets) -> DataFrame:
    """Counts of the candidates of that length, slice by slice, and the bucket counts of the next length, task by task.

    shorter and buckets are broadcast bitmaps: of the frequent phrases one word shorter, and of this length's buckets.
    """
    kept_shorter, kept_buckets = (None if b is None else b.value for b in (shorter, buckets))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits if length < longest else 0, np.int32)
        for own in _texts(batches):
            here = own.within(length)
            if length > 1:
                known = Bits(kept_shorter, bits).has(own.hashes(length - 1))
                here = here & known[:-1] & known[1:] & Bits(kept_buckets, bits).has(own.hashes(length))
            lang, phrase, n = own.distinct(length, np.flatnonzero(here))
            yield _rows(own.names.take(pa.array(lang)), phrase, n, [])
            if length < longest:
                longer = own.within(length + 1) & here[:-1] & here[1:]
                np.add.at(counts, own.hashes(length + 1)[longer] >> np.uint64(64 - bits), 1)
                np.minimum(counts, least, out=counts) if counts.max(initial=0) > 1 << 30 else None
        if length < longest:
            none = pa.array([], pa.string())
            yield _rows(none, none, np.zeros(0), list(_chunks(counts, least)))

    return texts.mapInArrow(released(count), _PASS)


def _bitmap(counted: DataFrame, least: int, bits: int) -> np.ndarray:
    """Packed bits of the buckets whose counts, added up over all tasks, reach the least; 2^bits / 8 bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros(CHUNK, np.int64), None
        for batch in batches:
            chunk = batch.column("chunk")[0].as_py()
            for own in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(own.as_buffer()), np.uint8)
        packed = np.packbits(total >= least, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([packed], pa.binary())], ["chunk", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, CHUNK // 8)
    for r in counted.where("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, bits binary").collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _marked(phrases: DataFrame, length: int, bits: int) -> DataFrame:
    """Chunks with the buckets of the phrases (lang, phrase) set, in the form of bucket counts."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for own in _texts(batches):
            counts[own.hashes(length)[own.within(length)] >> np.uint64(64 - bits)] = 1
        none = pa.array([], pa.string())
        yield _rows(none, none, np.zeros(0), list(_chunks(counts, 1)))

    return phrases.select("lang", F.col("phrase").alias("text")).mapInArrow(released(mark), _PASS)


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = LEAST_COUNT, lang_col: str = "lang", text_col: str = "text", bits: int = BUCKET_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n: all words of a language) and, for each length up to the longest, lang, phrase, n of the phrases that occur least times."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    shorter = buckets = words = None
    found = []
    for length in range(1, longest + 1):
        counted = materialize(_pass(texts, length, longest, least, bits, shorter, buckets), f"phrases-{length}")
        exact = counted.where("phrase IS NOT NULL")
        if length == 1:
            words = materialize(exact.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-words")
        own = exact.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        found.append(materialize(own, f"phrases-frequent-{length}"))
        if length < longest:
            shorter = context.broadcast(_bitmap(_marked(found[-1], length, bits), 1, bits))
            buckets = context.broadcast(_bitmap(counted, least, bits))
        discard(docs.sparkSession, counted)
    return words, found


def cut_scores(words: DataFrame, found: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score and the most of any longer frequent phrase around it, of the frequent phrases of 2 and 3 words."""
    one, two, three = found
    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)

    def score(a: str, left: str, right: str):
        whole = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
        return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {whole(a)} * {whole(a)}) DIV ({whole(left)} * {whole(right)})")

    pairs = two.select("lang", "phrase", F.col("n").alias("a"), first.alias("w1"), last.alias("w2"))
    for word, name in (("w1", "l"), ("w2", "r")):
        pairs = pairs.join(one.select("lang", F.col("phrase").alias(word), F.col("n").alias(name)), ["lang", word])
    pairs = materialize(pairs.select("lang", "phrase", "a", "l", "r"), "phrases-pairs")
    inner = three.select("lang", "phrase", F.col("n").alias("a"), F.substring_index("phrase", " ", 2).alias("p12"), F.substring_index("phrase", " ", -2).alias("p23"))
    inner = inner.join(pairs.select("lang", F.col("phrase").alias("p12"), F.col("a").alias("a12"), F.col("l").alias("f1")), ["lang", "p12"])
    inner = inner.join(pairs.select("lang", F.col("phrase").alias("p23"), F.col("a").alias("a23"), F.col("r").alias("f3")), ["lang", "p23"])
    inner = inner.withColumns({"s1": score("a", "f1", "a23"), "s2": score("a", "a12", "f3")})
    by_first = F.col("s1") <= F.col("s2")
    triples = inner.select("lang", "phrase", "a", *(F.when(by_first, x).otherwise(y).alias(n) for n, x, y in (("l", F.col("f1"), F.col("a12")), ("r", F.col("a23"), F.col("f3")), ("score", F.col("s1"), F.col("s2")))))
    around = three.select("lang", F.col("n").alias("around"), F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    scored = pairs.withColumn("score", score("a", "l", "r")).join(around, ["lang", "phrase"], "left")
    return scored.select("lang", "phrase", "a", "l", "r", "score", "around").unionByName(triples.withColumn("around", F.lit(None).cast("long")))


def collocations(docs: DataFrame, least: int = LEAST_COUNT, most: int = MOST_PHRASES, lang_col: str = "lang", text_col: str = "text", bits: int = BUCKET_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 and 3 words of each language.

    A phrase's score is its worst cut's, floor(10^6 * a * a / (l * r)), of equal ones the first. A phrase that stands
    inside a longer frequent one at least half of the time is dropped.
    """
    words, found = frequent_phrases(docs, 3, least, lang_col, text_col, bits)
    kept = cut_scores(words, found).where(F.col("around").isNull() | (100 * F.col("around") < 50 * F.col("a")))
    ordered = kept.withColumns({"_score": -F.col("score"), "_a": -F.col("a")})
    placed = running_total(ordered, ["lang", "_score", "_a", "phrase"], F.lit(1), "earlier")
    sizes = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("lang", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))  # a row a language
    ranked = placed.join(firsts, "lang").withColumn("rank", F.col("earlier") - F.col("_first") + 1).where(F.col("rank") <= most)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
