"""Byte-level BPE: ranked merges folded over the distinct words of documents.

Spark's higher-order functions fold the merges over the bytes of a word against a broadcast rank map. The words that are
common in a bounded sample of documents are folded once, and their ids broadcast; which words these are is about cost
alone. Everything else runs in one stage without a shuffle: a block is a run of documents, or a part of a long one, of
bounded size; its distinct words that the task hasn't folded yet are folded, and the ids go back to the documents.
decode() concatenates the binary pieces of the ids.

Null and empty texts give no ids; an empty table gives an empty result. Repeated rows are encoded each. Columns besides
the id and the text are not read. A long text passes through several blocks, a long word through the same fold.
"""

from __future__ import annotations

import base64
import json
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waynet.llm.common import materialize, released, whole_text

#: Characters of text in a block.
BLOCK_CHARS = 1 << 20
#: Words that a task remembers from earlier blocks (some 200 bytes each); then it forgets all.
REMEMBERED = 150_000
#: Documents of the sample that tells common words, and the most of them.
SAMPLE_ROWS, MOST_COMMON = 16_000, 1 << 18
#: Parts that the common words are folded in.
COMMON_PARTS = 24
#: Places between the bytes of a word of up to BITS bytes fit a signed 64-bit number; those of longer words lie in runs.
BITS, RUN = 60, 512
#: Ids that are decoded at once.
DECODED_IDS = 1 << 20
#: Buckets of the rank map.
BUCKETS = 1 << 16

_BLOCK = pa.schema(
    [
        ("doc_id", pa.list_(pa.int64())),
        ("n_pieces", pa.list_(pa.int32())),
        ("codes", pa.list_(pa.int32())),
        ("words", pa.list_(pa.binary())),
        ("forget", pa.bool_()),
        ("more", pa.bool_()),
    ]
)
_BLOCK_DDL = "doc_id array<bigint>, n_pieces array<int>, codes array<int>, words array<binary>, forget boolean, more boolean"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a line has a piece in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _place(piece: bytes, size: int) -> int:
    """Of a piece in a table of that many places: xxhash64, as Spark's."""
    import xxhash

    return xxhash.xxh64_intdigest(piece, 42) % size


@lru_cache(2)
def _tables(vocabulary: str) -> tuple[str, str]:
    """The ranks of a checked vocabulary in small maps, and the length of the longest piece with the first three bytes of a place, in JSON."""
    ranks = load_ranks(vocabulary)
    check_order(ranks)
    buckets: list[dict[str, int] | None] = [None] * BUCKETS
    bounds = [2] * BUCKETS
    for piece, rank in ranks.items():
        at = _place(piece, BUCKETS)
        buckets[at] = (buckets[at] or {}) | {piece.decode("latin-1"): rank}
        if len(piece) > 2:
            at = _place(piece[:3], BUCKETS)
            bounds[at] = max(bounds[at], len(piece))
    return json.dumps(buckets, separators=(",", ":"), ensure_ascii=False), json.dumps(bounds, separators=(",", ":"))


def rank_table(spark: SparkSession, vocabulary: str) -> DataFrame:
    """The ranks of a vocabulary as a written row to broadcast: an array of small maps (Spark searches a map from its start), and the bounds of lengths.

    As literals they would stand in every plan and its descriptions, which the driver keeps.
    """
    text = spark.createDataFrame([_tables(vocabulary)], "buckets string, bounds string")
    of_bytes = F.transform(F.from_json("buckets", "array<map<string,bigint>>"), lambda m: F.transform_keys(m, lambda piece, _: F.encode(piece, "ISO-8859-1")))
    return materialize(text.select(of_bytes.alias("_buckets"), F.from_json("bounds", "array<int>").alias("_bounds")), "bpe-ranks")


def check_order(ranks: dict[bytes, int]) -> None:
    """An error if a byte is missing, a piece or rank doesn't fit the fold's numbers, or some piece arises by merges whose ranks fall.

    Trained vocabularies have no such piece: what a merge needs was there before it. So merges of any
    text rise in rank, since a stretch that becomes one piece is merged as it would be alone.
    """
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks a byte")
    if max(map(len, ranks)) > 63 or max(ranks.values()) >= 1 << 19:
        raise ValueError("a piece is too long, or its rank too high, for the fold")
    for piece in ranks:
        made = _merge_order(piece, ranks) if len(piece) > 1 else []
        if made != sorted(made):
            raise ValueError(f"the merges of {piece!r} don't rise in rank")


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, buckets: Column, bounds: Column) -> Column:
    """The ids of one word: ranked merges of adjacent parts, least rank first, leftmost first.

    Every ranked stretch of the word is a possible merge: rank, start and end. Merges rise in rank (check_order),
    so one fold over the stretches in that order does them all. A merge is due if both its ends are places where
    parts meet and just one such place lies between, which it takes away. The state of the fold is those places:
    of a word of up to BITS bytes the bits of one number (and so are start and end), of a longer one the
    next place of every place, in runs of RUN so that a merge copies little.
    """
    one = F.lit(1).cast("bigint")

    def shifted(by):
        return F.call_function("shiftleft", one, by)

    def folded(n):
        def part(start, length):
            return F.substring(word, start, length)

        def rank(piece):
            return F.element_at(buckets[F.xxhash64(piece).bitwiseAND(BUCKETS - 1)], piece)

        def ranked(bits, end_of):
            """Starts and ends by rank. A stretch is one number until it is sorted: rank, start and length."""

            def stretches_from(i):
                most = F.least(n + 1 - i, bounds[F.xxhash64(part(i, F.lit(3))).bitwiseAND(BUCKETS - 1)])
                return F.transform(F.sequence(F.lit(2), most), lambda k: F.shiftleft(rank(part(i, k)), 6 + bits) + (i.cast("bigint") * 64 + k))

            found = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), stretches_from))
            start = lambda c: F.shiftright(c, 6).bitwiseAND((1 << bits) - 1).cast("int")
            length = lambda c: c.bitwiseAND(63).cast("int")
            return F.transform(F.sort_array(F.filter(found, lambda c: c.isNotNull())), lambda c: F.struct(end_of(start(c)).alias("start"), end_of(start(c) + length(c)).alias("end")))

        def merge_bits(places, c):
            within = places.bitwiseAND(c["end"] - c["start"])  # the start, and what lies between
            due = (places.bitwiseAND(c["end"]) != 0) & (places.bitwiseAND(c["start"]) != 0) & (F.bit_count(within) == 2)
            return F.when(due, places - within + c["start"]).otherwise(places)

        def short():
            places = F.aggregate(ranked(6, shifted), shifted(n + 2) - 2, merge_bits)
            kept = _bind(places, lambda p: F.filter(F.sequence(F.lit(1), n + 1), lambda b: F.getbit(p, b) == 1))
            return _bind(kept, lambda k: F.zip_with(F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.size(k) - 1), lambda a, b: rank(part(a, b - a))))

        def run_of(place):
            return F.floor(place / RUN).cast("int")

        def after(runs, place):
            return F.get(F.get(runs, run_of(place)), place % RUN)

        def put(runs, place, value):
            own, at = F.get(runs, run_of(place)), place % RUN
            changed = F.concat(F.slice(own, F.lit(1), at), F.array(value), F.slice(own, at + 2, F.lit(RUN)))
            return F.concat(F.slice(runs, F.lit(1), run_of(place)), F.array(changed), F.slice(runs, run_of(place) + 2, F.size(runs)))

        def merge_runs(runs, c):
            middle = after(runs, c["start"])
            due = (middle > 0) & (middle < c["end"]) & (after(runs, F.greatest(middle, F.lit(0))) == c["end"])
            return F.when(due, _bind(put(runs, c["start"], c["end"]), lambda now: put(now, middle, F.lit(-1)))).otherwise(runs)

        def long():
            each = F.transform(F.sequence(F.lit(0), run_of(n)), lambda r: F.transform(F.sequence(r * RUN, F.least(r * RUN + RUN - 1, n)), lambda place: place + 1))
            nexts = F.flatten(F.aggregate(ranked(38, lambda i: i), each, merge_runs))
            kept = F.filter(F.transform(nexts, lambda e, i: F.when((e > 0) & (i > 0) & (i <= n), F.struct(i.alias("start"), e.alias("end")))), lambda x: x.isNotNull())
            return F.transform(kept, lambda x: rank(part(x["start"], x["end"] - x["start"])))

        return _bind(rank(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).when(n <= BITS, short()).otherwise(long()))

    return F.when(F.octet_length(word) > 0, _bind(F.octet_length(word), folded)).otherwise(F.array().cast("array<bigint>"))


def _merge_order(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ranks of the merges of a short piece, in their order."""
    parts, made = [piece[i : i + 1] for i in range(len(piece))], []
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == len(ranks):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        made.append(rank)
    return made


def _parts(pattern: str, text: str) -> Iterator[list[str]]:
    """The pieces of a text; those of a long one in lists of bounded size."""
    import regex

    compiled = regex.compile(pattern)
    if len(text) <= BLOCK_CHARS:
        yield compiled.findall(text)
        return
    found = (m.group() for m in compiled.finditer(text))
    while part := list(islice(found, BLOCK_CHARS // 4)):
        yield part


class WordCodes(dict):
    """Codes of words; a word that is asked for first gets the next code and is listed as new."""

    def __init__(self, words: dict[str, int]):
        super().__init__(words)
        self.new: list[bytes] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word.encode())
        return self.setdefault(word, len(self))


def _pack(pattern: str, shared):
    """Documents to blocks: the words that are new to the task, and every document's pieces as codes of common words and of the task's own."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value.codes
        known = WordCodes(common)
        ids, counts, pieces, size = [], [], [], 0

        def block(more):
            nonlocal known
            forget = len(known) - len(common) > REMEMBERED
            if forget:
                known = WordCodes(common)
            codes = np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces))
            new, known.new = known.new, []
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((ids, counts, codes, new, forget, more), _BLOCK)], schema=_BLOCK)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                ids.append(doc)
                counts.append(0)
                for part in _parts(pattern, text):
                    if counts[-1]:  # of a long text
                        yield block(True)
                        ids, counts, pieces, size = [doc], [0], [], 0
                    counts[-1] = len(part)
                    pieces += part
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield block(False)
                    ids, counts, pieces, size = [], [], [], 0
        if ids:
            yield block(False)

    return blocks


class WordIds:
    """Words by code, and the ids of each, one after the other. Workers make the codes when they need them."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        self.words = words
        self.sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)

    @cached_property
    def codes(self) -> dict[str, int]:
        return dict(zip(self.words.to_pylist(), range(len(self.words))))


def _unpack(shared):
    """Blocks to documents: the ids of a word go wherever its code stands."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        sizes, values, begun = common.sizes, common.values, []
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column("forget")[r].as_py():
                    sizes, values = common.sizes, common.values
                doc, counts, codes, folded = (batch.column(c)[r].values for c in ("doc_id", "n_pieces", "codes", "ids"))
                sizes = np.concatenate((sizes, folded.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
                values = np.concatenate((values, folded.flatten().to_numpy(zero_copy_only=False).astype(np.int32)))
                codes = codes.to_numpy(zero_copy_only=False)
                per_piece = sizes[codes]
                ends = np.cumsum(np.concatenate(([0], per_piece)))
                first = (np.cumsum(sizes) - sizes)[codes]
                taken = values[np.arange(ends[-1]) + np.repeat(first - ends[:-1], per_piece)]
                bounds = ends[np.cumsum(np.concatenate(([0], counts.to_numpy(zero_copy_only=False))))]
                begun.append(taken)
                if batch.column("more")[r].as_py():
                    continue
                taken = np.concatenate(begun)
                bounds[1:] += len(taken) - len(begun[-1])
                begun = []
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(taken))
                yield pa.RecordBatch.from_arrays([doc, lists], names=["doc_id", "ids"])

    return documents


def _common_words(texts: DataFrame, pattern: str) -> DataFrame:
    """The words that the sample holds more than once, the commonest MOST_COMMON of them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for text in batch.column("text"):
                for part in _parts(pattern, text.as_py()):
                    seen.update(part)
            if len(seen) > REMEMBERED:
                yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})
                seen = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    share = min(1.0, SAMPLE_ROWS / max(1, texts.count()))
    unit = F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    counts = texts.where(unit < share).mapInArrow(released(counted), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where("n > 1").orderBy(F.desc("n"), "word").limit(MOST_COMMON).select("word")


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>, as the tiktoken library encodes without special tokens."""
    ranks = F.broadcast(rank_table(docs.sparkSession, vocabulary))

    def fold(blocks: DataFrame) -> DataFrame:
        # All words of a block see the ranks through variables.
        ids = _bind(F.col("_buckets"), lambda b: _bind(F.col("_bounds"), lambda m: F.transform("words", lambda w: fold_merges(w, b, m))))
        return blocks.crossJoin(ranks).withColumn("ids", ids).drop("_buckets", "_bounds")

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    dealt = _common_words(texts, pattern).groupBy(F.pmod(F.xxhash64("word"), F.lit(COMMON_PARTS)).alias("part")).agg(F.collect_list(F.encode("word", "UTF-8")).alias("words"))
    once = fold(materialize(dealt, "bpe-common")).select(F.explode(F.arrays_zip("words", "ids")).alias("z")).select(F.decode("z.words", "UTF-8").alias("word"), F.col("z.ids").cast("array<int>").alias("ids"))
    once = once.toArrow().combine_chunks()  # MOST_COMMON rows at most
    words, ids = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (once["word"], once["ids"]))
    shared = docs.sparkSession.sparkContext.broadcast(WordIds(words, ids))
    return fold(texts.mapInArrow(released(_pack(pattern, shared)), _BLOCK_DDL)).mapInArrow(released(_unpack(shared)), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and bytes: the binary pieces of the ids, concatenated."""
    return _with_pieces(encoded, vocabulary, "bytes binary", lambda ids, data: data)


def digests(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256, after decoding the ids."""

    def both(ids, data):
        from hashlib import sha256

        return sha256(ids.astype("<u4").tobytes()).hexdigest(), sha256(data).hexdigest()

    return _with_pieces(encoded, vocabulary, "ids_sha256 string, decoded_sha256 string", both)


def _decoded(values: np.ndarray, ends: np.ndarray, pieces: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """Every row's ids and the concatenation of their pieces, DECODED_IDS at once or one row."""
    first = 0
    while first < len(ends) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + DECODED_IDS, side="right")) - 1)
        taken = pieces.take(pa.array(values[ends[first] : ends[last]]))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64)[ends[first : last + 1] - ends[first]] if len(taken) else np.zeros(last - first + 1, np.int64)
        data = memoryview(data or b"")
        for a, b, x, y in zip(ends[first:last], ends[first + 1 : last + 1], at, at[1:]):
            yield values[a:b], bytes(data[x:y])
        first = last


def _with_pieces(encoded: DataFrame, vocabulary: str, ddl: str, made) -> DataFrame:
    pieces = {rank: piece for piece, rank in load_ranks(vocabulary).items()}
    shared = encoded.sparkSession.sparkContext.broadcast(pa.array([pieces.get(i, b"") for i in range(max(pieces) + 1)], pa.large_binary()))
    whole = ddl.startswith("bytes")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.concatenate(([0], ends)))
            out = [made(*x) for x in _decoded(values, ends, shared.value)]
            if whole:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(out, pa.binary())], names=["doc_id", "ids", "bytes"])
            else:
                columns = [batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), *(pa.array([x[k] for x in out], pa.string()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(released(rows), f"doc_id bigint, {'ids array<int>' if whole else 'n_tokens bigint'}, {ddl}")
