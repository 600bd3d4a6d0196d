"""Document fingerprints: a Merkle tree over paragraphs and sections, by DataFrame functions alone.

Sections are parted by an empty line, paragraphs by a line feed, and a paragraph is cut into blocks of BLOCK words with
the white space beside them. A block's digest is the sha256 of its text, a paragraph's that of its blocks' digests, a
section's that of its paragraphs' digests, the root that of its sections' digests. So equal roots mean equal texts, and
branches that differ locate edits: edit() walks from the top past equal branches at both ends.

The likeness of two trees is the larger of two Dice shares, at every size of texts: of the blocks, each as often as it
occurs, wherever they hang (the same as walking down and counting equal branches whole, as these have equal blocks), and of
the words at their places. So a moved paragraph keeps its blocks, and short texts are compared by words.

A null text counts as empty: one section with one empty paragraph. Two empty texts are alike (1.0). Repeated rows get
the same fingerprint; an empty table gives an empty result. Columns besides the id and the text aren't read. A long text
is one row's arrays, some 30 bytes a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.llm.common import whole_text

#: Words of a block.
BLOCK = 4
#: Rows of an id range, and the most ranges; edges of ranges are literals of the plan.
ROWS_PER_RANGE, MOST_RANGES = 512, 4096
_COVER = r"\s*\S+(?:\s+\S+){0,%d}|\s+" % (BLOCK - 1)


def tree(text: Column) -> Column:
    """The tree: an array of sections, each an array of paragraphs, each an array of its blocks' digests."""

    def blocks(paragraph):
        return F.transform(F.regexp_extract_all(paragraph, F.lit(_COVER), F.lit(0)), lambda b: F.sha2(b, 256))

    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), blocks))


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def paragraphs(sections: Column) -> Column:
    """Paragraph digests of a tree, section by section."""
    return F.transform(sections, lambda s: F.transform(s, _digest))


def root(sections: Column) -> Column:
    """The root digest of a tree."""
    return _digest(F.transform(paragraphs(sections), _digest))


def leaves(sections: Column, text: Column) -> Column:
    """(blocks, words): the tree's blocks, each with how often it came before, and the words with their places, as 64-bit hashes."""
    ordered = F.array_sort(F.flatten(F.transform(sections, lambda s: F.flatten(s))))

    def counted(own):
        places = F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)))
        return _bind(F.filter(places, lambda i: (F.size(own) > 0) & ((i == 0) | (F.get(own, i) != F.get(own, i - 1)))), lambda starts: numbered(own, starts))

    def numbered(own, starts):
        ends = lambda k: F.coalesce(F.get(starts, k + 1), F.size(own))
        return F.flatten(F.transform(starts, lambda i, k: F.transform(F.sequence(F.lit(1), ends(k) - i), lambda c: F.xxhash64(F.get(own, i), c))))

    words = F.transform(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), lambda w, i: F.xxhash64(w, i))
    return F.struct(_bind(ordered, counted).alias("blocks"), words.alias("words"))


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two leaves() columns."""

    def dice(x, y):
        total = F.size(x) + F.size(y)
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)

    return F.greatest(dice(a["blocks"], b["blocks"]), dice(a["words"], b["words"]))


def edit(a: Column, b: Column) -> Column:
    """(first, removed, added) between two arrays of digests: from place `first` on, so many of a's became so many of b's; null if equal."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    back = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False)).cast("int") - 1
    last = F.array_position(back, F.lit(False)).cast("int") - 1
    kept = F.least(last, F.least(F.size(a), F.size(b)) - first)
    return F.when(F.array_position(same, F.lit(False)) > 0, F.struct(first.alias("first"), (F.size(a) - first - kept).alias("removed"), (F.size(b) - first - kept).alias("added")))


def edited_branches(a: Column, b: Column) -> Column:
    """Where the edit from tree a to tree b lies: its sections, and its paragraphs counted within these."""

    def located(x, y):
        sections = edit(F.transform(x, _digest), F.transform(y, _digest))

        def within(at):
            own = F.flatten(F.slice(x, at["first"] + 1, at["removed"])), F.flatten(F.slice(y, at["first"] + 1, at["added"]))
            return F.when(at.isNotNull(), F.struct(at.alias("sections"), edit(*own).alias("paragraphs")))

        return _bind(sections, within)

    return _bind(paragraphs(a), lambda x: _bind(paragraphs(b), lambda y: located(x, y)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and next_text, the text of the document that follows by descending id (the first, after the last).

    Documents are dealt to ranges of ids whose edges are quantiles of all ids, so no task holds
    the table. Every range also gets the first document of the range that follows it. Rows of one id
    are ordered by a hash of their texts. A null id comes last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    ids = rows.select("doc_id")
    count = ids.count()
    ranges = min(MOST_RANGES, max(1, -(-count // ROWS_PER_RANGE)))
    shares = [k / ranges for k in range(1, ranges)]
    edges = (ids.agg(F.percentile_approx("doc_id", shares, 10 * MOST_RANGES).alias("e")).first()["e"] if shares else None) or []
    edges = sorted({int(e) for e in edges})

    def range_of(doc_id: Column) -> Column:
        """How many edges lie below the id, by halving; null ids are a range before all."""
        if not edges:
            return F.lit(0)
        table = F.array(*map(F.lit, edges)) if len(edges) < 2 else F.from_json(F.lit(str(edges)), "array<bigint>")
        steps = F.sequence(F.lit(1), F.lit(len(edges).bit_length()))

        def halve(s, _):
            middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
            below = F.get(table, middle) < doc_id
            low = F.when(s["low"] < s["high"], F.when(below, middle + 1).otherwise(s["low"])).otherwise(s["low"])
            high = F.when(s["low"] < s["high"], F.when(below, s["high"]).otherwise(middle)).otherwise(s["high"])
            return F.struct(low.alias("low"), high.alias("high"))

        start = F.struct(F.lit(0).alias("low"), F.lit(len(edges)).alias("high"))
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.aggregate(steps, start, halve)["low"])

    # The first document of every range; at most MOST_RANGES + 1 rows.
    ranged = ids.withColumn("range", range_of(F.col("doc_id"))).groupBy("range").agg(F.max("doc_id").alias("first"))
    firsts = sorted(((r["range"], r["first"]) for r in ranged.collect()), reverse=True)
    follows = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    borders = F.broadcast(docs.sparkSession.createDataFrame(follows, "first bigint, before int"))

    def seat(at: Column, halo: bool) -> Column:
        return F.struct(at.alias("range"), F.lit(halo).alias("halo"))

    own, other = seat(range_of(F.col("doc_id")), False), seat(F.col("before"), True)
    seats = F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("seat")
    all_rows = rows.join(borders, F.col("doc_id").eqNullSafe(F.col("first")), "left").select("doc_id", "text", seats).select("doc_id", "text", "seat.*")
    order = Window.partitionBy("range").orderBy("halo", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return all_rows.withColumn("next_text", F.lead("text").over(order)).where(~F.col("halo")).select("doc_id", "text", "next_text")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and fingerprint, the root of the text's tree."""
    return docs.select(F.col(id_col).alias("doc_id"), root(tree(whole_text(text_col))).alias("fingerprint"))


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tree of every text beside those of its edited text and of the next document.

    The edited text has the last half of the code points (rounded down) replaced by as many, or all, of the next
    document's first.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited)
    rows = rows.withColumns({"own": tree(F.col("text")), "changed": tree(F.col("edited")), "following": tree(F.col("next_text"))})
    rows = rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("own")).alias("fingerprint"),
        root(F.col("changed")).alias("edited_fingerprint"),
        edited_branches(F.col("own"), F.col("changed")).alias("edit"),
        leaves(F.col("own"), F.col("text")).alias("own"),
        leaves(F.col("changed"), F.col("edited")).alias("changed"),
        leaves(F.col("following"), F.col("next_text")).alias("following"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        F.when(F.col("fingerprint") == F.col("edited_fingerprint"), F.lit(1.0)).otherwise(likeness(F.col("own"), F.col("changed"))).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
        F.to_json("edit").alias("edit"),
    )
