"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has an exponential key, -ln(u) over its quality weight, with u from a hash of
its id: sorting a source by it draws documents without replacement in proportion to their
weights. A source whose target passes its size repeats whole epochs first; the rest of the target is
a fractional epoch, filled in the order of the keys until prefix sums reach the budget. The
document at the border is cut there, so a source meets its target to the word.

Prefix sums run in two levels, so no task holds a source: keys are dealt to ranges of about
RANGE_ROWS rows, the ranges' totals are summed up, and rows are summed within their range. The ranges' edges come from
the distribution of the keys: rows of one weight have exponential keys, and a source's weights are counted in bins of an
eighth of a power of two.

Null texts have size 0 and are never taken; a null source is a source of its own, the last.
Ties of keys go by id and size. Repeated rows are taken each for itself. A source of size 0 has target 0. An empty table
gives an empty result. Further columns pass through mixed() whatever their names. A long text is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waynet.llm.common import materialize, new_names

RANGE_ROWS = 2048
MOST_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text_col: str) -> Column:
    """0.1 to 1: how far the mean length of words is from that of common prose, times how many of the words are new.

    Prose has some sqrt(n) different words among n at the very least; texts that repeat themselves have fewer.
    """
    words = F.greatest(n_words(text_col), F.lit(1))
    length = 1.0 - F.abs(F.length(text_col) / words - 6.0) / 12.0
    different = F.size(F.array_distinct(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)))) / F.sqrt(words)
    return F.coalesce(F.greatest(F.lit(0.1), length * F.least(F.lit(1.0), different)), F.lit(0.1))


def source_targets(sizes: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """target of every (source, source_size): shares of the whole by weight, at most `most` times the size.

    Weights 1, 2, 3 repeat over the sources by code point, null last. What a cap cuts off is shared
    again by weight, which ends at one level: target = min(most * size, level * weight).
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1)
    limit = F.lit(most) * F.col("source_size")
    by_ratio = Window.orderBy((limit / F.col("weight")), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({"capped": F.coalesce(F.sum(limit).over(by_ratio), F.lit(0)), "gone": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))})
    ranked = ranked.crossJoin(ranked.agg(F.sum("source_size").alias("whole"), F.sum("weight").alias("weights")))  # one row
    # If the sources before this one, by limit over weight, are capped, the rest share what they leave at this level.
    ranked = ranked.withColumn("level", (F.col("whole") - F.col("capped")) / (F.col("weights") - F.col("gone")))
    holds = F.col("level") * F.col("weight") <= limit
    final = F.min(F.when(holds, F.struct(F.col("gone"), F.col("level")))).over(Window.partitionBy())["level"]
    return ranked.withColumn("final", final).select("source", "source_size", F.coalesce(F.least(limit.cast("double"), F.col("final") * F.col("weight")), F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: int = 11, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, epochs (whole copies; the rest of taken is one cut copy) and row, the value of row_col."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(text_col).alias("size"),
        (quality_weight(text_col) if weight is None else weight).cast("double").alias("weight"),
        (F.lit(0).cast("bigint") if row_col is None else F.col(row_col)).alias("row"),
    )
    rows = materialize(rows.withColumn("key", -F.log(unit) / F.col("weight")).withColumn("bin", F.floor(8 * F.log2("weight"))), "mix-keys")
    binned = rows.groupBy("source", "bin").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight"))
    bins = F.collect_list(F.struct("n", "weight"))
    totals = materialize(binned.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"), bins.alias("bins")), "mix-sources")
    targets = source_targets(totals.select("source", "source_size")).select(F.col("source").alias("s"), "target")
    sources = totals.join(targets, totals["source"].eqNullSafe(targets["s"])).drop("s")
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    sources = sources.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
    sources = materialize(sources.withColumnRenamed("source", "s"), "mix-targets")

    # The share of a source's keys below this one: near uniform on 0 to 1, and rising with the key.
    below = F.aggregate("bins", F.lit(0.0), lambda s, b: s + b["n"] * (1 - F.exp(-F.col("key") * b["weight"]))) / F.col("n")
    spread = rows.join(sources, rows["source"].eqNullSafe(sources["s"])).withColumn("range", F.floor(below * F.ceil(F.col("n") / RANGE_ROWS)).cast("bigint"))
    spread = spread.select("doc_id", "row", "source", "size", "source_size", "target", "epochs", "rest", "key", "range")
    per_range = spread.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("before_range"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    summed = spread.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = summed.join(per_range, summed["source"].eqNullSafe(per_range["s"]) & (summed["range"] == per_range["r"]))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before_range") - F.col("inside")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"), "epochs", "row")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as the mix takes them: a row for every whole copy, and one cut after its words where a copy is partial.

    Every row is numbered first, so repeated rows and rows without an id are told apart; what is taken comes back by number.
    """
    row, words, taken, copy = new_names(docs.columns, 4)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    chosen = mix(numbered, id_col, text_col, source_col, row_col=row).where("taken > 0").select(F.col("row").alias(row), F.col("taken").alias(taken))
    rows = numbered.join(chosen, row).withColumn(words, n_words(text_col))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(words)).cast("int"))))
    left = (F.col(taken) - (F.col(copy) - 1) * F.col(words)).cast("int")
    found = F.regexp_extract_all(text_col, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    rows = rows.withColumn(text_col, F.when(left >= F.col(words), F.col(text_col)).otherwise(F.array_join(F.slice(found, F.lit(1), left), "")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
