"""Exact deduplication by a stateful stream, by DataFrame functions alone.

Arrivals (identifier, digest, content locator) run through a Structured Streaming
aggregation whose keyed state lies on disk (RocksDB), checkpointed to the shared folder, and
never expires. For every digest it retains the largest identifier seen, where that
document's content is, and a count. Rows that hit an existing digest are then compared
with the retained document's full bytes; should they differ, they are grouped by their text instead, so a
digest's collisions don't merge documents.

A state folder given by the caller outlives the call: later documents are compared with all that arrived before, whose
bytes are read by the retained locator, the file that held them. Without one the state is of this call alone.

Digests that hold more than their part of all rows are joined by a broadcast of a bounded size, and
full bytes are compared in salted runs of SALT_ROWS rows, each beside the retained document.

A null text counts as empty. Rows of one id with equal texts are copies too, and one of
them stays; rows of one id with different texts are different documents. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from waynet.llm.common import is_hot, join_split, materialize, new_names, scratch, whole_text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a digest that one retained text is compared with in one place.
SALT_ROWS = 1000
#: Digests of copies are broadcast up to this many (about 30 MB), so texts without a copy aren't shuffled; beyond, by a shuffle.
BROADCAST_GROUPS = 1 << 18
#: Settings of the stream's own session. The memory of all stores of an executor is bounded together.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def stream_state(arrivals: str, schema: StructType, where: str, spark: SparkSession, files_per_batch: int = 1000) -> DataFrame:
    """digest, keep_id, keep_seq, keep_file, keep_call and n of every digest of a folder of arrivals, from the stream's state at `where`.

    Files that the state has seen aren't read again.
    """
    own = spark.newSession()
    for k, v in {**STATE_SETTINGS, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(k, v)
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
    keeper = F.max(F.struct("doc_id", "seq", "call", "file")).alias("keeper")
    state = stream.groupBy("digest").agg(keeper, F.count(F.lit(1)).alias("n"))
    state.writeStream.format("noop").outputMode("update").option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.format("statestore").load(where)
    keeper, n = (F.col("value")[f.name] for f in kept.schema["value"].dataType.fields[:2])
    return kept.select(F.col("key.digest").alias("digest"), keeper["doc_id"].alias("keep_id"), keeper["seq"].alias("keep_seq"), keeper["call"].alias("keep_call"), keeper["file"].alias("keep_file"), n.alias("n"))


def _earlier_texts(copied: DataFrame, call: str, id_col: str, text_col: str, digest) -> DataFrame | None:
    """digest and text of the retained documents of earlier calls, read from the files that their locators name."""
    earlier = copied.where(F.col("keep_call") != call)
    files = [r[0] for r in earlier.select("keep_file").distinct().collect()]  # files of earlier inputs, not documents
    if not files:
        return None
    if "" in files:
        raise ValueError("documents that aren't read from files have no locator to compare later ones with")
    found = copied.sparkSession.read.parquet(*files).select(F.col(id_col).alias("keep_id"), whole_text(text_col).alias("text"))
    found = found.withColumn("digest", digest(F.col("text"))).join(earlier.select("digest", "keep_id"), ["digest", "keep_id"], "left_semi")
    return found.select("digest", "text").dropDuplicates(["digest"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, state: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest. Of equal texts the row of the largest id stays, also among those that a kept state has seen."""
    spark, call = docs.sparkSession, uuid.uuid4().hex
    folder = state or scratch(spark, "dedup-state")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.input_file_name().alias("file"))
    keyed = rows.select("doc_id", digest(F.col("text")).alias("digest"), "file").withColumns({"seq": F.monotonically_increasing_id(), "call": F.lit(call)})
    keyed.write.mode("append").parquet(f"{folder}/arrivals")
    arrivals = spark.read.schema(keyed.schema).parquet(f"{folder}/arrivals").where(F.col("call") == call)
    if arrivals.isEmpty():
        return arrivals.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "digest").limit(0)
    groups = materialize(stream_state(f"{folder}/arrivals", keyed.schema, f"{folder}/checkpoint", spark), "dedup-groups")
    hot = groups.where(is_hot(F.col("n"), arrivals.count()))
    is_keeper = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("seq") == F.col("keep_seq")) & (F.col("keep_call") == call)
    found = join_split(arrivals, groups.drop("keep_file"), hot, ["digest"]).select("digest", "doc_id", "keep_id", "n", is_keeper.alias("is_keeper"))
    found = materialize(found, "dedup-found")

    # Full bytes on hits: the texts of digests seen more than once, against the retained document's.
    copied = materialize(groups.where("n > 1").select("digest", "keep_id", "keep_call", "keep_file", "n"), "dedup-copied")
    sought = copied.select("digest", "keep_id", "n", (F.col("keep_call") == call).alias("own"))
    hits = rows.withColumn("digest", digest(F.col("text")))
    hits = hits.join(F.broadcast(sought), "digest") if copied.count() <= BROADCAST_GROUPS else join_split(hits, sought, hot, ["digest"])
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    salt = F.pmod(F.monotonically_increasing_id(), salts).cast("int")
    hits = materialize(hits.select("digest", "doc_id", "text", salt.alias("salt"), salts.alias("salts"), (F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("retained")), "dedup-hits")
    retained = hits.where("retained").groupBy("digest", "salts").agg(F.max("text").alias("bytes"))
    earlier = _earlier_texts(copied, call, id_col, text_col, digest) if state else None
    if earlier is not None:
        retained = retained.unionByName(earlier.join(hits.select("digest", "salts").distinct(), "digest").select("digest", "salts", F.col("text").alias("bytes")))
    retained = retained.select("digest", "bytes", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    unlike = hits.join(retained, ["digest", "salt"]).where(F.col("text") != F.col("bytes")).select("digest", "doc_id", "text")
    unlike = materialize(unlike, "dedup-unlike")
    if unlike.isEmpty():
        return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("is_keeper").alias("kept"), "digest")
    own = Window.partitionBy("digest", "text")
    regrouped = unlike.select("digest", "doc_id", F.max("doc_id").over(own).alias("own_keep"), F.count(F.lit(1)).over(own).alias("own_size")).dropDuplicates(["digest", "doc_id"])
    fewer = unlike.groupBy("digest").agg(F.count(F.lit(1)).alias("fewer"))

    out = found.join(regrouped, ["digest", "doc_id"], "left").join(fewer, "digest", "left")
    apart = F.col("own_keep").isNotNull()
    return out.select(
        "doc_id",
        F.when(apart, F.col("own_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(apart, F.col("own_size")).otherwise(F.col("n") - F.coalesce("fewer", F.lit(0))).alias("group_size"),
        F.when(apart, F.col("own_keep") == F.col("doc_id")).otherwise(F.col("is_keeper")).alias("kept"),
        "digest",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns; of repeated rows one."""
    own, mark = new_names(docs.columns, 2)
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(own), F.col("digest").alias("digest"))
    marked = docs.withColumn(mark, sha256(whole_text(text_col)))
    found = marked.join(kept.withColumnRenamed("digest", "_" + mark), marked[id_col].eqNullSafe(F.col(own)) & (F.col(mark) == F.col("_" + mark)), "left_semi")
    return found.dropDuplicates([id_col, mark]).select(*docs.columns)
