"""A corpus pipeline of five stages: language ID, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which its predecessor kept;
all but the last return the columns of docs. An empty table gives an empty result in each, and columns may have any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waynet.llm import bpe, exact_dedup, jaccard, language, mixing
from waynet.llm.common import crc_fold, new_names, scratch
from waynet.llm.queries import VOCABULARY


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is among ids, null too; docs may have columns of any name."""
    (own,) = new_names(docs.columns, 1)
    return docs.join(ids.select(F.col("doc_id").alias(own)).distinct(), F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts and texts without a letter go."""
    model = language.fit(docs.where(crc_fold("doc_id", 3) != 1))
    return _kept(docs, language.predict(docs, model).where("lang_pred <> 'und'"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id; of repeated rows one. A null text counts as empty."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest doc_id; rows of one id are one. A null doc_id links with nothing and stays."""
    return _kept(docs, jaccard.jaccard_components(docs).where("doc_id <=> component_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's border is cut there. Rows without words go."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; none for a null or empty text."""
    encoded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: SQL can't express the learned first stage nor the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
