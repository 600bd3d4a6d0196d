"""The pipeline's stages on nulls, ties, repeated rows, clashing names, an empty table and a long text."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waynet.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id long, __digest string, __size long, __words long, __copy int, __taken long, _own0 int"
BASE = "the cat sat on the mat while it rained all day long and nobody came by to ask them why"
LONG = "der hund lief durch den wald und fand nichts als regen " * 4000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, BASE), (2, BASE), (2, BASE), (3, BASE + " today"), (4, None), (5, ""), (6, "!!! 42"), (None, "one two three four five six"), (8, "ein anderer text ganz ohne bezug zu den übrigen"), (9, LONG)]
    rows = [(i, t, "de" if t and "der" in t else "en", ["a", "b", None][k % 3], len(t or ""), 7, "x", 7, 7, 7, 7, 7) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_an_empty_table_stays_empty(spark, docs, name, stage):
    out = stage(spark, docs.limit(0), "")
    assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_every_stage_keeps_what_it_should(spark, docs, tmp_path):
    stages, seen, now = dict(corpus_pipeline.STAGES), {}, docs
    for name in ("language_id", "exact_dedup", "near_dedup"):
        stages[name](spark, now, "").write.parquet(path := f"file://{tmp_path}/{name}")
        now = spark.read.parquet(path)
        assert now.columns == docs.columns
        seen[name] = rows(now)
    assert seen["language_id"] == collections.Counter({(1, BASE): 1, (2, BASE): 2, (3, BASE + " today"): 1, (None, "one two three four five six"): 1, (8, "ein anderer text ganz ohne bezug zu den übrigen"): 1, (9, LONG): 1})
    assert seen["exact_dedup"] == seen["language_id"] - collections.Counter({(1, BASE): 1, (2, BASE): 1})
    assert seen["near_dedup"] == seen["exact_dedup"] - collections.Counter({(3, BASE + " today"): 1})
    mixed = stages["mixing"](spark, now, "")
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(mixing.n_words("text"))).first()[0] == mixing.mix(now).agg(F.sum("taken")).first()[0]
