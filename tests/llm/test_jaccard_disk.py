"""What the near-duplicate join leaves on disk, and that its lists don't grow with the table."""

import itertools
import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_operators import components_by_force
from waynet.llm import common, jaccard

SCHEMA = "doc_id long, text string"


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(f) for f in manager.localDirsString() for f in Path(f).rglob("shuffle_*")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = common.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert out.count() == 7 and not [f for f in shuffle_files(spark) - before if f.endswith(".data") and Path(f).stat().st_size > 1000]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_the_sample_grows_with_the_table(spark, monkeypatch):
    """A passage in 96 of 800 texts is common, though the least sample has hardly one of them."""
    monkeypatch.setattr(jaccard, "SAMPLE_ROWS", 8)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(12))
    texts = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) + (f" {passage}" if k % 8 == 1 and k < 768 else "")) for k in range(800)]
    marks, sizes, _ = jaccard._common(spark.createDataFrame(texts, SCHEMA))
    (own,) = jaccard.Shingler().sets(np.frombuffer(passage.encode(), np.uint8), np.array([0, len(passage)]))
    assert jaccard._is_common(own, marks).all() and len(marks) < 20 and set(sizes) <= {17, 29}


def test_little_is_left_and_lists_of_one_main_component_meet_once(spark, monkeypatch, tmp_path):
    """Near copies of one text, of which some link with none: their many lists are one, and only small tables stay."""
    monkeypatch.setattr(jaccard, "SHORT_LIST", 8)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 8)
    compared, gathered, kept = [], jaccard._gathered, []
    monkeypatch.setattr(jaccard, "_gathered", lambda label: compared.append((label.select("key").distinct().count(), gathered(label))) or compared[-1][1])
    plain = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: kept.append((name, out := plain(df, name))) or out)
    rng = random.Random(2)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for k in range(80):
        own = list(base)
        for _ in range(1 + k % 3):
            own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append((k, " ".join(own)))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert out == components_by_force(texts) and len({c for _, c in out.values()}) > 3
    (lists, made), = compared
    left = {name for name, df in kept if Path(df.inputFiles()[0].removeprefix("file:")).exists()}
    assert lists > 3 and not left & {"jaccard-keys", "jaccard-nodes", "jaccard-pairs", "jaccard-ids", "jaccard-sets", "jaccard-lists", "jaccard-common"}
    assert made.select("key").distinct().count() < lists


def test_gathered_lists_hold_every_odd_pair(spark):
    """Whatever lists are one, a row outside the main component still meets all rows of each of its lists."""
    rng = random.Random(9)
    rows = [(key, i, 10, i // 4 * 4 if i < 28 else i) for key in range(12) for i in rng.sample(range(40), 10)]
    label = spark.createDataFrame(rows, "key long, id long, m long, component long")
    got = [tuple(r) for r in jaccard._gathered(label).select("key", "id", "odd").collect()]
    met = {(a, b) for k, a, odd in got if odd for j, b, _ in got if j == k}
    for _, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        assert all(a[3] == b[3] or (a[1], b[1]) in met or (b[1], a[1]) in met for a, b in itertools.combinations(own, 2))
