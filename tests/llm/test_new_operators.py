"""Top-k search, importance resampling and phrases against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from waynet.llm import fingerprint, importance, phrases, queries, topk

SF = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_topk_blocks_ties_repeats_and_odd_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 1.0, 0.003]) for _ in range(6)]) for i in range(120)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (50, rows[50][1]), (50, [9.0]), (None, [5.0] * 6), (201, None), (202, [1.0, None]), (203, [float("nan")]), (204, [float("inf")]), (250, []), (251, [0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, id int, vector string").repartition(3)
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, v in sorted({(i, tuple(v)) for i, v in valid if i is not None and i % 50 == 0}):
        scored = [(-sum(a * b for a, b in itertools.zip_longest(v, w, fillvalue=0)), i is None, i or 0) for i, w in valid if i != q]
        expected += [(q, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:5])]
    sparse = topk.sparse_rows(vectors, 256)
    for sizes in ((4096, 2048), (2, 10)):
        out = topk.top_k(sparse, F.col("id") % 50 == 0, 5, *sizes)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    assert topk.top_k(sparse, F.col("id") % 50 == 0, 1000).count() == sum(len([1 for i, _ in valid if i != q]) for q, _ in {(i, tuple(v)) for i, v in valid if i is not None and i % 50 == 0})
    assert topk.top_k(sparse.limit(0), F.col("id") % 50 == 0).count() == topk.top_k(sparse, F.lit(False)).count() == 0


def test_topk_scores_are_exact_beyond_64_bits_inside(spark):
    big = 2.0**40
    vectors = spark.createDataFrame([(0, [big, big, 1.0]), (1, [big, -big, 3.0]), (2, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    out = topk.top_k(topk.sparse_rows(vectors, 1), F.col("id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(2, 2 * 2**40 + 1), (1, 3)]
    with pytest.raises(Exception, match="64 bits|OverflowError|too large|out of bounds"):
        topk.top_k(topk.sparse_rows(vectors, 2**12), F.col("id") == 1).collect()
        topk.sparse_rows(vectors, 2**30).collect()


def drawn_by_hand(docs, target, percent=25, least=20, seed=7, buckets=10_000):
    def feats(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(words), [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    s, t = collections.Counter(), collections.Counter()
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            side.update(feats(x)[1])
    whole_s, whole_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * whole_s / ((s[b] + 1) * whole_t))) for b in range(buckets)]
    out = []
    for i, x in docs:
        n, f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_importance_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = queries.op12_importance(spark, SF)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, out.collect()), key=repr) == drawn_by_hand(docs, target)


def edge_texts():
    base = "the cat sat on the mat while it rained all day long and nobody came by to ask them why not"
    texts = [None, "", " \n\t ", "a", "A B c.", "!!! ???", "Ünïcode ß 漢字 \U0001f600 x", base, base.upper(), f"{base}. Today", base * 200, "x" * 70_000, "pad " + "long" * 40 + " " + "long" * 40, base]
    return [(i, t) for i, t in enumerate(texts)] + [(7, base), (None, base), (None, None)]


def edge_table(spark):
    return spark.createDataFrame([(i, t, [None, "en", "und", "de"][k % 4], "s", 1, 2, "p", 3) for k, (i, t) in enumerate(edge_texts())], "doc_id long, text string, lang string, source string, n long, rank int, phrase string, weight int").repartition(3)


def test_importance_edges(spark):
    target = spark.createDataFrame([(1, "The cat sat on the mat"), (2, None)], "item_id long, text string")
    out = importance.resample(edge_table(spark), target, 50, 5)
    rows = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out.collect()]
    expected = drawn_by_hand(edge_texts(), ["The cat sat on the mat", None], 50, 5)
    # Rows that repeat share their ranks among themselves.
    assert sorted(r[:4] for r in map(lambda r: (str(r[0]), *r[1:]), rows)) == sorted(r[:4] for r in map(lambda r: (str(r[0]), *r[1:]), expected))
    assert sorted(r[4] for r in rows if r[4]) == sorted(r[4] for r in expected if r[4])
    assert importance.resample(edge_table(spark).limit(0), target).count() == 0
    assert {r["weight"] for r in importance.resample(edge_table(spark), target.limit(0), 50, 5).where("n_features = 0").collect()} == {0}


def mined_by_hand(docs, least=10, most=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    kept = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = collections.Counter()
    for (lang, p), a in kept.items():
        if len(p) == 3:
            for part in (p[:2], p[1:]):
                longer[lang, part] = max(longer[lang, part], a)
    out = []
    for lang in n:
        rows = []
        for (own, p), a in kept.items():
            if own == lang and (len(p) == 3 or 100 * longer[lang, p] < 50 * a):
                cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most])]
    return sorted(out)


def phrase_docs():
    rng = random.Random(2)
    words = ["New", "york", "times", "is", "the", "of", "a", "ß", "漢字", "it's", "x-y"]
    docs = [(rng.choice(["en", None, "de", "und"]), " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(rng.randint(0, 80)))) for _ in range(60)]
    return docs + [("en", "new york times " * 15), ("en", None), (None, ""), ("fr", "solo"), ("en", "z" * 9000), ("de", " , ;; \r\n"), ("en", "New\x0bYork\x0cTimes\x00 is")]


@pytest.mark.parametrize("bits", [16, 24])
def test_phrases_equal_brute_force(spark, bits):
    docs = phrase_docs()
    table = spark.createDataFrame([(i, t, lang, 1, "p") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, n int, phrase string").repartition(5)
    out = phrases.collocations(table, bits=bits)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = mined_by_hand([(lang or "und", t) for lang, t in docs])
    assert sorted(map(tuple, out.collect())) == expected and expected


def test_phrases_keep_the_first_of_a_language_only(spark):
    docs = phrase_docs()
    table = spark.createDataFrame([(t, lang) for lang, t in docs], "text string, lang string")
    out = phrases.collocations(table, 3, 5, bits=16)
    assert sorted(map(tuple, out.collect())) == mined_by_hand([(lang or "und", t) for lang, t in docs], 3, 5)
    assert phrases.collocations(table.limit(0), bits=16).count() == 0
    assert phrases.collocations(edge_table(spark), bits=16).where("lang = 'de' AND n < 1").count() == 0


def test_buckets_prune_what_cannot_be_frequent(spark):
    """Of phrases that occur once none passes to the exact count but by a shared bucket."""
    texts = spark.createDataFrame([(" ".join(f"w{i % 40}" for i in range(j, j + 3)), "en") for j in range(40)] * 3 + [(f"rare{j} w1 odd{j}", "en") for j in range(500)], "text string, lang string")
    one = phrases._pass(texts.select("lang", "text"), 1, 3, 3, 16, None, None)
    frequent = one.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where("n >= 3")
    context = spark.sparkContext
    two = phrases._pass(texts.select("lang", "text"), 2, 3, 3, 16, context.broadcast(phrases._bitmap(phrases._marked(frequent, 1, 16), 1, 16)), context.broadcast(phrases._bitmap(one, 3, 16)))
    counted = {r["phrase"] for r in two.where("phrase IS NOT NULL").collect()}
    assert {f"w{i} w{i + 1}" for i in range(39)} <= counted and len(counted) < 60


def test_long_texts_take_time_in_proportion(spark):
    """op10's leaves of a text of 128,000 different words take at most 3 times as long as of 64,000."""
    import time

    def seconds(n):
        text = " ".join(f"w{i:06d}" for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        began = time.time()
        df.select(F.size(fingerprint.leaves(fingerprint.tree(F.col("text")), F.col("text"))["blocks"])).collect()
        return time.time() - began

    seconds(1000)
    assert seconds(128_000) < 3 * max(1.0, seconds(64_000))


def test_five_megabytes_in_one_text(spark):
    text = "The quick brown fox, jumps over the lazy dog again; and again " * 85_000
    table = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    (row,) = importance.resample(table, table, 100, 1).collect()
    assert row["n_words"] == 12 * 85_000 and row["n_features"] == 2 * 12 * 85_000 - 1 and row["weight"] == 0
    assert {r["n"] for r in phrases.collocations(table, bits=16).collect()} == {12 * 85_000}
    assert 0 < fingerprint.compare_with_edit(table).first()["near_edited"] <= 1
