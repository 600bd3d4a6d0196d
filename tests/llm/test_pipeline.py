"""The pipeline's stages against brute force, each on what its predecessor kept; and run()'s rows against the stages'."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_operators import components_by_force
from waynet.llm import bpe, mixing, queries

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(docs)
        stage(spark, docs, SF).write.parquet(path := f"file://{tmp_path}/{k}")
        out = spark.read.parquet(path)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        docs = out
    texts = [{r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in seen]
    assert set(texts[1]) == {i for i, t in texts[0].items() if t and any(c.isalpha() for c in t)}
    assert set(texts[2]) == set({t: i for i, t in sorted(texts[1].items())}.values())
    assert set(texts[3]) == {i for i, (_, c) in components_by_force(list(texts[2].items())).items() if i == c}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(seen[3]).collect() if r["taken"]}
    got = {r[0]: r[1] for r in seen[4].select("doc_id", mixing.n_words("text").alias("n")).groupBy("doc_id").sum("n").collect()}
    assert got == taken
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.VOCABULARY), special_tokens={})
    expected = sorted((r["doc_id"], library.encode_ordinary(r["text"])) for r in seen[4].collect())
    assert sorted((r["doc_id"], r["ids"]) for r in docs.collect()) == expected
    assert sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()) == expected


def test_null_ids_stay(spark):
    """A row without an id passes near dedup and is mixed as often as mix() takes it."""
    rows = [(k, f"{chr(97 + k)} " * (5 + k), "en", "a", 10 + 2 * k) for k in range(6)] + [(None, "one two three four five six seven eight nine", "en", "a", 43)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(out.collect(), key=str) == sorted(docs.collect(), key=str)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    got = {r[0]: r[1] for r in mixing.mixed(docs).select("doc_id", mixing.n_words("text").alias("n")).groupBy("doc_id").sum("n").collect()}
    assert taken[None] > 0 and got == taken
