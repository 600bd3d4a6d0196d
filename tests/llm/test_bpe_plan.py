"""The plans of the encoder, which the driver keeps with their descriptions."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from waynet.llm import bpe
from waynet.llm.queries import VOCABULARY


def test_ranks_are_in_no_plan(spark):
    docs = spark.createDataFrame([(1, "one two  three"), (2, None), (3, "x" * 70)], "doc_id long, text string")
    encoded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    assert len(encoded._jdf.queryExecution().toString()) < 200_000
    assert {r.doc_id: len(r.ids) > 0 for r in encoded.collect()} == {1: True, 2: False, 3: True}


def test_ids_are_decoded_in_runs_of_rows(monkeypatch):
    """Rows longer than a run, empty ones and ids without a piece, without a Python step for each id."""
    monkeypatch.setattr(bpe, "DECODED_IDS", 4)
    pieces = [b"a", b"", b"\xc3\x9f", b"long piece"]
    rows = [[], [0, 3], [2, 1, 2, 0, 3, 3, 0], [], [1], [3, 3, 3, 0], []]
    ends = np.cumsum([0] + [len(r) for r in rows])
    values = np.array([i for r in rows for i in r], np.int32)
    found = list(bpe._decoded(values, ends, pa.array(pieces, pa.large_binary())))
    assert [(ids.tolist(), data) for ids, data in found] == [(r, b"".join(pieces[i] for i in r)) for r in rows]
    assert list(bpe._decoded(values[:0], ends[:1], pa.array(pieces, pa.large_binary()))) == []


def test_new_words_get_codes_once_after_the_common_ones():
    codes = bpe.WordCodes({"the": 0, " of": 1})
    assert [codes[w] for w in ("the", "ß", " of", "x", "ß")] == [0, 2, 1, 3, 2]
    assert codes.new == ["ß".encode(), b"x"] and len(codes) == 4
