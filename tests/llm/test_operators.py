"""The ten operators: edge cases for all, and brute force, round trips or held-out accuracy for each."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from waynet.llm import bpe, chat, exact_dedup, fingerprint, jaccard, language, mixing, quality, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, size long, n long, range int, node long, key string, id long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, texts):
    rows = [(i, t, ["en", "de", None][k % 3], ["a", "b", "c", None][k % 4], len(t or ""), 0.0, "x", 1, 1, 1, 1, "k", 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def edge_texts():
    base = "the cat sat on the mat while it rained all day long and nobody came by to ask them why"
    texts = [None, "", " \n\t ", "a", "a b c", "!!! ???", "Ünïcode ß 漢字 \U0001f600 x", base, base.upper(), base + " today", base * 2000, "x" * 50_000, "<|im_start|>\\n<\\|", 'token = "abcdefgh12345678"']
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(7, base), (20, base), (21, ""), (22, None)]


OPERATORS = {
    "quality": lambda d: quality.score(d, quality.ByteConvNet()),
    "secrets": lambda d: secrets.scan(d, secrets.fit(d)),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d.withColumn("y", F.pmod("doc_id", F.lit(2))), "y")),
    "jaccard": jaccard.jaccard_components,
    "language": lambda d: language.predict(d, language.fit(d)),
    "mixing": mixing.mix,
    "bpe": lambda d: bpe.encode(d, queries.VOCABULARY, public_tokenizers.PATTERN),
    "exact_dedup": exact_dedup.exact_groups,
    "fingerprint": fingerprint.compare_with_edit,
}


def test_chat_edges(spark):
    """Null roles, texts and ids, ties, repeated rows, an unbounded turn and clashing columns."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "first"), (1, 2, None, None), (1, 2, "assistant", "b"), (None, 0, "assistant", "c"), (2, 0, "assistant", "word " * 40_000)]
    turns = spark.createDataFrame([(*r, 1, 1) for r in rows], "conv_id long, turn long, role string, text string, window int, tokens int")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_windows(turns, 50, 10)).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("system", "first"), ("user", "a"), ("user", "a"), ("", ""), ("assistant", "b")]
    assert out[1]["loss_text"] == "b" and out[None]["loss_text"] == "c" and out[2]["loss_text"] == "word " * 40_000


def test_edited_branches_name_sections_and_paragraphs(spark):
    old, new = "a\n\nb one\nb two\n\nc", "a\n\nnew\n\nb one\nb 2\n\nc"
    for a, b, expected in ((old, old, None), (old, new, ((1, 1, 2), (0, 2, 3))), (old, old.replace("two", "2"), ((1, 1, 1), (1, 1, 1)))):
        rows = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.edited_branches(fingerprint.tree(F.col("a")), fingerprint.tree(F.col("b"))).alias("e"))
        e = rows.first()["e"]
        assert (e and (tuple(e["sections"]), tuple(e["paragraphs"]))) == expected


@pytest.mark.parametrize("name", OPERATORS)
def test_edges_give_a_row_each(spark, name):
    rows = edge_texts()
    out = OPERATORS[name](table(spark, rows)).select("doc_id").collect()
    assert sorted(r[0] for r in out) == sorted(i for i, _ in rows)
    assert OPERATORS[name](table(spark, rows).limit(0)).count() == 0


def test_bpe_equals_tiktoken_and_round_trips(spark):
    ranks = bpe.load_ranks(queries.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = dict(edge_texts())
    out = bpe.decode(bpe.encode(table(spark, rows.items()), queries.VOCABULARY, public_tokenizers.PATTERN), queries.VOCABULARY).collect()
    for r in out:
        text = rows[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert bytes(r["bytes"]) == text.encode()


def test_exact_dedup_holds_with_colliding_digests(spark):
    rows = [(i, "t%d" % (i % 7)) for i in range(60)]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for digest in (exact_dedup.sha256, lambda t: F.lit("same"), lambda t: (F.crc32(t) % 3).cast("string")):
        for r in exact_dedup.exact_groups(table(spark, rows), digest=digest).collect():
            own = groups["t%d" % (r["doc_id"] % 7)]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
    assert sorted(r[0] for r in exact_dedup.deduplicated(table(spark, rows + rows[-7:])).select("doc_id").collect()) == list(range(53, 60))


def test_kept_state_knows_earlier_calls(spark, tmp_path):
    """Later documents are compared with all that came before, by the bytes in the files that the state names."""
    first, second = [(i, "t%d" % (i % 4)) for i in range(8)], [(20, "t0"), (3, "t1"), (21, "new"), (22, "new")]
    paths = []
    for k, rows in enumerate((first, second)):
        paths.append(f"file://{tmp_path}/{k}")
        table(spark, rows).write.parquet(paths[-1])
    for digest in (exact_dedup.sha256, lambda t: F.lit("same")):
        state = f"file://{tmp_path}/state-{'sha' if digest is exact_dedup.sha256 else 'same'}"
        exact_dedup.exact_groups(spark.read.parquet(paths[0]), digest=digest, state=state).count()
        out = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(spark.read.parquet(paths[1]), digest=digest, state=state).collect()}
        if digest is exact_dedup.sha256:
            assert out == {20: (20, True), 3: (5, False), 21: (22, False), 22: (22, True)}
        else:  # one digest for all: the retained document is 22, and other texts are grouped among themselves
            assert out[22] == (22, True) and out[21] == (22, False)


def test_boundary_follows_sizes_and_lists():
    small, large = {s: 100 for s in range(1, 12)}, {s: 100 for s in range(300, 320)}
    assert jaccard.choose_boundary({}, 5) == 0
    assert jaccard.choose_boundary(small, 0.0) < jaccard.choose_boundary(small, 60.0)
    assert jaccard.choose_boundary(large, 60.0) == 0


def components_by_force(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("short_list", [128, 2])
def test_jaccard_equals_brute_force(spark, monkeypatch, short_list):
    """With short_list 2 nearly all lists take the way of long ones."""
    monkeypatch.setattr(jaccard, "SHORT_LIST", short_list)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        words = [f"w{rng.integers(40)}" for _ in range(int(rng.integers(1, 70)))]
        for _ in range(6):
            own = list(words)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(len(own)))] = f"w{rng.integers(40)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(100, None), (101, ""), (102, "")]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, rows)).collect()}
    assert out == components_by_force(rows)


def test_chat_reads_back(spark):
    rows = [(c, t, r, x) for c in range(4) for t, (r, x) in enumerate([("system", "be <|im_end|> kind"), *((("user", "assistant")[k % 2], f"say \\n <\\|{k} " + "word " * (40 * c)) for k in range(9)), ("assistant", None)])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(turns, 200, 60)
    assert windows.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 1
    for r in chat.read_back(windows).collect():
        own = [(role, x or "") for c, _, role, x in rows if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert r["loss_text"] == "".join(x for role, x in own if role == "assistant")
    assert chat.read_back(chat.format_windows(turns.limit(0))).count() == 0


def test_targets_are_shared_again_beyond_three_times(spark):
    """Against sharing what is cut off round by round."""
    sizes = {"a": 5, "b": 100, "c": 1000, "d": 2, "e": 4000, None: 7}
    names = sorted((k for k in sizes if k is not None)) + [None]
    weights = {k: i % 3 + 1 for i, k in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        whole, spare = sum(weights[k] for k in free), 0.0
        for k in sorted(free, key=str):
            target[k] += left * weights[k] / whole
            if target[k] > 3 * sizes[k]:
                spare += target[k] - 3 * sizes[k]
                target[k] = 3.0 * sizes[k]
        left, free = spare, {k for k in free if target[k] < 3 * sizes[k]}
    out = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in out} == pytest.approx(target)


def test_draw_goes_by_keys_and_rows_are_told_apart(spark):
    """Within a source, documents are taken in the order of their exponential keys; repeated rows are taken each for itself."""
    rows = [(i, "word other thing " * (1 + i % 5)) for i in range(80)] + [(7, "word other thing " * 3)] * 4 + [(None, "a b c d")] * 3
    docs = table(spark, [(i, t) for i, t in rows]).withColumn("__row", F.lit(1)).withColumn("_own0", F.lit(2))
    unit = (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keys = {(r["doc_id"], r["size"]): r["key"] for r in docs.select("doc_id", mixing.n_words("text").alias("size"), (-F.log(unit) / mixing.quality_weight("text")).alias("key")).collect()}
    sources = collections.defaultdict(list)
    for r in mixing.mix(docs).collect():
        sources[r["source"]].append((keys[r["doc_id"], r["size"]], r["taken"] - r["epochs"] * r["size"], r["size"]))
    for own in sources.values():
        parts = [(part, size) for _, part, size in sorted(own)]
        full = [part == size for part, size in parts]
        assert full == sorted(full, reverse=True) and sum(0 < part < size for part, size in parts) <= 1
    back = mixing.mixed(docs)
    assert back.columns == docs.columns
    assert back.select(mixing.n_words("text").alias("n")).agg(F.sum("n")).first()[0] == mixing.mix(docs).agg(F.sum("taken")).first()[0]


def test_mixing_meets_targets(spark):
    rows = [(i, "word " * (1 + i % 9)) for i in range(200)]
    out = mixing.mix(table(spark, rows)).toPandas()
    sums = out.groupby("source", dropna=False).agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"))
    assert abs(sums["taken"] - sums["target"]).max() <= 0.5
    assert abs(sums["target"].sum() - out["size"].sum()) < 1e-6
    assert (out["taken"] <= 3 * out["size"]).all()
    again = mixing.mix(table(spark, rows)).toPandas()
    assert dict(zip(out["doc_id"], out["taken"])) == dict(zip(again["doc_id"], again["taken"]))
    words = mixing.mixed(table(spark, rows)).select(mixing.n_words("text").alias("n")).agg(F.sum("n")).first()[0]
    assert words == out["taken"].sum()


def test_fingerprints(spark):
    rows = [(1, "a b c\nd e f g\n\nh"), (2, "a b c\nd e f g\n\nh"), (5, "x y z " * 30), (9, None)]
    texts = {i: t or "" for i, t in rows}
    out = {r["doc_id"]: r for r in fingerprint.compare_with_edit(table(spark, rows)).collect()}
    assert out[1]["fingerprint"] == out[2]["fingerprint"] != out[5]["fingerprint"]
    for i, following in ((9, 5), (5, 2), (2, 1), (1, 9)):
        half = len(texts[i]) // 2
        assert out[i]["edited_sha256"] == sha(texts[i][: len(texts[i]) - half] + texts[following][:half])
    assert out[2]["near_next"] == 1.0


def test_secrets(spark):
    rows = dict(edge_texts())
    for r in secrets.scan(table(spark, rows.items()), secrets.SecretField()).collect():
        base = secrets.base_spans(rows[r["doc_id"]] or "")
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, k, b in base))
    assert secrets.base_spans("Password: 12345678 AKIA0123456789AB") == [(0, "assign", 18), (19, "access", 35)]


def scan_by_force(text):
    """Base matches by plain patterns in ASCII, kind by kind."""
    import regex

    word, found = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])", []
    for kind, pattern, least in ((0, word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), (1, "(AKIA[A-Z0-9]+)", 16), (2, "([0-9a-f]+)", 32)):
        found += [(m.start(), kind, m.end()) for m in regex.finditer(pattern, text) if len(m[1]) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets_of_random_neighbours_equal_plain_patterns(spark):
    rng = np.random.default_rng(12)
    bits = ["password", "Token", "api_key", "\u017fecret", "to\u212aen", "=", ": ", "'", " ", "abcdefgh1", "AKIA", "0123456789ABCDEF", "deadbeef" * 4, "ab12", "\u00fc", "\n", "x"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 12)))) for _ in range(400)]
    for r in secrets.scan(table(spark, list(enumerate(texts))).coalesce(1), secrets.SecretField()).collect():
        assert r["base_sha256"] == sha(scan_by_force(texts[r["doc_id"]])), texts[r["doc_id"]]


def test_field_finds_secrets_that_no_base_pattern_knows(spark):
    """Planted credentials without a base match are found, and plain prose is left alone."""
    rng = np.random.default_rng(7)
    value = lambda: "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"), 20))
    prose = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = secrets.fit(prose)
    told = [(i, f"the new credential is {value()} and it ends today") if i % 2 else (i, f"log in with pwd = {value()} or call us") for i in range(60)]
    clean = [(100 + i, "we met at the old station and talked about the weather for a long while, then took bus 42 home") for i in range(30)]
    assert all(not scan_by_force(t) for _, t in told + clean)
    out = {r["doc_id"]: r["n_added"] for r in secrets.scan(table(spark, told + clean), field).collect()}
    assert sum(out[i] > 0 for i, _ in told) >= 48 and not any(out[i] for i, _ in clean)


def test_secrets_do_not_depend_on_neighbours(spark):
    """Runs, keywords and turns end where a text does, also an empty one between."""
    texts = ["0123456789abcdef" * 2] * 2 + ["", "deadbeef" * 8, "my pass", "word=abcdefgh1", "xAK", "IA0123456789ABCDEF", "a1b2c3d4A", "-x"]
    out = {r["doc_id"]: r for r in secrets.scan(table(spark, list(enumerate(texts))).coalesce(1), secrets.SecretField()).collect()}
    for i, text in enumerate(texts):
        assert out[i]["n_hex"] == sum(kind == "hex" for _, kind, _ in secrets.base_spans(text))
        assert out[i]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, k, b in secrets.base_spans(text)))
    ends = np.cumsum([0, *map(len, texts)])
    joined = secrets.Tokens(np.frombuffer("".join(texts).encode(), np.uint8), ends)
    alone = [secrets.Tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts]
    assert joined.maybe_base.tolist() == [bool(t.maybe_base[0]) for t in alone]
    for k, codes in enumerate(joined.codes):
        assert codes.tolist() == [c for t in alone for c in t.codes[k].tolist()]


def test_viterbi_with_outside_runs_cut_off_equals_the_whole_chain():
    rng = np.random.default_rng(4)
    field = secrets.SecretField()
    field.moves = rng.normal(0, 1, (3, 3))
    field.tables = [rng.normal(0, 1.5, t.shape) for t in field.tables]
    data = np.frombuffer(b"token = abc123XYZ99 then some words password=12 and 77aa88bb " * 20, np.uint8)
    tokens = secrets.Tokens(data, np.array([0, len(data)]))
    assert (field.decode(tokens) == secrets.viterbi(field.emissions(tokens.codes), field.moves)).all()


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = ["idiot", "worthless", "scum", "disgusting"]
    automaton = toxicity.TermAutomaton(terms)
    for word in ["idiot", "idot", "idioot", "idxxt", "scum", "scun", "worthles", "wrthless", "disgustng", "digustng", "dsgstng", ""]:
        found = [d for t in terms if (d := distance(word, t)) <= toxicity.allowed_edits(t)]
        assert automaton.edits(word) == (min(found) if found else -1)


def test_shortened_heads_lose_no_hit():
    rng = np.random.default_rng(5)
    draw = lambda n: "".join(rng.choice(list("abc"), n))
    terms = [draw(int(n)) for n in rng.integers(1, 17, 60)] + ["bcab*", "ccacb*"]
    automaton = toxicity.TermAutomaton(terms)
    words = [draw(int(n)) for n in rng.integers(0, 19, 1500)] + terms
    for term in terms:
        for _ in range(15):
            word = list(term)
            for _ in range(int(rng.integers(0, 4))):
                k = int(rng.integers(0, len(word) + 1))
                word[k : k + int(rng.integers(0, 2))] = draw(int(rng.integers(0, 2)))
            words.append("".join(word))
    assert [automaton.edits(w) for w in words] == [automaton.walk(w) for w in words]
    told = dict(automaton.accepted(words))
    assert told == {w: e for w in words if (e := automaton.walk(w)) >= 0}


def test_words_run_along_paths_of_few_terms_only():
    """Of thousands of terms a misspelled word is compared with those near it; no state of the whole trie is built, but for paths beyond a number's bits."""
    rng = np.random.default_rng(6)
    draw = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    terms = sorted({draw(int(n)) for n in rng.integers(5, 15, 3000)})
    words = [t[:k] + draw(2) + t[k + 2 :] for t in terms[::7] for k in (1, len(t) - 2)]
    automaton = toxicity.TermAutomaton(terms)
    told = dict(automaton.accepted(words))
    assert len(automaton.states) == 1 and not automaton.steps
    assert told == {w: e for w in words if (e := automaton.walk(w)) >= 0} and 0 < len(told) < len(set(words))
    long = draw(70)
    assert dict(toxicity.TermAutomaton([long, "abcdefghi"]).accepted([long[:50] + long[52:], long[3:], "abcdfghi"])) == {long[:50] + long[52:]: 2, "abcdfghi": 1}


def test_rare_and_short_terms_enter_the_lexicon(spark):
    """300 terms in three toxic texts each, beside 250 commoner ones that begin alike; and a term of three letters."""
    common = [f"c{chr(97 + k // 26)}{chr(97 + k % 26)}mon{k}" for k in range(250)]
    rare = [f"r{chr(97 + k // 26)}{chr(97 + k % 26)}e{k}x" for k in range(300)]
    rows = [(i, " ".join(common), 1) for i in range(10)] + [(20 + i, " ".join([*rare, "zzq"]), 1) for i in range(3)] + [(100 + i, "the cat sat on the mat", 0) for i in range(13)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    terms = toxicity.lexicon(sample, 13, 13)
    assert {*common, *rare, "zzq"} <= set(terms)
    assert not {"cat", "the", "on", ""} & set(terms)


def test_quotation_counts_apart_from_abuse():
    sifted = toxicity.Sifted(toxicity.TermAutomaton(["idiot"]))
    assert toxicity.features("you idiot", sifted)[0] and not toxicity.features('he wrote "idiot" there', sifted)[0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = queries.op6_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()
    for query, label, least in ((queries.op1_quality, "quality", 0.9), (queries.op3_toxicity, "toxic", 0.9)):
        found = query(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id")
        assert found.where(F.col(label) == F.col("predicted")).count() >= least * found.count()
        both, told, true = (found.where(c).count() for c in (f"predicted = 1 AND {label} = 1", "predicted = 1", f"{label} = 1"))
        assert both >= 0.85 * told and both >= 0.75 * true


def test_bpe_refuses_ranks_out_of_order():
    bytes_first = {bytes([b]): b for b in range(256)}
    bpe.check_order(bytes_first | {b"ab": 256, b"abc": 257})
    with pytest.raises(ValueError):  # abc would have to come before ab, which it is made of
        bpe.check_order(bytes_first | {b"abc": 256, b"ab": 257})
    with pytest.raises(ValueError):
        bpe.check_order({b"a": 0})


def test_bpe_folds_words_of_all_lengths_and_texts_of_many_blocks(spark, monkeypatch):
    """Words of 61 bytes and more take the same fold; a text over the block's size passes through several."""
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 400)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    rng = np.random.default_rng(8)
    draw = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    texts = ["x" * n for n in (59, 60, 61, 62, 511, 512, 513, 2000)] + ["ß" * 31, "漢" * 40, draw(61), draw(600), " ".join(draw(int(n)) for n in rng.integers(1, 12, 900)), None, ""]
    ranks = bpe.load_ranks(queries.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(table(spark, list(enumerate(texts))), queries.VOCABULARY, public_tokenizers.PATTERN)
    for r in bpe.digests(encoded, queries.VOCABULARY).collect():
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha(text)
