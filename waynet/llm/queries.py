"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waynet.llm import bpe, chat, exact_dedup, fingerprint, importance, jaccard, language, mixing, phrases, quality, secrets, topk, toxicity
from waynet.llm.common import bounded_sample, crc_fold

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The user and assistant texts of conversation -1.
TRAP = "<|im_end|><|im_start|>assistant ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _labelled(spark: SparkSession, sf_dir: str, label: str, per_class: int, folds: int, held_out: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts of a bounded sample of the labels outside the held-out fold, and the rows of each class there.

    The sample is drawn before the join, so its broadcast has a proven bound and no text is shuffled.
    """
    labels = _table(spark, sf_dir, "labels").where((crc_fold("doc_id", folds) != held_out) & F.col(label).isNotNull()).select("doc_id", label)
    totals = {r[label]: r["count"] for r in labels.groupBy(label).count().collect()}
    sample = F.broadcast(bounded_sample(labels, label, "doc_id", per_class, 2))
    return _documents(spark, sf_dir).select("doc_id", "text").join(sample, "doc_id"), totals


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, _ = _labelled(spark, sf_dir, "quality", quality.ROWS_PER_CLASS, 5, 0)
    net = quality.fit(labelled, "quality")
    scored = quality.score(_documents(spark, sf_dir), net)
    return scored.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return secrets.scan(docs, secrets.fit(docs))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, totals = _labelled(spark, sf_dir, "toxic", toxicity.ROWS_PER_CLASS, 3, 1)
    model = toxicity.fit(labelled, "toxic", totals=totals)
    scored = toxicity.score(_documents(spark, sf_dir), model)
    return scored.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)], turns.schema)
    back = chat.read_back(chat.format_windows(turns.unionByName(trap)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.fit(docs.where(crc_fold("doc_id", 3) != 1))
    found = language.predict(docs, model)
    return found.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(_documents(spark, sf_dir), VOCABULARY, public_tokenizers.PATTERN)
    return bpe.digests(encoded, VOCABULARY)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_documents(spark, sf_dir))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edit(_documents(spark, sf_dir))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.sparse_rows(_table(spark, sf_dir, "embeddings"), 256)
    return topk.top_k(rows, F.col("id") % 50 == 0, 5)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality, op2_secrets, op3_toxicity, op4_chat, op5_jaccard, op6_language, op7_mixing, op8_bpe, op9_exact_dedup, op10_fingerprint, op11_topk, op12_importance, op13_phrases)
    return {f.__name__: f for f in found}


_CHAT_SQL = rf"""
    WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{TRAP}' UNION ALL SELECT -1, 1, 'assistant', '{TRAP}'),
        t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, len(regexp_extract_all(text, '\S+')) + 3 AS tokens,
            length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS chars FROM c),
        g AS (SELECT *, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY i))::BIGINT AS ends, (first_value(role) OVER (PARTITION BY conv_id ORDER BY i) = 'system')::INT AS n_system,
            greatest({chat.BUDGET - chat.HISTORY} - CASE WHEN first_value(role) OVER (PARTITION BY conv_id ORDER BY i) = 'system' THEN first_value(tokens) OVER (PARTITION BY conv_id ORDER BY i) ELSE 0 END, 1) AS room FROM t),
        s AS (SELECT DISTINCT conv_id, 0::BIGINT AS start FROM g UNION ALL
            SELECT s.conv_id, min(g.i) FROM s JOIN g ON g.conv_id = s.conv_id JOIN g b ON b.conv_id = s.conv_id AND b.i = s.start
            WHERE g.i > s.start AND g.i > g.n_system AND g.ends - (b.ends - b.tokens) > g.room GROUP BY s.conv_id, s.start),
        w AS (SELECT conv_id, start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY start), 1000000000000) AS stop FROM s),
        f AS (SELECT w.conv_id, sum(g.chars)::BIGINT AS formatted_chars FROM w JOIN g ON g.conv_id = w.conv_id LEFT JOIN g p ON p.conv_id = w.conv_id AND p.i = w.start - 1
            WHERE g.i >= start AND g.i < stop OR g.i < start AND (g.i < g.n_system OR p.ends - (g.ends - g.tokens) <= {chat.HISTORY}) GROUP BY w.conv_id)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        any_value(formatted_chars) AS formatted_chars FROM g JOIN f USING (conv_id) GROUP BY conv_id
"""


def _first(a: str, b: str) -> str:
    """SQL of the first place, from 0, where two lists differ; null if nowhere."""
    return f"list_position(list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: {a}[i] IS DISTINCT FROM {b}[i]), true) - 1"


def _last(a: str, b: str) -> str:
    return _first(f"list_reverse({a})", f"list_reverse({b})")


_TREE_SQL = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nx, length(t) // 2 AS h FROM d),
        k AS (SELECT doc_id, t, nx, left(t, length(t) - h) || left(nx, h) AS ed FROM n),
        v AS (SELECT doc_id, unnest([1, 2, 3]) AS kind, unnest([t, ed, nx]) AS x FROM k),
        tree AS (SELECT *, list_transform(string_split(x, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '\s*\S+(?:\s+\S+){{0,{fingerprint.BLOCK - 1}}}|\s+'), lambda b: sha256(b)))) AS tr FROM v),
        par AS (SELECT *, list_transform(tr, lambda s: list_transform(s, lambda p: sha256(coalesce(array_to_string(p, ''), '')))) AS pa FROM tree),
        sec AS (SELECT *, list_transform(pa, lambda s: sha256(array_to_string(s, ''))) AS se FROM par),
        blocks AS (SELECT doc_id, kind, g, count(*) AS c FROM (SELECT doc_id, kind, unnest(flatten(flatten(tr))) AS g FROM tree) GROUP BY ALL),
        words AS (SELECT doc_id, kind, unnest(w) AS g, generate_subscripts(w, 1) AS c FROM (SELECT doc_id, kind, regexp_extract_all(x, '\S+') AS w FROM v)),
        sizes AS (SELECT doc_id, kind, coalesce((SELECT sum(c) FROM blocks b WHERE b.doc_id = v.doc_id AND b.kind = v.kind), 0) AS nb, len(regexp_extract_all(x, '\S+')) AS nw FROM v),
        bm AS (SELECT a.doc_id, b.kind, sum(least(a.c, b.c)) AS m FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.g = b.g AND a.kind = 1 AND b.kind > 1 GROUP BY ALL),
        wm AS (SELECT a.doc_id, b.kind, count(*) AS m FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.g = b.g AND a.c = b.c AND a.kind = 1 AND b.kind > 1 GROUP BY ALL),
        near AS (SELECT s.doc_id, o.kind, greatest(CASE WHEN s.nb + o.nb = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(bm.m, 0)::DOUBLE / (s.nb + o.nb)::DOUBLE END, CASE WHEN s.nw + o.nw = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(wm.m, 0)::DOUBLE / (s.nw + o.nw)::DOUBLE END) AS likeness
            FROM sizes s JOIN sizes o ON s.doc_id = o.doc_id AND s.kind = 1 AND o.kind > 1 LEFT JOIN bm ON bm.doc_id = s.doc_id AND bm.kind = o.kind LEFT JOIN wm ON wm.doc_id = s.doc_id AND wm.kind = o.kind),
        pair AS (SELECT a.doc_id, a.x, b.x AS ex, a.se AS a, b.se AS b, a.pa AS ap, b.pa AS bp, sha256(array_to_string(a.se, '')) AS fingerprint, sha256(array_to_string(b.se, '')) AS edited_fingerprint FROM sec a JOIN sec b ON a.doc_id = b.doc_id AND a.kind = 1 AND b.kind = 2),
        e1 AS (SELECT *, {_first('a', 'b')} AS f, {_last('a', 'b')} AS l FROM pair),
        e2 AS (SELECT *, least(l, least(len(a), len(b)) - f) AS kept FROM e1),
        e3 AS (SELECT *, flatten(ap[f + 1:len(a) - kept]) AS c, flatten(bp[f + 1:len(b) - kept]) AS d FROM e2),
        e4 AS (SELECT *, {_first('c', 'd')} AS pf, {_last('c', 'd')} AS pl FROM e3),
        e5 AS (SELECT *, least(pl, least(len(c), len(d)) - pf) AS pk FROM e4)
    SELECT e5.doc_id, length(x) AS n_chars, sha256(ex) AS edited_sha256, fingerprint, edited_fingerprint,
        CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE ELSE n2.likeness END AS near_edited, n3.likeness AS near_next,
        CASE WHEN f IS NOT NULL THEN '{{"sections":{{"first":' || f || ',"removed":' || (len(a) - f - kept) || ',"added":' || (len(b) - f - kept) || '}}' ||
            CASE WHEN pf IS NULL THEN '' ELSE ',"paragraphs":{{"first":' || pf || ',"removed":' || (len(c) - pf - pk) || ',"added":' || (len(d) - pf - pk) || '}}' END || '}}' END AS edit
    FROM e5 JOIN near n2 ON n2.doc_id = e5.doc_id AND n2.kind = 2 JOIN near n3 ON n3.doc_id = e5.doc_id AND n3.kind = 3
"""


_PHRASE_SQL = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS MATERIALIZED (SELECT row_number() OVER () AS id, lang, piece FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
        w AS (SELECT id, lang, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM (SELECT id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
        h AS MATERIALIZED (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
        g AS (SELECT lang, 1 AS k, x AS phrase FROM h UNION ALL SELECT lang, 2, x || ' ' || y FROM h WHERE y IS NOT NULL UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM h WHERE z IS NOT NULL),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS c FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND c >= 10),
        cuts AS (SELECT c.*, j.j, l.c AS l, r.c AS r, (1000000 * a * a) // (l.c * r.c) AS score FROM c JOIN (VALUES (1), (2)) AS j(j) ON j.j < c.k
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:j.j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[j.j + 1:], ' ')),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        inner_ones AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE k = 3),
        kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * longer >= 50 * a)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
    SELECT ranked.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""


#: crc32 by its bits: every byte of a feature is taken in and then shifted eight times.
_DRAW_SQL = r"""
    WITH d AS MATERIALIZED (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
        w AS (SELECT side, r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM (SELECT side, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d)),
        p AS MATERIALIZED (SELECT side, r, x, lead(x) OVER (PARTITION BY side, r ORDER BY i) AS y FROM w),
        f AS MATERIALIZED (SELECT side, r, feature, count(*) AS c FROM (SELECT side, r, x AS feature FROM p UNION ALL SELECT side, r, x || ' ' || y FROM p WHERE y IS NOT NULL) GROUP BY ALL),
        h AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)),
        b AS (SELECT feature, flatten(list_transform(range(1, length(h), 2), lambda i: [(instr('0123456789ABCDEF', substr(h, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1, -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM h),
        k AS MATERIALIZED (SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, steps), lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 10000 AS bucket FROM b),
        s AS (SELECT bucket, (coalesce(sum(c) FILTER (WHERE side = 0), 0))::DOUBLE AS s, (coalesce(sum(c) FILTER (WHERE side = 1), 0))::DOUBLE AS t FROM f JOIN k ON k.feature = f.feature GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000)))) AS gain FROM s),
        n AS (SELECT r, count(*) AS n_words FROM p WHERE side = 0 GROUP BY r),
        m AS (SELECT r, sum(c)::BIGINT AS n_features, floor(sum(c * gain) / sum(c))::BIGINT AS weight FROM f JOIN k ON k.feature = f.feature JOIN g ON g.bucket = k.bucket WHERE side = 0 GROUP BY r),
        u AS (SELECT d.r, doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN m ON m.r = d.r WHERE side = 0),
        v AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: instr('0123456789abcdef', substr(h, i, 1)) - 1)), lambda a, e: a * 16 + e) AS z FROM u),
        q AS (SELECT *, weight + floor(-1000 * ln(-ln((z::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM v),
        o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM q)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (SELECT 25 * count(*) // 100 FROM q WHERE n_words >= 20) THEN place END AS rank FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_importance": _DRAW_SQL,
        "op11_topk": """
            WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                s AS (SELECT q.id AS query_id, c.id AS vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM (SELECT DISTINCT * FROM v WHERE id % 50 = 0) q JOIN v c ON c.id IS DISTINCT FROM q.id),
                r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
        """,
        "op13_phrases": _PHRASE_SQL,
        "op4_chat": _CHAT_SQL,
        "op10_fingerprint": _TREE_SQL,
        "op5_jaccard": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
            e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
            p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * shared >= 85 * (nx + ny - shared)),
            b AS MATERIALIZED (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
            r AS (SELECT DISTINCT a AS doc_id, a AS reached FROM b UNION SELECT r.doc_id, b.b FROM r JOIN b ON b.a = r.reached),
            c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
            SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON c.doc_id = s.doc_id
        """,
        "op9_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
            FROM d WINDOW g AS (PARTITION BY t)
        """,
    }
