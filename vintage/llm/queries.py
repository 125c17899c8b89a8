"""One registered query per operator, over whole tables, and its SQL where SQL can state it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm import align, bpe, chat, decontaminate, exact_dedup, langid, mixing, quality, repair, simhash, topk, toxicity, warc
from vintage.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, 3 bits."""
    return simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), cut=0.3)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicate groups of every document."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    return mixing.mixture(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from heuristics only."""
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs)[1])


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of each query: every row whose id is divisible by 20 against all rows."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of an installed tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered: id, turns, copies, length and SHA-256 of the text."""
    out = chat.format_conversations(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", "copies", F.length("rendered").cast("long").alias("n_chars"),
                      F.sha2(F.col("rendered").cast("binary"), 256).alias("text_sha256"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside passages of 10 words that a benchmark item holds."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under both tokenizers: groups between common token ends and linked ids."""
    return align.alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                           tokenizer_path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by the rule of the test and repaired at least cost."""
    turns = table(spark, sf_dir, "conversations")
    return repair.with_all_ids(repair.repairs(repair.damaged(turns)), turns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality": op7_quality,
    "op8_exact_topk": op8_exact_topk,
    "op9_bpe": op9_bpe,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_decontamination": op11_decontamination,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
                          length(coalesce(text, '')) AS len FROM documents),
        r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size
              FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r""",
    "op5_warc": r"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (1 + ((CAST('0x' || substr(h, CAST((k // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31)), 1)), '')
                   AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM g""",
    "op8_exact_topk": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                     vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op10_chat_formatting": r"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                          '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS s
                   FROM conversations),
        p AS (SELECT conv_id, pos, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY pos) AS body,
                     count(*) OVER (PARTITION BY conv_id) AS n FROM t),
        whole AS (SELECT min(conv_id) AS conv_id, n, body, count(*) AS copies FROM p WHERE pos = n GROUP BY n, body),
        proper AS (SELECT DISTINCT pos, body FROM p WHERE pos < n)
        SELECT w.conv_id, w.n AS n_turns, w.copies, length(w.body) AS n_chars, sha256(w.body) AS text_sha256
        FROM whole w LEFT JOIN proper x ON x.pos = w.n AND x.body = w.body WHERE x.pos IS NULL""",
    "op11_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS x FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM benchmark),
        p AS (SELECT *, unnest(range(1, greatest(len(x) - 8, 2))) AS pos FROM i WHERE len(x) > 0),
        w AS (SELECT DISTINCT item, least(len(x), 10) AS n, array_to_string(list_slice(x, pos, pos + 9), ' ') AS w FROM p),
        s AS (SELECT r, x, n, unnest(range(1, len(x) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM w) WHERE len(x) >= n),
        t AS (SELECT r, n, pos, array_to_string(list_slice(x, pos, pos + n - 1), ' ') AS w FROM s),
        h AS (SELECT r, pos, n, item FROM t JOIN w USING (n, w)),
        words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(pos, pos + n)) FROM h) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(x) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE tab AS (
            SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS BIGINT)] || range(8),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
        raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       xor(list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' ||
                               coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
                           lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) % 20 AS k
                FROM conversations, tab),
        hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                        unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw WHERE k <> 0),
        num AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS ini, lag(left(role, 1)) OVER w AS before,
                       rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
                FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
        again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM num),
        f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                             WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM again),
        moves(st, op, st2, price, ini) AS (VALUES
            (0, 'D', 0, 4, NULL), (1, 'D', 1, 4, NULL), (2, 'D', 2, 4, NULL), (3, 'D', 3, 4, NULL),
            (0, 'K', 1, 0, 's'), (0, 'K', 2, 0, 'u'), (1, 'K', 2, 0, 'u'), (3, 'K', 2, 0, 'u'), (2, 'K', 3, 0, 'a'),
            (0, 'R', 2, 3, NULL), (1, 'R', 2, 3, NULL), (3, 'R', 2, 3, NULL), (2, 'R', 3, 3, NULL)),
        inserts(st, pre, goal, lines) AS (VALUES
            (0, '', 0, ''), (1, '', 1, ''), (2, '', 2, ''), (3, '', 3, ''),
            (0, 'I', 2, chr(10) || 'user:'), (1, 'I', 2, chr(10) || 'user:'), (3, 'I', 2, chr(10) || 'user:'), (2, 'I', 3, chr(10) || 'assistant:'),
            (0, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
            (3, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 'II', 2, chr(10) || 'assistant:' || chr(10) || 'user:')),
        dp AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS best FROM f
            UNION ALL
            SELECT d.conv_id, f.i, m.st2, min({'c': d.best.c + 3 * length(p.pre) + m.price + CASE WHEN m.op <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END,
                       'a': d.best.a || p.pre || m.op,
                       't': d.best.t || p.lines || CASE m.op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text
                            ELSE chr(10) || CASE m.st2 WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || f.text END})
            FROM dp d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1
            JOIN inserts p ON p.st = d.st JOIN moves m ON m.st = p.goal
            WHERE (m.op = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (m.ini IS NULL OR m.ini = f.ini) AND (coalesce(m.ini, '') <> 's' OR p.pre = '')
            GROUP BY d.conv_id, f.i, m.st2),
        ends AS (SELECT conv_id, i, {'c': best.c + 3 * length(pre), 'a': best.a || pre, 't': best.t || lines} AS best
                 FROM dp JOIN inserts USING (st) WHERE goal IN (0, 3)),
        facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                         count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
        done AS (SELECT x.*, (SELECT min(e.best) FROM ends e WHERE e.conv_id IS NOT DISTINCT FROM x.conv_id AND e.i = x.n) AS best FROM facts x)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
