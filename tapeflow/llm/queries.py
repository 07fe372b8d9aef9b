"""Queries op1 to op13: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_automaton import encode_digests
from .common import table
from .cover_tree import top_k
from .decontamination import contamination
from .digests import edited_digests
from .html_text import extract_text
from .importance import resample
from .lexical import rank_documents
from .near_dup import near_duplicates
from .ppm import fold, score_texts
from .repair import damaged, repair
from .token_counts import count_tokens
from .toxicity import toxicity
from .warc import archive_pages


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op5_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), fold() != 2)


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_bucket_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_digests(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_html_text, op3_importance_resampling, op4_warc_archive, op5_ppm_scoring, op6_bpe_automaton,
        op7_cover_tree_top_k, op8_near_duplicates, op9_token_counts, op10_toxicity, op11_bucket_digests, op12_lexical_search, op13_conversation_repair,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_cover_tree_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) AND q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
            FROM s
        )
        SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
    """,
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                   lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words
            FROM documents WHERE text IS NOT NULL
        ), i AS (
            SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                   lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
            FROM benchmark WHERE text IS NOT NULL
        ), q AS (SELECT item_id, term, count(*) AS repeats FROM i GROUP BY ALL
        ), totals AS (
            SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS words FROM d WHERE len(words) > 0
        ), p AS (
            SELECT doc_id, term, count(*) AS tf, any_value(n) AS n
            FROM (SELECT row_number() OVER () AS number, doc_id, len(words) AS n, unnest(words) AS term FROM d)
            GROUP BY number, doc_id, term
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
            FROM p, totals GROUP BY term, docs
        ), s AS (
            SELECT q.item_id, p.doc_id,
                   CAST(sum(q.repeats * w.weight * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * t.docs) // t.words)))) AS BIGINT) AS score
            FROM q JOIN p USING (term) JOIN w USING (term), totals t
            GROUP BY q.item_id, p.doc_id
        ), r AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS "rank", doc_id, score
            FROM s WHERE score > 0
        )
        SELECT item_id, "rank", doc_id, score FROM r WHERE "rank" <= 20
    """,
    "op13_conversation_repair": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc
            FROM range(256) t(i)
        ), k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
            FROM conversations
        ), h AS (
            SELECT k.*, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: CAST(ord(name[i]) AS BIGINT)),
                   lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
            FROM k, crc_table
        ), d AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM h, range(CASE kind WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0
        ), o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k,
                   left(role, 1) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
            FROM d
        ), r AS (
            SELECT *, CASE WHEN trimmed = '' THEN 'blank'
                           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                           WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                   lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i NOT IN ('su', 'ua', 'au') AS illegal
            FROM o
        ), steps(letter, source, target, inserts) AS (
            VALUES ('D', 0, 0, 0), ('D', 1, 1, 0), ('D', 2, 2, 0), ('D', 3, 3, 0), ('s', 0, 1, 0),
                   ('u', 0, 2, 0), ('u', 1, 2, 0), ('u', 3, 2, 0), ('u', 2, 2, 1), ('a', 2, 3, 0), ('a', 0, 3, 1), ('a', 1, 3, 1), ('a', 3, 3, 1)
        ), paths AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'text': ''} AS best FROM conversations
            UNION ALL
            SELECT conv_id, k, target, min({'cost': cost, 'audit': audit, 'text': text || CASE WHEN line <> '' AND text <> '' THEN chr(10) ELSE '' END || line})
            FROM (
                SELECT p.conv_id, r.k, s.target,
                       p.best.cost + 5 * s.inserts + CASE WHEN s.letter = 'D' THEN 2 ELSE CASE WHEN s.letter = r.i THEN 0 ELSE 1 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END END AS cost,
                       p.best.audit || repeat('I', s.inserts) || CASE WHEN s.letter = 'D' THEN 'D' WHEN s.letter = r.i THEN 'K' ELSE 'R' END AS audit,
                       p.best.text || CASE WHEN s.inserts = 1 THEN CASE WHEN p.best.text <> '' THEN chr(10) ELSE '' END || CASE s.letter WHEN 'u' THEN 'assistant:' ELSE 'user:' END ELSE '' END AS text,
                       CASE WHEN s.letter = 'D' THEN '' ELSE CASE WHEN s.letter = r.i THEN r.role WHEN s.letter = 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text END AS line
                FROM paths p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = p.k + 1
                JOIN steps s ON s.source = p.state AND (s.letter = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (s.letter <> 's' OR r.i = 's')))
            ) GROUP BY conv_id, k, target
        ), ends AS (
            SELECT conv_id, k, min({'cost': best.cost + 5 * inserts, 'audit': best.audit || repeat('I', inserts), 'text': best.text || more}) AS best
            FROM paths JOIN (VALUES (0, 0, ''), (3, 0, ''), (2, 1, chr(10) || 'assistant:'), (1, 2, chr(10) || 'user:' || chr(10) || 'assistant:')) e(state, inserts, more) USING (state)
            GROUP BY conv_id, k
        ), counts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
            FROM r GROUP BY conv_id
        )
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit,
               sha256(e.best.text) AS repaired_sha256
        FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id WHERE e.k = coalesce(c.n, 0)
    """,
}
