"""Registered queries of the corpus operators, each over its whole table, with SQL where there is such SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import (
    byte_bpe, conversation_repair, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, mixing, packing,
    prefix_trie, quality_rules, sharding, warc,
)
from shelfmark.llm.common import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def codec() -> byte_bpe.Codec:
    import public_tokenizers

    return byte_bpe.load_codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf, "documents"))


@query(r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
""")
def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


@query()
def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf, "documents"), codec())


@query()
def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = jaccard_join.near_duplicates(table(spark, sf, "documents"))
    return rows.select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


@query()
def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf, "pages"))


@query()
def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.languages_of(table(spark, sf, "documents"))


@query(r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), lines AS (
    SELECT doc_id, host, text, line,
           trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
           len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), hosts AS (
    SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host
), often AS (
    SELECT host, norm FROM lines JOIN hosts USING (host) GROUP BY host, norm, docs
    HAVING count(DISTINCT text) > 5 AND count(DISTINCT text) > 0.05 * docs
), by_line AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
           count(*) FILTER (o.norm IS NOT NULL) AS n_frequent_lines, sum(n) FILTER (o.norm IS NOT NULL) AS gone
    FROM lines l LEFT JOIN often o USING (host, norm) GROUP BY doc_id
), grams AS (
    SELECT doc_id, i, list_slice(words, i, i + 4) AS gram
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)
), repeated AS (
    SELECT doc_id, count(DISTINCT place) AS n_repeat_words
    FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM grams) WHERE times > 1)
    GROUP BY doc_id
), base AS (
    SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
           coalesce(n_frequent_lines, 0)::BIGINT AS n_frequent_lines, (len(words) - coalesce(gone, 0))::BIGINT AS words_left
    FROM d LEFT JOIN by_line USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
           AND NOT words_left < 0.3 * n_words AS kept,
       n_frequent_lines, words_left
FROM base
""")
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf, "documents")).drop("tkey")


@query()
def op8_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(table(spark, sf, "documents"))


@query("""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), f AS (
    SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
), r AS (
    SELECT *, strlen(html) >= 100 AND page_id <> first_id AS revisit FROM f
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first_id END AS refers_to
FROM r
""")
def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(table(spark, sf, "pages"))


@query()
def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shards_of(table(spark, sf, "documents"))


@query()
def op11_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    encoder = packing.load_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    pieces = packing.packed(table(spark, sf, "documents"), encoder)
    return pieces.select(
        "doc_id", "start", "length", packing.crc_of_ids(), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_id"
    )


@query()
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    conversations = table(spark, sf, "conversations")
    return conversation_repair.verdicts(conversations, conversation_repair.damaged(conversations))


@query("""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS content
    FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
    SELECT conv_id, content, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, content) AS pos
    FROM t
), crc AS (
    SELECT conv_id, conv_id - conv_id % 20 AS first, xor(list_reduce(
        list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
        lambda a, b: list_reduce(range(8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(a, b)),
        4294967295), 4294967295) % 4 AS head
    FROM (SELECT DISTINCT conv_id FROM numbered)
), rebuilt AS (
    SELECT c.conv_id, 0 AS part, n.pos, n.content, n.words FROM crc c JOIN numbered n ON n.conv_id = c.first AND n.pos <= c.head
    UNION ALL
    SELECT c.conv_id, 1, n.pos, n.content, n.words FROM crc c JOIN numbered n ON n.conv_id = c.conv_id AND n.pos > c.head
), members AS (
    SELECT c.conv_id, coalesce(list(r.content ORDER BY part, pos) FILTER (r.content IS NOT NULL), []) AS contents,
           coalesce(list(r.words ORDER BY part, pos) FILTER (r.content IS NOT NULL), []) AS words
    FROM crc c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id
), paths AS (
    SELECT conv_id, d AS depth, len(contents) = d AS ends, array_to_string(contents[1:d], ',') AS key,
           CASE WHEN d > 0 THEN array_to_string(contents[1:d - 1], ',') END AS parent_key, coalesce(words[d], 0) AS words
    FROM (SELECT *, unnest(range(0, len(contents) + 1)) AS d FROM members)
), nodes AS (
    SELECT depth, key, any_value(parent_key) AS parent_key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
           bool_and(ends) AS leaf, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM paths GROUP BY depth, key
), below AS (
    SELECT p.depth, p.key, count(*) FILTER (n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens,
           count(*) FILTER (n.depth = p.depth + 1) AS n_children
    FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.key
)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (depth, key) LEFT JOIN nodes a ON a.depth = n.depth - 1 AND a.key = n.parent_key
""")
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))


@query()
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
