"""Queries of problems 2 to 10, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandwell.llm.credentials import credential_verdicts, credentials_found, redacted_texts
from strandwell.llm.encoding_repair import restored_documents
from strandwell.llm.mixing import mix, mix_shares
from strandwell.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from strandwell.llm.code_languages import language_sentences, language_shares, languages_found
from strandwell.llm.conversations import conversation_messages, conversations_found
from strandwell.llm.packing import container_fill, containers
from strandwell.llm.source_files import deciding_evidence, not_hand_written
from strandwell.llm.splitting import oversized_found, split_oversized
from strandwell.records import read

Query = Callable[[SparkSession, str], DataFrame]

P4_SQL = """
WITH r AS (SELECT DISTINCT canonical_id, string_split(canonical_id, '::')[2] AS s, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS t
  FROM rag_node WHERE len(string_split(canonical_id, '::')) >= 4),
g AS (SELECT DISTINCT canonical_id, s, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS g FROM (SELECT canonical_id, s, t, unnest(range(1, len(t) - 1)) AS i FROM r)),
n AS (SELECT canonical_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.canonical_id AS a, b.canonical_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.g = b.g AND a.canonical_id < b.canonical_id GROUP BY 1, 2)
SELECT a AS canonical_id_a, b AS canonical_id_b FROM c JOIN n x ON x.canonical_id = a JOIN n y ON y.canonical_id = b WHERE 10 * c >= 7 * (x.n + y.n - c)
"""

P3_SQL = r"""
WITH r AS (
  SELECT turn_id, lower(regexp_replace(session_id, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) AS session_id, trim(created_at_utc) AS t,
    regexp_replace(question_neutral, '^\s+|\s+$', '', 'g') AS q, regexp_replace(answer_neutral, '^\s+|\s+$', '', 'g') AS a FROM conversation_turn),
v AS (
  SELECT turn_id, session_id,
    CASE WHEN regexp_full_match(t, '\d{13}') THEN make_timestamp(CAST(t AS BIGINT) * 1000)
      WHEN regexp_full_match(t, '[A-Z][a-z]{2}, .* GMT') THEN strptime(t, '%a, %d %b %Y %H:%M:%S GMT')
      WHEN regexp_full_match(t, '\d{4}-\d\d-\d\d.*') THEN CAST(TRY_CAST(CASE WHEN regexp_matches(t, '(Z|[+-]\d\d:\d\d)$') THEN t ELSE t || '+00:00' END AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) END AS ts,
    CASE WHEN regexp_matches(q, '[\p{L}\p{N}]') AND lower(q) NOT IN ('null', 'none') THEN q END AS q,
    CASE WHEN regexp_matches(a, '[\p{L}\p{N}]') AND lower(a) NOT IN ('null', 'none') THEN a END AS a
  FROM r WHERE session_id <> ''),
t AS (SELECT session_id, turn_id, min(ts) AS ts, min(q) AS q, min(a) AS a FROM v GROUP BY 1, 2),
k AS (SELECT session_id FROM t GROUP BY 1 HAVING bool_and(ts IS NOT NULL AND q IS NOT NULL AND a IS NOT NULL))
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, turn_id) AS INTEGER) AS turn_no, turn_id FROM t WHERE session_id IN (SELECT session_id FROM k)
"""

P6_SQL = r"""
WITH n AS (SELECT DISTINCT canonical_id, text, regexp_replace(lower(trim(file_type)), '^\.', '') AS k FROM rag_node WHERE len(string_split(canonical_id, '::')) >= 4),
l AS (SELECT DISTINCT canonical_id, text, coalesce(s.max_chars, (SELECT max_chars FROM size_limit WHERE file_type = '*')) AS m FROM n LEFT JOIN size_limit s ON lower(s.file_type) = k)
SELECT canonical_id, CASE WHEN list_max([length(regexp_replace(x, '\r$', '')) FOR x IN string_split(text, chr(10))]) > m THEN 'inside' ELSE 'line' END AS cut_kind
FROM l WHERE length(text) > m
"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "p2_found": (lambda s, d: languages_found(read(s, d, "rag_node"), read(s, d, "documents")), None),
    "p2_sentences": (lambda s, d: language_sentences(read(s, d, "rag_node"), read(s, d, "documents")), None),
    "p2_shares": (lambda s, d: language_shares(read(s, d, "rag_node"), read(s, d, "documents")), None),
    "p3_found": (lambda s, d: conversations_found(s, f"{d}/conversation_turn.parquet"), P3_SQL),
    "p3_messages": (lambda s, d: conversation_messages(s, f"{d}/conversation_turn.parquet"), None),
    "p4_groups": (lambda s, d: near_duplicate_groups(read(s, d, "rag_node")), None),
    "p4_found": (lambda s, d: near_duplicate_pairs(read(s, d, "rag_node")), P4_SQL),
    "p7_found": (lambda s, d: credentials_found(read(s, d, "rag_node")), None),
    "p7_redacted": (lambda s, d: redacted_texts(read(s, d, "rag_node")), None),
    "p7_verdicts": (lambda s, d: credential_verdicts(read(s, d, "rag_node")), None),
    "p5_found": (lambda s, d: not_hand_written(read(s, d, "rag_node")).select("canonical_id").distinct(), None),
    "p5_kinds": (lambda s, d: not_hand_written(read(s, d, "rag_node")), None),
    "p5_evidence": (lambda s, d: deciding_evidence(read(s, d, "rag_node")), None),
    "p6_found": (lambda s, d: oversized_found(read(s, d, "rag_node"), read(s, d, "size_limit")), P6_SQL),
    "p6_pieces": (lambda s, d: split_oversized(read(s, d, "rag_node"), read(s, d, "size_limit")), None),
    "p8_containers": (lambda s, d: containers(read(s, d, "documents"), read(s, d, "container_spec")), None),
    "p8_fill": (lambda s, d: container_fill(read(s, d, "documents"), read(s, d, "container_spec")), None),
    "p9_mix": (lambda s, d: mix(read(s, d, "documents"), read(s, d, "mix_target")), None),
    "p9_shares": (lambda s, d: mix_shares(read(s, d, "documents"), read(s, d, "mix_target")), None),
    "p9_mix_held": (lambda s, d: mix(read(s, d, "documents"), read(s, d, "mix_target"), "held"), None),
    "p9_shares_held": (lambda s, d: mix_shares(read(s, d, "documents"), read(s, d, "mix_target"), "held"), None),
    "p10_found": (lambda s, d: restored_documents(read(s, d, "documents")).select("doc_id"), None),
    "p10_restored": (lambda s, d: restored_documents(read(s, d, "documents")), None),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
