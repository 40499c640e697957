"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, line_dedup, near_dedup, packing, pii, substring_dedup_bytes, substring_dedup_words, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup_bytes.suffix_dedup(_table(spark, folder, "documents"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup_words.window_dedup(_table(spark, folder, "documents"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.best_fit_packing(_table(spark, folder, "documents"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, folder, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH x AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'),
           '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'),
           '<[^>]*>', '', 'g') AS text FROM pages
), p AS (
  SELECT page_id, host, list_filter(list_transform(string_split(text, chr(10)), lambda v: regexp_replace(v, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda v: v <> '') AS lines FROM x
), t AS (SELECT host, count(*) AS pages FROM p GROUP BY host
), b AS (
  SELECT host, line FROM (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line) c
  JOIN t USING (host) WHERE n > 1 AND n > 0.2 * pages
), l AS (SELECT host, list(line) AS gone FROM b GROUP BY host
), k AS (SELECT page_id, p.host, lines, list_filter(lines, lambda v: NOT list_contains(coalesce(gone, []), v)) AS kept FROM p LEFT JOIN l ON p.host = l.host)
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
"""


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(chat.format_chats(chat.turns_as_events(turns.select("conv_id", "turn", "role", "text").unionByName(extra))))


def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, folder, "documents"), size=4, percent=80)


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(_table(spark, folder, "documents"))
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(23 + length(regexp_replace(role, '<(~*)\|', '<~\1|', 'g')) + length(regexp_replace(text, '<(~*)\|', '<~\1|', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, folder, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), w AS (
  SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS run
  FROM (SELECT item_id, words, least(len(words), 10) AS n, unnest(generate_series(1, len(words) - least(len(words), 10) + 1)) AS s FROM i WHERE len(words) > 0)
), p AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS s FROM d
), h AS (
  SELECT doc_id, s, w.n, item_id FROM p CROSS JOIN (SELECT DISTINCT n FROM w) k JOIN w ON w.n = k.n AND array_to_string(p.words[p.s:p.s + k.n - 1], ' ') = w.run
  WHERE p.s + k.n - 1 <= len(p.words)
), c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS pos FROM h) GROUP BY doc_id
), x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_line_dedup": op4_line_dedup,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_toxicity": op8_toxicity,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op5_chat_formatting": OP5_SQL, "op7_decontamination": OP7_SQL, "op9_exact_dedup": OP9_SQL}
