"""The subpackage's queries, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import render
from .common import table
from .fingerprint import edit_likeness
from .media import text_media
from .mixing import by_length, pareto_mix
from .near_dup import near_duplicates
from .packing import best_fit_packing
from .repeats import PASSAGE, shortened
from .secrets import editions, secret_digest, update_ledger
from .surrogates import replace_personal
from .toxicity import toxicity

#: The tokenizer of packing, by its name among the public ones.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pareto_mix(table(spark, sf_dir, "documents"), by_length)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "expected")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = shortened(table(spark, sf_dir, "documents"), PASSAGE)
    return cut.select("doc_id", "cleaned", F.to_json("kept_spans").alias("kept_spans"), F.to_json("gone").alias("gone"))


def op3_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: one over an earlier edition of every document, one over the documents, which scans what the ledger lacks."""
    docs = table(spark, sf_dir, "documents")
    return secret_digest(docs, update_ledger(editions(docs)))


def op5_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.to_json("entities").alias("entities"))


def op7_bigru_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = render(table(spark, sf_dir, "conversations"))
    return parts.withColumn("masks", F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ","))


def op9_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pareto_mix, op2_line_dedup, op3_odd_sketch, op4_blob_ledger, op5_multiset_hash, op6_surrogates, op7_bigru_attention, op8_perspectives, op9_iso_media, op10_best_fit)}

_ROTATED = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text FROM conversations
), people AS (SELECT DISTINCT conv_id AS of_conv, name AS perspective FROM said WHERE name <> 'system'),
roles AS (
  SELECT said.*, perspective,
    CASE WHEN name = 'system' THEN 'system' WHEN name = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM of_conv
), headed AS (
  SELECT *, CASE WHEN role = 'user' THEN '<|user name=' || replace(replace(replace(replace(replace(replace(name, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(13), '%0D'), chr(10), '%0A') || '|>'
    ELSE '<|' || role || '|>' END || chr(10) AS head FROM roles
), rendered AS (SELECT *, head || replace(text, '<|', '<||') || '<|end|>' || chr(10) AS content FROM headed),
placed AS (
  SELECT *, CAST(sum(length(content)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, text
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM rendered
), parts AS (SELECT *, (upto - length(content)) // 65536 AS part, min(upto - length(content)) OVER (PARTITION BY conv_id, perspective, (upto - length(content)) // 65536) AS "from" FROM placed)
SELECT conv_id, perspective, part, min("from") AS "start", string_agg(content, '' ORDER BY upto) AS rendered, CAST(count(*) AS INTEGER) AS n_turns,
  coalesce(string_agg((upto - length(content) + length(head) - "from") || ':' || (upto - "from"), ',' ORDER BY upto) FILTER (role = 'assistant'), '') AS masks
FROM parts GROUP BY conv_id, perspective, part
"""

#: For each kind: its pattern, and which part of a match (0: all of it) must have how many characters.
_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", r"""^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$""", 1, 6),
    ("access", "AKIA[A-Z0-9]+", "^.*$", 0, 20),
    ("hex", "[0-9a-f]+", "^.*$", 0, 24),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "^.*$", 0, 0),
    ("github", "gh[opsur]_[A-Za-z0-9]+", "^.*$", 0, 40),
)


def _matches(number: int, kind: str, pattern: str, part: str, group: int, least: int) -> str:
    """All matches of a kind with their place: what lies between them tells where each begins."""
    return f"""SELECT doc_id, {number} AS number, '{kind}' AS kind, "end" - length(m) AS "start", "end", length(regexp_extract(m, '{part}', {group})) >= {least} AS stays FROM (
      SELECT doc_id, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM (
        SELECT doc_id, unnest(found) AS m, unnest(gaps[1:len(found)]) AS g, unnest(range(len(found))) AS i FROM (
          SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS gaps FROM texts)))"""


_SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS (SELECT * FROM ({" UNION ALL ".join(_matches(i, *k) for i, k in enumerate(_KINDS))}) WHERE stays),
listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", number) FILTER (number < 3) AS base,
  string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", number) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN listed USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op4_blob_ledger": _SECRETS, "op8_perspectives": _ROTATED}
