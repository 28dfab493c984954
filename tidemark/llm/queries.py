"""Registered queries of this package and their DuckDB SQL.

Each query applies one operator, with production parameters, to its whole
table and derives the columns of its contract from the operator's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat_format import format_chats, read_back, text_parts
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.embedding_dedup import embedding_dedup
from tidemark.llm.graph_index import nearest_neighbours
from tidemark.llm.hard_negatives import mine_hard_negatives
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.packing import pack_documents
from tidemark.llm.periodic_runs import periodic_runs, run_digest
from tidemark.llm.secrets import scan_secrets
from tidemark.llm.sharding import shard_documents
from tidemark.llm.simhash import simhash_dedup
from tidemark.llm.support import operator_conf, scratch
from tidemark.llm.token_counts import token_counts
from tidemark.llm.toxicity import score_toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, its score and its place."""
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("doc_key")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_read(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_read(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))],
                                  "conv_id bigint, turn bigint, role string, text string")
    turns = turns.unionByName(probe).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    written = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    with scratch(spark, "chats") as s, operator_conf(spark):
        back = read_back(s.table(format_chats(turns), "formatted"))
        out = back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"),
                          F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                          F.length("formatted").cast("bigint").alias("formatted_chars"))
        return s.table(out, "digests", keep=True)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "kept")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(_read(spark, sf_dir, "documents"), planted=True))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_token_counts, op3_sharding, op4_embedding_dedup, op5_license_scan, op6_chat_format,
    op7_secret_scan, op8_toxicity, op9_packing, op10_simhash_dedup, op11_nearest_neighbours, op12_periodic_runs,
    op13_hard_negatives)}

#: Only the chat digests are within SQL's reach: the others rest on token merges,
#: differencing, trained weights, XXH64 or alignments (their tests use brute force).
ORACLE_SQL = {
    "op6_chat_format": r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '(<)(\|)|(<)(/?s>)|(\[)(/?INST\])', '\1\3\5\\\2\4\6', 'g') AS r,
         regexp_replace(replace(text, '\', '\\'), '(<)(\|)|(<)(/?s>)|(\[)(/?INST\])', '\1\3\5\\\2\4\6', 'g') AS b
  FROM rows_
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(length(r) + length(b) + length('<|turn|><|body|><|end|>')) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
""",
}
