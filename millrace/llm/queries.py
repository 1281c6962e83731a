"""Registered queries of the subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, language, mixing, neardup, pieces, quality, secrets, sharding, substrings, topk
from millrace.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("p_good", 6).alias("p_good"),
    )


#: Added to the table of op9: control strings as plain text.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_conversations(chat.as_events(rows))
    turns = chat.parse(F.col("formatted"))
    loss = chat.masked_text(F.col("formatted"), F.col("mask"))
    listing = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return done.withColumn("turns", turns).withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listing.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("p", F.round("p", 9))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.weighted(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows.where("id % 50 = 0"), rows, k=5)


OP1_SQL = """
WITH w AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM w q JOIN w c ON q.id % 50 = 0 AND q.id <> c.id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(language.learned_from()))
    done = language.identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        of("crf").alias("n_crf"),
    )


QUERIES: dict[str, Query] = {
    "op4_secrets": op4_secrets,
    "op5_substring_dedup": op5_substring_dedup,
    "op3_near_duplicates": op3_near_duplicates,
    "op2_language_id": op2_language_id,
    "op1_topk": op1_topk,
    "op10_mixing": op10_mixing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_formatting": op9_chat_formatting,
}

OP9_SQL = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(16 + 2 * length(role || text) - length(replace(replace(replace(role || text, '~', ''), '<', ''), '[', ''))
    + length(role) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""

SQL: dict[str, str] = {"op1_topk": OP1_SQL, "op9_chat_formatting": OP9_SQL}
