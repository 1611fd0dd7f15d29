"""Named queries of the operators, with the SQL each must equal where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..registry.base import Query
from . import conversations, decontaminate, embed_dedup, exact_dedup, hard_negatives, langid, mixing, packing, pii, quality, secret_scan, simhash, token_counts
from .common import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_language_id")
def op1_language_id(spark, sf):
    return langid.predictions(table(spark, sf, "documents"))


@query("op2_personal_data")
def op2_personal_data(spark, sf):
    return pii.detect(table(spark, sf, "documents")).drop("found")


@query("op3_exact_dedup", exact_dedup.ORACLE_SQL)
def op3_exact_dedup(spark, sf):
    return exact_dedup.exact_copies(table(spark, sf, "documents"))


@query("op4_source_mix")
def op4_source_mix(spark, sf):
    return mixing.mixture(table(spark, sf, "documents"))


@query("op5_quality")
def op5_quality(spark, sf):
    return quality.classify(table(spark, sf, "documents"))


@query("op6_pack_documents")
def op6_pack_documents(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), 2048)


@query("op7_embedding_near_dedup")
def op7_embedding_near_dedup(spark, sf):
    return embed_dedup.link_vectors(table(spark, sf, "embeddings"))


@query("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op9_token_counts")
def op9_token_counts(spark, sf):
    return token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


@query("op10_secrets")
def op10_secrets(spark, sf):
    return secret_scan.scan(table(spark, sf, "documents"))


@query("op11_decontamination", decontaminate.ORACLE_SQL)
def op11_decontamination(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_hard_negatives", hard_negatives.ORACLE_SQL)
def op12_hard_negatives(spark, sf):
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").select("vec_id", label.alias("label"), hard_negatives.quantised("embedding").alias("v"))
    return hard_negatives.mine(vectors, vec_id % 100 == 0)


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf):
    rows = table(spark, sf, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)
