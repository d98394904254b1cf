"""The training-data queries, as registered with the driver, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeweave.llm import decontamination, embedding_dedup, language_id, line_dedup, ngram_join, packing, pipeline, quality, token_counts, toxicity, warc
from primeweave.llm.shared import Stages, fold

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
QUERIES["pipeline"] = pipeline.run


def register(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


@register
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@register
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096, with_ids=False)


@register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@register
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels").where(~out))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


@register
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


@register
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


@register
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Stages(spark).path("archives")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).withColumnRenamed("id", "page_id")


def _base32_sql(hex_column: str) -> str:
    letters = [f"substr('{warc.BASE32}', ((('0x' || substr({hex_column}, {5 * k + 1}, 5))::int >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0)]
    return " || ".join(letters)


ORACLES["op7_warc"] = f"""
with p as (select page_id, coalesce(html, '') as payload from pages),
     d as (select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as h from p),
     f as (select h, min(page_id) as first_id from d group by h)
select page_id, payload_bytes, {_base32_sql("d.h")} as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from d join f using (h)"""


@register
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@register
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
