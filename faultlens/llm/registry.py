"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import (bpe, conversation, credentials, decontaminate, filteraudit, htmltext, langid, neighbours, sharding,
                           simhash, suffixdedup, urlfilter, warc)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.group_near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(_read(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER)
    return out.select("doc.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_benchmark(_read(spark, sf_dir, "documents", "doc_id", "text"),
                                       _read(spark, sf_dir, "benchmark", "item_id", "text"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["begin"]))
    return out.select("doc.doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.size("spans") > 0).alias("contaminated"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.remove_repeats(_read(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["begin"]))
    return out.select("doc.doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = langid.predict_language(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc.doc_id", "lang_pred", "score") \
        .select("doc_id", (langid.remainder() == 2).alias("held_out"), "lang_pred", "score")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.main_text(_read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(_read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = credentials.find_secrets(_read(spark, sf_dir, "documents", "doc_id", "text"))
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, credentials.KINDS), F.sha2(credentials.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      credentials.joined(F.concat("base", "added")).alias("spans"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_filters(_read(spark, sf_dir, "documents", "doc_id", "text", "source"),
                                     _read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.audit_conversations(_read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_bpe": op4_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_suffix": op6_suffix,
    "op7_language": op7_language,
    "op8_urls": op8_urls,
    "op9_html": op9_html,
    "op10_warc": op10_warc,
    "op11_secrets": op11_secrets,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversations": op13_conversations,
}
ORACLES: dict[str, str] = {
    "op8_urls": urlfilter.oracle(),
    "op10_warc": warc.ORACLE,
    "op12_filter_audit": filteraudit.ORACLE,
}
