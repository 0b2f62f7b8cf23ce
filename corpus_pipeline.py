"""Training-corpus pipeline: five operators of ``faultlens.llm`` over the documents, stage after stage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but
the last return the columns of ``documents``.  ``run`` writes each result as Parquet in the
shared folder and reads it back as the next stage's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import bpe, decontaminate, langid, simhash, suffixdedup
from faultlens.llm.common import discard, stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters, unlike all that was learned, or undecided go."""
    return langid.with_language(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id."""
    return simhash.one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier in the corpus."""
    return suffixdedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) and whether decoding
    the ids gives the text back."""
    out = bpe.encode_documents(docs, TOKENIZER)
    return out.select("doc.doc_id", "doc.lang", "doc.source", "n_tokens", "ids",
                      (F.col("decoded") == F.coalesce("doc.text", F.lit(""))).alias("round_trip"))


STAGES = [("language_id", known_language), ("simhash_near_dedup", near_duplicates),
          ("suffix_array_dedup", repeated_passages), ("benchmark_decontamination", benchmark_leaks),
          ("bpe_encoding", token_ids)]

# Classifier, hashing trees, byte strings and merges are beyond SQL: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for name, stage in STAGES:
        docs, now = stored(stage(spark, docs, sf_dir), name)
        if path:
            discard(spark, path)
        path = now
    return docs
