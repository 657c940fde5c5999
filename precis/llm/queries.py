"""Registered queries of the training-data operators: each takes
(spark, sf_dir), applies one operator to its whole table and shapes the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm import host_reputation, language_id, ordinal_quality, toxicity
from precis.llm.common import table
from precis.llm.conversation_repair import conversation_digests, damaged, repair_conversations
from precis.llm.exact_dedup import exact_duplicates
from precis.llm.license_scan import scan_licenses
from precis.llm.mixing import mix_sources
from precis.llm.quality_rules import quality_verdicts
from precis.llm.sentencepiece_bpe import encode_documents
from precis.llm.simhash import simhash_components
from precis.llm.warc import round_trip
from precis.llm.whitening import whiten


def vocabulary_path() -> str:
    """The merge-type vocabulary of the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fold(ident: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit(""))) % folds


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return exact_duplicates(docs, carry={"text_sha256": digest})


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels: 0 poor, 1 good but toxic, 2 good; a quarter of the
    ids (crc32 modulo 4 is 2) is not learned from."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    ratings = labels.where("quality is not null").select("doc_id", grade.alias("grade"))
    model = ordinal_quality.train(docs, ratings, levels=3, learn=fold("_rated", 4) != 2)
    out = ordinal_quality.grade_documents(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "expected_grade", "tail", "selected")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, learn=fold("doc_id", 4) != 2)
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    model = language_id.train(docs.where(fold("doc_id", 5) != 0))
    out = language_id.identify(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables label documents only; the label of the document with the page's id
    is taken as the page's outcome: bad if poor or toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    out = host_reputation.judge_urls(pages, labels.select(F.col("doc_id").alias("_page"), bad.alias("_bad")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels")
    return quality_verdicts(docs, labels)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents", "doc_id"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    return encode_documents(docs, vocabulary_path(), with_ids=False)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "pages"))
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      F.col("refers_to").cast("long").alias("refers_to"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table; one that lost all its rows has zeros and nothing to repair."""
    turns = table(spark, sf_dir, "conversations")
    repairs = repair_conversations(damaged(turns))
    found = repairs.conversations.join(conversation_digests(repairs.turns).withColumnRenamed("conv_id", "_of"),
                                       F.col("conv_id").eqNullSafe(F.col("_of")), "left").drop("_of")
    found = found.withColumnRenamed("conv_id", "_conv")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_ordinal_quality": op2_ordinal_quality,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_host_reputation": op5_host_reputation,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash": op9_simhash,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_warc": op11_warc,
    "op12_whitening": op12_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}
