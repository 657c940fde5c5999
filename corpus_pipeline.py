"""A training corpus from ``documents``: quality rules, exact dedup, SimHash
near-dedup, mixing to target weights, and SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. An empty table gives an
empty table at every stage, and further columns may have any name. All but the last return
the columns of ``documents``; the last returns the ids of every row of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from precis.llm.common import prepare, table
from precis.llm.exact_dedup import drop_exact_duplicates
from precis.llm.mixing import repeat_to_mix
from precis.llm.quality_rules import keep_good
from precis.llm.queries import vocabulary_path
from precis.llm.sentencepiece_bpe import encode_documents
from precis.llm.simhash import drop_near_duplicates
from precis.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and wordless texts go; repeated rows are judged alike."""
    prepare(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id, null ids last; null counts as empty."""
    prepare(spark)
    return drop_exact_duplicates(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints: the one with the smallest id, null ids last."""
    prepare(spark)
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null is a source of its own; wordless texts are not taken."""
    prepare(spark)
    return repeat_to_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix; a null or empty text has none."""
    prepare(spark)
    return encode_documents(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix", mix),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents", "doc_id")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't state fingerprints and merges of a vocabulary: tested by brute force instead.
ORACLE_SQL = None
