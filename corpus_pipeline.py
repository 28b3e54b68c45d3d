"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage works on all that its predecessor kept. The first three drop documents, the fourth redacts secrets in
place, the last one replaces the text by its token ids and the digest of the text that they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from casemill.llm import bpe, decontaminate, quality, secret_scan, simhash
from casemill.llm.common import table, text_key, text_of
from casemill.llm.queries import VOCABULARY, WORDS
from casemill.session import discard, write_through


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the verdict on their host reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id; of rows that repeat it, one."""
    kept = simhash.keep_one(docs).withColumn("key of the text", text_key(text_of("text")))
    return kept.dropDuplicates(["doc_id", "key of the text"]).drop("key of the text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough benchmark words go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; all documents stay."""
    return secret_scan.redact(docs, public_tokenizers.path(WORDS))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of the text, and the digest of the text decoded from them."""
    made = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, spaced=True, decoded="decoded")
    return made.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("byte-level BPE", byte_bpe),
]

#: Fingerprints and byte-pair merges have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, write_through(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
