"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from casemill.llm import alignment, bpe, chat, decontaminate, html_text, lattice, quality, repair, secret_scan, sharding, simhash, substring, toxicity
from casemill.llm.common import table

SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(16)], 1613
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"
BYTE_LEVEL = "byte_bpe_50k.json"


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, spaced=True, decoded="decoded")
    return ids.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.score(table(spark, folder, "documents"), public_tokenizers.path(PIECES))


def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, public_tokenizers.path(WORDS))
    base = secret_scan.spelled(F.col("spans"), secret_scan.KINDS[:3])
    return found.select(
        "doc_id",
        *[secret_scan.counted(F.col("spans"), k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secret_scan.spelled(F.col("spans")).alias("spans"),
    )


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.digests(table(spark, folder, "documents"))


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    made = chat.format_chats(chat.records_of_turns(rows.unionByName(more)))
    turns = chat.read_back(F.col("formatted"))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = chat.learned_text(F.col("formatted"), F.col("loss"))
    return made.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages").select("page_id", "url", "html"))


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.audits(repair.damaged(table(spark, folder, "conversations")), gone="gone")


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = alignment.align(docs, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    counts = [F.col(c).cast("long").alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return found.select(*counts, digest.alias("groups_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_secret_scans": op3_secret_scans,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_html_text": op11_html_text,
    "op12_repair": op12_repair,
    "op13_alignment": op13_alignment,
}
