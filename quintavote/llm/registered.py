"""The registered corpus queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quintavote.llm import (
    byte_bpe,
    chat_repair,
    decontaminate,
    html_wrapper,
    language_id,
    line_templates,
    parity_join,
    part_codes,
    prefix_trie,
    quality_ledger,
    scaled_sketch,
    suffix_dedup,
    warc,
)
from quintavote.llm.common import table
from quintavote.staging import fresh_path

RANK_FILE = "byte_bpe_50k.tiktoken"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.ledger(table(spark, sf_dir, "documents"))
    base = quality_ledger.apply_policy(rows, quality_ledger.BASE, "base_kept")
    return quality_ledger.apply_policy(base, quality_ledger.STANDARD, "kept").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept", "fail_bits",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language_id.held_out())
    known = language_id.learn(docs.where("NOT held_out"))
    return language_id.identify(docs, known).select("doc_id", "held_out", "lang_pred", "score")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op7_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_components(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode(docs, ranks, pattern, decoded="decoded").select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, normal = fresh_path(spark, "warc-written"), fresh_path(spark, "warc")
    warc.write_monolithic(warc.records(table(spark, sf_dir, "pages")), written)
    warc.normalise(spark, written, normal)
    return warc.read_back(spark, normal).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = part_codes.train(table(spark, sf_dir, "embeddings"))
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if coded is None:
        return spark.createDataFrame([], schema)
    return part_codes.with_label_errors(coded.rows).select(
        F.col("id").alias("vec_id"),
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(part_codes.digest(coded.books)).alias("codebooks_sha256"),
    )


def op13_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.compare_with_edited(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", ",").alias("fingerprint"),
        F.array_join("edited_sketch", ",").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


# Queries without a plain SQL twin: tested against brute force, an exact round trip or
# held-out accuracy.
NO_SQL = {
    "op1_suffix_dedup",
    "op4_language_id",
    "op5_html_extraction",
    "op7_chat_repair",
    "op9_byte_bpe",
    "pipeline",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_quality_rules,
        op3_line_dedup,
        op4_language_id,
        op5_html_extraction,
        op6_decontamination,
        op7_chat_repair,
        op8_ngram_jaccard,
        op9_byte_bpe,
        op10_warc,
        op11_prefix_trie,
        op12_part_codes,
        op13_scaled_sketch,
    )
}
