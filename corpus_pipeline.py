"""A training-data pipeline over ``documents``: five stages, each written and read again.

Every stage works on all that its predecessor kept.  A stage that filters removes whole
documents; line dedup shortens texts and removes a document of which no line is left.

Rows of one doc_id are one document: near-duplicate removal keeps one of them, of the least
hash.  A row without doc_id is near to nothing and stays there, and loses its place for a
benchmark item like any other, as that is decided by text.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quintavote.llm import byte_bpe, decontaminate, language_id, line_templates, parity_join
from quintavote.llm.common import table
from quintavote.staging import materialize

# A text that is less like every learned language than this is rejected, however short.
MIN_SCORE = 0.02
# The cosine of unrelated vectors of DIM signs is normal with deviation DIM ** -0.5, and the
# score is the best of all languages.  From so many letters on, an unlearned text passes with
# these odds at most; fewer letters are too little to tell, as labelled texts score like noise.
ODDS = ((32, 0.001), (16, 0.1))
# A line of some words is dropped from its second document on, before similar documents go.
LINE_DOCS = 2


def least_score(odds: float, languages: int) -> float:
    """The score that the best of so many unrelated vectors exceeds with these odds at most."""
    return NormalDist().inv_cdf(1 - odds / max(1, languages)) * language_id.DIM**-0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and some likeness to a language; learned from the labelled ones."""
    known = language_id.learn(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select(F.struct("*").alias("own"), "text"), known)
    n_letters = F.length(F.regexp_replace("text", "[^\\p{L}]+", ""))
    gates = [(letters, least_score(odds, len(known))) for letters, odds in ODDS]
    # Letters are counted only where the score leaves it open.
    gate = F.when(F.col("score") >= max(g for _, g in gates), MIN_SCORE)
    for letters, least in gates:
        gate = gate.when(n_letters >= letters, max(MIN_SCORE, least))
    good = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= gate.otherwise(MIN_SCORE))
    return found.where(good).select("own.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; n_chars follows."""
    own = docs.select(F.struct("*").alias("own"), "doc_id", "text")
    left = line_templates.drop_recurring(own, line_docs=LINE_DOCS).where(
        "n_dropped = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'"
    )
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(
        *(changed.get(c, F.col("own").getField(c)).alias(c) for c in docs.columns)
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of similar documents."""
    classes = parity_join.similar_components(docs)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(materialize(gone, "near-duplicates"), "doc_id", "left_anti").select(docs.columns)
    again = kept.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = materialize(again, "repeated-ids")
    if again.isEmpty():
        return kept
    # Rows are compared before they are moved, so an id of many rows is no group in one task.
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), F.struct(*kept.columns).alias("row"))).alias("first")
    )
    rest = kept.join(again, "doc_id", "left_anti").select(kept.columns)
    return rest.unionByName(one.select("first.row.*"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    texts = docs.select(F.xxhash64("text").alias("text_id"), "text")
    held = decontaminate.find(texts, table(spark, sf_dir, "benchmark"), key="text_id")
    held = materialize(held.select(F.col("doc_id").alias("text_id")).distinct(), "contaminated")
    return docs.join(held, F.xxhash64("text") == F.col("text_id"), "left_anti").select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, packed ids, and the digest of the text they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    texts = docs.select("doc_id", "text")
    return byte_bpe.encode(texts, ranks, pattern, decoded="decoded").select(
        "doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("byte_bpe", tokenize),
]

# Language identification is not expressible in SQL; the pipeline is tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
