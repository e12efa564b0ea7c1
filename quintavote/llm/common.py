"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` long and ``text`` string alone, whatever else ``docs`` carries."""
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, from which shard and partition numbers are taken."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it inside ``body``.

    A lambda variable is evaluated once, where a repeated column expression
    would be computed at every mention, even for each element of an array.
    """
    return f"transform(array({value}), {name} -> {body})[0]"
