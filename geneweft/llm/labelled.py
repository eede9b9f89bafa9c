"""Labelled rows for the classifiers: a deterministic sample of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; what decides which rows are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int) -> DataFrame:
    """text, label (0 or 1) of at most ``per_class`` labelled documents of each class, chosen by a hash of the id.

    A document with several labels has the largest; null labels and null ids teach nothing. Repeated rows of a chosen
    id all come, so the choice is made among ids.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * per_class ids and labels: a checked bound
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_doc"), "label"))
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "label")
