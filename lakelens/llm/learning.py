"""Bounded samples of labelled rows, the same for every run on the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the documents with a non-null label; of several the largest."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id")).agg(F.max(label).alias("label"))
    return known.join(docs.select("doc_id"), "doc_id", "left_semi")


def sample(docs: DataFrame, ids: DataFrame, per_label: int) -> DataFrame:
    """(doc_id, label, text) of at most ``per_label`` rows of each label of ``ids``.

    Of the rows whose id hashes to a slot, the one with the smallest hash is taken.
    Rows are chosen on ids and labels alone, summed map-side; texts are fetched by
    the chosen ids, without a shuffle of the others. Of texts that share an id the
    smallest is kept.
    """
    slot = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(per_label)).alias("slot")
    chosen = (
        ids.groupBy("label", slot).agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("least"))
        .groupBy(F.col("least.doc_id").alias("_doc")).agg(F.min("label").alias("label"))
    )
    # bounded by per_label and the number of labels
    fetched = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc"))
    return fetched.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")).groupBy("doc_id").agg(
        F.min("label").alias("label"), F.min("text").alias("text"))


def trains(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0
