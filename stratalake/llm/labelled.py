"""Labelled rows for the classifiers: folds by a checksum of the id, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .store import Scratch


def fold(id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents outside the held-out fold, written to the shared folder.

    The sample is the ``most`` ids with the smallest hash, so it doesn't depend on the layout of the tables.  Labels that
    are null, or that aren't 0 or 1, count for nothing; several labels of one id are averaged and rounded.  Of several
    rows with one id the smallest text is used.
    """
    y = F.col(label).cast("double")
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), y.alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0))
    own = own.filter(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    # ids alone are sampled: those that have a document, first by a bound on the hash that leaves about four times as many
    own = own.join(docs.select(F.col(id).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    work = Scratch(docs.sparkSession, "labelled")
    own = work.keep(own, "ids")
    share = min(1.0, 4 * most / max(1, own.count()))
    few = own.filter(F.col("h") <= min(2**63 - 1, -(2**63) + int(share * 2**64))).orderBy("h", "doc_id").limit(most).select("doc_id", "y")
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return work.keep(found, "texts")
