"""A bounded sample of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int | None = None) -> DataFrame:
    """doc_id, text, y of at most per_class documents of each label, none of them held out; one row a doc_id.

    The choice is by a hash of doc_id, so it is the same wherever it runs. The
    sample's size is bounded by per_class, hence the broadcast; with most_bytes,
    chosen documents with a longer text are left out, so its bytes are bounded
    too. A document labelled twice counts with its larger label; of several texts
    of one doc_id the least counts; null labels are left out.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if most_bytes is not None:
        own = own.where(F.octet_length("text") <= most_bytes)
    return own.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
