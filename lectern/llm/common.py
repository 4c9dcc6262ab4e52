"""What several operators of this package use."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def held_out(doc_id) -> bool:
    """The rows that no model learns from: crc32 of the id as text, divisible by 5."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, label, text): at most limit labelled rows that are not held out, in the order of a hash of doc_id.

    A bounded top-k (TakeOrdered): no more than limit rows of a task leave it. Null labels,
    ids and texts are left out; of repeated label rows the largest label counts, of rows that repeat
    an id one with the smallest hash of its text.
    """
    truth = labels.select("doc_id", label).where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    truth = truth.where(~held_out_column())
    chosen = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").where("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("label", "text"), F.xxhash64("text")).alias("one"))
    return one.select("doc_id", "one.label", "one.text")


def with_column_of_arrays(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that later expressions read as often as they like: the value is made once a row."""
    return rows.select("*", F.explode(F.array(value)).alias(name))
