"""Folders as streams of micro-batches whose effect is that of one batch: a repeated batch, or one begun again, changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import snapshots
from lectern.operators.buckets import BucketTable


def micro_batches(spark: SparkSession, folder: str, schema: str | T.StructType, checkpoint: str, take: Callable[[DataFrame, int], None], files: int = 1) -> int:
    """Gives what is new in the folder to take, so many files a batch, until nothing is left; how many batches there were.

    The checkpoint remembers which files belong to which batch: after a failure the last batch comes again with
    the same number and files. Files that were there in an earlier run don't come again.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        return sum(1 for p in query.recentProgress if p["numInputRows"] > 0)
    finally:
        query.stop()


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch as the folder batch=number below path, in place of what an attempt at it has left."""

    def take(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return take


def merged(table: BucketTable, revision: str) -> Callable[[DataFrame, int], None]:
    """Merges each batch into a table: of each key the row of the highest revision stays, so that
    neither a repeated batch nor the order of batches matters. Only touched buckets are read and written."""

    def take(rows: DataFrame, number: int) -> None:
        new = snapshots.newest_revisions(rows, table.key, revision)
        there = table.read(table.touched(new)).join(new.select(table.key), table.key, "left_semi")
        table.upsert(snapshots.newest_revisions(there.unionByName(new.select(*there.columns)), table.key, revision))

    return take
