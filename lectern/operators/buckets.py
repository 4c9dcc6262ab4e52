"""Tables laid out by a hash of their key: a write reads and replaces only the buckets that it touches.

A table is a folder of Parquet parted by bucket. A write finds the buckets of its keys, at most as many numbers as there are
buckets; reads only these, since they're a filter of partitions; and overwrites only these (dynamic partition overwrite: Spark
moves a partition in when all tasks have ended). Files of other buckets stay as they are. A bucket that a write leaves empty has its
folder removed. One writer at a time: what reads meanwhile may see some buckets before a write and some after it.

refreshed() of two states gives the changes between them, of the touched buckets only; what is derived
from a table by its keys, sums and postings, follows from these changes.

Keys are never null: rows with a null key are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import snapshots
from lectern.session import cut

BUCKETS = 256


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class BucketTable:
    """A folder of rows by bucket of the key, an integer or a string."""

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    buckets: int = BUCKETS

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> BucketTable:
        table = cls(rows.sparkSession, path, key, rows.schema, buckets)
        table._put(rows, "errorifexists")
        return table

    def _placed(self, rows: DataFrame) -> DataFrame:
        checked = F.when(F.col(self.key).isNull(), F.raise_error(F.lit(f"a row without its key {self.key}"))).otherwise(bucket_of(F.col(self.key), self.buckets))
        return rows.withColumn("bucket", checked.cast("int"))

    def _put(self, rows: DataFrame, mode: str) -> None:
        """A bucket is written by one task, or, if it's large, by several."""
        placed = self._placed(rows).hint("rebalance", "bucket")
        placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def touched(self, *changes: DataFrame) -> list[int]:
        """The buckets of the changes' keys."""
        found: set[int] = set()
        for rows in changes:
            found |= {r["bucket"] for r in self._placed(rows.select(self.key)).select("bucket").distinct().collect()}
        return sorted(found)

    def read(self, touched: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)
        return (rows if touched is None else rows.where(F.col("bucket").isin(touched))).drop("bucket")

    def _replace(self, rows: DataFrame, touched: list[int]) -> list[int]:
        """rows in place of all that the touched buckets hold."""
        rows = cut(self._placed(rows))  # once, before its own source is overwritten
        if touched:
            self._put(rows.drop("bucket"), "overwrite")
            left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
            for bucket in sorted(set(touched) - left):
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
            self.spark.catalog.refreshByPath(self.path)
        return touched

    def upsert(self, new: DataFrame, keep: tuple[str, ...] = ()) -> list[int]:
        """new, of distinct keys, over the rows there; nulls of new don't overwrite the columns of keep. The touched buckets."""
        touched = self.touched(new)
        return self._replace(snapshots.upsert(self.read(touched), new, self.key, keep), touched)

    def replace(self, new: DataFrame) -> list[int]:
        """All of new in place of the rows with its keys, of which there may be many."""
        touched = self.touched(new)
        return self._replace(snapshots.replaced(self.read(touched), new, self.key), touched)

    def delete(self, gone: DataFrame) -> list[int]:
        """The rows without those whose key is in gone."""
        touched = self.touched(gone)
        return self._replace(snapshots.without(self.read(touched), gone, self.key), touched)

    def reconcile(self, upserts: DataFrame, stale: DataFrame) -> list[int]:
        """Rows written over or added, and the index columns of stale keys cleared, in one write."""
        touched = self.touched(upserts, stale)
        return self._replace(snapshots.reconciled_writes(self.read(touched), upserts, stale, self.key), touched)


class FilesByPath:
    """Files by bucket of their id, with their paths by bucket of the path: a write without an id finds the file of its path."""

    def __init__(self, files: BucketTable, paths: BucketTable) -> None:
        self.files, self.paths = files, paths

    @classmethod
    def create(cls, rows: DataFrame, path: str, buckets: int = BUCKETS) -> FilesByPath:
        """rows (id, path, ...), both distinct."""
        return cls(BucketTable.create(rows, f"{path}/files", "id", buckets), BucketTable.create(rows.select("path", "id"), f"{path}/paths", "path", buckets))

    def resolved(self, new: DataFrame) -> DataFrame:
        """new with ids: its own, else that of the file at its path, else one after all others, by path.

        Only the buckets of new's paths are read. Rows without an id are numbered by range of their path, a count for each partition.
        """
        known = self.paths.read(self.paths.touched(new)).select("path", F.col("id").alias("_there"))
        placed = cut(new.join(known, "path", "left").withColumn("id", F.coalesce("id", "_there")).drop("_there").select(*new.columns))
        fresh = cut(placed.where("id is null").repartitionByRange("path").sortWithinPartitions("path").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
        last = max(r or 0 for r in (self.files.read().agg(F.max("id")).first()[0], placed.agg(F.max("id")).first()[0]))
        starts = F.create_map(F.lit(-1), F.lit(0).cast("long"))
        for row in fresh.groupBy("_p").count().orderBy("_p").collect():  # one row a partition
            starts, last = F.map_concat(starts, F.create_map(F.lit(row["_p"]), F.lit(last + 1).cast("long"))), last + row["count"]
        numbered = fresh.withColumn("id", F.element_at(starts, F.col("_p")) + F.col("_i")).select(*new.columns)
        return placed.where("id is not null").unionByName(numbered)

    def upsert(self, new: DataFrame, keep: tuple[str, ...] = ()) -> tuple[list[int], list[int]]:
        """new (id or null, path, ...), distinct, written; extensions become lower case. The touched buckets of files and of paths."""
        rows = cut(self.resolved(new))
        if "ext" in rows.columns:
            rows = rows.withColumn("ext", F.lower("ext"))
        touched = self.files.touched(rows)
        before = cut(self.files.read(touched).join(rows.select("id"), "id", "left_semi").select("path", "id"))
        files = self.files.upsert(rows, keep)
        moved = before.join(rows.select("path", "id"), ["path", "id"], "left_anti")
        gone = self.paths.delete(moved.select("path"))
        return files, sorted({*gone, *self.paths.upsert(rows.select("path", "id"))})


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, old, new): rows inserted, updated or deleted between two states, by key and a hash of the row.

    A key's rows are compared by two hashes of all their columns; equal rows give nothing. Both states have distinct keys.
    """
    columns = [c for c in after.columns if c != key]
    of = lambda rows: rows.select(key, F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("g"))
    a, b = of(before.select(*after.columns)).alias("a"), of(after).alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    kind = F.when(F.col("a.h").isNull(), "insert").when(F.col("b.h").isNull(), "delete").when((F.col("a.h") != F.col("b.h")) | (F.col("a.g") != F.col("b.g")), "update")
    out = both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), kind.alias("change"), F.col("a.row").alias("old"), F.col("b.row").alias("new"))
    return out.where("change is not null")


def refreshed_counts(counts: DataFrame, feed: DataFrame, group: str, amount: str) -> DataFrame:
    """counts (group, n, total) of a table after a feed of changes: what changed is added and taken away, what didn't isn't read."""
    gone = feed.where("old is not null").select(F.col(f"old.{group}").alias(group), F.lit(-1).alias("n"), (-F.col(f"old.{amount}")).alias("total"))
    come = feed.where("new is not null").select(F.col(f"new.{group}").alias(group), F.lit(1).alias("n"), F.col(f"new.{amount}").alias("total"))
    moved = gone.unionByName(come).groupBy(group).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    both = counts.unionByName(moved).groupBy(group).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return both.where("n > 0")
