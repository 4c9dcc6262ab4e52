"""Writes as new snapshots: merges, replacements, retention, generations.

Plain Parquet has no row updates: each operator returns the table's next state, and commit()
publishes it. Merges are one full outer join on the key.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """new over old by key; in the columns of keep, nulls of new don't overwrite."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh = F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c in keep:
            return F.coalesce(f"n.{c}", f"o.{c}")
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*(value(c).alias(c) for c in old.columns))


def bumped(old: DataFrame, new: DataFrame, key: str, counters: tuple[str, ...]) -> DataFrame:
    """upsert in which the counters of rows that were there go up by one, and begin at one."""
    merged = upsert(old, new.select(*(c for c in new.columns if c not in counters)), key)
    touched = new.select(key).distinct().withColumn("_touched", F.lit(1))
    return merged.join(touched, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) + F.coalesce("_touched", F.lit(0)) for c in counters}).drop("_touched").select(*old.columns)


def patched(rows: DataFrame, where: Column, patch: dict[str, Column], allowed: tuple[str, ...]) -> DataFrame:
    """Sets allowed columns of some rows; another column is refused."""
    if other := set(patch) - set(allowed):
        raise ValueError(f"columns can't be set: {sorted(other)}")
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in patch.items()})


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of new in place of the rows of old with its keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without(rows: DataFrame, gone: DataFrame, key: str, own: str | None = None) -> DataFrame:
    """rows but for those whose key is in gone: a delete, or its cascade to another table."""
    return rows.join(gone.select(F.col(key).alias("_gone")).distinct(), F.col(own or key) == F.col("_gone"), "left_anti")


def newest_revisions(writes: DataFrame, key: str, revision: str) -> DataFrame:
    """Of writes to the same key the one of the highest revision: an older one never overwrites it."""
    return writes.groupBy(key).agg(F.max_by(F.struct(*writes.columns), F.col(revision)).alias("r")).select("r.*")


def check_one_space(vectors: DataFrame, model: str, dim: int) -> None:
    """Refuses vectors of another model or dimension."""
    other = vectors.where((F.col("model") != model) | (F.col("dim") != dim)).limit(1).count()
    if other:
        raise ValueError(f"vectors of another space than {model}, {dim}")


def with_note_chunk(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """notes (file_id, text) as the files' only note chunks, at the old one's place or after the last chunk."""
    per_file = chunks.join(notes.select("file_id"), "file_id", "left_semi").groupBy("file_id").agg(F.min(F.when(F.col("kind") == "note", F.col("chunk_idx"))).alias("at"), F.max("chunk_idx").alias("last"))
    rest = chunks.where("kind <> 'note'").unionByName(chunks.where("kind = 'note'").join(notes.select("file_id"), "file_id", "left_anti"))
    placed = notes.join(per_file, "file_id", "left").select("file_id", F.coalesce("at", F.col("last") + 1, F.lit(0)).cast("int").alias("chunk_idx"), "text", F.lit("note").alias("kind"))
    return rest.unionByName(placed, allowMissingColumns=True)


def reconciled_writes(old: DataFrame, upserts: DataFrame, stale: DataFrame, key: str = "id") -> DataFrame:
    """old with rows written over or added, and the index columns of stale keys cleared, as one next state."""
    merged = upsert(old, upserts, key).join(stale.select(key).distinct().withColumn("_stale", F.lit(True)), key, "left")
    gone = F.coalesce("_stale", F.lit(False))
    return merged.withColumns({c: F.when(~gone, F.col(c)) for c in ("indexed_at", "index_signature")}).select(*old.columns)


def other_spaces(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """(model, dim, others): the vectors that don't belong to a space."""
    return vectors.where((F.col("model") != model) | (F.col("dim") != dim)).groupBy("model", "dim").agg(F.count("*").alias("others"))


def removed_until(rows: DataFrame, removals: DataFrame, key: str, revision: str, until: str) -> DataFrame:
    """rows but for those that a removal of their key is as new as, or newer than."""
    last = removals.groupBy(key).agg(F.max(until).alias("_until"))
    return rows.join(last, key, "left").where(F.col("_until").isNull() | (F.col(revision) > F.col("_until"))).drop("_until")


def cleared(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def pending(rows: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """rows whose keys aren't staged yet."""
    return rows.join(staged.select(key).distinct(), key, "left_anti")


def seeded(rows: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """rows with the defaults whose keys are missing; doing it again changes nothing."""
    return rows.unionByName(defaults.join(rows.select(key), key, "left_anti"))


def latest_writes(writes: DataFrame, keys: list[str], at: str, sticky: tuple[str, ...] = ()) -> DataFrame:
    """The latest write of each key; flags of sticky stay set once any write has set them."""
    latest = writes.groupBy(*keys).agg(F.max_by(F.struct(*writes.columns), F.col(at)).alias("_last"), *(F.bool_or(c).alias(f"_{c}") for c in sticky))
    return latest.select(*((F.col(f"_{c}") if c in sticky else F.col(f"_last.{c}")).alias(c) for c in writes.columns))


def retained(rows: DataFrame, where: Column, there: DataFrame, key: str) -> DataFrame:
    """rows, but of those that the condition means only the ones whose key is there."""
    return rows.where(~where).unionByName(rows.where(where).join(there.select(key).distinct(), key, "left_semi").select(*rows.columns))


def invalidated(files: DataFrame, bad: DataFrame) -> DataFrame:
    """files with index, hash and link cleared for the bad ids."""
    marked = files.join(bad.select("id").distinct().withColumn("_bad", F.lit(True)), "id", "left")
    return marked.withColumns({c: F.when(F.col("_bad").isNull(), F.col(c)) for c in files.columns if c != "id"}).drop("_bad")


def written_if_current(old: DataFrame, new: DataFrame, key: str, generation: str) -> DataFrame:
    """new over old where both are of the same generation."""
    same = new.alias("n").join(old.select(F.col(key).alias("_key"), F.col(generation).alias("_now")), F.col(f"n.{key}") == F.col("_key")).where(F.col(f"n.{generation}") == F.col("_now"))
    return upsert(old, same.select("n.*"), key)


class Generations:
    """Tables as numbered folders with a pointer to the current one, in a file system that Spark reaches.

    A generation is written beside the current one; then the pointer is replaced by a rename. Between
    the removal of the old pointer and the rename there is none, so readers try again. Resuming skips
    the keys that are staged already.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def current(self) -> DataFrame | None:
        """The current generation, or nothing before the first."""
        if not self._fs.exists(self._at("CURRENT")):
            return None
        name = json.loads(self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).first()[0])["generation"]
        return self.spark.read.parquet(f"{self.root}/{name}")

    def stage(self, rows: DataFrame, name: str = "shadow") -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def staged(self, name: str = "shadow") -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{name}") if self._fs.exists(self._at(name)) else None

    def pending(self, rows: DataFrame, key: str, name: str = "shadow") -> DataFrame:
        """rows whose keys aren't staged yet."""
        done = self.staged(name)
        return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")

    def commit(self, key: str, expected: int, name: str = "shadow") -> DataFrame:
        """Publishes the staged keys over the current generation, if there are as many as expected."""
        staged = self.staged(name)
        found = 0 if staged is None else staged.select(key).distinct().count()
        if staged is None or found != expected:
            raise ValueError(f"{found} of {expected} are staged")
        current = self.current()
        self.publish(staged if current is None else replaced(current, staged, key))
        self.discard(name)
        return self.current()

    def publish(self, rows: DataFrame) -> None:
        name = f"gen-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        fresh = self._at(f"CURRENT-{name}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps({"generation": name}).encode()))
        out.close()
        old = self._at("CURRENT")
        if self._fs.exists(old):
            self._fs.delete(old, False)
        self._fs.rename(fresh, old)

    def discard(self, name: str = "shadow") -> None:
        self._fs.delete(self._at(os.path.basename(name)), True)
