"""Watched folders as streams: stability, de-duplication, batches by count or time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

OBSERVED = "path string, size bigint, changed_at timestamp, observed_at timestamp"


def stable(observations: DataFrame, seconds: float = 2.0) -> DataFrame:
    """Stream of OBSERVED to (path, size, observed_at): a file is let through when an observation shows the
    size and time of an earlier one at least so many seconds before; then its state is cleared. Only
    observations let a file through, never a timer. A path's state is one row."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values("observed_at")
        for r in rows.itertuples():
            changed, at = r.changed_at.value / 1e9, r.observed_at.value / 1e9
            if held is None or held[0] != r.size or held[1] != changed:
                held = (r.size, changed, at)
            elif at - held[2] >= seconds:
                out.append((key[0], r.size, r.observed_at))
                held = None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
        yield pd.DataFrame(out, columns=["path", "size", "observed_at"])

    return observations.groupBy("path").applyInPandasWithState(step, "path string, size bigint, observed_at timestamp", "size bigint, changed double, since double", "append", GroupStateTimeout.NoTimeout)


def stable_in_batch(observations: DataFrame, seconds: float = 2.0) -> DataFrame:
    """(path, size, observed_at): the first observation of each unchanged run that is old enough.

    A run is consecutive observations of a path with the same size and time. The stream's twin for
    a table, where each run lets its file through once.
    """
    order = Window.partitionBy("path").orderBy("observed_at")
    same = (F.lag("size").over(order) == F.col("size")) & (F.lag("changed_at").over(order) == F.col("changed_at"))
    runs = observations.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(order))
    since = runs.withColumn("since", F.min("observed_at").over(Window.partitionBy("path", "run")))
    old = since.where(F.unix_micros("observed_at") - F.unix_micros("since") >= int(seconds * 1e6))
    return old.groupBy("path", "run").agg(F.min("observed_at").alias("observed_at"), F.first("size").alias("size")).select("path", "size", "observed_at")


def once(observations: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each path, size and time once within the watermark."""
    return observations.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["path", "size", "changed_at"])


def not_in_baseline(observations: DataFrame, baseline: DataFrame) -> DataFrame:
    """But for entries that were there from the start; baseline is a static table of paths."""
    return observations.join(baseline.select("path"), "path", "left_anti")


def vanished(known: DataFrame, listing: DataFrame) -> DataFrame:
    """Known entries that the latest listing lacks."""
    return known.join(listing.select("path"), "path", "left_anti")


def batches_by_count_or_time(rows: DataFrame, group: str, ts: str, count: int = 5, seconds: int = 30, order: str | None = None) -> DataFrame:
    """rows with batch: a group's rows in order, a batch ending at its count, or when the next row comes
    seconds or more after its first.

    Groups are dealt to tasks, sorted there and folded in one pass over Arrow batches; what is kept from a row to the next is the
    open batch, so that neither the number of groups nor a group's length matters. Rows without a time come first and end no batch.
    """
    by = [ts] + ([order] if order else [])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, batch, n, begun = None, 1, 0, None
        for rows in batches:
            out = []
            for g, t in zip(rows.column("_group").to_pylist(), rows.column("_at").to_pylist()):
                if (g,) != own:
                    own, batch, n = (g,), 1, 0
                elif n >= count or (begun is not None and t - begun >= limit):
                    batch, n = batch + 1, 0
                if not n:
                    begun = t
                n += 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(out, pa.int32())], names=[*names, "batch"])

    names, limit = rows.columns, seconds * 1_000_000
    timed = rows.select("*", F.col(group).alias("_group"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    dealt = timed.repartition(group).sortWithinPartitions(group, *by)
    return dealt.mapInArrow(fold, T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())]))


def latest_generation(results: DataFrame, key: str, generation: str) -> DataFrame:
    """Results of each key's newest generation; those of older runs are discarded."""
    newest = results.groupBy(key).agg(F.max(generation).alias(generation))
    return results.join(newest, [key, generation], "left_semi")


def usage_windows(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums of each type in tumbling windows of event time, for streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def folder_snapshots(entries: DataFrame, width: str = "1 hour") -> DataFrame:
    """(path, size, changed_at, observed_at): a folder as one observation for each window: the bytes and the last change of its
    entries (root, ts, size); stable then holds for folders as for files, with a longer time."""
    held = entries.groupBy("root", F.window("ts", width).alias("w")).agg(F.sum("size").alias("size"), F.max("ts").alias("changed_at"))
    return held.select(F.col("root").cast("string").alias("path"), "size", "changed_at", F.col("w.start").alias("observed_at"))


def states_kept(states: DataFrame, below: Column, listing: DataFrame) -> DataFrame:
    """States of paths, without those below a folder that its latest listing lacks."""
    return states.where(~below).unionByName(states.where(below).join(listing.select("path").distinct(), "path", "left_semi"))


def linked_duplicates(arrivals: DataFrame, files: DataFrame) -> DataFrame:
    """(id, original_id): arrivals (id, content_hash), a batch or a stream, whose content an indexed file that is no duplicate has."""
    first = files.where("indexed_at IS NOT NULL AND duplicate_of_file_id IS NULL").groupBy("content_hash").agg(F.min("id").alias("original_id"))
    return arrivals.join(first, "content_hash").where("id <> original_id").select("id", "original_id")


def without_organised(baseline: DataFrame, organised: DataFrame) -> DataFrame:
    """The baseline once some of its entries are to be organised after all."""
    return baseline.join(organised.select("path"), "path", "left_anti")


def accounted(entries: DataFrame, skipped: Column, failed: Column) -> DataFrame:
    """(outcome, n): how a batch of entries ended."""
    return entries.select(F.when(skipped, "skipped").when(failed, "failed").otherwise("organised").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))

