"""Statistics of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.filters import added_at
from lectern.session import cut


def index_counts(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total"), F.count("indexed_at").alias("indexed"), (F.count("*") - F.count("indexed_at")).alias("unindexed"))


def summary(files: DataFrame) -> DataFrame:
    """Counts, bytes and extracted characters; zeros for an empty library."""
    return files.agg(
        F.count("*").alias("files"),
        F.count("indexed_at").alias("indexed"),
        F.coalesce(F.sum(F.greatest("size", F.lit(0))), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.length(F.coalesce("content_text", F.lit("")))), F.lit(0)).alias("extracted_text_chars"),
    )


def per_day(rows: DataFrame, ts: Column, zone: str = "UTC", **values: Column) -> DataFrame:
    """One row for each local day."""
    day = F.to_date(F.from_utc_timestamp(ts, zone))
    return rows.where(ts.isNotNull()).groupBy(day.alias("day")).agg(*(v.alias(k) for k, v in values.items()))


def dense_days(rows: DataFrame, first: str, last: str, *values: str) -> DataFrame:
    """Every day from first to last, zeros where there's none."""
    days = rows.sparkSession.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day")
    return days.join(F.broadcast(rows.where(F.col("day").between(first, last))), "day", "left").select("day", *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def category_storage(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(F.sum(F.greatest("size", F.lit(0))).alias("bytes"), F.count("*").alias("files")).orderBy(F.desc("bytes"), "category")


def added_and_indexed(files: DataFrame, zone: str = "UTC") -> DataFrame:
    """By day: files added (found, else indexed, else changed) and files indexed, in one pass of the files."""
    events = files.select(F.inline(F.array(
        F.struct(F.coalesce("discovered_at", "indexed_at", "mtime").alias("ts"), F.lit(1).alias("added"), F.lit(0).alias("indexed")),
        F.struct(F.col("indexed_at").alias("ts"), F.lit(0).alias("added"), F.lit(1).alias("indexed")),
    )))
    return per_day(events, F.col("ts"), zone, added=F.sum("added"), indexed=F.sum("indexed"))


def dashboard(files: DataFrame, usage: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of totals; the three parts are single rows, so their joins carry one row each."""
    tokens = usage.agg(F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"))
    stored = vectors.agg(F.coalesce(F.sum(F.size("embedding") * 4), F.lit(0)).cast("long").alias("vector_bytes"))
    return summary(files).crossJoin(F.broadcast(tokens)).crossJoin(F.broadcast(stored))


def one_space(vectors: DataFrame) -> DataFrame:
    """The dimension if all vectors have the same one, else no row."""
    return vectors.agg(F.min("dim").alias("dim"), F.count_distinct("dim").alias("_n")).where("_n = 1").drop("_n")


def spaces(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("model", "dim").agg(F.count("*").alias("vectors"))


#: A content that more than this share of the files has is hot: fewer than 1 / HOT_SHARE are.
HOT_SHARE = 1 / 500


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Files with the same content: the one that others are linked to stays, else the first added.

    Row by row: the group's hash and size, the place in it, and what the rest of it takes up. Groups are aggregated
    before they shuffle. Files of hot contents are dealt to tasks by range of their order, where
    they're numbered, and each range begins after the files of the ranges before; others are numbered by group.
    """
    hashed = files.where("content_hash IS NOT NULL AND content_hash <> '' AND NOT is_directory").select("id", "path", "size", "content_hash", "mtime", added_at().alias("added"))
    linked = files.where("duplicate_of_file_id IS NOT NULL").select(F.col("duplicate_of_file_id").alias("id")).distinct().withColumn("_linked", F.lit(1))
    rows = hashed.join(linked, "id", "left").withColumn("_order", F.struct(F.coalesce(-F.col("_linked"), F.lit(0)).alias("l"), "added", "mtime", "path", "id")).drop("_linked", "added", "mtime")
    groups = rows.groupBy("content_hash").agg(F.count("*").alias("members"), F.sum("size").alias("_total"), F.min_by(F.struct("id", "size"), "_order").alias("_kept")).where("members > 1")
    groups = groups.select("content_hash", "members", F.col("_kept.id").alias("kept_id"), (F.col("_total") - F.col("_kept.size")).alias("reclaimable"))
    least = max(1000.0, hashed.count() * HOT_SHARE)
    hot = rows.join(F.broadcast(groups.where(F.col("members") > least)), "content_hash")
    rest = rows.join(groups.where(F.col("members") <= least), "content_hash")
    numbered = rest.withColumn("place", F.row_number().over(Window.partitionBy("content_hash").orderBy("_order")))
    dealt = cut(hot.repartitionByRange("content_hash", "_order").withColumn("_range", F.spark_partition_id()))  # once: ranges must not change
    sizes = dealt.groupBy("content_hash", "_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("content_hash", "_range", F.coalesce(F.sum("_n").over(Window.partitionBy("content_hash").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("content_hash", "_range").orderBy("_order"))
    placed = dealt.withColumn("_within", within).join(starts, ["content_hash", "_range"]).withColumn("place", (F.col("_within") + F.col("_before")).cast("int"))
    columns = ["content_hash", "id", "path", "place", "members", "kept_id", "reclaimable"]
    return numbered.select(*columns).unionByName(placed.select(*columns))


def original_of(files: DataFrame) -> DataFrame:
    """(id, original_id): the first added indexed file with the same content that is no duplicate itself."""
    fit = files.where("content_hash IS NOT NULL")
    first_two = fit.where("indexed_at IS NOT NULL AND duplicate_of_file_id IS NULL").groupBy("content_hash").agg(F.min(F.struct(added_at().alias("added"), "id")).alias("first"))
    return fit.select("id", "content_hash").join(first_two, "content_hash").where("id <> first.id").select("id", F.col("first.id").alias("original_id"))


def states(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of each state, as columns."""
    names = ("pending", "processing", "completed", "failed")
    return rows.groupBy(*keys).agg(*(F.count_if(F.col("state") == n).alias(n) for n in names), F.count("*").alias("total"))


def tree_snapshot(files: DataFrame) -> DataFrame:
    """By directory: files, bytes, last change, and a digest of the sorted entries.

    The entries of a directory are first digested in blocks of 4096, so that no row holds them all.
    """
    entry = files.where("NOT is_directory").select("source_dir", "path", "size", "mtime", F.xxhash64("path", "size", "mtime").alias("h"))
    order = Window.partitionBy("source_dir", "block").orderBy("path")
    blocks = entry.withColumn("block", F.pmod(F.xxhash64("path"), F.lit(64)))
    placed = blocks.withColumn("n", F.row_number().over(order))
    sums = placed.groupBy("source_dir").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("mtime").alias("last_change"), F.sum(F.pmod(F.xxhash64("block", "n", "h"), F.lit(2**40))).alias("sum"))
    return sums.select("source_dir", "files", "bytes", "last_change", F.sha2(F.col("sum").cast("string"), 256).alias("digest"))


def majority_category(files: DataFrame) -> DataFrame:
    """By directory: the most frequent category, the first by name of equals."""
    counts = files.groupBy("source_dir", "category").agg(F.count("*").alias("n"))
    return counts.groupBy("source_dir").agg(F.min(F.struct((-F.col("n")).alias("m"), "category")).alias("best")).select("source_dir", F.col("best.category").alias("category"), (-F.col("best.m")).alias("files"))


def tokens_per_second(output: Column, first: Column, total: Column) -> Column:
    """Null under a twentieth of a second or without times."""
    took = total - first
    return F.when(took >= 0.05, output / took)


def quality_at(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """Recall at 10, mean reciprocal rank at 10, and latency percentiles, from the first right result's rank (null if none)."""
    hit = F.col(rank) <= 10
    return ranks.agg(
        F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("recall_at_10"),
        F.round(F.avg(F.when(hit, F.lit(1.0) / F.col(rank)).otherwise(0.0)), 6).alias("mrr_at_10"),
    )
