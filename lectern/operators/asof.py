"""As-of joins, and summaries that can be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(events: DataFrame, states: DataFrame, key: str, at: str, values: tuple[str, ...], seconds: int = 3600) -> DataFrame:
    """events with the values of their key's latest state at or before them; null where there is none.

    Both sides are united and carried forward within a key and an interval of so many seconds, so that a key of
    many rows is dealt to as many tasks as it has intervals. What an interval begins with is carried over the intervals' last
    states, one row for each key and interval, and meets the events by key and interval. Of states at the same time the
    one with the greatest values counts. Null keys and times of events have no state; states without either are left out.
    """
    value = F.struct(*values)
    slot = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000))
    e = events.withColumns({"_slot": slot, "_state": F.lit(None).cast(states.select(value.alias("v")).schema["v"].dataType), "_side": F.lit(1)})
    s = states.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.max(value).alias("_state")).withColumns({"_slot": slot, "_side": F.lit(0)})
    both = e.unionByName(s, allowMissingColumns=True)
    within = Window.partitionBy(key, "_slot").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("_own", F.last("_state", ignorenulls=True).over(within)).where("_side = 1").drop("_state", "_side")
    ends = s.groupBy(key, "_slot").agg(F.max_by("_state", at).alias("_end"))
    slots = ends.unionByName(e.where(F.col(key).isNotNull()).select(key, "_slot").distinct(), allowMissingColumns=True).groupBy(key, "_slot").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = slots.select(key, "_slot", F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    joined = own.join(begins, [key, "_slot"], "left")
    found = F.when(F.col(key).isNotNull() & F.col(at).isNotNull(), F.coalesce("_own", "_begin"))
    return joined.withColumn("_found", found).select(*events.columns, *(F.col(f"_found.{v}").alias(v) for v in values))


def sketches(rows: DataFrame, groups: dict[str, Column], distinct: str, amount: str, lg: int = 12) -> DataFrame:
    """(groups, users, amounts, n): for each group a HyperLogLog sketch of distinct values and a KLL sketch of amounts, to be stored."""
    return rows.groupBy(*(c.alias(name) for name, c in groups.items())).agg(F.hll_sketch_agg(distinct, lg).alias("users"), F.expr(f"kll_sketch_agg_double(cast({amount} AS double))").alias("amounts"), F.count("*").alias("n"))


def merged_sketches(stored: DataFrame, groups: list[str], quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(groups, users, q50, q90, n) of any range of stored sketches, without reading what they were made of."""
    merged = stored.groupBy(*groups).agg(F.hll_union_agg("users").alias("_users"), F.expr("kll_merge_agg_double(amounts)").alias("_amounts"), F.sum("n").alias("n"))
    q = [F.expr(f"kll_sketch_get_quantile_double(_amounts, {p}D)").alias(f"q{round(p * 100)}") for p in quantiles]
    return merged.select(*groups, F.hll_sketch_estimate("_users").alias("users"), *q, "n")
