"""Ranking, paging, de-duplication and retention of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(rows: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """1-based rank within the keys; order should be total."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key: by an aggregate that combines before it shuffles, not by a sort of each group."""
    columns = rows.columns
    sort = F.struct(*order).alias("o")
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), sort).alias("r"))
    return best.select(*(F.col(f"r.{c}").alias(c) for c in columns))


def newest_kept(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key; Spark drops the rest of a partition before the shuffle."""
    return ranked(rows, keys, order, "_rank").where(F.col("_rank") <= n).drop("_rank")


def page_before(rows: DataFrame, id_: str, before: int | None, limit: int) -> DataFrame:
    """The last limit rows below an id, oldest first, each with whether there are earlier ones."""
    chosen = rows if before is None else rows.where(F.col(id_) < before)
    some = chosen.orderBy(F.desc(id_)).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(F.desc(id_)))
    n = F.count("*").over(Window.partitionBy())
    return some.withColumns({"_place": place, "has_earlier": n > limit}).where(F.col("_place") <= limit).drop("_place").orderBy(id_)


def offset_page(rows: DataFrame, order: list, offset: int, limit: int = 20, most: int = 200) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))


def fitting_suffix(rows: DataFrame, keys: list[str], newest_first: list, cost: Column, budget: int) -> DataFrame:
    """Of each key, the newest rows whose costs together fit the budget."""
    running = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running_cost", running).where(F.col("running_cost") <= budget)


def split_candidates(hits: DataFrame, query: str, order: list, most: int) -> DataFrame:
    """lane: rerank for the first chunk of a file with text, up to most of them in a query; else tail."""
    first = ranked(hits, [query, "file_id"], order, "_in_file")
    fit = (F.col("_in_file") == 1) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    count = F.sum(fit.cast("int")).over(Window.partitionBy(query).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("lane", F.when(fit & (count <= most), "rerank").otherwise("tail")).drop("_in_file")


def collision_names(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """moves (id, folder, stem, ext) with a name that no other has: 'stem (2).ext' and so on.

    A move's number counts the moves of its folder and name before it and whether a file is there.
    """
    taken = existing.select("folder", "stem", "ext").distinct().withColumn("there", F.lit(1))
    place = F.row_number().over(Window.partitionBy("folder", "stem", "ext").orderBy("id"))
    out = moves.join(taken, ["folder", "stem", "ext"], "left").withColumn("_n", place + F.coalesce("there", F.lit(0)))
    numbered = F.when(F.col("_n") > 1, F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise("")
    return out.withColumn("name", F.concat("stem", numbered, F.lit("."), "ext")).drop("_n", "there")


def placed(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first limit rows with their place; places are counted over these only."""
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def planned_order(planned: str) -> list:
    """newest, oldest, largest or smallest first."""
    column = F.col("mtime" if planned in ("newest", "oldest") else "size")
    return [column.desc() if planned in ("newest", "largest") else column.asc(), F.col("id")]
