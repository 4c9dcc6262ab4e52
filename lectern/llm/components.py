"""Connected components and skew-safe joins by DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import cut

#: A key is hot when more than this share of the rows has it; so fewer than 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 500
#: The most cells that a filter of keys may have: 1 Mi words of 64 cells, 16 MB of longs.
MOST_CELLS = 1 << 26
#: Rows of one key that stay in one task, where rows are dealt with a long value each.
DEALT = 256
#: Members of a large bucket that meet all others at once.
BLOCK = 512
#: Links that are contracted together in a task.
LOT = 1 << 17


def join_by_hot_key(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join, inner or left, of rows with groups, which has one row for each key and, in size, how many of the rows have it.

    Hot keys, fewer than 1 / HOT_SHARE of them by the pigeonhole rule, are broadcast, so that
    none of their rows shuffle; the others are joined by a shuffle. rows should be cheap to
    read twice. total: the number of rows. An inner join leaves rows with a null key out.
    """
    least = max(1.0, total * HOT_SHARE)
    values = [c for c in groups.columns if c not in (key, size)]
    hot = groups.where(F.col(size) > least).select(key, F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    at_once = marked.where(F.col("_hot").isNotNull()).select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in values))
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(groups.where(F.col(size) <= least).drop(size), key, how)
    return at_once.unionByName(rest.select(*rows.columns, *values))


def filter_size(n: int, each: int = 16) -> int:
    """Cells of a filter for n keys: a power of two, at most MOST_CELLS."""
    return min(MOST_CELLS, max(1 << 12, 1 << (each * max(1, n) - 1).bit_length()))


def sieved(rows: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """rows with column _in: false where key, a long, is surely none of keys; n: how many keys there are.

    The filter of at most MOST_CELLS cells is broadcast; no row shuffles.
    """
    cells = filter_size(n, 4)
    mixed = lambda c: F.xxhash64(c).bitwiseAND(F.lit(cells - 1))
    words = keys.select(mixed(F.col(key)).alias("_cell")).groupBy(F.shiftright("_cell", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_cell & 63 as int)))").alias("_bits"))
    columns = rows.columns
    marked = rows.withColumn("_at", mixed(F.col(key))).join(F.broadcast(words), F.shiftright("_at", 6) == F.col("_word"), "left")
    return marked.select(*columns, F.expr("coalesce(shiftright(_bits, cast(_at & 63 as int)) & 1, 0) = 1").alias("_in"))


def only_keys(rows: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """The rows whose key is among keys, distinct ones, n of them: few others reach the join."""
    return sieved(rows, keys, key, n).where("_in").drop("_in").join(keys.select(key), key, "left_semi")


def one_of_each(rows: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """A row for each of keys that rows has: copies go before the shuffle, so that a frequent key costs no task more."""
    return sieved(rows, keys, key, n).where("_in").drop("_in").dropDuplicates([key]).join(keys.select(key), key, "left_semi")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From links (u, v), a LOT at once, to links of each node to the smallest one that it reaches by them."""

    def contracted(lot: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (pa.chunked_array([b.column(i) for b in lot]).to_numpy() for i in (0, 1))
        nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        parent = list(range(len(nodes)))
        for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist()):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[max(a, b)] = min(a, b)
        for i, p in enumerate(parent):  # a parent is smaller than its node
            parent[i] = parent[p]
        root = np.array(parent, np.int64)
        moved = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(x, lot[0].schema.types[0]) for x in (nodes[moved], nodes[root[moved]])], names=["u", "v"])

    lot, n = [], 0
    for batch in batches:
        lot.append(batch)
        n += batch.num_rows
        if n >= LOT:
            yield contracted(lot)
            lot, n = [], 0
    if n:
        yield contracted(lot)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link to another: the smallest node reachable.

    Links are contracted by a LOT within tasks; if there are several lots, large-star and small-star steps
    follow in turn until nothing changes. Each round is cut with a checkpoint in the shared folder. Hubs are joined by broadcast, see join_by_hot_key. Null
    ends and links of a node to itself are ignored; repeated links count once.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = cut(edges)
    n = edges.count()
    if n:
        kind = edges.schema["u"].dataType.simpleString()
        edges = cut(edges.coalesce(-(-n // LOT)).mapInArrow(_forest, f"u {kind}, v {kind}"))
    state = None
    for _ in range(max_rounds if n > LOT else 0):
        now = edges.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % 1_000_000_007)).alias("h")).first()
        if now == state or now["n"] == 0:
            break
        state, total = now, now["n"]
        tasks = -(-total // LOT)
        # large star: each larger neighbour of a node is linked to the node's smallest one
        lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
        degree = edges.groupBy("v").agg(F.count("*").alias("n"))
        moved = degree.join(lowest, degree["v"] == lowest["u"], "left").select("v", "n", F.coalesce("m", "v").alias("m"))
        large = cut(join_by_hot_key(edges, moved, "v", "n", total).select("u", F.col("m").alias("v")).distinct().coalesce(tasks))
        # small star: each smaller neighbour of a node, and the node, are linked to the smallest one
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        around = join_by_hot_key(large, lowest, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(around.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
    else:
        if n > LOT:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def size_reaches(a: Column, b: Column, similarity: float = 0.8) -> Column:
    """Whether sets of these sizes, in the field size, can have the similarity."""
    return F.least(a["size"], b["size"]) >= F.greatest(a["size"], b["size"]) * (similarity - 1e-9)


def links_within_buckets(members: DataFrame, compare: Callable[[DataFrame], DataFrame], reach: Callable[[Column, Column], Column] = size_reaches, paired: int = 64, reps: int = 8, more: DataFrame | None = None, marks: DataFrame | Callable[[DataFrame, int], DataFrame] | None = None, alike: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(a, b): links that join all members of a bucket that can be reached by pairs which compare accepts.

    members: (bucket, key, own), keys distinct within a bucket; own: a struct that follows from bucket and
    key, by which reach rules out pairs at once; a column members, if there is one, has the size of the bucket. compare: of pairs (a, b) those that are linked.
    more: candidates (a, b) by another method, with a < b, that are compared with the first.
    marks: (key, mark), by whose marks alike rules out more pairs of large buckets; keys may repeat with equal marks. Or what makes
    them, once each, of keys (key) and their number.
    Buckets of at most paired members are compared in pairs. In a larger one, reps members are
    compared with all others; then, with the components so far of large buckets' members, each member outside the bucket's
    largest component with all members of other components. So of two members that end in
    different components at least one was compared with the other, or ruled out: nothing is lost.
    Members meet in arrays of BLOCK, and only pairs that no rule excludes become rows.
    """
    sized = members = cut(members)
    if "members" not in members.columns:
        counted = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        sized = join_by_hot_key(members, counted.select("bucket", "n", F.col("n").alias("members")), "bucket", "n", max(1, members.count()))
    few = sized.where(F.col("members") <= paired)
    a, b = (few.select("bucket", F.col("key").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")
    pairs = a.join(b, (a["bucket"] == b["bucket"]) & (F.col("a") < F.col("b")) & reach(F.col("own_a"), F.col("own_b"))).select("a", "b")
    pairs = pairs if more is None else pairs.unionByName(more)
    many = cut(sized.where(F.col("members") > paired).select("bucket", "key", "own", F.col("key").alias("component")))
    total = many.count()
    if total == 0:
        return cut(compare(cut(pairs.distinct())))
    mark = F.lit(None).alias("mark")
    sizes = cut(many.groupBy("bucket").agg(F.count("*").alias("n")))
    among = cut(many.select("key").distinct())
    n_among = among.count()
    if marks is not None:
        made = marks(among, n_among) if callable(marks) else one_of_each(marks, among, "key", n_among)
        many, mark = cut(many.join(made, "key")), F.col("mark")
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("key"), "key")
    ranked = lambda rows: rows.select("bucket", "key", "own", mark, "component", F.row_number().over(order).alias("rank"))

    def met(chosen: DataFrame, parts: DataFrame) -> DataFrame:
        """(a, b): members of parts (bucket, n) with those chosen of their bucket; a BLOCK of a bucket at once, hot buckets' rows don't shuffle."""
        rep = F.struct(F.col("key").alias("rep"), F.col("own").alias("rep_own"), F.col("mark").alias("rep_mark"), F.col("component").alias("part"))
        blocks = chosen.groupBy("bucket", F.floor((F.col("rank") - 1) / BLOCK).alias("block")).agg(F.collect_list(rep).alias("reps"))
        dealt = many.sparkSession.createDataFrame([], "a long, b long")
        for block in range(-(-(chosen.agg(F.max("rank")).first()[0] or 0) // BLOCK)):
            some = cut(blocks.where(F.col("block") == block).join(parts.select("bucket", "n"), "bucket").select("bucket", "n", "reps"))
            rows = join_by_hot_key(many, some, "bucket", "n", total)

            def wanted(r: Column) -> Column:
                near = (F.col("component") != r["part"]) & reach(F.col("own"), r["rep_own"])
                return near & alike(F.col("mark"), r["rep_mark"]) if alike is not None else near

            found = rows.select("key", F.explode(F.transform(F.filter("reps", wanted), lambda r: r["rep"])).alias("rep"))
            dealt = dealt.unionByName(cut(found.select(F.least("key", "rep").alias("a"), F.greatest("key", "rep").alias("b")).distinct()))
        return dealt

    taken = cut(ranked(many).where(F.col("rank") <= reps))
    links = cut(compare(cut(pairs.unionByName(met(taken, sizes)).distinct())))
    within = links
    for end in "ab":
        within = only_keys(within, among.withColumnRenamed("key", end), end, n_among)
    counted = many.drop("component").join(connected_components(within).withColumnRenamed("node", "key"), "key", "left")
    many = cut(counted.withColumn("component", F.coalesce("component", "key")))
    shares = many.groupBy("bucket", "component").agg(F.count("*").alias("share"))
    parts = shares.groupBy("bucket").agg(F.max_by("component", F.struct("share", "component")).alias("largest"), F.sum("share").alias("n"), F.count("*").alias("parts"))
    parts = cut(parts.where("parts > 1").select("bucket", "largest", "n"))
    left = join_by_hot_key(many, parts, "bucket", "n", total).where("component <> largest").join(taken.select("bucket", "key"), ["bucket", "key"], "left_anti")
    rest = cut(met(cut(ranked(left)), parts).distinct())
    return links if rest.isEmpty() else links.unionByName(cut(compare(rest)))


def with_texts(pairs: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """pairs (a, b) with text_a and text_b from texts (key, text), in which keys are distinct.

    The end that more pairs have becomes a. Its text goes to every task that has pairs of it, and
    no more than DEALT pairs of it go to one; the text of b goes with the pair.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    n_a, n_b = (ends.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    counted = pairs.join(n_a, "a").join(n_b, "b")
    swap = F.col("n_b") > F.col("n_a")
    dealt = counted.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("n_a", "n_b").alias("n"))
    dealt = dealt.withColumn("parts", F.ceil(F.col("n") / DEALT).cast("long"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    there = dealt.groupBy("a").agg(F.max("parts").alias("parts"))
    text_b = dealt.select("a", "b", "part").join(texts.select(F.col("key").alias("b"), F.col(text).alias("text_b")), "b")
    text_a = texts.select(F.col("key").alias("a"), F.col(text).alias("text_a")).join(there, "a")
    text_a = text_a.select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return text_b.join(text_a, ["a", "part"]).select("a", "b", "text_a", "text_b")
