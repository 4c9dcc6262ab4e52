"""Filter interaction audit: what five filters remove in each of their orders, for each part of a corpus.

A document fails A with too few words, B with too few distinct ones, C with too many capitals, D
with one of certain signs, and E if its text is identical to that of a smaller doc_id anywhere in the table.

E is an existential self-join. One scan makes thin rows: id, part, hash of the text and the other failures.
Only texts whose hash may occur again (a filter of hashes, broadcast) shuffle: their distinct texts with the smallest
doc_id on one side, the rows on the other, joined left-semi on hash, exact text and smaller doc_id. Rows of a
frequent hash are dealt to several tasks, and its texts go to each of these. E's ids, united with
the other failure ids, are then aggregated to bits by row and to counts by combination of bits, of which a part has
at most 128. All orders, steps and shares follow from these counts.

Parts are the values of a column; null counts as an empty string. Null texts are empty texts: they fail A, and
E after a smaller id's. Null ids can't be compared: they never fail E, and have no label. Rows that repeat an id count each,
and don't fail E for each other. Of labels the largest value for an id counts. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import with_column_of_arrays
from lectern.llm.components import HOT_SHARE, sieved
from lectern.llm.quality_rules import words
from lectern.session import cut

FILTERS = "ABCDE"
_BIT = {f: 1 << k for k, f in enumerate(FILTERS)}


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, hash, bits): a row for each of docs, bits of those of A to D that it fails."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), t.alias("_text"))
    rows = with_column_of_arrays(rows, "_words", words(F.col("_text")))
    n, t = F.size("_words"), F.col("_text")
    fails = {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct("_words")) < 50 * n,
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > 3 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }
    bits = sum((F.when(c, _BIT[f]).otherwise(0) for f, c in fails.items()), F.lit(0))
    return rows.select("doc_id", "part", F.xxhash64("_text").alias("hash"), bits.alias("bits"))


def repeats(docs: DataFrame, thin: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, hash) of the rows whose text a smaller doc_id has; thin: failures of docs, cut."""
    total = thin.count()
    often = cut(thin.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = sieved(rows.withColumn("hash", F.xxhash64("_text")), often, "hash", often.count()).where("_in").drop("_in").where("doc_id is not null")
    # fewer than 1 / HOT_SHARE hashes are hot; their rows are dealt to so many tasks that none gets more than that share
    least = max(1.0, total * HOT_SHARE)
    hot = F.broadcast(often.where(F.col("n") > least).select("hash", F.ceil(F.col("n") / least).cast("int").alias("_parts")))
    first = rows.groupBy("hash", "_text").agg(F.min("doc_id").alias("_first")).join(hot, "hash", "left")
    first = first.select("hash", "_text", "_first", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_task"))
    later = rows.join(hot, "hash", "left").withColumn("_task", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    a, b = later.alias("a"), first.alias("b")
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a._task") == F.col("b._task")) & (F.col("a._text") == F.col("b._text"))
    return a.join(b, same & (F.col("b._first") < F.col("a.doc_id")), "left_semi").select("doc_id", "part", "hash")


def combinations(thin: DataFrame, again: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, good, toxic, n): documents that fail something, by all that they fail and their labels."""
    others = thin.where("bits > 0").withColumn("rows", F.lit(1))
    both = others.unionByName(again.select("*", F.lit(_BIT["E"]).alias("bits"), F.lit(0).alias("rows")))
    # rows that repeat an id and its text fail alike, so that as many come from either side
    n = F.greatest(F.sum("rows"), F.count("*") - F.sum("rows"))
    failed = both.groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), n.alias("n"))
    truth = labels.where("doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    marked = failed.join(truth, "doc_id", "left")
    return marked.groupBy("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row
    for each part, order of the filters and step; labels: (doc_id, quality, toxic)."""
    thin = cut(failures(docs, doc_id, text, part))
    counts = combinations(thin, repeats(docs, thin, doc_id, text, part), labels)
    totals = thin.groupBy("part").agg(F.count("*").alias("total"))
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "good", "toxic", "n")).alias("combos"))
    parts = totals.join(by_part, "part", "left").select("part", "total", F.coalesce("combos", F.array().cast("array<struct<bits:int,good:boolean,toxic:boolean,n:bigint>>")).alias("combos"))
    orders = F.split(F.lit(",".join("".join(o) for o in permutations(FILTERS))), ",")
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda c: F.element_at(F.create_map(*(F.lit(x) for kv in _BIT.items() for x in kv)), c)
    letters = F.split("filter_order", "")
    before = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda s, c: s.bitwiseOR(bit(c)))
    steps = steps.withColumns({"_filter": F.get(letters, F.col("step") - 1), "_before": before}).withColumn("_bit", bit(F.col("_filter")))

    def count(cond) -> Column:
        return F.aggregate(F.filter("combos", cond), F.lit(0).cast("long"), lambda s, c: s + c["n"])

    fails = lambda c: c["bits"].bitwiseAND(F.col("_bit")) > 0
    gone = lambda c: c["bits"].bitwiseAND(F.col("_before")) > 0
    out = steps.select(
        "part", "filter_order", "step", "_filter",
        (F.col("total") - count(lambda c: fails(c) | gone(c))).alias("kept"),
        count(lambda c: fails(c) & ~gone(c)).alias("removed"),
        count(lambda c: fails(c) & gone(c)).alias("redundant"),
        count(lambda c: c["bits"] == F.col("_bit")).alias("unique_fails"),
        count(lambda c: fails(c) & ~gone(c) & c["good"]).alias("good_lost"),
        count(lambda c: fails(c) & ~gone(c) & c["toxic"]).alias("toxic_lost"),
    )
    # 120 rows of a part have the filter
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_filter"))).drop("_filter")
