"""Exact duplicates by two-pass Bloom filtering, with DataFrame functions only.

Texts are equal when identical after replacing each run of ASCII white space by one space;
null counts as empty. Pass one turns each text's hash into two cells of a filter of a bounded
number of cells, counts the cells (summed before they shuffle; texts never do) and keeps those
hit at least twice, 64 to a word. Pass two tests every row against these words, which are
broadcast: a row with a cell that was hit once has no equal and passes straight through. Only
the others shuffle, and are grouped by the whole SHA-256. A full filter lets more rows through
to the grouping, but never changes a result.

Of equal texts the row with the smallest id stays. Rows that repeat an id and its text all name
that id as the one that stays and count in the group's size; keep_first returns one of them.
Null ids sort last; a group of null ids only has a null keep_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import filter_size, join_by_hot_key
from lectern.session import cut


def digest(text: Column) -> Column:
    """SHA-256 of the text with its white space evened out."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "), 256)


def _cells(sha: Column, n: int) -> list[Column]:
    return [F.xxhash64(sha, F.lit(k)).bitwiseAND(F.lit(n - 1)) for k in (1, 2)]


def repeated_cells(rows: DataFrame, sha: str, cells: int) -> DataFrame:
    """(word, bits): the cells that at least two rows hit, at most cells / 64 rows."""
    hits = rows.select(F.explode(F.array(*_cells(F.col(sha), cells))).alias("cell")).groupBy("cell").agg(F.count("*").alias("hits"))
    return hits.where("hits > 1").groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits"))


def mark_possible(rows: DataFrame, sha: str, filter_words: DataFrame, cells: int) -> DataFrame:
    """rows with column _possible: false where no other row can be equal."""
    columns = rows.columns
    for k, cell in enumerate(_cells(F.col(sha), cells)):
        words = filter_words.select(F.col("word").alias(f"_word{k}"), F.col("bits").alias(f"_bits{k}"))
        rows = rows.withColumn(f"_cell{k}", cell).join(F.broadcast(words), F.shiftright(f"_cell{k}", 6) == F.col(f"_word{k}"), "left")
    hit = [F.expr(f"coalesce(shiftright(_bits{k}, cast(_cell{k} & 63 as int)) & 1, 0) = 1") for k in (0, 1)]
    return rows.select(*columns, (hit[0] & hit[1]).alias("_possible"))


def _decide(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("text_sha256")))
    cells = filter_size(rows.count())
    words = cut(repeated_cells(rows, "text_sha256", cells))
    marked = mark_possible(rows, "text_sha256", words, cells)
    again = marked.where("_possible").drop("_possible")
    groups = again.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.count("*").alias("n"))
    grouped = join_by_hot_key(again, groups, "text_sha256", "n", rows.count())
    once = marked.where("not _possible").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return once.unionByName(grouped), words, cells


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs."""
    decided, _, _ = _decide(docs, doc_id, text)
    return decided.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; rows that cannot have an equal don't shuffle."""
    decided, words, cells = _decide(docs, doc_id, text)
    stay = decided.where("group_size = 1 or doc_id <=> keep_id").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_stays")).distinct()
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_doc"), digest(F.col(text)).alias("_sha"))
    marked = mark_possible(whole, "_sha", words, cells)
    chosen = marked.where("_possible").join(stay, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_stays")), "left_semi").dropDuplicates(["_doc", "_sha"])
    return marked.where("not _possible").select("_row.*").unionByName(chosen.select("_row.*"))
