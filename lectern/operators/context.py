"""Bounded evidence and history for grounded answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions.text import citations, token_estimate
from lectern.operators.chunking import tokens
from lectern.operators.rows import newest_kept
from lectern.operators.slices import ROWS, of_strings

#: Bounds of a question's evidence.
PARENTS, CHARACTERS, EXCERPT, PER_FILE = 8, 20_000, 2_800, 4


def evidence(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, place, file_id, parent_idx, label, excerpt): at most PARENTS parents of a query's hits (query,
    file_id, parent_idx, score, text), PER_FILE of a file, excerpts cut to what is left of CHARACTERS.

    Each query's candidates are first cut to the PARENTS x PER_FILE best, so that a group stays small.
    """
    order = [F.desc("score"), "file_id", "parent_idx"]
    per_file = newest_kept(hits.dropDuplicates([query, "file_id", "parent_idx"]), [query, "file_id"], order, PER_FILE)
    few = newest_kept(per_file, [query], order, PARENTS)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        left, numbers, out = CHARACTERS, {}, []
        for r in rows.sort_values(["score", "file_id", "parent_idx"], ascending=[False, True, True]).itertuples():
            text = r.text.strip()[: min(EXCERPT, left)]
            if not text:
                continue
            left -= len(text)
            number = numbers.setdefault(r.file_id, len(numbers) + 1)
            out.append((getattr(r, query), len(out) + 1, r.file_id, r.parent_idx, f"[F{number}:P{r.parent_idx}]", text))
        return pd.DataFrame(out, columns=[query, "place", "file_id", "parent_idx", "label", "excerpt"])

    return few.select(query, "file_id", "parent_idx", "score", "text").groupBy(query).applyInPandas(fold, f"{query} long, place int, file_id long, parent_idx int, label string, excerpt string")


def checked_citations(answers: DataFrame, answer: str, allowed: str) -> DataFrame:
    """answers with the marks that its evidence has (cited) and those that it hasn't (unknown)."""
    found = citations(F.col(answer))
    return answers.withColumns({"cited": F.array_intersect(found, F.col(allowed)), "unknown": F.array_except(found, F.col(allowed))})


def history_budget(window: int, thinking: bool = False) -> dict[str, int]:
    """How many tokens of a model's window go to the answer, to safety and to what is sent."""
    window = max(window, 2048)
    reserve = max(512, min(4096, window // 4))
    if thinking:
        reserve = max(reserve, min(2048, window // 3))
    safety = max(128, window // 10)
    return {"window": window, "reserve": reserve, "safety": safety, "input": max(512, window - reserve - safety)}


#: Most tokens of a batch and divisor of the window, by place and task.
BATCHES = {
    ("local", "translate"): (4096, 8), ("local", "summarise"): (12000, 4), ("local", "both"): (3072, 10),
    ("cloud", "translate"): (16000, 6), ("cloud", "summarise"): (24000, 3), ("cloud", "both"): (10000, 7),
}


def batch_budget(place: str, task: str, window: int) -> int:
    most, divisor = BATCHES[place, task]
    return max(1024, min(most, window // divisor))


def batched(units: DataFrame, group: str, order: str, text: str, most: int) -> DataFrame:
    """units with batch: consecutive units of a group, as many as fit the tokens; one that is larger has its own.

    Groups are dealt to tasks, sorted there and folded in one pass over Arrow batches, without a Python call for each group.
    """
    names = units.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, batch, held = None, 1, 0
        for rows in batches:
            out = []
            for at in range(0, rows.num_rows, ROWS):
                some = rows.slice(at, ROWS)
                for g, t in zip(some.column("_group").to_pylist(), some.column("_text").to_pylist()):
                    cost = tokens(t)
                    if (g,) != own:
                        own, batch, held = (g,), 1, 0
                    elif held and held + cost > most:
                        batch, held = batch + 1, 0
                    held += cost
                    out.append(batch)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(out, pa.int32())], names=[*names, "batch"])

    dealt = units.select("*", F.col(group).alias("_group"), F.col(text).alias("_text")).repartition(group).sortWithinPartitions(group, F.asc_nulls_last(order))
    return dealt.mapInArrow(fold, T.StructType([*units.schema.fields, T.StructField("batch", T.IntegerType())]))


def truncated(text: Column, most: int) -> Column:
    """The longest beginning of the text that fits the tokens with an ellipsis."""
    return of_strings(lambda t: None if t is None else _fit(t, most), text)


def _fit(text: str, most: int) -> str:
    if tokens(text) <= most:
        return text
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if tokens(text[:mid].rstrip() + "…") <= most else (low, mid - 1)
    return text[:low].rstrip() + "…"


def deterministic_sections(sections: DataFrame, terms: list[str], most: int = 4) -> DataFrame:
    """Each query's best sections (query_id, file_id, parent_idx, seed_rank, text, kind): 100 less the seed's rank,
    8 for each term, 1 for a table."""
    low = F.lower("text")
    score = F.when(F.col("seed_rank").isNotNull(), 100 - F.least("seed_rank", F.lit(50))).otherwise(0)
    for t in terms:
        score = score + F.when(F.contains(low, F.lit(t.lower())), 8).otherwise(0)
    score = score + F.when(F.col("kind") == "table", 1).otherwise(0)
    return newest_kept(sections.withColumn("score", score).where("score > 0"), ["query_id"], [F.desc("score"), "file_id", "parent_idx"], most)


def with_neighbours(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """(query_id, file_id, chunk_idx, how): hits (query_id, file_id, chunk_idx) and the chunks beside them: hit or near."""
    around = hits.select("query_id", "file_id", "chunk_idx", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("d"))
    places = around.select("query_id", "file_id", (F.col("chunk_idx") + F.col("d")).alias("chunk_idx"), F.abs("d").alias("d")).groupBy("query_id", "file_id", "chunk_idx").agg(F.min("d").alias("d"))
    return chunks.join(places, ["file_id", "chunk_idx"]).select("query_id", "file_id", "chunk_idx", F.when(F.col("d") == 0, "hit").otherwise("near").alias("how"))


#: Wordings that ask for more than one place of a document.
REASONING = ("compare", "why", "relationship", "across", "overall")


def inspects_tree(question: Column, seeds: Column) -> Column:
    """Whether a question's sections are looked at: by wording, 24 tokens, or 10 tokens and three seed parents."""
    n = token_estimate(question)
    return F.lower(question).rlike("|".join(REASONING)) | (n >= 24) | ((n >= 10) & (seeds >= 3))


def candidate_sections(sections: DataFrame, terms: tuple[str, ...], most: int = 72, per_file: int = 12) -> DataFrame:
    """At most so many sections (file_id, parent_idx, page_start, path, seed): seeds (why 0), then those whose path has a
    term (1), then the first of each file (2), then others at even steps (3)."""
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.asc_nulls_last("page_start"), "parent_idx"))
    named = F.lit(False)
    for t in terms:
        named = named | F.contains(F.lower("path"), F.lit(t.lower()))
    why = F.when(F.col("seed"), 0).when(named, 1).when(F.col("_place") <= per_file, 2).otherwise(3)
    marked = sections.withColumn("_place", place).withColumn("why", why)
    first = marked.where("why < 3").orderBy("why", "file_id", "_place").limit(most)
    rest = marked.where("why = 3").orderBy(F.xxhash64("file_id", "parent_idx"), "file_id", "parent_idx").limit(most)
    both = first.unionByName(rest).orderBy("why", "file_id", "_place").limit(most)
    return both.drop("_place")


def document_route(tokens: Column, window: int, translate: bool) -> Column:
    """direct if the whole document and its answer fit the window, else map_reduce; retrieval without any text."""
    window = max(2048, window)
    answer = F.greatest(F.lit(1024), F.floor(tokens * 6 / 5)) if translate else F.greatest(F.lit(2048), F.least(F.lit(8192), F.floor(tokens / 4)))
    fits = (tokens <= min(32_000, max(4096, window // 4))) & (tokens + answer + 2048 <= window * 7 // 10)
    return F.when(tokens <= 0, "retrieval").when(fits, "direct").otherwise("map_reduce")


def map_coverage(units: DataFrame, answers: DataFrame, key: str, unit: str) -> DataFrame:
    """(key, units, done, complete): how many units of a document have an answer."""
    done = answers.select(key, unit).distinct().withColumn("_done", F.lit(1))
    return units.join(done, [key, unit], "left").groupBy(key).agg(F.count("*").alias("units"), F.count("_done").alias("done"), (F.count("*") == F.count("_done")).alias("complete"))


def tree_hits(chosen: DataFrame, further: DataFrame, seeds: DataFrame) -> DataFrame:
    """(file_id, unit, place, score): chosen sections (score 1), further ones (0.99), then seeds with their own score, each unit once."""
    parts = [chosen.select("file_id", "unit", F.lit(0).alias("src"), F.lit(1.0).alias("score")), further.select("file_id", "unit", F.lit(1).alias("src"), F.lit(0.99).alias("score")), seeds.select("file_id", "unit", F.lit(2).alias("src"), "score")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("file_id", "unit").agg(F.min(F.struct("src", "score")).alias("best"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("best.src", "unit"))
    return both.select("file_id", "unit", place.alias("place"), F.col("best.score").alias("score"))


def rendered(units: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text): a document's units (key, order, label, text) in order, each under its label."""
    one = F.concat(F.lit("["), F.col(order).cast("string"), F.lit(" | "), "label", F.lit("]\n"), "text")
    return units.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("t")))).alias("l")).select(key, F.array_join("l.t", "\n\n").alias("text"))


def final_document(units: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text): the answers of a document's units in order, and how many of them there are."""
    listed = units.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))).alias("l"), F.count("*").cast("string").alias("n"))
    return listed.select(key, F.concat(F.array_join("l.t", "\n\n"), F.lit("\n\n# Coverage\n\n"), "n", F.lit(" of "), "n").alias("text"))


def recovered_ids(answers: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """(key, unit, place): the unit of each answer (key, answer_id, place): by its id, case and space aside; where the document
    has as many answers as units (key, unit, place), otherwise by its place. Other answers go."""
    clean = answers.withColumn("_id", F.lower(F.trim("answer_id")))
    named = units.select(key, F.lower(F.trim("unit")).alias("_id"), F.col("unit").alias("_named"))
    placed = units.select(key, "place", F.col("unit").alias("_placed"))
    sizes = answers.groupBy(key).agg(F.count("*").alias("_a")).join(units.groupBy(key).agg(F.count("*").alias("_u")), key)
    found = clean.join(named, [key, "_id"], "left").join(sizes.where("_a = _u").select(key, F.lit(True).alias("_as_many")), key, "left").join(placed, [key, "place"], "left")
    unit = F.coalesce("_named", F.when(F.col("_as_many"), F.col("_placed")))
    return found.select(key, unit.alias("unit"), "place").where("unit IS NOT NULL").groupBy(key, "unit").agg(F.min("place").alias("place"))


def fallback_answers(hits: DataFrame, query: str, most: int = 5) -> DataFrame:
    """(query, answer): the names of each query's best hits (query, name, score, id), a line each."""
    best = newest_kept(hits, [query], [F.desc("score"), "id"], most)
    listed = best.groupBy(query).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "name"))).alias("l"))
    return listed.select(query, F.array_join(F.transform("l.name", lambda n: F.concat(F.lit("- "), n)), "\n").alias("answer"))


#: Tokens of models' windows, by what their names hold or begin with.
WINDOWS = (("claude", 200_000), ("gpt-4.1", 1_047_576), ("gpt-5", 400_000), ("gpt-4o", 128_000), ("^o[134]", 200_000), ("gpt-4-turbo", 128_000), ("gpt-3.5", 16_385))


def window_of(model: Column, otherwise: int = 32_768) -> Column:
    low = F.lower(model)
    return F.coalesce(*(F.when(low.rlike(p.replace(".", "\\.")), F.lit(n)) for p, n in WINDOWS), F.lit(otherwise))

