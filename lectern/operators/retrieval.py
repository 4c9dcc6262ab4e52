"""Lexical, chunk, entity and vector retrieval, their fusion and confidence."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import entities
from lectern.functions.vectors import cosine
from lectern.operators.rows import first_of_each

FLOOR, SPAN = 0.38, 0.18
#: Weights of fields in ranking by words, and its two constants.
FIELD_WEIGHTS = {"name": 5, "title": 1, "content_text": 3, "note": 3, "path": 2}
K1, B = 1.2, 0.75


def add(columns: list[Column]) -> Column:
    return functools.reduce(Column.__add__, columns)


def count_terms(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return add([F.contains(low, F.lit(t.lower())).cast("int") for t in terms])


def chunk_lane(chunks: DataFrame, terms: list[str], limit: int = 200, most_terms: int = 8) -> DataFrame:
    """(file_id, chunk_idx, matched, score): chunks with any term, by the number of terms."""
    matched = count_terms(F.concat_ws("\n", "text", "contextual_text"), terms[:most_terms])
    hits = chunks.select("file_id", "chunk_idx", matched.alias("matched")).where("matched > 0")
    score = F.least(F.lit(1.0), F.lit(0.62) + F.lit(0.10) * (F.col("matched") - 1))
    return hits.withColumn("score", F.round(score, 6)).orderBy(F.desc("matched"), "file_id", "chunk_idx").limit(min(400, limit))


def entity_lane(chunks: DataFrame, terms: list[str], limit: int = 200, most_terms: int = 12) -> DataFrame:
    """(file_id, chunk_idx, matched, score): chunks whose entities hold any of the terms."""
    wanted = [t.lower() for t in terms if len(t) >= 3][:most_terms]
    if all(t.isascii() and "\n" not in t for t in wanted):
        # an entity is a part of its text, so that others can't hold such a term
        chunks = chunks.where(count_terms(F.col("text"), wanted) > 0)
    found = chunks.select("file_id", "chunk_idx", F.explode(F.array(F.array_join(entities(F.col("text")), "\n"))).alias("e"))  # once a row
    hits = found.select("file_id", "chunk_idx", count_terms(F.col("e"), wanted).alias("matched")).where("matched > 0")
    score = F.least(F.lit(1.0), F.lit(0.92) + F.lit(0.02) * (F.col("matched") - 1))
    return hits.withColumn("score", F.round(score, 6)).orderBy(F.desc("matched"), "file_id", "chunk_idx").limit(limit)


def keyword_ladder(files: DataFrame, keyword: str, limit: int = 200) -> DataFrame:
    """Files that hold the keyword, by the first stage that has any: a part of the text (three or more
    characters), a word, a part of name, title, note or path. One scan gives each file's best stage."""
    low = keyword.lower()
    meta = F.lower(F.concat_ws("\n", "name", "title", "note", "path"))
    body = F.lower(F.concat_ws("\n", "name", "title", "content_text", "note", "path"))
    stage = (
        F.when(F.contains(body, F.lit(low)) if len(low) >= 3 else F.lit(False), 1)
        .when(F.array_contains(F.split(body, "[^\\p{L}\\p{N}]+"), low), 2)
        .when(F.contains(meta, F.lit(low)), 3)
    )
    hits = files.select("id", stage.alias("stage")).where("stage is not null")
    best = hits.agg(F.min("stage").alias("best"))
    return hits.join(F.broadcast(best), F.col("stage") == F.col("best")).select("id", "stage").orderBy("id").limit(limit)


def inverted(files: DataFrame) -> DataFrame:
    """(word, id, field, tf): the inverted index of all fields, for files of any size."""
    fields = [F.struct(F.lit(f).alias("field"), F.split(F.lower(F.coalesce(f, F.lit(""))), "[^\\p{L}\\p{N}]+").alias("words")) for f in FIELD_WEIGHTS]
    words = files.select("id", F.inline(F.array(*fields))).select("id", "field", F.explode("words").alias("word")).where("word <> ''")
    return words.groupBy("word", "id", "field").agg(F.count("*").alias("tf"))


def bm25(files: DataFrame, terms: list[str], limit: int = 200) -> DataFrame:
    """(id, score): files by BM25 with weighted fields, from one scan for the terms and one for the lengths."""
    wanted = sorted({t.lower() for t in terms})

    def words(f: str) -> Column:
        return F.filter(F.split(F.lower(F.coalesce(f, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")

    # a generator, so that each text is split once, not once for each term
    held = files.select("id", F.inline(F.array(F.struct(*(words(f).alias(f) for f in FIELD_WEIGHTS)))))
    length = add([F.size(f) * w for f, w in FIELD_WEIGHTS.items()])
    tf = {}
    for t in wanted:
        tf[t] = add([_occurrences(f, t) * weight for f, weight in FIELD_WEIGHTS.items()])
    rows = held.select("id", length.alias("length"), *(v.alias(f"tf{i}") for i, v in enumerate(tf.values())))
    total = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    parts = []
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        t = F.col(f"tf{i}")
        parts.append(idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("length") / F.col("mean"))))
    scored = rows.where(add([F.col(f"tf{i}") for i in range(len(wanted))]) > 0).crossJoin(F.broadcast(total))  # one row of totals
    return scored.select("id", F.round(add(parts), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def _occurrences(field: str, term: str) -> Column:
    return F.size(F.filter(field, lambda w: w == F.lit(term)))


def nearest(vectors: DataFrame, query: list[float], k: int, scope: DataFrame | None = None) -> DataFrame:
    """(file_id, chunk_idx, score): the k vectors of the highest cosine; scope: ids of files, none means all."""
    some = vectors if scope is None else vectors.join(scope.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    target = F.lit([float(x) for x in query])
    scored = some.select("file_id", "chunk_idx", F.round(cosine(F.col("embedding"), target), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "file_id", "chunk_idx").limit(k)


def nearest_files(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """Files by their best chunk among the 4 k nearest."""
    return nearest(vectors, query, 4 * k).groupBy("file_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "file_id").limit(k)


def accepted(hits: DataFrame, query: str | None = None, floor: float = FLOOR, span: float = SPAN) -> DataFrame:
    """Hits of a query at least the floor and within span of its best one."""
    best = F.max("score").over(Window.partitionBy(*([query] if query else [])))
    return hits.withColumn("_best", best).where(F.col("score") >= F.greatest(F.lit(floor), F.round(F.col("_best") - span, 6))).drop("_best")


def best_per_file(hits: DataFrame) -> DataFrame:
    """Each file's best hit, the first chunk of equals."""
    return first_of_each(hits, ["file_id"], [-F.col("score"), F.col("chunk_idx")])


def fuse(lexical: DataFrame, semantic: DataFrame, entity: DataFrame, exact: DataFrame, most: int = 400) -> DataFrame:
    """(file_id, lexical_rank, semantic_rank, entity_rank, fused): reciprocal ranks of three lanes, weighted.

    Lanes are (file_id, score); of each the best most files count, so that what is ranked is bounded. They're
    united and grouped, not outer-joined.
    """
    rows = None
    for name, lane in (("lexical", lexical), ("semantic", semantic), ("entity", entity)):
        best = lane.groupBy("file_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "file_id").limit(most)
        order = Window.orderBy(F.desc("score"), "file_id")
        ranked = best.select("file_id", F.lit(name).alias("lane"), "score", F.row_number().over(order).alias("rank"))
        rows = ranked if rows is None else rows.unionByName(ranked)
    rows = rows.unionByName(exact.select("file_id", F.lit("exact").alias("lane"), F.lit(1.0).alias("score"), F.lit(1).alias("rank")))

    def of(lane: str, column: str) -> Column:
        return F.max(F.when(F.col("lane") == lane, F.col(column)))

    grouped = rows.groupBy("file_id").agg(
        *(of(lane, "rank").alias(f"{lane}_rank") for lane in ("lexical", "semantic", "entity", "exact")), of("semantic", "score").alias("semantic_score"), of("lexical", "score").alias("lexical_score")
    )
    parts = [F.coalesce(F.lit(w) / (60 + F.col(f"{lane}_rank")), F.lit(0.0)) for lane, w in (("lexical", 0.36), ("semantic", 0.44), ("entity", 0.20))]
    fused = add(parts) + F.coalesce(0.20 * F.col("semantic_score"), F.lit(0.0)) + F.when(F.col("exact_rank").isNotNull(), 0.10).otherwise(0.0)
    return grouped.withColumn("fused", F.round(fused, 6))


def fuse_questions(lexical: DataFrame, semantic: DataFrame, question: str = "question_id", limit: int = 10, floor: float = FLOOR, span: float = SPAN) -> DataFrame:
    """(question, file_id, lexical_rank, semantic_rank, fused, rank): the best files of each question by the reciprocal
    ranks of two lanes, weighted as in fuse.

    lexical: (question, id, rank) of files; semantic: (question, file_id, chunk_idx, score) of chunks, of which those count that reach the
    floor and lie within span of the question's best; a file ranks by its best chunk. Lanes hold a bounded number of rows for
    each question, so that they're grouped and ranked by question without more.
    """
    near = accepted(semantic, question, floor, span).groupBy(question, "file_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(question).orderBy(F.desc("score"), "file_id")
    near = near.select(question, "file_id", "score", F.row_number().over(order).alias("rank"), F.lit("semantic").alias("lane"))
    words = lexical.select(question, F.col("id").alias("file_id"), F.lit(None).cast("double").alias("score"), "rank", F.lit("lexical").alias("lane"))
    of = lambda lane, c: F.max(F.when(F.col("lane") == lane, F.col(c)))
    both = words.unionByName(near).groupBy(question, "file_id").agg(of("lexical", "rank").alias("lexical_rank"), of("semantic", "rank").alias("semantic_rank"), of("semantic", "score").alias("_score"))
    part = lambda c, w: F.coalesce(F.lit(w) / (60 + F.col(c)), F.lit(0.0))
    fused = F.round(part("lexical_rank", 0.36) + part("semantic_rank", 0.44) + F.coalesce(0.20 * F.col("_score"), F.lit(0.0)), 6)
    best = Window.partitionBy(question).orderBy(F.desc("fused"), "file_id")
    return both.select(question, "file_id", "lexical_rank", "semantic_rank", fused.alias("fused")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def lexical_score(query: str, terms: list[str]) -> tuple[Column, Column]:
    """(score, kind) of a file for a query: the best whole match, then a sum over terms."""
    q = query.lower()
    low = {f: F.lower(F.coalesce(f, F.lit(""))) for f in FIELD_WEIGHTS}
    stem = F.regexp_replace(low["name"], "\\.[^.]*$", "")
    has = {f: F.contains(c, F.lit(q)) for f, c in low.items()}
    whole = F.greatest(
        F.when((low["name"] == q) | (stem == q), 500).otherwise(0),
        F.when(has["content_text"] | has["note"], 400).otherwise(0),
        F.when(has["name"] | has["path"], 200).otherwise(0),
        F.when(low["title"] == q, 110).when(has["title"], 100).otherwise(0),
    )
    per_term = [F.when(F.contains(low["content_text"], F.lit(t)) | F.contains(low["note"], F.lit(t)), 40).when(F.contains(low["name"], F.lit(t)) | F.contains(low["path"], F.lit(t)), 20).when(F.contains(low["title"], F.lit(t)), 10).otherwise(0) for t in (x.lower() for x in terms) if t != q]
    score = whole + (add(per_term) if per_term else F.lit(0))
    kind = (
        F.when(whole == 500, "fileName").when(has["content_text"], "content").when(has["note"], "note").when(has["name"], "fileName").when(has["path"], "path").when(has["title"], "title")
        .when(score > 0, "terms")
    )
    return score, kind


def is_identifier(word: str) -> bool:
    """distinctive_identifier of one word."""
    return word.isascii() and word.isalnum() and 2 <= len(word) <= 32 and (any(c.isdigit() for c in word) or word.isalpha() and word.isupper())


def lexical_lane(files: DataFrame, query: str, terms: list[str], limit: int = 200) -> DataFrame:
    """(file_id, score, kind, coverage, identifier): files that match, the strongest first; identifier: whether one of
    the query's distinctive identifiers occurs."""
    score, kind = lexical_score(query, terms)
    body = F.concat_ws("\n", "name", "title", "content_text", "note", "path")
    coverage = count_terms(body, terms) / len(terms) if terms else F.lit(0.0)
    marks = [w for w in query.split() if is_identifier(w)]
    identifier = count_terms(body, marks) > 0 if marks else F.lit(False)
    hits = files.select(F.col("id").alias("file_id"), score.alias("score"), kind.alias("kind"), F.round(coverage, 6).alias("coverage"), identifier.alias("identifier")).where("score > 0")
    return hits.orderBy(F.desc("score"), "file_id").limit(limit)


def semantic_confidence(kind: Column, score: Column) -> Column:
    """A base by the kind of match, and up to 0.09 by how far the score lies above the floor."""
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - FLOOR) / 0.62))
    return F.when(kind.isin("content", "note"), 0.90).when(kind == "title", 0.45).otherwise(0.60) + 0.09 * strength


def lexical_confidence(found: Column, coverage: Column, exact: Column, required_missing: Column, identifier: Column) -> Column:
    """Confidence of a lexical match from its own, found; coverage of the core words; and four tests."""
    return (
        F.when(exact, F.least(found, F.lit(1.0)))
        .when(required_missing & identifier, F.least(F.lit(0.65), F.greatest(F.lit(0.52), 0.40 + 0.40 * coverage)))
        .when(required_missing, F.least(F.lit(0.49), 0.24 + 0.25 * coverage))
        .when(coverage > 0, F.least(F.lit(0.78), 0.42 + 0.36 * coverage))
        .otherwise(F.least(F.lit(0.45), found))
    )


def final_confidence(kind: Column, lexical: Column, semantic: Column, coverage: Column) -> Column:
    """One confidence of a result from its lanes'; each kind has its ceiling."""
    ceiling = F.when(kind.isin("content", "note"), 0.96).when(kind == "fileName", 0.86).when(kind == "path", 0.82).when(kind == "title", 0.76).otherwise(0.78)
    either = F.greatest(F.coalesce(lexical, F.lit(0.0)), F.coalesce(semantic, F.lit(0.0)))
    return F.when(lexical.isNull(), F.least(semantic, F.lit(0.94))).when(coverage > 0, F.least(either, ceiling)).otherwise(F.least(either, F.lit(0.74)))


def displayed(results: DataFrame, query: str, least: float = 0.5, fill: int = 3) -> DataFrame:
    """Of each query's results those of sufficient confidence; if they're under fill, the best weak ones too."""
    order = Window.partitionBy(query).orderBy(F.desc("confidence"), "file_id")
    return results.withColumn("_n", F.row_number().over(order)).where((F.col("confidence") >= least) | (F.col("_n") <= fill)).drop("_n")


def keyword_candidates(files: DataFrame, keywords: tuple[str, ...], limit: int = 200) -> DataFrame:
    """(id, lane): candidates for several keywords: by how many of three or more characters the text holds (lane 1),
    and by shorter ones in name or path (lane 2), for which a quarter of the limit, at least 25, is kept."""
    long, short = ([k.lower() for k in keywords if (len(k) >= 3) == x] for x in (True, False))
    kept = max(25, limit // 4) if short else 0
    lanes = []
    if long:
        matched = files.select("id", count_terms(F.col("content_text"), long).alias("n")).where("n > 0")
        lanes.append(matched.orderBy(F.desc("n"), "id").limit(max(1, limit - kept)).select("id", F.lit(1).alias("lane")))
    if short:
        meta = F.concat_ws("\n", "name", "path")
        lanes.append(files.where(count_terms(meta, short) > 0).select("id").orderBy("id").limit(kept).select("id", F.lit(2).alias("lane")))
    return functools.reduce(DataFrame.unionByName, lanes).groupBy("id").agg(F.min("lane").alias("lane"))


def trigrams(files: DataFrame, fields: tuple[str, ...] = tuple(FIELD_WEIGHTS)) -> DataFrame:
    """(gram, id, field): which files' fields hold each run of three characters."""
    low = [F.struct(F.lit(f).alias("field"), F.lower(F.coalesce(f, F.lit(""))).alias("t")) for f in fields]
    each = files.select("id", F.inline(F.array(*low))).where(F.length("t") >= 3)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring("t", i, F.lit(3))))
    return each.select(F.explode(grams).alias("gram"), "id", "field")


def phrase_counts(docs: DataFrame, phrases: DataFrame, text: str = "text", block: int = 200) -> DataFrame:
    """(item_id, documents): how many rows of docs hold each phrase (item_id, text) as it stands.

    A phrase of five or more words is looked for where its second to fourth words stand together; the
    few others are asked in blocks of a scan each. Rows of docs that repeat are counted each.
    """
    own = F.split("text", "\\s+")
    long = phrases.where(F.size(own) >= 5).select("item_id", F.col("text").alias("phrase"), F.xxhash64(F.array_join(F.slice(own, 2, 3), " ")).alias("anchor"))
    anchors = long.select("anchor").distinct()
    n = anchors.count()
    rows = docs.select(F.col(text).alias("text"))
    words = F.split("text", "\\s+")
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1)))
    hashes = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(F.col("words"), i, F.lit(3)), " "))))
    each = rows.withColumn("words", words).select("text", F.explode(hashes).alias("anchor"))
    found = each.join(F.broadcast(long) if n <= 100_000 else long, "anchor").where(F.contains("text", F.col("phrase")))
    counts = [found.groupBy("item_id").agg(F.count("*").alias("documents"))]
    short = [(r["item_id"], r["text"]) for r in phrases.where(F.size(own) < 5).toLocalIterator()]
    for at in range(0, len(short), block):
        hits = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(t)), F.lit(i).cast("long")) for i, t in short[at : at + block])))
        counts.append(rows.select(F.explode(hits).alias("item_id")).groupBy("item_id").agg(F.count("*").alias("documents")))
    return functools.reduce(DataFrame.unionByName, counts)


def match_kind(exact: Column, lexical: Column, semantic: Column, entity: Column, kind: Column, dated: Column) -> Column:
    """How a result was found, by the lanes that have it; kind: of the lexical match."""
    return (
        F.when(exact, "fileName").when(entity & (lexical | semantic), "hybrid").when(entity, "entity").when(lexical & semantic, "hybrid")
        .when(lexical, kind).when(semantic, "semantic").when(dated, "date").otherwise("filter")
    )


def recency_tier(kind: Column, confidence: Column) -> Column:
    """Which results come first where new ones are asked for."""
    return F.when(kind.isin("content", "note"), 5).when((kind == "fileName") & (confidence == 1), 6).when(kind.isin("fileName", "path"), 3).when(kind == "title", 2).when(kind == "semantic", 1).otherwise(0)


def keyword_evidence(text: Column, concepts: dict[str, tuple[str, ...]], most: int = 3) -> Column:
    """concept:word for the concepts of which a word occurs, each once, the first so many."""
    low = F.lower(text)
    found = []
    for name, words in {n.lower(): w for n, w in reversed(concepts.items())}.items():
        first = F.coalesce(*(F.when(F.contains(low, F.lit(w.lower())), F.lit(f"{name}:{w.lower()}")) for w in words))
        found.insert(0, first)
    return F.slice(F.array_compact(F.array(*found)), 1, most)


def if_empty(lane: DataFrame, fallback: DataFrame) -> DataFrame:
    """The fallback's rows if the lane has none; only whether it has one is looked at."""
    some = lane.limit(1).select(F.lit(1).alias("_some"))  # at most one row
    return fallback.join(F.broadcast(some), F.lit(True), "left").where("_some IS NULL").drop("_some")


@dataclass(frozen=True)
class Search:
    """A hybrid search: words, optionally a query vector, and entity terms."""

    query: str
    terms: tuple[str, ...]
    entity_terms: tuple[str, ...] = ()
    vector: tuple[float, ...] | None = None
    limit: int = 10


def hybrid(files: DataFrame, chunks: DataFrame, vectors: DataFrame, search: Search, scope: Column | None = None) -> DataFrame:
    """(file_id, fused, kind, confidence): files by all lanes; scope: a filter of files that every lane keeps to.

    Each lane ends in a bounded top-k; what follows works on some hundreds of rows.
    """
    some = files if scope is None else files.where(scope)
    ids = None if scope is None else some.select("id")
    within = chunks if ids is None else chunks.join(ids.withColumnRenamed("id", "file_id"), "file_id", "left_semi")
    words = lexical_lane(some, search.query, list(search.terms))
    by_chunk = best_per_file(chunk_lane(within, list(search.terms))).select("file_id", "score")
    none = words.select("file_id", F.lit(0.0).alias("score")).where("false")
    near = none
    if search.vector is not None:
        near = accepted(nearest(vectors, list(search.vector), 200, ids)).select("file_id", "score")
    named = entity_lane(within, list(search.entity_terms)).select("file_id", "score") if search.entity_terms else none
    lexical = words.select("file_id", (F.col("score") / 1000).alias("score")).unionByName(by_chunk.withColumn("score", F.col("score") / 1000))
    exact = words.where("score >= 500").select("file_id")
    fused = fuse(lexical, near, named, exact).join(words.select("file_id", "kind", "coverage", "identifier", F.col("score").alias("words")), "file_id", "left")
    kind = F.when(F.col("exact_rank").isNotNull(), "fileName").when(F.col("entity_rank").isNotNull(), "entity").when(F.col("semantic_rank").isNotNull() & F.col("lexical_rank").isNotNull(), "hybrid").when(F.col("lexical_rank").isNotNull(), F.coalesce("kind", F.lit("content"))).otherwise("semantic")
    cover = F.coalesce("coverage", F.lit(0.0))
    strength = F.coalesce("words", F.lit(0))
    found = F.when(strength >= 400, 0.95).when(strength >= 200, 0.80).when(strength >= 100, 0.60).otherwise(0.45)
    sure = lexical_confidence(found, cover, strength >= 400, cover < 1, F.coalesce("identifier", F.lit(False)))
    of_words = F.when(F.col("lexical_rank").isNotNull(), sure)
    of_vector = F.when(F.col("semantic_rank").isNotNull(), semantic_confidence(F.lit("content"), F.col("semantic_score")))
    confidence = F.when(F.col("exact_rank").isNotNull(), 1.0).when(F.col("entity_rank").isNotNull(), 0.98).otherwise(final_confidence(F.coalesce("kind", F.lit("content")), of_words, of_vector, cover))
    out = fused.select("file_id", "fused", kind.alias("match_kind"), F.round(confidence, 6).alias("confidence"))
    return displayed(out.withColumn("q", F.lit(1)), "q").drop("q").orderBy(F.desc("fused"), "file_id").limit(search.limit)
