"""Queries over texts, vectors and retrieval."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators import chunking, context, organize, retrieval
from lectern.plans.registry import Registry
from lectern.plans.search_plan import date_interval
from lectern.session import table
from lectern.sources import library

R = Registry()
#: The question that the search queries ask, and its vector: the mean of no document, but the first vector's.
QUESTION, TERMS, ENTITIES = "secret token", ["secret", "token", "the"], ["example", "com"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@R.add(r"""SELECT doc_id, cast(greatest(1, ceil(round(2.0 / 3 * len(regexp_extract_all(text, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]')) + 4.0 / 3 * len(regexp_extract_all(text, '[A-Za-z0-9''_-]+'))
  + len(regexp_extract_all(text, '[^\sA-Za-z0-9''_\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}-]')), 9))) AS integer) AS tokens FROM documents""")
def mth06_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@R.add(r"SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS concept FROM documents")
def str15_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.concept(F.col("text")).alias("concept"))


@R.add(r"SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2 AND w NOT IN ('the', 'of', 'and')))) AS terms FROM documents")
def str09_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(tx.terms(F.col("text"), ("the", "of", "and"))).cast("long").alias("terms"))


@R.add(r"SELECT doc_id, round(len(regexp_extract_all(text, '\p{L}')) / greatest(length(text), 1), 6) AS ratio FROM documents")
def str24_letter_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(tx.letter_ratio(F.col("text")), 6).alias("ratio"))


@R.add("SELECT a.p_partkey AS id, round(1.0 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name), 1), 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def str25_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name against the next one's."""
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"))
    b = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("b"))
    return a.join(b, "id").select("id", F.round(tx.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@R.add(r"SELECT file_id, chunk_idx, NOT regexp_matches(text, '[\p{L}\p{N}]') OR regexp_matches(trim(text), '^(?i:page|p\.?)\s*[0-9]+(\s*(?i:of|/)\s*[0-9]+)?$') AS noise FROM chunks", "chunks")
def str26_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.chunks(spark, sf_dir).select("file_id", "chunk_idx", tx.noise(F.col("text")).alias("noise"))


@R.add("SELECT doc_id, sha256(text) AS digest FROM documents")
def str27_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest"))


@R.add("""SELECT doc_id, length(text) >= 768 AND (length(text[1:length(text) - 256]) - length(replace(text[1:length(text) - 256], right(text, 256), ''))) / 256 >= 2 AS runaway FROM documents""")
def str33_runaway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.runaway(F.col("text")).alias("runaway"))


@R.add("SELECT doc_id, cast(ceil(length(text) / 320) AS bigint) AS slices, text[1:320] AS first FROM documents")
def str42_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tx.slices(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("slices"), F.get(s, F.lit(0)).alias("first"))


@R.add("SELECT id, CASE WHEN ext IN ('txt', 'md', 'pdf') THEN 'document' WHEN ext = 'py' THEN 'code' ELSE 'archive' END AS category FROM files", "files")
def str18_str19_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).select("id", tx.category(tx.extension(F.col("name"))).alias("category"))


@R.add(r"SELECT p_partkey AS id, left(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 64) AS slug FROM part")
def str23_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.slug(F.col("p_name")).alias("slug"))


@R.add()
def ret23_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every whole text; word borders are those of Unicode, which SQL engines differ on."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(tx.entities(F.col("text")), ",").alias("entities"))


@R.add(r"SELECT doc_id, regexp_extract(replace(text, chr(10), ' '), '^(.{0,40})', 1) AS head FROM documents")
def str41_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.regexp_extract(F.replace("text", F.lit("\n"), F.lit(" ")), "^(.{0,40})", 1).alias("head"))


@R.add("SELECT event_id AS id, printf('%02d:%02d', cast(s // 60 AS integer), cast(s % 60 AS integer)) AS code FROM (SELECT event_id, event_id % 3000 AS s FROM events)")
def dat09_time_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), tx.time_code(F.col("event_id") % 3000).alias("code"))


@R.add("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
def dat03_last_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = date_interval("what changed last week", date(2024, 1, 17))
    return table(spark, sf_dir, "events").where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))).select(F.col("event_id").alias("id"))


@R.add("SELECT id, cast(coalesce(discovered_at, organized_at, indexed_at, mtime) AS date) AS day FROM files", "files")
def dat01_dat02_added_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.filters import added_at

    return library.files(spark, sf_dir).select("id", F.to_date(added_at()).alias("day"))


@R.add("SELECT event_id AS id, cast(props->>'$.k' AS bigint) AS k FROM events")
def jsn01_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    found = library.embeddings(spark, sf_dir).where("id = 0").select("embedding").first()
    return list(found[0])


@R.add("SELECT a.vec_id AS id, round(list_cosine_similarity(cast(a.embedding AS double[]), cast(b.embedding AS double[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mth02_cosine_of_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = library.embeddings(spark, sf_dir)
    b = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("b"))
    return v.select("id", "embedding").join(b, "id").select("id", F.round(vx.cosine(F.col("embedding"), F.col("b")), 5).alias("cosine"))


@R.add("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x AS double) * x))), 4) AS norm FROM embeddings")
def mth01_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.embeddings(spark, sf_dir).select("id", F.round(vx.norm(F.col("embedding")), 4).alias("norm"))


@R.add(f"SELECT vec_id AS file_id, 0 AS chunk_idx, round(list_cosine_similarity(cast(embedding AS double[]), cast({_Q} AS double[])), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 25")
def ret10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(library.embeddings(spark, sf_dir), _query_vector(spark, sf_dir), 25)


@R.add(f"SELECT vec_id AS file_id, 0 AS chunk_idx, round(list_cosine_similarity(cast(embedding AS double[]), cast({_Q} AS double[])), 6) AS score FROM embeddings WHERE vec_id IN (SELECT id FROM files WHERE ext = 'md') ORDER BY score DESC, vec_id LIMIT 25", "files")
def ret12_nearest_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(library.embeddings(spark, sf_dir), _query_vector(spark, sf_dir), 25, library.files(spark, sf_dir).where("ext = 'md'").select("id"))


@R.add(f"""WITH t AS (SELECT vec_id AS file_id, 0 AS chunk_idx, round(list_cosine_similarity(cast(embedding AS double[]), cast({_Q} AS double[])), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 100)
  SELECT * FROM t WHERE score >= greatest(0.38, (SELECT round(max(score) - 0.18, 6) FROM t))""")
def ret13_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.accepted(retrieval.nearest(library.embeddings(spark, sf_dir), _query_vector(spark, sf_dir), 100))


_MATCHED = "cast(contains(l, 'secret') AS integer) + cast(contains(l, 'token') AS integer) + cast(contains(l, 'the') AS integer)"


@R.add(f"""SELECT file_id, chunk_idx, m AS matched, cast(round(least(1.0, 0.62 + 0.10 * (m - 1)), 6) AS double) AS score FROM (SELECT file_id, chunk_idx, {_MATCHED} AS m FROM (SELECT file_id, chunk_idx, lower(text) AS l FROM chunks))
  WHERE m > 0 ORDER BY m DESC, file_id, chunk_idx LIMIT 200""", "chunks")
def ret08_chunk_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunk_lane(library.chunks(spark, sf_dir), TERMS)


@R.add()
def ret09_entity_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.entity_lane(library.chunks(spark, sf_dir), ENTITIES)


@R.add("SELECT id, 1 AS stage FROM files WHERE contains(lower(content_text), 'that') OR contains(lower(name), 'that') OR contains(lower(path), 'that') ORDER BY id LIMIT 200", "files")
def ret04_keyword_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_ladder(library.files(spark, sf_dir), "That")


_INDEX = " UNION ALL ".join(rf"SELECT id, '{f}' AS field, unnest(list_filter(regexp_split_to_array(lower(coalesce({f}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS word FROM files" for f in retrieval.FIELD_WEIGHTS)


@R.add(f"SELECT word, field, count(*) AS tf, count(DISTINCT id) AS df FROM ({_INDEX}) GROUP BY word, field", "files")
def ret02_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every field, with its occurrences and files."""
    return retrieval.inverted(library.files(spark, sf_dir)).groupBy("word", "field").agg(F.sum("tf").alias("tf"), F.count("id").alias("df"))


def _bm25_oracle() -> str:
    fields = {"name": 5, "title": 1, "content_text": 3, "note": 3, "path": 2}
    words = ", ".join(rf"list_filter(regexp_split_to_array(lower(coalesce({f}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w_{f}" for f in fields)
    length = " + ".join(f"{w} * len(w_{f})" for f, w in fields.items())
    tf = {t: " + ".join(f"{w} * len(list_filter(w_{f}, lambda x: x = '{t}'))" for f, w in fields.items()) for t in ("secret", "the", "token")}
    columns = ", ".join(f"{e} AS tf_{t}" for t, e in tf.items())
    stats = ", ".join(f"count(*) FILTER (tf_{t} > 0) AS df_{t}" for t in tf)
    score = " + ".join(f"ln(1 + (n - df_{t} + 0.5) / (df_{t} + 0.5)) * tf_{t} * 2.2 / (tf_{t} + 1.2 * (0.25 + 0.75 * len_ / mean_))" for t in tf)
    hit = " + ".join(f"tf_{t}" for t in tf)
    return f"""WITH a AS (SELECT id, {words} FROM files), b AS (SELECT id, {length} AS len_, {columns} FROM a), s AS (SELECT count(*) AS n, avg(len_) AS mean_, {stats} FROM b)
  SELECT id, round({score}, 6) AS score FROM b, s WHERE {hit} > 0 ORDER BY score DESC, id LIMIT 200"""


@R.add(_bm25_oracle(), "files")
def ret06_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(library.files(spark, sf_dir), TERMS)


@R.add("""WITH f AS (SELECT id, lower(name) AS n, regexp_replace(lower(name), '\\.[^.]*$', '') AS s, lower(title) AS t, lower(content_text) AS c, lower(coalesce(note, '')) AS o, lower(path) AS p FROM files),
  w AS (SELECT id AS file_id, greatest(CASE WHEN n = 'doc_12' OR s = 'doc_12' THEN 500 ELSE 0 END, CASE WHEN contains(c, 'doc_12') OR contains(o, 'doc_12') THEN 400 ELSE 0 END,
    CASE WHEN contains(n, 'doc_12') OR contains(p, 'doc_12') THEN 200 ELSE 0 END, CASE WHEN t = 'doc_12' THEN 110 WHEN contains(t, 'doc_12') THEN 100 ELSE 0 END)
    + CASE WHEN contains(c, 'token') OR contains(o, 'token') THEN 40 WHEN contains(n, 'token') OR contains(p, 'token') THEN 20 WHEN contains(t, 'token') THEN 10 ELSE 0 END AS score FROM f)
  SELECT file_id, score FROM w WHERE score > 0 ORDER BY score DESC, file_id LIMIT 200""", "files")
def ret15_lexical_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical_lane(library.files(spark, sf_dir), "doc_12", ["token"]).select("file_id", "score")


_LANES = """l AS (SELECT vec_id AS file_id, round((vec_id % 50) / 50.0, 6) AS score FROM embeddings WHERE vec_id % 3 = 0), s AS (SELECT vec_id AS file_id, round((vec_id % 70) / 70.0, 6) AS score FROM embeddings WHERE vec_id % 2 = 0),
  e AS (SELECT vec_id AS file_id, round((vec_id % 30) / 30.0, 6) AS score FROM embeddings WHERE vec_id % 5 = 0),
  lr AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_id) AS r FROM l QUALIFY r <= 400), sr AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_id) AS r FROM s QUALIFY r <= 400), er AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_id) AS r FROM e QUALIFY r <= 400)"""


@R.add(f"""WITH {_LANES} SELECT file_id, cast(lr.r AS integer) AS lexical_rank, cast(sr.r AS integer) AS semantic_rank, cast(er.r AS integer) AS entity_rank,
  round(coalesce(0.36 / (60 + lr.r), 0) + coalesce(0.44 / (60 + sr.r), 0) + coalesce(0.20 / (60 + er.r), 0) + coalesce(0.20 * sr.score, 0) + CASE WHEN file_id = 30 THEN 0.10 ELSE 0 END, 6) AS fused
  FROM lr FULL JOIN sr USING (file_id) FULL JOIN er USING (file_id) FULL JOIN (SELECT 30 AS file_id) x USING (file_id)""")
def ret14_win02_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = library.embeddings(spark, sf_dir).select("file_id")

    def lane(step: int, base: int) -> DataFrame:
        return v.where(F.col("file_id") % step == 0).select("file_id", F.round((F.col("file_id") % base) / float(base), 6).alias("score"))

    fused = retrieval.fuse(lane(3, 50), lane(2, 70), lane(5, 30), v.where("file_id = 30"))
    return fused.select("file_id", "lexical_rank", "semantic_rank", "entity_rank", "fused")


@R.add("""SELECT q, file_id, confidence FROM (SELECT label AS q, vec_id AS file_id, (vec_id * 7 % 100) / 100.0 AS confidence, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7 % 100) DESC, vec_id) AS r FROM embeddings)
  WHERE confidence >= 0.5 OR r <= 3""")
def flt24_display_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = library.embeddings(spark, sf_dir).select(F.col("label").alias("q"), "file_id", ((F.col("file_id") * 7 % 100) / 100.0).alias("confidence"))
    return retrieval.displayed(made, "q")


@R.add("""SELECT file_id, chunk_idx, score FROM (SELECT file_id, chunk_idx, length(text) AS score, row_number() OVER (PARTITION BY file_id ORDER BY length(text) DESC, chunk_idx) AS r FROM chunks) WHERE r = 1""", "chunks")
def agg15_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.best_per_file(library.chunks(spark, sf_dir).select("file_id", "chunk_idx", F.length("text").cast("long").alias("score")))


@R.add()
def ret27_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    search = retrieval.Search(QUESTION, tuple(TERMS), tuple(ENTITIES), tuple(_query_vector(spark, sf_dir)), 30)
    return retrieval.hybrid(library.files(spark, sf_dir), library.chunks(spark, sf_dir), library.embeddings(spark, sf_dir), search)


@R.add()
def ret29_planned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question read by rules, its filters in every lane."""
    from lectern.plans.search_plan import inferred

    plan = inferred("find documents about the secret token added this month", date(2024, 1, 15))
    search = retrieval.Search(" ".join(plan.terms), plan.terms, (), tuple(_query_vector(spark, sf_dir)), 30)
    return retrieval.hybrid(library.files(spark, sf_dir), library.chunks(spark, sf_dir), library.embeddings(spark, sf_dir), search, plan.filter.column())


@R.add()
def txt01_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(library.files(spark, sf_dir))


@R.add()
def txt02_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of every text that chunks are packed from."""
    made = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(tx.units(F.col("text"), 60))).alias("units"))  # once a row
    return made.select("doc_id", F.posexplode("units").alias("unit", "text"))


@R.add()
def txt05_txt06_run_on_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without sentences, cut between words; each piece begins with the last words of the one before, as far as they fit."""
    run_on = F.trim(F.regexp_replace("text", "[.!?。！？\\s]+", " "))
    return chunking.chunked(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), run_on.alias("content_text")), target=80, overlap=16)


@R.add()
def txt11_merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = F.transform(F.split("text", "\n"), lambda t, i: F.struct(t.alias("text"), F.floor(i / 25 + 1).cast("int").alias("page")))
    return chunking.merged(_docs(spark, sf_dir).select(F.col("doc_id").alias("file_id"), chunks.alias("chunks")))


@R.add(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n[\t ]*\n+'), lambda p: trim(p) <> '')) AS paragraphs FROM documents")
def txt03_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split("text", "\n[\t ]*\n+", -1), lambda p: F.trim(p) != "")
    return _docs(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("paragraphs"))


@R.add("SELECT id FROM files WHERE NOT (indexed_at IS NOT NULL AND index_signature = 'v1')", "files")
def txt18_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that an index of the present signature lacks."""
    files = library.files(spark, sf_dir)
    done = files.where("indexed_at IS NOT NULL AND index_signature = 'v1'").select("id", "content_hash")
    return files.select("id", "content_hash").join(done, ["id", "content_hash"], "left_anti").select("id")


@R.add("SELECT id, contains(regexp_replace(lower(content_text), '[^a-z]', '', 'g'), regexp_replace(lower(title), '[^a-z]', '', 'g')) AS held FROM files", "files")
def txt15_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    def flat(c: str):
        return F.regexp_replace(F.lower(c), "[^a-z]", "")

    return library.files(spark, sf_dir).select("id", F.contains(flat("content_text"), flat("title")).alias("held"))


@R.add()
def ctx01_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.chunk_lane(library.chunks(spark, sf_dir), TERMS).select("file_id", "chunk_idx", "score")
    texts = library.chunks(spark, sf_dir).select("file_id", "chunk_idx", "parent_idx", "text").join(hits, ["file_id", "chunk_idx"])
    return context.evidence(texts.select((F.col("file_id") % 5).alias("query_id"), "file_id", F.col("parent_idx").cast("int").alias("parent_idx"), "score", "text"))


@R.add()
def ctx11_win08_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = library.chunks(spark, sf_dir).select("file_id", "chunk_idx", "text")
    return context.batched(units, "file_id", "chunk_idx", "text", context.batch_budget("local", "both", 8192)).select("file_id", "chunk_idx", "batch")


@R.add()
def str31_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", context.truncated(F.col("text"), 192).alias("head"))


@R.add("SELECT conv_id AS id, string_agg('doc_' || (conv_id * 3 + k) || '.' || CASE (conv_id * 3 + k) % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'pdf' WHEN 3 THEN 'py' ELSE 'zip' END, '|' ORDER BY k DESC) AS names FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0), (1)) v(k) GROUP BY conv_id")
def join14_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    asked = asked.withColumn("file_ids", F.array(F.col("id") * 3 + 1, F.col("id") * 3))
    named = organize.resolved_references(asked, library.files(spark, sf_dir).select("id", "name"))
    return named.select("id", F.array_join("names", "|").alias("names"))


@R.add()
def src29_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.sources.readers import text_of_html

    return table(spark, sf_dir, "pages").select("page_id", text_of_html(F.col("html")).alias("text"))


@R.add()
def src36_txt10_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts of a minute a turn; a conversation's turns are bounded."""
    from lectern.sources.readers import transcript_chunks

    turn = F.struct((F.col("turn") * 60.0).alias("start"), (F.col("turn") * 60.0 + 55).alias("end"), "text")
    told = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(F.array_sort(F.collect_list(turn)).alias("segments"))
    return transcript_chunks(told)


@R.add("SELECT page_id, regexp_extract(url, '[^/]+$') AS name FROM pages")
def src33_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "[^/]+$", 0).alias("name"))


@R.add("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')")
def str40_ascii_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(~F.col("text").rlike("[^\\x00-\\x7F]")).select("doc_id")


@R.add("SELECT b.item_id, count(*) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def ret07_exact_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each phrase of the benchmark."""
    from lectern.plans.stored_queries import phrase_counts

    return phrase_counts(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))
