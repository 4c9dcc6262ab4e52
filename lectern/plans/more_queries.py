"""Further queries: lookups, updates, predicates, scalar functions, confidence, streaming twins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators import context, filters, organize, providers, retrieval, rows, snapshots
from lectern.plans.registry import Registry
from lectern.session import table
from lectern.sources import library
from lectern.streaming import watching

R = Registry()


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir)


@R.add("SELECT id, name FROM files WHERE id = 42 OR path IN ('/library/src3/doc_3.py', '/private/library/src3/doc_3.py')", "files")
def src06_src07_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where((F.col("id") == 42) | F.col("path").isin("/library/src3/doc_3.py", "/private/library/src3/doc_3.py")).select("id", "name")


@R.add("SELECT id, path FROM files WHERE content_hash IS NOT NULL AND NOT is_directory AND indexed_at IS NULL", "files")
def src14_unindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where("content_hash IS NOT NULL AND NOT is_directory AND indexed_at IS NULL").select("id", "path")


@R.add("SELECT session_id, max(ts) AS last FROM messages GROUP BY session_id ORDER BY last DESC, session_id LIMIT 50", "messages")
def src16_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.messages(spark, sf_dir).groupBy("session_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "session_id").limit(50)


@R.add("SELECT source_dir, string_agg(name, '|' ORDER BY id) AS names FROM (SELECT *, row_number() OVER (PARTITION BY source_dir ORDER BY id) AS r FROM files) WHERE r <= 80 GROUP BY source_dir", "files")
def src38_directory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory's first 80 names: each partition keeps 80 before the shuffle."""
    first = rows.newest_kept(_files(spark, sf_dir).select("source_dir", "id", "name"), ["source_dir"], ["id"], 80)
    listed = first.groupBy("source_dir").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("l"))
    return listed.select("source_dir", F.array_join("l.name", "|").alias("names"))


@R.add("SELECT id, CASE WHEN contains(content, 'the') THEN replace(content, 'the', 'THE') ELSE content END AS content FROM messages", "messages")
def snk02_title_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = library.messages(spark, sf_dir)
    return some.select("id", F.when(F.contains("content", F.lit("the")), F.replace("content", F.lit("the"), F.lit("THE"))).otherwise(F.col("content")).alias("content"))


@R.add("SELECT f.id, o.original_id, CASE WHEN o.original_id IS NULL THEN f.indexed_at END AS indexed_at FROM files f LEFT JOIN (SELECT id, min(id) OVER (PARTITION BY content_hash) AS original_id FROM files QUALIFY id <> original_id) o USING (id)", "files")
def snk15_mark_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _files(spark, sf_dir).select("id", "content_hash", "indexed_at")
    groups = some.groupBy("content_hash").agg(F.min("id").alias("first"))
    marked = some.join(groups, "content_hash").withColumn("original_id", F.when(F.col("id") != F.col("first"), F.col("first")))
    return marked.select("id", "original_id", F.when(F.col("original_id").isNull(), F.col("indexed_at")).alias("indexed_at"))


@R.add("SELECT id FROM (SELECT id, path, CASE WHEN id % 11 = 3 THEN name || '.part' ELSE name END AS n FROM files) WHERE NOT regexp_matches(n, '\\.part$') OR starts_with(path, '/library/src1/')", "files")
def snk18_purge_transient(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("id") % 11 == 3, F.concat("name", F.lit(".part"))).otherwise(F.col("name"))
    return _files(spark, sf_dir).where(~filters.transient(name) | filters.under(F.col("path"), "/library/src1")).select("id")


@R.add("SELECT event_id AS id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def snk22_newest_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts").orderBy(F.desc("ts"), F.desc("id")).limit(1000)


@R.add("SELECT id, CASE WHEN id % 5 = 0 THEN 'good' ELSE rating END AS rating, CASE WHEN id % 5 = 0 THEN 'pending' ELSE state END AS state FROM feedback", "feedback")
def snk24_feedback_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ratings reset the state of their records."""
    old = library.feedback(spark, sf_dir)
    return snapshots.upsert(old, old.where("id % 5 = 0").select("id", F.lit("good").alias("rating"), F.lit("pending").alias("state")), "id")


@R.add("SELECT user_id, max_by(event_type, event_id) AS state, count(*) AS events FROM events GROUP BY user_id")
def snk27_latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.count("*").alias("events"))


@R.add("SELECT id FROM files WHERE category = 'document' AND ext IN ('pdf', 'txt') AND indexed_at IS NOT NULL AND index_signature = 'v2'", "files")
def flt26_flt29_reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = filters.FileFilter(categories=("document",), extensions=("pdf", "txt"), indexed=True).column()
    return _files(spark, sf_dir).where(wanted & (F.col("index_signature") == "v2")).select("id")


@R.add("SELECT s.session_id FROM (SELECT DISTINCT session_id FROM usage) s WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.session_id = s.session_id)", "usage", "messages")
def join09_empty_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.usage(spark, sf_dir).select("session_id").distinct().join(library.messages(spark, sf_dir).select("session_id"), "session_id", "left_anti")


@R.add("SELECT b.id, coalesce(f.name, '') AS name, coalesce(f.size, 0) AS size FROM feedback b LEFT JOIN (SELECT * FROM files WHERE ext <> 'zip') f USING (id)", "files", "feedback")
def join13_job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _files(spark, sf_dir).where("ext <> 'zip'").select("id", "name", "size")
    return library.feedback(spark, sf_dir).select("id").join(known, "id", "left").select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("size", F.lit(0)).alias("size"))


@R.add("""SELECT role, count(*) FILTER (contains(content, 'the')) AS lexical, count(*) FILTER (length(content) > 200) AS semantic, count(*) AS returned FROM messages GROUP BY role""", "messages")
def agg21_lane_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.messages(spark, sf_dir).groupBy("role").agg(F.count_if(F.contains("content", F.lit("the"))).alias("lexical"), F.count_if(F.length("content") > 200).alias("semantic"), F.count("*").alias("returned"))


@R.add("SELECT id, round(least(1.0, (CASE WHEN contains(t, 'the') THEN 0.5 ELSE 0 END + CASE WHEN contains(t, 'token') THEN 0.3 ELSE 0 END + CASE WHEN contains(t, 'and') THEN 0.2 ELSE 0 END) / 1.0), 6) AS coverage FROM (SELECT id, lower(content_text) AS t FROM files)", "files")
def agg22_ret16_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("content_text")
    weights = {"the": 0.5, "token": 0.3, "and": 0.2}
    got = retrieval.add([F.when(F.contains(low, F.lit(t)), w).otherwise(0.0) for t, w in weights.items()])
    return _files(spark, sf_dir).select("id", F.round(F.least(F.lit(1.0), got / sum(weights.values())), 6).alias("coverage"))


@R.add("SELECT session_id, left(replace(min_by(content, id) FILTER (role = 'user'), chr(10), ''), 32) AS title FROM messages GROUP BY session_id", "messages")
def agg28_session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("role") == "user"
    first = library.messages(spark, sf_dir).groupBy("session_id").agg(F.min_by(F.when(user, F.col("content")), F.when(user, F.col("id"))).alias("q"))
    return first.select("session_id", F.substring(F.replace("q", F.lit("\n"), F.lit("")), 1, 32).alias("title"))


@R.add("SELECT id FROM (SELECT id, CASE WHEN contains(title, '2024') THEN 2 WHEN mtime >= TIMESTAMP '2024-01-01' AND mtime < TIMESTAMP '2024-01-01 06:00:00' THEN 1 ELSE 0 END AS tier, size FROM files) ORDER BY tier DESC, size DESC, id LIMIT 40", "files")
def srt04_dat07_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.contains("title", F.lit("2024")), 2).when((F.col("mtime") >= F.lit("2024-01-01 00:00:00").cast("timestamp")) & (F.col("mtime") < F.lit("2024-01-01 06:00:00").cast("timestamp")), 1).otherwise(0)
    return _files(spark, sf_dir).select("id", tier.alias("tier"), "size").orderBy(F.desc("tier"), F.desc("size"), "id").limit(40).select("id")


@R.add("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY category ORDER BY id) AS r FROM files) WHERE r % 7 = 1", "files")
def srt17_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.ranked(_files(spark, sf_dir).select("id", "category"), ["category"], ["id"]).where("rank % 7 = 1").select("id")


@R.add("SELECT id, n FROM (SELECT id, 1 AS n FROM files WHERE category = 'code' UNION ALL SELECT id, 2 FROM vectors WHERE label = 1)", "files", "vectors")
def set02_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _files(spark, sf_dir).where("category = 'code'").select("id", F.lit(1).alias("n"))
    return a.unionByName(library.embeddings(spark, sf_dir).where("label = 1").select("id", F.lit(2).alias("n")))


@R.add("SELECT event_id AS id, NOT (json_keys(props) @> ['k', 'missing']) AS lacking FROM events")
def set07_required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(F.lit("k"), F.lit("missing"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.size(F.array_except(wanted, F.json_object_keys("props"))) > 0).alias("lacking"))


@R.add(r"SELECT id FROM files WHERE name LIKE 'doc\_1%.md' ESCAPE '\'", "files")
def str02_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(F.like("name", F.lit("doc\\_1%.md"))).select("id")


@R.add()
def str04_folded_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts against the next document's and their own in capitals, blind to case and marks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after"))
    equal = lambda a, b: F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")
    return docs.join(after, "doc_id", "left").select("doc_id", equal(F.col("text"), F.upper("text")).alias("same"), equal(F.col("text"), F.col("after")).alias("as_next"))


@R.add("SELECT id, regexp_full_match(w, '[A-Za-z0-9]{2,32}') AND (regexp_matches(w, '[0-9]') OR regexp_full_match(w, '[A-Z]+')) AS distinctive FROM (SELECT id, split_part(content_text, ' ', 3) AS w FROM files)", "files")
def str12_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.split_part("content_text", F.lit(" "), F.lit(3))
    return _files(spark, sf_dir).select("id", tx.distinctive_identifier(word).alias("distinctive"))


@R.add()
def str16_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(tx.like_literal(F.col("content_text"), "token")).select("id", tx.excerpt(F.col("content_text"), "token").alias("excerpt"))


@R.add("SELECT id, CASE WHEN starts_with(p, '/private/tmp/') THEN substr(p, 9) WHEN starts_with(p, '/tmp/') THEN '/private' || p ELSE p END AS alias FROM (SELECT id, CASE id % 3 WHEN 0 THEN '/tmp/' || name WHEN 1 THEN '/private/tmp/' || name ELSE path END AS p FROM files)", "files")
def str22_path_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("id") % 3 == 0, F.concat(F.lit("/tmp/"), "name")).when(F.col("id") % 3 == 1, F.concat(F.lit("/private/tmp/"), "name")).otherwise(F.col("path"))
    return _files(spark, sf_dir).select("id", p.alias("p")).select("id", F.when(F.startswith("p", F.lit("/private/tmp/")), F.expr("substring(p, 9)")).when(F.startswith("p", F.lit("/tmp/")), F.concat(F.lit("/private"), "p")).otherwise(F.col("p")).alias("alias"))


@R.add("SELECT id, stem || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.' || ext AS name FROM (SELECT id, ext, 'item' AS stem, row_number() OVER (PARTITION BY source_dir, ext ORDER BY id) AS n FROM files)", "files")
def str21_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = _files(spark, sf_dir).select("id", F.col("source_dir").alias("folder"), F.lit("item").alias("stem"), "ext")
    return rows.collision_names(moves, moves.where("false")).select("id", "name")


@R.add("SELECT id, len(list_distinct(regexp_extract_all(a, '\\[F[0-9]+:P[0-9]+\\]'))) AS cited FROM (SELECT id, concat('see [F', id % 3, ':P1] and [F1:P', id % 2, '] or [F9:P9]') AS a FROM files)", "files")
def str28_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("see [F"), (F.col("id") % 3).cast("string"), F.lit(":P1] and [F1:P"), (F.col("id") % 2).cast("string"), F.lit("] or [F9:P9]"))
    return _files(spark, sf_dir).select("id", F.size(tx.citations(answer)).cast("long").alias("cited"))


@R.add("SELECT id, sha256(concat_ws(chr(10), 'v5', category, ext, cast(size AS varchar))) AS key FROM files", "files")
def str45_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("id", F.sha2(F.concat_ws("\n", F.lit("v5"), "category", "ext", F.col("size").cast("string")), 256).alias("key"))


@R.add("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def dat08_plan_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(filters.date_range(F.col("ts"), "2024-01-07", "2024-01-05")).select(F.col("event_id").alias("id"))


@R.add("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+'), lambda n: length(n) = 4 AND n[1:2] IN ('19', '20')))), ',') AS years FROM documents")
def dat05_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.years(F.col("text")), ",").alias("years"))


@R.add("SELECT vec_id AS id, round(greatest(-1.0, least(1.0, 1 - d * d / 2)), 6) AS similarity FROM (SELECT vec_id, (vec_id % 25) / 10.0 AS d FROM embeddings)")
def mth03_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.embeddings(spark, sf_dir).select("id", F.round(vx.similarity_of_distance((F.col("id") % 25) / 10.0), 6).alias("similarity"))


@R.add("SELECT p_partkey AS id, round(CASE WHEN p_size >= 20 THEN 0.0 WHEN p_size > 0 THEN CASE WHEN 20 - p_size > 0 THEN least(10, 20 - p_size) * 10 / 100.0 ELSE 0 END END, 6) AS overlap FROM part")
def mth08_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(20.0).alias("w"), F.lit(10.0).alias("h"))
    b = F.struct(F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(organize.overlap_ratio(a, b), 6).alias("overlap"))


@R.add()
def mth09_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 100 + 1).alias("w"), (F.col("p_partkey") % 50 * 100 + 1).cast("int").alias("h"))
    return size.select("id", F.inline(providers.tile_plan(F.col("w"), F.col("h"))))


@R.add("SELECT p_partkey AS id, cast(p_size % 5 AS bigint) * 10000 + p_partkey % 100 AS key FROM part")
def mth11_version_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = tx.version_key(F.concat_ws(".", (F.col("p_size") % 5).cast("string"), (F.col("p_partkey") % 100).cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.get(key, F.lit(0)) * 10000 + F.get(key, F.lit(1))).alias("key"))


@R.add("SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(text, ' '))), '|') AS words, list_has_any(string_split(text, ' '), ['the', 'der']) AS common FROM documents")
def arr02_arr04_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(words)), "|").alias("words"), F.arrays_overlap(words, F.array(F.lit("the"), F.lit("der"))).alias("common"))


_CONFIDENCE = "CASE WHEN id % 9 = 0 THEN least(0.9, 1.0) WHEN id % 7 = 0 THEN least(0.49, 0.24 + 0.25 * c) WHEN c > 0 THEN least(0.78, 0.42 + 0.36 * c) ELSE least(0.45, 0.9) END"


@R.add(f"SELECT id, round({_CONFIDENCE}, 6) AS confidence FROM (SELECT id, (id % 5) / 4.0 AS c FROM files)", "files")
def ret17_lexical_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieval.lexical_confidence(F.lit(0.9), (F.col("id") % 5) / 4.0, F.col("id") % 9 == 0, F.col("id") % 7 == 0, F.lit(False))
    return _files(spark, sf_dir).select("id", F.round(got, 6).alias("confidence"))


@R.add("""SELECT id, round(CASE WHEN l IS NULL THEN least(s, 0.94) WHEN c > 0 THEN least(greatest(l, coalesce(s, 0)), CASE k WHEN 0 THEN 0.96 WHEN 1 THEN 0.86 WHEN 2 THEN 0.82 ELSE 0.76 END) ELSE least(greatest(l, coalesce(s, 0)), 0.74) END, 6) AS confidence
  FROM (SELECT id, id % 4 AS k, CASE WHEN id % 5 <> 0 THEN (id % 10) / 10.0 END AS l, (id % 20) / 20.0 AS s, (id % 3) / 2.0 AS c FROM files)""", "files")
def ret18_final_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    kind = F.when(i % 4 == 0, "content").when(i % 4 == 1, "fileName").when(i % 4 == 2, "path").otherwise("title")
    got = retrieval.final_confidence(kind, F.when(i % 5 != 0, (i % 10) / 10.0), (i % 20) / 20.0, (i % 3) / 2.0)
    return _files(spark, sf_dir).select("id", F.round(got, 6).alias("confidence"))


@R.add("SELECT vec_id AS id, round(0.9 + 0.09 * greatest(0.0, least(1.0, (s - 0.38) / 0.62)), 6) AS confidence FROM (SELECT vec_id, (vec_id % 100) / 100.0 AS s FROM embeddings)")
def mth07_semantic_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.embeddings(spark, sf_dir).select("id", F.round(retrieval.semantic_confidence(F.lit("content"), (F.col("id") % 100) / 100.0), 6).alias("confidence"))


@R.add()
def mth05_hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = providers.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), providers.hash_embedder)
    return got.select("doc_id", F.size("embedding").alias("dimensions"), F.round(vx.norm(F.col("embedding")), 4).alias("norm"))


@R.add()
def ret25_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.chunk_lane(library.chunks(spark, sf_dir), ["secret", "token"]).select("file_id", "chunk_idx", "score")
    texts = library.chunks(spark, sf_dir).select("file_id", "chunk_idx", "text").join(hits, ["file_id", "chunk_idx"])
    got = providers.reranked(texts.withColumns({"query_id": F.lit(1), "query": F.lit("secret token")}), providers.overlap_score)
    return got.select("file_id", "chunk_idx", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@R.add("SELECT file_id, parent_idx FROM (SELECT file_id, parent_idx, min(chunk_idx) AS first FROM chunks WHERE contains(text, 'that') GROUP BY ALL)", "chunks")
def ctx04_parents_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = library.chunks(spark, sf_dir).where(F.contains("text", F.lit("that"))).select("file_id", "parent_idx", "chunk_idx")
    return rows.first_of_each(hits, ["file_id", "parent_idx"], [F.col("chunk_idx")]).select("file_id", "parent_idx")


@R.add("SELECT file_id, parent_idx, printf('C%05d', row_number() OVER (PARTITION BY file_id ORDER BY parent_idx)) AS unit FROM parents", "parents")
def ctx10_source_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rows.ranked(library.parents(spark, sf_dir).select("file_id", "parent_idx"), ["file_id"], ["parent_idx"])
    return ranked.select("file_id", "parent_idx", F.format_string("C%05d", "rank").alias("unit"))


@R.add("SELECT session_id, id FROM (SELECT session_id, id, row_number() OVER w AS r, count(*) OVER (PARTITION BY session_id) AS n FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY id)) WHERE r = 1 OR r > n - 7", "messages")
def ctx15_first_and_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("session_id"))
    ranked = rows.ranked(library.messages(spark, sf_dir).select("session_id", "id"), ["session_id"], ["id"]).withColumn("n", n)
    return ranked.where("rank = 1 OR rank > n - 7").select("session_id", "id")


@R.add()
def ctx08_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = library.chunks(spark, sf_dir)
    sections = c.select((F.col("file_id") % 50).alias("query_id"), "file_id", F.col("chunk_idx").alias("parent_idx"), F.when(F.col("chunk_idx") < 3, F.col("chunk_idx")).alias("seed_rank"), "text", "kind")
    return context.deterministic_sections(sections, ["secret", "token"]).select("query_id", "file_id", "parent_idx", "score")


@R.add("SELECT name, origin FROM (SELECT concat('skill', p_partkey % 200) AS name, CASE p_size % 3 WHEN 0 THEN 'bundled' WHEN 1 THEN 'shared' ELSE 'managed' END AS origin, row_number() OVER (PARTITION BY p_partkey % 200 ORDER BY p_size % 3 DESC, p_partkey) AS r FROM part) WHERE r = 1")
def fbk04_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.when(F.col("p_size") % 3 == 0, "bundled").when(F.col("p_size") % 3 == 1, "shared").otherwise("managed")
    made = table(spark, sf_dir, "part").select(F.concat(F.lit("skill"), (F.col("p_partkey") % 200).cast("string")).alias("name"), origin.alias("origin"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("path"))
    return organize.discovered(made).select("name", "origin")


@R.add("SELECT DISTINCT user_id, event_type FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_id = 0)")
def stm05_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    base = e.where("event_id = 0").select(F.col("event_type").alias("path"))
    return watching.not_in_baseline(e.select(F.col("event_type").alias("path"), "user_id"), base).select("user_id", F.col("path").alias("event_type")).distinct()


@R.add("SELECT path FROM files WHERE id % 10 = 4", "files")
def stm07_vanished(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _files(spark, sf_dir).select("id", "path")
    return watching.vanished(some, some.where("id % 10 <> 4")).select("path")


@R.add("SELECT a.id FROM files a JOIN (SELECT path, CASE WHEN id % 12 = 0 THEN 'changed' ELSE content_hash END AS h FROM files) b USING (path) WHERE a.content_hash <> b.h", "files")
def stm14_changed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _files(spark, sf_dir).select("id", "path", "content_hash")
    seen = some.select("path", F.when(F.col("id") % 12 == 0, "changed").otherwise(F.col("content_hash")).alias("h"))
    return some.join(seen, "path").where("content_hash <> h").select("id")


@R.add()
def stm09_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), "ts", "event_id")
    return watching.batches_by_count_or_time(e, "g", "ts", 5, 30, "event_id").select("g", "event_id", "batch")


@R.add("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-16'")
def dat10_trailing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.plans.search_plan import date_interval

    start, end = date_interval("the past 7 days", date(2024, 1, 15))
    return table(spark, sf_dir, "events").where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))).select(F.col("event_id").alias("id"))


@R.add("SELECT o_orderpriority AS priority, count(*) AS orders FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) GROUP BY 1")
def star_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"))


@R.add("SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def star_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return some.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))
