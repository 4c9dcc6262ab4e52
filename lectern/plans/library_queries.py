"""Queries over files: scans, filters, sorts, statistics, duplicates, snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import aggregates, filters, organize, rows, snapshots
from lectern.plans.registry import Registry
from lectern.session import table
from lectern.sources import library

R = Registry()
ADDED = "coalesce(discovered_at, organized_at, indexed_at, mtime)"


@R.add(f"SELECT id, name, {ADDED} AS added FROM files", "files")
def src01_all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).select("id", "name", filters.added_at().alias("added")).orderBy(F.desc("added"), F.lower("name"), "id")


@R.add("SELECT id, name, ext, size, category, mtime FROM files", "files")
def src02_pruned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).select("id", "name", "ext", "size", "category", "mtime")


@R.add("SELECT id, path FROM files WHERE lower(path) = '/library/src3' OR starts_with(lower(path), '/library/src3/')", "files")
def src03_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).where(filters.under(F.col("path"), "/Library/src3")).select("id", "path")


@R.add("SELECT id, path FROM files WHERE starts_with(lower(path), '/library/src1/') ORDER BY coalesce(organized_at, indexed_at, discovered_at, mtime) DESC, id LIMIT 20", "files")
def src04_recently_organized(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = library.files(spark, sf_dir).where(filters.under(F.col("path"), "/library/src1"))
    return some.orderBy(F.coalesce("organized_at", "indexed_at", "discovered_at", "mtime").desc(), "id").limit(20).select("id", "path")


@R.add("SELECT id, source_dir FROM files WHERE source_dir IN ('/library/src2', '/private/library/src2')", "files")
def src05_one_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).where(F.col("source_dir").isin("/library/src2", "/private/library/src2")).select("id", "source_dir")


@R.add("SELECT f.id, f.path, b.text FROM files f JOIN (SELECT item_id * 7 AS id, text FROM benchmark) b ON f.id = b.id", "files")
def src09_hydrate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a set of ids: a join that Spark broadcasts while the set is small."""
    wanted = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).alias("id"), "text")
    return library.files(spark, sf_dir).select("id", "path").join(wanted, "id")


@R.add("SELECT c.file_id, c.chunk_idx, c.parent_idx, p.children FROM chunks c LEFT JOIN parents p USING (file_id, parent_idx)", "chunks", "parents")
def src10_join01_chunks_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = library.chunks(spark, sf_dir).select("file_id", "chunk_idx", "parent_idx")
    return some.join(library.parents(spark, sf_dir).select("file_id", "parent_idx", "children"), ["file_id", "parent_idx"], "left").select("file_id", "chunk_idx", "parent_idx", "children")


@R.add("SELECT file_id, chunk_idx, kind FROM chunks WHERE kind NOT IN ('note', 'title', 'metadata') AND length(trim(text)) > 0", "chunks")
def src11_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.chunks(spark, sf_dir).where(~F.col("kind").isin("note", "title", "metadata") & (F.length(F.trim("text")) > 0)).select("file_id", "chunk_idx", "kind")


@R.add("SELECT file_id, count(*) AS n, string_agg(kind, ',' ORDER BY chunk_idx) AS kinds FROM chunks GROUP BY file_id", "chunks")
def src12_chunks_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's chunk kinds in order: a file's own chunks are bounded by the file."""
    listed = library.chunks(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("chunk_idx", "kind"))).alias("l"))
    return listed.select("file_id", "n", F.array_join("l.kind", ",").alias("kinds"))


@R.add("SELECT session_id, id, role FROM messages", "messages")
def src17_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.messages(spark, sf_dir).select("session_id", "id", "role").orderBy("session_id", "id")


@R.add("SELECT id, rating, state FROM feedback WHERE state IN ('pending', 'failed')", "feedback")
def src21_pending_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.feedback(spark, sf_dir).where(F.col("state").isin("pending", "failed")).orderBy("id")


_FILTER = filters.FileFilter(extensions=("MD", ".txt"), categories=("document", "other"), folder_terms=("src", "library"), directory=False, added=(datetime(2024, 1, 1, 1), datetime(2024, 1, 20)), size=(5000, 200))


@R.add(f"""SELECT id, name, size FROM files WHERE ext IN ('md', 'txt') AND category IN ('document', 'other') AND NOT is_directory
  AND {ADDED} >= TIMESTAMP '2024-01-01 01:00:00' AND {ADDED} < TIMESTAMP '2024-01-20' AND size BETWEEN 200 AND 5000""", "files")
def flt01_metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).where(_FILTER.column()).select("id", "name", "size")


@R.add("SELECT id FROM files WHERE trim(coalesce(note, '')) <> '' AND indexed_at IS NOT NULL", "files")
def flt08_noted_and_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).where(filters.FileFilter(has_note=True, indexed=True).column()).select("id")


@R.add(f"SELECT id, name FROM files WHERE category = 'document' ORDER BY {ADDED} DESC, lower(name), id LIMIT 100", "files")
def flt09_newest_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.newest(library.files(spark, sf_dir).where(filters.FileFilter(categories=("document",)).column()), 100).select("id", "name")


@R.add("SELECT id FROM files WHERE contains(lower(name), 'doc_1') OR contains(lower(title), 'the') OR contains(lower(coalesce(note, '')), 'note on e')", "files")
def flt12_literal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = filters.any_contains(("name",), ("doc_1",)) | filters.any_contains(("title",), ("The",)) | filters.any_contains(("note",), ("note on e",))
    return library.files(spark, sf_dir).where(hit).select("id")


@R.add("SELECT file_id, chunk_idx FROM chunks WHERE contains(lower(text), 'secret') OR contains(lower(text), 'idiot')", "chunks")
def flt14_chunk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.chunks(spark, sf_dir).where(filters.any_contains(("text",), ("secret", "idiot"))).select("file_id", "chunk_idx")


@R.add("SELECT id FROM files WHERE mtime >= TIMESTAMP '2024-01-01' AND mtime < TIMESTAMP '2024-01-02'", "files")
def flt16_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).where(filters.date_range(F.col("mtime"), "2024-01-01", "2023-12-31") & filters.date_range(F.col("mtime"), "2024-01-01", None)).select("id")


@R.add("""SELECT id, CASE WHEN regexp_matches(n, '\\.(tmp|part)$') THEN 'transient' WHEN starts_with(n, '.') THEN 'hidden'
  WHEN NOT is_directory AND ext NOT IN ('txt', 'md', 'pdf') THEN 'unsupported' END AS reason
  FROM (SELECT id, ext, is_directory, CASE id % 11 WHEN 3 THEN concat(name, '.part') WHEN 4 THEN concat('.', name) ELSE name END AS n FROM files)""", "files")
def flt18_flt19_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("id") % 11 == 3, F.concat("name", F.lit(".part"))).when(F.col("id") % 11 == 4, F.concat(F.lit("."), "name")).otherwise(F.col("name"))
    return library.files(spark, sf_dir).select("id", filters.exclusion_reason(name, F.col("ext"), F.col("is_directory"), ("txt", "md", "pdf")).alias("reason"))


@R.add("""SELECT id FROM files WHERE indexed_at IS NOT NULL AND (is_directory OR ext IN ('md', 'txt')) ORDER BY CASE WHEN id > 300 THEN 0 ELSE 1 END, id LIMIT 256""", "files")
def flt20_audit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit_candidates(library.files(spark, sf_dir), 300, ("md", "txt")).select("id")


@R.add("""WITH c AS (SELECT id, size FROM files WHERE indexed_at IS NOT NULL AND (is_directory OR ext IN ('md', 'txt')) ORDER BY CASE WHEN id > 300 THEN 0 ELSE 1 END, id LIMIT 256),
  s AS (SELECT id, size, sum(size) OVER w AS total, count(*) OVER w AS n FROM c WINDOW w AS (ORDER BY CASE WHEN id > 300 THEN 0 ELSE 1 END, id ROWS UNBOUNDED PRECEDING))
  SELECT id, size FROM s WHERE total <= 100000 OR n = 1""", "files")
def stm13_audit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = filters.audit_candidates(library.files(spark, sf_dir), 300, ("md", "txt")).select("id", "size")
    return filters.within_budget(some, [F.when(F.col("id") > 300, 0).otherwise(1), "id"], "size", 100_000)


@R.add("SELECT vec_id AS id FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0")
def flt22_valid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.vectors import valid

    return library.embeddings(spark, sf_dir).where(valid(F.col("embedding"))).select("id")


@R.add("""SELECT f.id, e.label FROM files f JOIN embeddings e ON e.vec_id = f.id""", "files")
def join02_files_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).select("id").join(library.embeddings(spark, sf_dir).select("id", "label"), "id")


@R.add("SELECT id FROM files WHERE id NOT IN (SELECT doc_id FROM labels) ORDER BY id DESC LIMIT 512", "files")
def join07_without_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return library.files(spark, sf_dir).select("id").join(known, "id", "left_anti").orderBy(F.desc("id")).limit(512)


@R.add("SELECT DISTINCT file_id, parent_idx FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.file_id = c.file_id AND p.parent_idx = c.parent_idx)", "chunks", "parents")
def join08_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = library.chunks(spark, sf_dir).select("file_id", "parent_idx").distinct()
    return keys.join(library.parents(spark, sf_dir).select("file_id", "parent_idx"), ["file_id", "parent_idx"], "left_anti")


@R.add("""WITH u AS (SELECT session_id, min(id) AS id FROM messages WHERE role = 'user' GROUP BY session_id)
  SELECT s.session_id, m.content AS question FROM (SELECT DISTINCT session_id FROM messages) s LEFT JOIN u USING (session_id) LEFT JOIN messages m ON m.id = u.id""", "messages")
def join15_first_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.messages(spark, sf_dir).groupBy("session_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("id"))).alias("question"))


@R.add(f"""WITH f AS (SELECT id, content_hash, first_value(id) OVER (PARTITION BY content_hash ORDER BY {ADDED}, id) AS o FROM files WHERE indexed_at IS NOT NULL AND duplicate_of_file_id IS NULL),
  o AS (SELECT DISTINCT content_hash, o FROM f)
  SELECT files.id, o.o AS original_id FROM files JOIN o USING (content_hash) WHERE files.id <> o.o""", "files")
def join16_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.original_of(library.files(spark, sf_dir))


@R.add("""WITH h AS (SELECT file_id, chunk_idx FROM chunks WHERE contains(lower(text), 'that'))
  SELECT DISTINCT c.file_id, c.chunk_idx FROM chunks c JOIN h ON h.file_id = c.file_id AND c.chunk_idx BETWEEN h.chunk_idx - 1 AND h.chunk_idx + 1""", "chunks")
def join18_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = library.chunks(spark, sf_dir).select("file_id", "chunk_idx", "text")
    return organize.neighbours(some.where(filters.any_contains(("text",), ("that",))), some.select("file_id", "chunk_idx"))


_RULES = [
    (1, "pdf, md", "Papers", 5, True, "move", []), (2, "md", "Notes", 9, True, "move", ["/library/src1", "/library/src2"]), (3, "zip", "", 1, True, "ignore", []),
    (4, "py", "bad/name", 7, True, "move", []), (5, "txt", "Texts", 1, False, "move", []), (6, "md;txt", "Low", 1, True, "move", []),
]


@R.add("""SELECT id, cast(CASE WHEN ext = 'md' AND source_dir IN ('/library/src1', '/library/src2') THEN 2 WHEN ext IN ('pdf', 'md') THEN 1 WHEN ext = 'zip' THEN 3 WHEN ext = 'txt' THEN 6 END AS bigint) AS rule_id,
  CASE WHEN ext = 'md' AND source_dir IN ('/library/src1', '/library/src2') THEN 'Notes' WHEN ext IN ('pdf', 'md') THEN 'Papers' WHEN ext = 'zip' THEN NULL WHEN ext = 'txt' THEN 'Low' ELSE category END AS folder,
  CASE WHEN ext = 'zip' THEN 'ignore' WHEN ext = 'py' THEN 'category' ELSE 'move' END AS action FROM files""", "files")
def org01_join19_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.classified(library.files(spark, sf_dir), organize.rules_frame(spark, _RULES))


@R.add("SELECT how, count(*) AS n FROM (SELECT CASE id % 10 WHEN 1 THEN 'identity' WHEN 2 THEN 'content' WHEN 3 THEN 'gone' ELSE 'path' END AS how FROM files) GROUP BY how", "files")
def join12_reconcile_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known files against a listing in which a tenth moved, a tenth was copied elsewhere and a tenth is gone."""
    known = library.files(spark, sf_dir).selectExpr("id", "path", "concat('i', id) AS identity", "size", "concat(content_hash, id) AS content_hash")
    kind = F.col("id") % 10
    listing = known.where(kind != 3).withColumn("path", F.when(kind.isin(1, 2), F.concat(F.lit("/moved"), "path")).otherwise(F.col("path")))
    listing = listing.withColumn("identity", F.when(kind == 2, F.concat(F.lit("n"), "identity")).otherwise(F.col("identity"))).drop("id")
    return organize.reconciled(known, listing).groupBy("how").agg(F.count("*").alias("n"))


@R.add("SELECT count(*) AS total, count(indexed_at) AS indexed, count(*) - count(indexed_at) AS unindexed FROM files", "files")
def agg01_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.index_counts(library.files(spark, sf_dir))


@R.add("SELECT count(*) AS files, count(indexed_at) AS indexed, cast(sum(greatest(size, 0)) AS bigint) AS bytes, cast(sum(length(content_text)) AS bigint) AS extracted_text_chars FROM files", "files")
def agg02_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summary(library.files(spark, sf_dir))


@R.add("SELECT cast(sum(input_tokens + output_tokens) AS bigint) AS tokens FROM usage", "usage")
def agg03_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.usage(spark, sf_dir).agg(F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"))


@R.add("""WITH a AS (SELECT cast(coalesce(discovered_at, indexed_at, mtime) AS date) AS day, 1 AS a, 0 AS i FROM files UNION ALL SELECT cast(indexed_at AS date), 0, 1 FROM files WHERE indexed_at IS NOT NULL)
  SELECT day, cast(sum(a) AS bigint) AS added, cast(sum(i) AS bigint) AS indexed FROM a GROUP BY day""", "files")
def agg05_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.added_and_indexed(library.files(spark, sf_dir))


@R.add("""WITH d AS (SELECT cast(unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-02-08', INTERVAL 1 DAY)) AS date) AS day),
  u AS (SELECT cast(ts AS date) AS day, sum(input_tokens + output_tokens) AS t FROM usage GROUP BY 1)
  SELECT d.day, cast(coalesce(u.t, 0) AS bigint) AS tokens FROM d LEFT JOIN u USING (day)""", "usage")
def agg06_dense_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = aggregates.per_day(library.usage(spark, sf_dir), F.col("ts"), tokens=F.sum(F.col("input_tokens") + F.col("output_tokens")))
    return aggregates.dense_days(used, "2024-01-10", "2024-02-08", "tokens")


@R.add("SELECT category, cast(sum(greatest(size, 0)) AS bigint) AS bytes, count(*) AS files FROM files GROUP BY category", "files")
def agg07_category_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.category_storage(library.files(spark, sf_dir))


@R.add("""SELECT count(*) AS files, count(indexed_at) AS indexed, cast(sum(greatest(size, 0)) AS bigint) AS bytes, cast(sum(length(content_text)) AS bigint) AS extracted_text_chars,
  (SELECT cast(sum(input_tokens + output_tokens) AS bigint) FROM usage) AS tokens, (SELECT cast(sum(dim * 4) AS bigint) FROM vectors) AS vector_bytes FROM files""", "files", "usage", "vectors")
def agg08_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.dashboard(library.files(spark, sf_dir), library.usage(spark, sf_dir), library.embeddings(spark, sf_dir))


@R.add("SELECT file_id, count(*) AS chunks, max(chunk_idx) + 1 AS next_idx FROM chunks GROUP BY file_id", "chunks")
def agg09_agg13_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.chunks(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("chunks"), (F.max("chunk_idx") + 1).alias("next_idx"))


@R.add("SELECT min(dim) AS dim FROM vectors HAVING count(DISTINCT dim) = 1", "vectors")
def agg10_one_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.one_space(library.embeddings(spark, sf_dir))


@R.add("SELECT model, dim, count(*) AS vectors FROM vectors GROUP BY model, dim", "vectors")
def agg12_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.spaces(library.embeddings(spark, sf_dir))


@R.add(f"""WITH l AS (SELECT DISTINCT duplicate_of_file_id AS id, TRUE AS original FROM files WHERE duplicate_of_file_id IS NOT NULL),
  g AS (SELECT f.content_hash, f.id, f.path, f.size, row_number() OVER (PARTITION BY f.content_hash ORDER BY coalesce(l.original, FALSE) DESC, {ADDED.replace('mtime', 'f.mtime')}, f.mtime, f.path) AS place,
    count(*) OVER (PARTITION BY f.content_hash) AS members, sum(f.size) OVER (PARTITION BY f.content_hash) AS total FROM files f LEFT JOIN l ON l.id = f.id WHERE NOT f.is_directory),
  k AS (SELECT content_hash, id AS kept_id, total - size AS reclaimable FROM g WHERE place = 1 AND members > 1)
  SELECT g.content_hash, g.id, g.path, cast(g.place AS integer) AS place, g.members, k.kept_id, cast(k.reclaimable AS bigint) AS reclaimable FROM g JOIN k USING (content_hash)""", "files")
def agg16_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.duplicate_groups(library.files(spark, sf_dir))


@R.add("""SELECT rating, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'processing') AS processing, count(*) FILTER (state = 'completed') AS completed,
  count(*) FILTER (state = 'failed') AS failed, count(*) AS total FROM feedback GROUP BY rating""", "feedback")
def agg17_agg18_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.states(library.feedback(spark, sf_dir), "rating")


@R.add("""WITH c AS (SELECT source_dir, category, count(*) AS n FROM files GROUP BY ALL)
  SELECT source_dir, category, n AS files FROM (SELECT *, row_number() OVER (PARTITION BY source_dir ORDER BY n DESC, category) AS r FROM c) WHERE r = 1""", "files")
def agg20_majority_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.majority_category(library.files(spark, sf_dir))


@R.add("SELECT source_dir, count(*) AS files, cast(sum(size) AS bigint) AS bytes, max(mtime) AS last_change FROM files WHERE NOT is_directory GROUP BY source_dir", "files")
def agg19_tree_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.tree_snapshot(library.files(spark, sf_dir)).drop("digest")


@R.add("SELECT source_dir, count(*) FILTER (NOT is_directory) AS files, count(*) FILTER (is_directory) AS directories FROM files WHERE ext <> 'zip' GROUP BY source_dir", "files")
def agg26_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = library.files(spark, sf_dir).where("ext <> 'zip'")
    return some.groupBy("source_dir").agg(F.count_if(~F.col("is_directory")).alias("files"), F.count_if("is_directory").alias("directories"))


@R.add("SELECT id, CASE WHEN input_tokens / 1000.0 >= 0.05 THEN round(output_tokens / (input_tokens / 1000.0), 6) END AS speed FROM usage", "usage")
def agg23_generation_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.usage(spark, sf_dir).select("id", F.round(aggregates.tokens_per_second(F.col("output_tokens"), F.lit(0.0), F.col("input_tokens") / 1000), 6).alias("speed"))


@R.add("SELECT round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0.0 END), 6) AS mrr_at_10 FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN event_id % 30 + 1 END AS r FROM events)")
def agg24_retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 30 + 1).alias("rank"))
    return aggregates.quality_at(ranks)


@R.add("SELECT session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS r FROM usage) WHERE r <= 5", "usage")
def win04_newest_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.newest_kept(library.usage(spark, sf_dir).select("session_id", "id"), ["session_id"], [F.desc("id")], 5)


@R.add("SELECT content_hash, min(id) AS id FROM files GROUP BY content_hash", "files")
def win03_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.first_of_each(library.files(spark, sf_dir).select("content_hash", "id"), ["content_hash"], [F.col("id")])


@R.add("""SELECT session_id, id, cast(c AS bigint) AS running_cost FROM (SELECT session_id, id, sum(length(content)) OVER (PARTITION BY session_id ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS c FROM messages) WHERE c <= 400""", "messages")
def win07_fitting_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.fitting_suffix(library.messages(spark, sf_dir), ["session_id"], [F.desc("id")], F.length("content"), 400).select("session_id", "id", "running_cost")


@R.add("SELECT file_id, parent_idx, cast(row_number() OVER (PARTITION BY file_id ORDER BY page_start NULLS LAST, parent_idx) AS integer) AS place FROM parents QUALIFY place <= 12", "parents")
def win05_srt14_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.sections_in_order(library.parents(spark, sf_dir)).select("file_id", "parent_idx", "place")


@R.add("SELECT id, name FROM files ORDER BY size DESC, lower(name), id LIMIT 50", "files")
def srt02_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).orderBy(F.desc("size"), F.lower("name"), "id").limit(50).select("id", "name")


@R.add(f"SELECT id, name FROM files ORDER BY {ADDED} DESC, id LIMIT 60", "files")
def srt01_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir).orderBy(filters.added_at().desc(), tx.natural_key(F.col("name"))).limit(60).select("id", "name")


@R.add("SELECT id, state FROM feedback ORDER BY CASE state WHEN 'failed' THEN 0 WHEN 'processing' THEN 1 WHEN 'pending' THEN 2 ELSE 3 END, id DESC LIMIT 100", "feedback")
def srt09_states_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("state") == "failed", 0).when(F.col("state") == "processing", 1).when(F.col("state") == "pending", 2).otherwise(3)
    return library.feedback(spark, sf_dir).orderBy(rank, F.desc("id")).limit(100).select("id", "state")


@R.add("SELECT id, TRUE AS has_earlier FROM messages WHERE id < 50000 ORDER BY id DESC LIMIT 40", "messages")
def srt10_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.page_before(library.messages(spark, sf_dir).select("id"), "id", 50_000, 40)


@R.add("SELECT id FROM files ORDER BY id OFFSET 40 LIMIT 20", "files")
def srt11_offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.offset_page(library.files(spark, sf_dir).select("id"), ["id"], 40)


@R.add("""WITH h AS (SELECT file_id, chunk_idx, text FROM chunks WHERE contains(lower(text), 'that') ORDER BY length(text) DESC, file_id, chunk_idx LIMIT 400)
  SELECT file_id, chunk_idx, CASE WHEN r = 1 AND c <= 30 THEN 'rerank' ELSE 'tail' END AS lane FROM (
  SELECT *, sum(CASE WHEN r = 1 THEN 1 ELSE 0 END) OVER (ORDER BY length(text) DESC, file_id, chunk_idx ROWS UNBOUNDED PRECEDING) AS c FROM (
  SELECT file_id, chunk_idx, text, row_number() OVER (PARTITION BY file_id ORDER BY length(text) DESC, chunk_idx) AS r FROM h))""", "chunks")
def srt13_rerank_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four hundred longest hits, as a lane gives them, parted for a model."""
    order = [F.length("text").desc(), "file_id", "chunk_idx"]
    hits = library.chunks(spark, sf_dir).where(filters.any_contains(("text",), ("that",))).select("file_id", "chunk_idx", "text", F.lit(1).alias("query_id"))
    return rows.split_candidates(hits.orderBy(*order).limit(400), "query_id", order, 30).select("file_id", "chunk_idx", "lane")


@R.add("""SELECT p_partkey AS id FROM part WHERE p_brand <> 'x' ORDER BY p_size DESC, cast(split_part(concat(p_size % 7, '.', p_partkey % 13), '.', 1) AS integer) DESC, p_partkey % 13 DESC, p_partkey LIMIT 40""")
def srt15_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size AS build", "concat(p_size % 7, '.', p_partkey % 13) AS version", "timestamp_seconds(0) AS published_at", "'universal' AS architecture")
    return organize.releases_in_order(made, F.lit(True)).limit(40).select("id")


@R.add("SELECT DISTINCT model, dim FROM (SELECT model, dim FROM vectors WHERE id % 2 = 0 UNION ALL SELECT model, dim FROM vectors WHERE id % 3 = 0)", "vectors")
def set01_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = library.embeddings(spark, sf_dir).select("id", "model", "dim")
    return v.where("id % 2 = 0").union(v.where("id % 3 = 0")).select("model", "dim").distinct()


@R.add("SELECT id FROM files WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 0) AND id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)", "files")
def set03_set04_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("id"))
    third = library.embeddings(spark, sf_dir).where("label = 3").select("id")
    return library.files(spark, sf_dir).select("id").join(clean, "id", "left_semi").join(third, "id", "left_anti")


@R.add("""SELECT conv_id, count(DISTINCT turn) FILTER (role = 'user' AND turn NOT IN (0, 1, 2)) AS extra FROM conversations GROUP BY conv_id""")
def set05_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", F.col("turn"))).alias("turns"))
    checked = done.select("conv_id", organize.coverage(F.array(*(F.lit(i).cast("long") for i in range(3))), F.col("turns")).alias("c"))
    return checked.select("conv_id", F.size("c.unexpected").cast("long").alias("extra"))


@R.add("""SELECT id, CASE WHEN id % 3 = 0 THEN concat(name, '!') ELSE name END AS name, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'fresh' ELSE note END AS note FROM files
  UNION ALL SELECT id + 1000000, concat(name, '!'), NULL FROM files WHERE id % 10 = 0""", "files")
def snk01_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = library.files(spark, sf_dir).select("id", "name", "note")
    new = old.where("id % 3 = 0").select("id", F.concat("name", F.lit("!")).alias("name"), F.when(F.col("id") % 2 == 0, "fresh").alias("note"))
    added = old.where("id % 10 = 0").select((F.col("id") + 1_000_000).alias("id"), F.concat("name", F.lit("!")).alias("name"), F.lit(None).cast("string").alias("note"))
    return snapshots.upsert(old, new.unionByName(added), "id", keep=("note",))


@R.add("SELECT file_id, chunk_idx, text FROM chunks WHERE file_id % 4 <> 0 UNION ALL SELECT DISTINCT file_id, 0, 'new' FROM chunks WHERE file_id % 4 = 0", "chunks")
def snk04_replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = library.chunks(spark, sf_dir).select("file_id", "chunk_idx", "text")
    new = old.where("file_id % 4 = 0").select("file_id", F.lit(0).alias("chunk_idx"), F.lit("new").alias("text")).distinct()
    return snapshots.replaced(old, new, "file_id")


@R.add("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def snk06_newest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.newest_revisions(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@R.add("""WITH n AS (SELECT file_id, coalesce(min(chunk_idx) FILTER (kind = 'note'), max(chunk_idx) + 1) AS chunk_idx FROM chunks WHERE file_id % 9 = 0 GROUP BY file_id)
  SELECT file_id, chunk_idx, kind, text FROM chunks WHERE kind <> 'note' OR file_id % 9 <> 0 UNION ALL SELECT file_id, chunk_idx, 'note', 'my note' FROM n""", "chunks")
def snk07_note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = library.chunks(spark, sf_dir).select("file_id", "chunk_idx", "kind", "text")
    return snapshots.with_note_chunk(old, old.where("file_id % 9 = 0").select("file_id", F.lit("my note").alias("text")).distinct())


@R.add("SELECT file_id, chunk_idx FROM chunks WHERE file_id NOT IN (SELECT id FROM files WHERE ext = 'zip')", "files", "chunks")
def snk17_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = library.files(spark, sf_dir).where("ext = 'zip'").select("id")
    return snapshots.without(library.chunks(spark, sf_dir).select("file_id", "chunk_idx"), gone, "id", own="file_id")


@R.add("SELECT model, cast(max(id) AS bigint) AS id, max(CASE WHEN model IN ('click', 'view') THEN 2 ELSE 1 END) AS version FROM usage GROUP BY model", "usage")
def snk26_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = library.usage(spark, sf_dir).groupBy("model").agg(F.max("id").alias("id")).withColumn("version", F.lit(1))
    return snapshots.bumped(old, old.where("model IN ('click', 'view')"), "model", ("version",))


@R.add("SELECT id, CASE WHEN ext = 'zip' THEN 'packed' ELSE category END AS category FROM files", "files")
def snk37_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.patched(library.files(spark, sf_dir).select("id", "ext", "category"), F.col("ext") == "zip", {"category": F.lit("packed")}, ("category", "note")).select("id", "category")


@R.add("SELECT ts AS at, event_type AS model, cast(n AS bigint) AS n FROM (SELECT cast(date_trunc('day', ts) AS timestamp) AS ts, event_type, count(*) AS n FROM events GROUP BY ALL)")
def stm17_usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.streaming.watching import usage_windows

    return usage_windows(table(spark, sf_dir, "events")).select(F.col("start").alias("at"), F.col("event_type").alias("model"), "n")


_RUNS = """o AS (SELECT concat('p', user_id % 40) AS path, ts, event_id, cast(floor(value / 60) AS bigint) AS size FROM events),
  s AS (SELECT *, CASE WHEN lag(size) OVER w = size THEN 0 ELSE 1 END AS n FROM o WINDOW w AS (PARTITION BY path ORDER BY ts)),
  r AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY ts) AS run FROM s),
  b AS (SELECT path, run, size, ts, min(ts) OVER (PARTITION BY path, run) AS since FROM r)"""


@R.add(f"WITH {_RUNS} SELECT path, max(size) AS size, min(ts) AS observed_at FROM b WHERE ts >= since + INTERVAL 2 SECOND GROUP BY path, run")
def stm01_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.streaming.watching import stable_in_batch

    seen = table(spark, sf_dir, "events").selectExpr("concat('p', user_id % 40) AS path", "cast(floor(value / 60) AS bigint) AS size", "timestamp_seconds(0) AS changed_at", "cast(ts AS timestamp) AS observed_at")
    return stable_in_batch(seen)


@R.add("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def stm10_latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.streaming.watching import latest_generation

    e = table(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("k"), "user_id", "event_type", "event_id")
    return latest_generation(e, "k", "event_id").select("user_id", "event_type", "event_id")


@R.add("SELECT id, CASE WHEN r <= 10 AND c >= 0.7 THEN 'good' ELSE 'bad' END AS rating FROM (SELECT id, id % 15 + 1 AS r, (id % 100) / 100.0 AS c FROM feedback)", "feedback")
def fbk01_default_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.feedback(spark, sf_dir).select("id", organize.default_rating(F.col("id") % 15 + 1, (F.col("id") % 100) / 100.0).alias("rating"))


#: Joins and aggregates over the star tables.
@R.add("""SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def star_orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
