"""Queries over listings: structured filters one by one, lookups, joins, totals, orders and pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import filters, organize, retrieval, rows
from lectern.operators.filters import FileFilter
from lectern.plans.registry import Registry
from lectern.session import table
from lectern.sources import library

R = Registry()
ADDED = "coalesce(discovered_at, organized_at, indexed_at, mtime)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir)


def _filtered(spark: SparkSession, sf_dir: str, wanted: FileFilter) -> DataFrame:
    return _files(spark, sf_dir).where(wanted.column())


@R.add("SELECT id, path FROM files WHERE lower(name) = 'doc_17.pdf'", "files")
def flt02_exact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, FileFilter(name="DOC_17.PDF")).select("id", "path")


@R.add("SELECT id, ext, category FROM files WHERE ext IN ('md', 'py') AND category IN ('document', 'code')", "files")
def flt03_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, FileFilter(extensions=(".MD", "py"), categories=("document", "code"))).select("id", "ext", "category")


@R.add("SELECT id, path FROM files WHERE contains(lower(concat(source_dir, chr(10), path, chr(10), coalesce(organization_subfolder, ''))), 'src1') AND contains(lower(concat(source_dir, chr(10), path, chr(10), coalesce(organization_subfolder, ''))), 'topic e')", "files")
def flt04_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, FileFilter(folder_terms=("SRC1", "topic E"))).select("id", "path")


@R.add("SELECT id FROM files WHERE is_directory", "files")
def flt05_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, FileFilter(directory=True)).select("id")


@R.add(f"""SELECT id, 'modified' AS field FROM files WHERE mtime >= TIMESTAMP '2024-01-01 02:00:00' AND mtime < TIMESTAMP '2024-01-01 09:00:00'
  UNION ALL SELECT id, 'added' FROM files WHERE {ADDED} >= TIMESTAMP '2024-01-01 02:00:00' AND {ADDED} < TIMESTAMP '2024-01-01 09:00:00'
  UNION ALL SELECT id, 'organized' FROM files WHERE organized_at >= TIMESTAMP '2024-01-01 02:00:00' AND organized_at < TIMESTAMP '2024-01-01 09:00:00'""", "files")
def flt06_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = (datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 9))
    parts = [_filtered(spark, sf_dir, FileFilter(**{f: span})).select("id", F.lit(f).alias("field")) for f in ("modified", "added", "organized")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add("SELECT id, size FROM files WHERE size BETWEEN 0 AND 900", "files")
def flt07_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that stand the wrong way round, one of them below zero."""
    return _filtered(spark, sf_dir, FileFilter(size=(900, -4))).select("id", "size")


@R.add("SELECT v.vec_id AS file_id FROM embeddings v WHERE v.vec_id IN (SELECT id FROM files WHERE category = 'document' AND indexed_at IS NOT NULL)", "files")
def flt10_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that a filter leaves, without a limit, as the scope of vectors."""
    scope = _filtered(spark, sf_dir, FileFilter(categories=("document",), indexed=True)).select(F.col("id").alias("file_id"))
    return library.embeddings(spark, sf_dir).select("file_id").join(scope, "file_id", "left_semi")


@R.add("SELECT id, strip_accents(lower(title)) = strip_accents(lower(title)) AND (contains(strip_accents(lower(path)), 'src2')) AS fits FROM files WHERE ext = 'txt'", "files")
def flt11_folded_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter again, blind to marks as well, over candidates."""
    some = _filtered(spark, sf_dir, FileFilter(extensions=("txt",)))
    return some.select("id", F.contains(tx.folded(F.col("path")), F.lit(tx.fold("SRC2"))).alias("fits"))


@R.add("SELECT id FROM files WHERE contains(lower(content_text), '100%') OR contains(lower(name), '100%') OR contains(lower(path), 'c_1') OR contains(lower(name), 'c_1')", "files")
def flt13_literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent signs and low lines stand for themselves."""
    hit = tx.like_literal(F.col("content_text"), "100%") | tx.like_literal(F.col("name"), "100%") | tx.like_literal(F.col("path"), "c_1") | tx.like_literal(F.col("name"), "c_1")
    return _files(spark, sf_dir).where(hit).select("id")


@R.add("SELECT file_id, chunk_idx FROM chunks WHERE chunk_idx BETWEEN 3 AND 6", "chunks")
def flt15_index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.chunks(spark, sf_dir).where(F.col("chunk_idx").between(3, 6)).select("file_id", "chunk_idx")


@R.add("SELECT id FROM files WHERE (starts_with(lower(path), '/library/src1/') OR lower(path) = '/library/src1') AND category IN ('document', 'archive')", "files")
def flt17_flt27_managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(filters.under(F.col("path"), "/Library/src1/") & F.col("category").isin("document", "archive")).select("id")


@R.add("SELECT f.id FROM files f WHERE f.name NOT IN (SELECT concat('doc_', doc_id, '.md') FROM documents WHERE doc_id % 2 = 1)", "files")
def flt21_not_in_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a folder's baseline lacks."""
    baseline = table(spark, sf_dir, "documents").where("doc_id % 2 = 1").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"))
    return _files(spark, sf_dir).select("id", "name").join(baseline, "name", "left_anti").select("id")


@R.add("SELECT id, path = '/library/src1' OR starts_with(path, '/library/src1/') OR path = '/library/src3' OR starts_with(path, '/library/src3/') AS inside FROM files", "files")
def flt23_source_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("id", organize.in_sources(F.col("path"), F.array(F.lit("/library/src1"), F.lit("/library/src3"))).alias("inside"))


_RELEASES = """SELECT p_partkey AS id, concat(p_partkey % 4, '.', p_size, '.', p_partkey % 7) AS version, p_size % 5 AS build, 'macos' AS platform, CASE p_partkey % 3 WHEN 0 THEN 'beta' ELSE 'stable' END AS channel,
  CASE p_partkey % 4 WHEN 0 THEN 'arm64' WHEN 1 THEN 'x86_64' WHEN 2 THEN 'universal' ELSE 'vax' END AS architecture, concat(CASE p_partkey % 5 WHEN 0 THEN 'http' ELSE 'https' END, '://example.org/', p_partkey) AS url,
  CASE p_partkey % 6 WHEN 0 THEN 'short' ELSE {sha} END AS sha256 FROM part"""


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _RELEASES.format(sha="sha2(cast(p_partkey AS string), 256)")
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


_RELEASES_SQL = "releases AS (" + _RELEASES.format(sha="sha256(cast(p_partkey AS varchar))") + ")"


@R.add(f"WITH {_RELEASES_SQL} SELECT id FROM releases WHERE platform = 'macos' AND channel = 'stable' AND architecture IN ('arm64', 'universal')")
def flt25_compatible_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _releases(spark, sf_dir).where(filters.ReleaseFilter("macos", "stable", "arm64").column()).select("id")


@R.add(f"""WITH {_RELEASES_SQL} SELECT id, cast(CASE WHEN architecture NOT IN ('arm64', 'x86_64', 'universal') THEN 1 ELSE 0 END + CASE WHEN NOT starts_with(url, 'https://') THEN 1 ELSE 0 END
  + CASE WHEN NOT regexp_full_match(sha256, '[0-9a-f]{{64}}') THEN 1 ELSE 0 END AS integer) AS errors FROM releases""")
def flt30_release_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _releases(spark, sf_dir).select("id", F.size(filters.release_errors()).alias("errors"))


@R.add(f"WITH {_RELEASES_SQL} SELECT id, build > 2 OR (build = 2 AND (id % 4 > 1 OR (id % 4 = 1 AND (p_size > 10 OR (p_size = 10 AND id % 7 > 0))))) AS newer FROM releases JOIN part ON p_partkey = id")
def srt16_newer_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _releases(spark, sf_dir).select("id", organize.is_newer(F.col("build"), F.col("version"), 2, "1.10.0").alias("newer"))


@R.add("SELECT f.id, f.name FROM files f JOIN (SELECT DISTINCT concat('/library/', source, '/doc_', doc_id, '.md') AS p FROM documents WHERE doc_id % 3 = 0) w ON f.path = w.p OR f.path = concat('/private', w.p)", "files")
def src08_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a set of paths, each also under its other name: an equality join on the names."""
    wanted = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").selectExpr("concat('/library/', source, '/doc_', doc_id, '.md') AS path").distinct()
    names = wanted.select(F.explode(F.array("path", F.concat(F.lit("/private"), "path"))).alias("path"))
    return _files(spark, sf_dir).select("id", "name", "path").join(names, "path").select("id", "name")


@R.add("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: cast(x AS double))), 4) AS total FROM embeddings")
def src13_binary_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors kept as little-endian 32-bit floats, read back."""
    from lectern.functions.vectors import from_bytes, to_bytes

    kept = library.embeddings(spark, sf_dir).select("id", to_bytes(F.col("embedding")).alias("blob"))
    total = F.aggregate(from_bytes(F.col("blob")), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return kept.select("id", F.round(total, 4).alias("total"))


@R.add("SELECT n_nationkey AS id, n_name AS pattern, n_regionkey AS priority FROM nation ORDER BY n_regionkey DESC, n_nationkey")
def src15_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, the highest priority first (nations stand in for them)."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("pattern"), F.col("n_regionkey").alias("priority")).orderBy(F.desc("priority"), "id")


@R.add("SELECT p_brand AS key, max(p_retailprice) AS value FROM part GROUP BY p_brand HAVING p_brand = (SELECT min(p_brand) FROM part)")
def src18_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key of a table of keys and values (brands and their highest price)."""
    settings = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(F.max("p_retailprice").alias("value"))
    return settings.orderBy("key").limit(1)


_HISTORY = "SELECT conv_id * 100 + turn AS id, text AS query, turn % 2 = 0 AS is_history, conv_id % 3 AS revision, {at} AS updated_at FROM conversations"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _HISTORY.format(at=f"timestamp_seconds({library.EPOCH} + conv_id * 60 + turn)")
    return spark.sql(sql.replace("FROM conversations", "FROM {told}"), told=table(spark, sf_dir, "conversations"))


_HISTORY_SQL = "history AS (" + _HISTORY.format(at=f"make_timestamp(({library.EPOCH} + conv_id * 60 + turn) * 1000000)") + ")"


@R.add(f"WITH {_HISTORY_SQL} SELECT id, updated_at, revision = (SELECT max(revision) FROM history) AS valid FROM history WHERE is_history ORDER BY updated_at DESC, id DESC LIMIT 100")
def src19_search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest searches, at most a hundred, with whether their results still hold."""
    history = _history(spark, sf_dir)
    now = history.agg(F.max("revision").alias("now"))  # one row
    return rows.offset_page(history.where("is_history"), [F.desc("updated_at"), F.desc("id")], 0, 500, 100).crossJoin(F.broadcast(now)).select("id", "updated_at", (F.col("revision") == F.col("now")).alias("valid"))


@R.add("SELECT event_id AS id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def src20_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.offset_page(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts"), [F.desc("ts"), F.desc("id")], 0, 9_999, 500)


@R.add("SELECT f.id, concat(c.c_nationkey, ':', c.c_custkey) AS identity FROM files f JOIN customer c ON c.c_custkey = f.id", "files")
def src40_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with what identifies them on their device (customers stand in for it)."""
    identities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(":", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("identity"))
    return _files(spark, sf_dir).select("id").join(identities, "id")


@R.add("SELECT l_partkey AS file_id FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_linestatus = 'O') AND l_linestatus <> 'F' ORDER BY l_linenumber")
def src42_job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the earliest open job that aren't done (orders stand in for jobs)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_linestatus").where("l_linestatus <> 'F'")
    job = lines.agg(F.min("l_orderkey").alias("l_orderkey"))  # one row
    return lines.join(F.broadcast(job), "l_orderkey", "left_semi").orderBy("l_linenumber").select(F.col("l_partkey").alias("file_id"))


@R.add("SELECT path FROM files WHERE source_dir = '/library/src2' AND NOT is_directory", "files")
def src43_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where("source_dir = '/library/src2' AND NOT is_directory").select("path")


@R.add("SELECT f.id, f.name, round(sum(n), 0) AS hits FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w = 'that')) AS n FROM documents) d JOIN files f ON f.id = d.doc_id WHERE n > 0 GROUP BY f.id, f.name", "files")
def join04_postings_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of one word, joined to their files after the word has been looked up."""
    files = _files(spark, sf_dir)
    postings = retrieval.inverted(files.select("id", *retrieval.FIELD_WEIGHTS)).where("word = 'that' AND field = 'content_text'")
    return postings.select("id", F.col("tf").cast("double").alias("hits")).join(files.select("id", "name"), "id")


@R.add("SELECT c.file_id, c.chunk_idx, p.children FROM chunks c LEFT JOIN parents p USING (file_id, parent_idx) WHERE (c.file_id, c.chunk_idx) IN (SELECT file_id, chunk_idx FROM chunks WHERE contains(lower(text), 'that') ORDER BY file_id, chunk_idx LIMIT 200)", "chunks", "parents")
def join05_candidates_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 200 candidate chunks, joined to their chunks and parents."""
    chunks = library.chunks(spark, sf_dir)
    few = chunks.where(retrieval.count_terms(F.col("text"), ["that"]) > 0).select("file_id", "chunk_idx").orderBy("file_id", "chunk_idx").limit(200)
    whole = chunks.select("file_id", "chunk_idx", "parent_idx").join(F.broadcast(few), ["file_id", "chunk_idx"])
    return whole.join(library.parents(spark, sf_dir).select("file_id", "parent_idx", "children"), ["file_id", "parent_idx"], "left").select("file_id", "chunk_idx", "children")


@R.add("SELECT f.id, cast(min(o.o_orderdate) AS date) AS created FROM files f JOIN orders o ON o.o_custkey = f.id GROUP BY f.id", "files")
def join06_creation_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.to_date(F.min("o_orderdate")).alias("created"))
    return _files(spark, sf_dir).select("id").join(created, "id")


@R.add("SELECT id, id IN (SELECT doc_id FROM labels WHERE quality = 1) AS staged FROM files WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "files")
def join10_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    left = _files(spark, sf_dir).select("id").join(labels.where("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_anti")
    good = labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("staged")).distinct()
    return left.join(good, "id", "left").select("id", F.coalesce("staged", F.lit(False)).alias("staged"))


@R.add("SELECT id, coalesce((SELECT max(quality) FROM labels l WHERE l.doc_id = f.id), -1) AS quality, coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = f.id), -1) AS toxic FROM files f", "files")
def join11_scalar_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values of another table for each row: one grouping and one join."""
    found = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return _files(spark, sf_dir).select("id").join(found, "id", "left").select("id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@R.add("SELECT q, file_id, chunk_idx FROM chunks, (VALUES (1, 'that'), (2, 'secret')) v(q, t) WHERE contains(lower(text), t)", "chunks")
def join17_terms_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a few stated terms each chunk holds: one projection, no join."""
    held = F.filter(F.array(*(F.when(F.contains(F.lower("text"), F.lit(t)), F.lit(i)) for i, t in ((1, "that"), (2, "secret")))), lambda x: x.isNotNull())
    return library.chunks(spark, sf_dir).select(F.explode(held).alias("q"), "file_id", "chunk_idx")


@R.add("SELECT a.id, min(b.id) AS twin FROM files a JOIN files b ON a.size = b.size AND a.content_hash = b.content_hash AND a.id > b.id GROUP BY a.id", "files")
def join20_same_size_and_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file of the same size and content for each later one, without meeting all pairs of a content."""
    files = _files(spark, sf_dir).select("id", "size", "content_hash")
    first = files.groupBy("size", "content_hash").agg(F.min("id").alias("twin"), F.count("*").alias("n")).where("n > 1").drop("n")
    return files.join(first, ["size", "content_hash"]).where("id > twin").select("id", "twin")


@R.add("SELECT sum(4 * len(embedding)) AS bytes FROM embeddings")
def agg04_vector_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.embeddings(spark, sf_dir).agg(F.sum(F.size("embedding") * F.lit(4).cast("long")).alias("bytes"))


@R.add("SELECT DISTINCT model FROM vectors", "vectors")
def agg11_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.embeddings(spark, sf_dir).select("model").distinct()


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@R.add(f"""WITH t AS (SELECT vec_id % 40 AS file_id, vec_id AS chunk_idx, round(list_cosine_similarity(cast(embedding AS double[]), cast({_Q} AS double[])), 6) AS score FROM embeddings ORDER BY score DESC, file_id, chunk_idx LIMIT 40)
  SELECT file_id, max(score) AS score FROM t GROUP BY file_id ORDER BY score DESC, file_id LIMIT 10""")
def agg14_best_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten files by their best chunk among the forty nearest."""
    v = library.embeddings(spark, sf_dir).select((F.col("id") % 40).alias("file_id"), F.col("id").alias("chunk_idx"), "embedding")
    query = list(library.embeddings(spark, sf_dir).where("id = 0").select("embedding").first()[0])
    return retrieval.nearest_files(v, query, 10)


@R.add(f"SELECT vec_id AS file_id, 0 AS chunk_idx, round(list_cosine_similarity(cast(embedding AS double[]), cast({_Q} AS double[])), 6) AS score FROM embeddings WHERE vec_id = 7")
def ret11_nearest_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = library.embeddings(spark, sf_dir)
    query = list(v.where("id = 0").select("embedding").first()[0])
    return retrieval.nearest(v.where("file_id = 7"), query, 6)


@R.add("SELECT sum(octet_length(encode(text))) AS bytes, count(*) AS entries FROM documents")
def agg27_storage_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("entries"))


_RESULTS = """SELECT id, name, mtime, size, category, is_directory, (id * 37 % 101) / 100.0 AS confidence, (id * 17 % 89) / 10.0 AS score,
  CASE id % 6 WHEN 0 THEN 'content' WHEN 1 THEN 'fileName' WHEN 2 THEN 'path' WHEN 3 THEN 'title' WHEN 4 THEN 'note' ELSE 'semantic' END AS kind FROM files"""
_RESULTS_SQL = f"results AS ({_RESULTS})"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RESULTS.replace("FROM files", "FROM {files}"), files=_files(spark, sf_dir))


@R.add(f"WITH {_RESULTS_SQL} SELECT id, row_number() OVER (ORDER BY confidence DESC, score DESC, lower(name), id) AS place FROM results QUALIFY place <= 200", "files")
def srt03_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.placed(_results(spark, sf_dir), [F.desc("confidence"), F.desc("score"), F.lower("name"), F.col("id")], 200).select("id", "place")


_TIER = "CASE WHEN kind IN ('content', 'note') THEN 5 WHEN kind = 'fileName' AND confidence = 1 THEN 6 WHEN kind IN ('fileName', 'path') THEN 3 WHEN kind = 'title' THEN 2 WHEN kind = 'semantic' THEN 1 ELSE 0 END"


@R.add(f"WITH {_RESULTS_SQL} SELECT id, {_TIER} AS tier, row_number() OVER (ORDER BY {_TIER} DESC, mtime DESC, id) AS place FROM results QUALIFY place <= 200", "files")
def srt05_recent_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = retrieval.recency_tier(F.col("kind"), F.col("confidence"))
    return rows.placed(_results(spark, sf_dir).withColumn("tier", tier), [F.desc("tier"), F.desc("mtime"), F.col("id")], 200).select("id", "tier", "place")


@R.add(f"""WITH {_RESULTS_SQL} SELECT 'newest' AS planned, id FROM (SELECT id FROM results ORDER BY mtime DESC, id LIMIT 20) UNION ALL SELECT 'oldest', id FROM (SELECT id FROM results ORDER BY mtime, id LIMIT 20)
  UNION ALL SELECT 'largest', id FROM (SELECT id FROM results ORDER BY size DESC, id LIMIT 20) UNION ALL SELECT 'smallest', id FROM (SELECT id FROM results ORDER BY size, id LIMIT 20)""", "files")
def srt06_srt12_planned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of twenty in each order that a plan can ask for."""
    out = None
    for planned in ("newest", "oldest", "largest", "smallest"):
        page = _results(spark, sf_dir).orderBy(*rows.planned_order(planned)).limit(20).select(F.lit(planned).alias("planned"), "id")
        out = page if out is None else out.unionByName(page)
    return out


@R.add(f"SELECT vec_id AS id, round(list_distance(cast(embedding AS double[]), cast({_Q} AS double[])), 5) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 15")
def srt07_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.vectors import distance

    v = library.embeddings(spark, sf_dir)
    query = list(v.where("id = 0").select("embedding").first()[0])
    return v.select("id", F.round(distance(F.col("embedding"), F.lit([float(x) for x in query])), 5).alias("distance")).orderBy("distance", "id").limit(15)


@R.add(f"SELECT id, added FROM (SELECT id, {ADDED} AS added, len(list_filter(regexp_split_to_array(lower(content_text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w = 'that')) AS n FROM files) WHERE n > 0 ORDER BY n DESC, added DESC, id LIMIT 100", "files")
def srt08_by_words_then_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    postings = retrieval.inverted(files.select("id", *retrieval.FIELD_WEIGHTS)).where("word = 'that' AND field = 'content_text'")
    added = files.select("id", filters.added_at().alias("added"))
    return postings.select("id", "tf").join(added, "id").orderBy(F.desc("tf"), F.desc("added"), "id").limit(100).select("id", "added")


@R.add("SELECT event_id AS id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY ORDER BY ts DESC, event_id DESC LIMIT 2000")
def srt18_pruned_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the last ten days, the newest two thousand of them."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    last = events.agg(F.max("ts").alias("last"))  # one row
    return events.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 10 DAYS")).orderBy(F.desc("ts"), F.desc("id")).limit(2000).select("id")


@R.add(f"SELECT content_hash, arg_min(id, struct_pack(a := {ADDED}, b := mtime, c := path)) AS oldest FROM files GROUP BY content_hash HAVING count(*) > 1", "files")
def srt19_oldest_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct(filters.added_at().alias("a"), F.col("mtime").alias("b"), F.col("path").alias("c"))
    return _files(spark, sf_dir).groupBy("content_hash").agg(F.min_by("id", order).alias("oldest"), F.count("*").alias("n")).where("n > 1").drop("n")


@R.add("SELECT conv_id AS job, count(*) = count(DISTINCT turn) AND count(*) = count(CASE WHEN trim(role) <> '' THEN 1 END) AS valid, string_agg(turn, ',' ORDER BY turn) AS ids FROM conversations GROUP BY conv_id")
def set06_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests in order, valid if no id is blank or comes twice (turns of conversations stand in for entries)."""
    entries = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("place"), F.col("turn").cast("string").alias("id"), "role")
    return organize.manifests(entries, "job")


@R.add("""WITH w AS (SELECT id, cast(contains(lower(content_text), 'that') AS integer) + cast(contains(lower(content_text), 'secret') AS integer) AS n, contains(lower(concat(name, chr(10), path)), '_1') AS short FROM files),
  l AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS r FROM w WHERE n > 0), s AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM w WHERE short),
  a AS (SELECT id, 1 AS lane, r FROM l WHERE r <= 75 UNION ALL SELECT id, 2, r FROM s WHERE r <= 25)
  SELECT id, min(lane) AS lane FROM a GROUP BY id""", "files")
def ret05_keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred candidates for several keywords, a quarter of them kept for short ones."""
    return retrieval.keyword_candidates(_files(spark, sf_dir), ("That", "secret", "_1"), 100)


@R.add("SELECT gram, count(*) AS files FROM (SELECT DISTINCT id, unnest(list_transform(range(1, length(name) - 1), lambda i: substr(lower(name), i, 3))) AS gram FROM files) GROUP BY gram", "files")
def ret01_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigram index of names: gram, file, field; here how many files have each gram."""
    grams = retrieval.trigrams(_files(spark, sf_dir), ("name",))
    return grams.groupBy("gram").agg(F.count("*").alias("files"))


@R.add("SELECT DISTINCT file_id FROM (SELECT file_id, chunk_idx FROM chunks WHERE contains(lower(text), 'that') AND contains(lower(text), 'the'))", "chunks")
def ret03_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = library.chunks(spark, sf_dir).where(retrieval.count_terms(F.col("text"), ["that", "the"]) == 2)
    return some.select("file_id").distinct()


@R.add(f"WITH {_RESULTS_SQL} SELECT id, CASE WHEN kind = 'fileName' AND confidence = 1 THEN 'fileName' WHEN id % 5 = 0 AND (id % 2 = 0 OR id % 3 = 0) THEN 'hybrid' WHEN id % 5 = 0 THEN 'entity' WHEN id % 2 = 0 AND id % 3 = 0 THEN 'hybrid' WHEN id % 2 = 0 THEN kind WHEN id % 3 = 0 THEN 'semantic' ELSE 'filter' END AS match FROM results", "files")
def ret20_match_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    match = retrieval.match_kind((F.col("kind") == "fileName") & (F.col("confidence") == 1), i % 2 == 0, i % 3 == 0, i % 5 == 0, F.col("kind"), F.lit(False))
    return _results(spark, sf_dir).select("id", match.alias("match"))


@R.add("SELECT file_id, chunk_idx, CASE WHEN contains(l, 'that') THEN 'demonstrative:that' ELSE '' END || CASE WHEN contains(l, 'that') AND contains(l, 'secret') THEN '|' ELSE '' END || CASE WHEN contains(l, 'secret') THEN 'hidden:secret' ELSE '' END AS evidence FROM (SELECT file_id, chunk_idx, lower(text) AS l FROM chunks)", "chunks")
def ret21_keyword_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three pieces of evidence, each once: a concept and the first of its words that occurs."""
    concepts = {"demonstrative": ("that",), "hidden": ("secret", "concealed"), "Demonstrative": ("that",)}
    return library.chunks(spark, sf_dir).select("file_id", "chunk_idx", F.array_join(retrieval.keyword_evidence(F.col("text"), concepts), "|").alias("evidence"))


@R.add("SELECT file_id, chunk_idx FROM chunks WHERE contains(lower(text), 'that') AND NOT EXISTS (SELECT 1 FROM files WHERE contains(lower(name), 'nowhere')) ORDER BY file_id, chunk_idx LIMIT 50", "files", "chunks")
def ret24_deferred_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the longest terms, only if no lane has found anything."""
    lane = _files(spark, sf_dir).where(F.contains(F.lower("name"), F.lit("nowhere"))).select("id")
    hits = library.chunks(spark, sf_dir).where(retrieval.count_terms(F.col("text"), ["that"]) > 0).select("file_id", "chunk_idx").orderBy("file_id", "chunk_idx").limit(50)
    return retrieval.if_empty(lane, hits)
