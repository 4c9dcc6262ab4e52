"""Queries over writes: each gives the next state of a table, or of several, after a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import filters, snapshots
from lectern.plans.registry import Registry
from lectern.session import table
from lectern.sources import library

R = Registry()


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.files(spark, sf_dir)


@R.add("""SELECT id, CASE WHEN id % 10 = 0 THEN concat(name, '.new') ELSE name END AS name, CASE WHEN id % 7 = 0 THEN NULL ELSE indexed_at END AS indexed_at, CASE WHEN id % 7 = 0 THEN NULL ELSE index_signature END AS index_signature
  FROM (SELECT id, name, indexed_at, index_signature FROM files UNION ALL SELECT id + 10000000, name, indexed_at, index_signature FROM files WHERE id % 100 = 1)""", "files")
def snk03_bulk_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed and new files and stale indexes in one write."""
    old = _files(spark, sf_dir).select("id", "name", "indexed_at", "index_signature")
    renamed = old.where("id % 10 = 0").withColumn("name", F.concat("name", F.lit(".new")))
    new = old.where("id % 100 = 1").withColumn("id", F.col("id") + 10_000_000)
    new = new.withColumn("name", F.when(F.col("id") % 10 == 0, F.concat("name", F.lit(".new"))).otherwise(F.col("name")))
    stale = old.unionByName(new).where("id % 7 = 0").select("id")
    return snapshots.reconciled_writes(old, renamed.unionByName(new), stale)


@R.add("SELECT model, dim, count(*) AS others FROM vectors WHERE model <> 'model0' OR dim <> 64 GROUP BY ALL", "vectors")
def snk05_other_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would make a write to one vector space fail: vectors of others."""
    return snapshots.other_spaces(library.embeddings(spark, sf_dir), "model0", 64)


@R.add("SELECT id AS file_id FROM vectors WHERE NOT (id % 5 = 0 AND label <= 3)", "vectors")
def snk08_removed_if_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of removed files go, but for those that were written after the removal (labels stand in for revisions)."""
    v = library.embeddings(spark, sf_dir).select("file_id", F.col("label").alias("revision"))
    removals = v.where("file_id % 5 = 0").select("file_id", F.lit(3).alias("until"))
    return snapshots.removed_until(v, removals, "file_id", "revision", "until").select("file_id")


@R.add("SELECT 'vectors' AS relation, 0 AS n UNION ALL SELECT 'chunks', 0 UNION ALL SELECT 'parents', count(*) FROM parents", "parents")
def snk09_cleared_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and chunks go, parents stay."""
    gone = {"vectors": library.embeddings(spark, sf_dir).select("file_id"), "chunks": library.chunks(spark, sf_dir).select("file_id")}
    counts = [snapshots.cleared(rows).agg(F.lit(name).alias("relation"), F.count("*").alias("n")) for name, rows in gone.items()]
    return counts[0].unionByName(counts[1]).unionByName(library.parents(spark, sf_dir).agg(F.lit("parents").alias("relation"), F.count("*").alias("n")))


@R.add("SELECT v.id, round(list_sum(list_transform(n.embedding, lambda x: cast(x AS double))), 4) AS total, v.model FROM vectors v JOIN embeddings n ON n.vec_id = v.id + 1", "vectors")
def snk10_replaced_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector replaced by a new one (the next file's), with the chunks that it belongs to kept; a file without a new one has none."""
    v = library.embeddings(spark, sf_dir)
    fresh = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("fresh"))
    swapped = v.drop("embedding").join(fresh, "id")
    return swapped.select("id", F.round(F.aggregate("fresh", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"), "model")


@R.add("SELECT vec_id AS id, cast(list_sum(list_transform(range(1, 9), lambda i: CASE WHEN embedding[i] > 0 THEN 1 << cast(i - 1 AS integer) ELSE 0 END)) AS bigint) AS cell FROM embeddings")
def snk11_rebuilt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse cell of each vector, from the signs of its first dimensions: searches can leave whole cells out."""
    from lectern.functions.vectors import sign_cell

    return library.embeddings(spark, sf_dir).select("id", sign_cell(F.col("embedding"), 8).alias("cell"))


@R.add("SELECT id FROM files WHERE id % 3 <> 0", "files")
def snk12_pending_of_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a resumed rebuild has still to stage."""
    files = _files(spark, sf_dir).select("id")
    return snapshots.pending(files, files.where("id % 3 = 0"), "id")


@R.add("SELECT id, CASE WHEN id % 3 = 0 THEN 'v9' ELSE index_signature END AS index_signature, (SELECT count(*) FROM files WHERE id % 3 = 0) AS staged FROM files", "files")
def snk13_committed_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is staged in place of what it was captured from, and how many were staged."""
    old = _files(spark, sf_dir).select("id", "index_signature")
    staged = old.where("id % 3 = 0").withColumn("index_signature", F.lit("v9"))
    n = staged.agg(F.count("*").alias("staged"))  # one row
    return snapshots.replaced(old, staged, "id").crossJoin(F.broadcast(n))


@R.add("""SELECT id, CASE id % 9 WHEN 0 THEN 'fresh note' ELSE note END AS note, CASE id % 9 WHEN 1 THEN 'h' ELSE content_hash END AS content_hash, CASE id % 9 WHEN 2 THEN NULL ELSE duplicate_of_file_id END AS duplicate_of_file_id,
  CASE WHEN id % 9 = 3 THEN NULL WHEN index_signature = 'v1' THEN 'v2' ELSE index_signature END AS index_signature FROM files""", "files")
def snk16_small_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note, a hash, a link cleared, an index marked stale, and a signature carried over to its next version."""
    kind, some = F.col("id") % 9, _files(spark, sf_dir).select("id", "note", "content_hash", "duplicate_of_file_id", "index_signature")
    allowed = ("note", "content_hash", "duplicate_of_file_id", "index_signature")
    for where, patch in ((kind == 0, {"note": F.lit("fresh note")}), (kind == 1, {"content_hash": F.lit("h")}), (kind == 2, {"duplicate_of_file_id": F.lit(None)})):
        some = snapshots.patched(some, where, patch, allowed)
    some = snapshots.patched(some, F.col("index_signature") == "v1", {"index_signature": F.lit("v2")}, allowed)
    return snapshots.patched(some, kind == 3, {"index_signature": F.lit(None)}, allowed)


@R.add("SELECT name, max(priority) AS priority FROM (SELECT n_name AS name, n_regionkey AS priority FROM nation UNION ALL SELECT r_name, -1 FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)) WHERE name <> 'FRANCE' GROUP BY name")
def snk19_seeded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules (nations) after one is deleted and the defaults (regions) are seeded where their names are missing, twice."""
    rules = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("priority"))
    defaults = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit(-1).alias("priority"))
    kept = rules.where("name <> 'FRANCE'")
    return snapshots.seeded(snapshots.seeded(kept, defaults, "name"), defaults, "name")


@R.add("SELECT session_id, id, CASE WHEN id % 1000 = 0 THEN 'edited' ELSE content END AS content FROM messages WHERE session_id % 4 <> 1 UNION ALL SELECT session_id, max(id) + 1, 'added' FROM messages WHERE session_id % 4 = 0 GROUP BY session_id", "messages")
def snk20_chat_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions deleted with their messages, first messages edited, and a message added."""
    m = library.messages(spark, sf_dir).select("session_id", "id", "content")
    left = snapshots.without(m, m.where("session_id % 4 = 1"), "session_id")
    edited = snapshots.patched(left, F.col("id") % 1000 == 0, {"content": F.lit("edited")}, ("content",))
    added = m.where("session_id % 4 = 0").groupBy("session_id").agg((F.max("id") + 1).alias("id"), F.lit("added").alias("content"))
    return edited.unionByName(added)


@R.add(f"""WITH s AS (SELECT lower(trim(text)) AS query, turn % 3 = 0 AS is_history, conv_id * 100 + turn AS t FROM conversations)
  SELECT query, max(t) AS updated_at, bool_or(is_history) AS is_history FROM s GROUP BY query ORDER BY updated_at DESC, query LIMIT 50""")
def snk21_search_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by their query: the latest write counts, history once set stays, and the fifty newest are kept."""
    s = table(spark, sf_dir, "conversations").select(F.lower(F.trim("text")).alias("query"), (F.col("turn") % 3 == 0).alias("is_history"), (F.col("conv_id") * 100 + F.col("turn")).alias("at"))
    return snapshots.latest_writes(s, ["query"], "at", sticky=("is_history",)).select("query", F.col("at").alias("updated_at"), "is_history").orderBy(F.desc("updated_at"), "query").limit(50)


@R.add("SELECT user_id AS query, event_type AS signature, max(ts) AS last FROM events GROUP BY ALL ORDER BY last DESC, query, signature LIMIT 200")
def snk23_plan_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_type").alias("signature"), F.col("ts").alias("last"))
    return snapshots.latest_writes(e, ["query", "signature"], "last").orderBy(F.desc("last"), "query", "signature").limit(200)


@R.add("SELECT id, CASE WHEN state = 'pending' THEN 'completed' ELSE state END AS state, state = 'pending' AS analysed FROM feedback WHERE state <> 'failed'", "feedback")
def snk25_analysed_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending records analysed, failed ones deleted."""
    f = library.feedback(spark, sf_dir)
    left = snapshots.without(f, f.where("state = 'failed'").select("id"), "id").withColumn("analysed", F.col("state") == "pending")
    return snapshots.patched(left, F.col("analysed"), {"state": F.lit("completed")}, ("state",)).select("id", "state", "analysed")


@R.add("SELECT source_dir, path FROM files WHERE source_dir NOT IN ('/library/src1', '/library/src2') AND NOT (source_dir = '/library/src3' AND id % 2 = 1) UNION ALL SELECT '/library/src2', concat('/library/src2/', l_linenumber) FROM (SELECT DISTINCT l_linenumber FROM lineitem)", "files")
def snk28_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of folders: one cleared, one replaced, of one only what is still there retained."""
    b = _files(spark, sf_dir).select("source_dir", "path")
    cleared = b.where("source_dir <> '/library/src1'")
    fresh = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().select(F.lit("/library/src2").alias("source_dir"), F.concat(F.lit("/library/src2/"), F.col("l_linenumber").cast("string")).alias("path"))
    replaced = snapshots.replaced(cleared, fresh, "source_dir")
    there = _files(spark, sf_dir).where("source_dir = '/library/src3' AND id % 2 = 0").select("path")
    return snapshots.retained(replaced, F.col("source_dir") == "/library/src3", there, "path")


@R.add("SELECT id, CASE WHEN id % 4 = 0 THEN DATE '2020-01-01' ELSE created END AS created FROM (SELECT o_custkey AS id, cast(min(o_orderdate) AS date) AS created FROM orders GROUP BY 1) UNION ALL SELECT DISTINCT -c_custkey - 1, DATE '2020-01-01' FROM customer WHERE c_custkey % 10 = 0")
def snk29_creation_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.to_date(F.min("o_orderdate")).alias("created"))
    changed = old.where("id % 4 = 0").select("id")
    new = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select((-F.col("c_custkey") - 1).alias("id"))
    return snapshots.upsert(old, changed.unionByName(new).withColumn("created", F.lit("2020-01-01").cast("date")), "id")


@R.add("SELECT count(*) AS n, sum(input_tokens) AS tokens FROM (SELECT input_tokens FROM usage UNION ALL SELECT 7 FROM messages)", "usage", "messages")
def snk30_appended_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = library.messages(spark, sf_dir).select(F.lit(7).cast("long").alias("input_tokens"))
    return library.usage(spark, sf_dir).select("input_tokens").unionByName(more).agg(F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"))


@R.add("SELECT p_brand AS key, CASE WHEN p_brand = 'new' THEN '1' WHEN cast(right(p_brand, 1) AS integer) % 2 = 0 THEN 'on' ELSE 'off' END AS value FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'new', '1'")
def snk31_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key")).distinct()
    old = keys.withColumn("value", F.lit("off"))
    on = keys.where(F.right("key", F.lit(1)).cast("int") % 2 == 0).withColumn("value", F.lit("on"))
    new = keys.agg(F.lit("new").alias("key"), F.lit("1").alias("value"))
    return snapshots.upsert(old, on.unionByName(new), "key")


@R.add("SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 9 ELSE p_size END AS build FROM part WHERE p_partkey % 11 <> 0")
def snk35_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases (parts) after an update of some and a deletion of others."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("build"))
    new = old.where("id % 6 = 0").withColumn("build", F.lit(9))
    return snapshots.without(snapshots.upsert(old, new, "id"), old.where("id % 11 = 0").select("id"), "id")


@R.add("SELECT count(*) AS history, 0 AS jobs FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 <> 0)")
def snk36_cleared_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    left = snapshots.without(history, history.where("conv_id % 5 = 0"), "conv_id").agg(F.count("*").alias("history"))
    jobs = snapshots.cleared(history).agg(F.count("*").cast("int").alias("jobs"))
    return left.crossJoin(F.broadcast(jobs))  # one row each


@R.add("""SELECT 'files' AS relation, count(*) AS n, count(indexed_at) AS indexed FROM (SELECT CASE WHEN id % 6 = 0 THEN NULL ELSE indexed_at END AS indexed_at FROM files)
  UNION ALL SELECT 'chunks', count(*), 0 FROM chunks WHERE file_id % 6 <> 0 UNION ALL SELECT 'parents', count(*), 0 FROM parents WHERE file_id % 6 <> 0 UNION ALL SELECT 'vectors', count(*), 0 FROM vectors WHERE file_id NOT IN (SELECT id FROM files WHERE id % 6 = 0)""", "files", "chunks", "parents", "vectors")
def snk38_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid files lose their index, hash and link, and their chunks, parents and vectors."""
    files = _files(spark, sf_dir)
    bad = files.where("id % 6 = 0").select("id")
    left = snapshots.invalidated(files.select("id", "indexed_at", "index_signature", "content_hash", "duplicate_of_file_id"), bad)
    out = left.agg(F.lit("files").alias("relation"), F.count("*").alias("n"), F.count("indexed_at").alias("indexed"))
    for name, rows in (("chunks", library.chunks(spark, sf_dir)), ("parents", library.parents(spark, sf_dir)), ("vectors", library.embeddings(spark, sf_dir))):
        rest = snapshots.without(rows.select("file_id"), bad, "id", "file_id")
        out = out.unionByName(rest.agg(F.lit(name).alias("relation"), F.count("*").alias("n"), F.lit(0).cast("long").alias("indexed")))
    return out


@R.add("SELECT f.id, coalesce(CASE WHEN f.id % 3 = 0 THEN concat('h', f.id) END, f.content_hash) AS content_hash, CASE WHEN f.id % 3 = 0 THEN f.mtime ELSE f.discovered_at END AS created FROM files f", "files")
def snk39_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes and creation dates of some files from one inventory."""
    old = _files(spark, sf_dir).select("id", "content_hash", F.col("discovered_at").alias("created"), "mtime")
    seen = old.where("id % 3 = 0").select("id", F.concat(F.lit("h"), F.col("id").cast("string")).alias("content_hash"), F.col("mtime").alias("created"))
    return snapshots.upsert(old.drop("mtime"), seen, "id", keep=("content_hash", "created"))


@R.add("SELECT session_id, id, CASE WHEN role = 'assistant' AND id % 3 = 0 THEN 'good' END AS feedback FROM messages WHERE session_id % 10 <> 3", "messages")
def snk40_message_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats deleted with their messages, and answers rated."""
    m = library.messages(spark, sf_dir).select("session_id", "id", "role", F.lit(None).cast("string").alias("feedback"))
    left = snapshots.without(m, m.where("session_id % 10 = 3"), "session_id")
    return snapshots.patched(left, (F.col("role") == "assistant") & (F.col("id") % 3 == 0), {"feedback": F.lit("good")}, ("feedback",)).drop("role")


@R.add("SELECT id, CASE WHEN id % 2 = 0 AND id % 3 >= 1 THEN 'done' ELSE index_signature END AS index_signature FROM files", "files")
def snk43_completed_if_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of an index run are written where their generation is still the file's."""
    old = _files(spark, sf_dir).select("id", "index_signature", F.lit(1).alias("generation"))
    done = old.where("id % 2 = 0").select("id", F.lit("done").alias("index_signature"), F.when(F.col("id") % 3 >= 1, 1).otherwise(0).alias("generation"))
    return snapshots.written_if_current(old, done, "id", "generation").drop("generation")


@R.add(f"SELECT id, added FROM (SELECT id, coalesce(discovered_at, organized_at, indexed_at, mtime) AS added, ext FROM files) WHERE ext <> 'zip' ORDER BY added DESC, id LIMIT 1000", "files")
def snk22_kept_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retention leaves of a list: the thousand newest."""
    rows = _files(spark, sf_dir).where("ext <> 'zip'").select("id", filters.added_at().alias("added"))
    return rows.orderBy(F.desc("added"), "id").limit(1000)
