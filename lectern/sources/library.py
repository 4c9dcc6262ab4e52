"""The document library as DataFrames: schemas, and adapters from the driver's tables.

The adapters are row-by-row projections, so filters and column pruning reach the Parquet scans.
ORACLE_VIEWS gives the same relations as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table

FILES = """id bigint, path string, name string, ext string, size bigint, mtime timestamp, category string,
source_dir string, indexed_at timestamp, content_hash string, title string, content_text string,
discovered_at timestamp, organized_at timestamp, note string, organization_subfolder string,
is_directory boolean, index_signature string, duplicate_of_file_id bigint, duplicate_detected_at timestamp"""
CHUNKS = """file_id bigint, chunk_idx int, text string, contextual_text string, section_path array<string>,
page_start int, page_end int, kind string, parent_idx int, token_count int, entity_terms array<string>"""
CHUNK_KINDS = ("text", "title", "list", "table", "code", "note", "metadata", "image")
CATEGORIES = ("document", "image", "video", "audio", "archive", "code", "other")

#: Seconds of 2024-01-01 UTC, where the stand-in times begin.
EPOCH = 1_704_067_200
_MINUTE = "{at}({epoch} + doc_id * 60 + {more}){end}"
_FILES = """
  doc_id AS id,
  concat('/library/', source, '/doc_', cast(doc_id as {str}), '.', {ext}) AS path,
  concat('doc_', cast(doc_id as {str}), '.', {ext}) AS name,
  {ext} AS ext,
  n_chars AS size,
  {t0} AS mtime,
  CASE lang WHEN 'en' THEN 'document' WHEN 'fr' THEN 'code' WHEN 'de' THEN 'archive' ELSE 'other' END AS category,
  concat('/library/', source) AS source_dir,
  CASE WHEN doc_id % 3 <> 0 THEN {t1} END AS indexed_at,
  {sha} AS content_hash,
  substring(text, 1, 24) AS title,
  text AS content_text,
  CASE WHEN doc_id % 4 <> 0 THEN {t2} END AS discovered_at,
  CASE WHEN doc_id % 5 = 0 THEN {t3} END AS organized_at,
  CASE WHEN doc_id % 7 = 0 THEN concat('note on ', lang) WHEN doc_id % 7 = 1 THEN '  ' END AS note,
  CASE WHEN doc_id % 6 = 0 THEN concat('Topic ', lang) END AS organization_subfolder,
  doc_id % 50 = 49 AS is_directory,
  CASE WHEN doc_id % 3 = 1 THEN 'v1' WHEN doc_id % 3 = 2 THEN 'v2' END AS index_signature,
  CASE WHEN doc_id % 97 = 5 THEN doc_id - 1 END AS duplicate_of_file_id"""
_EXT = "CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'pdf' WHEN 3 THEN 'py' ELSE 'zip' END"


def _files(at: str, end: str, string: str, sha: str) -> str:
    times = {f"t{i}": f"{at}({EPOCH} + doc_id * 60 + {more}){end}" for i, more in enumerate((0, 3600, 600, 1200))}
    return _FILES.format(str=string, ext=_EXT, sha=sha, **times)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FILES from documents (without the detection time): stand-in names, times and notes follow from the id."""
    expressions = _files("timestamp_seconds", "", "string", "sha2(text, 256)").strip().split(",\n")
    return table(spark, sf_dir, "documents").selectExpr(*expressions)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHUNKS of the documents' lines, up to ten lines to a parent."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("chunk_idx", "text"))
    return rows.where("trim(text) <> ''").selectExpr(
        "file_id",
        "chunk_idx",
        "text",
        "text AS contextual_text",
        "chunk_idx div 10 AS parent_idx",
        "cast(chunk_idx div 25 + 1 as int) AS page_start",
        "CASE WHEN chunk_idx % 11 = 0 THEN 'title' WHEN chunk_idx % 11 = 5 THEN 'note' ELSE 'text' END AS kind",
    )


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, parent_idx, children, chars, page_start): parents of chunks, but for every thirteenth file's."""
    rows = chunks(spark, sf_dir).where("file_id % 13 <> 0")
    return rows.groupBy("file_id", "parent_idx").agg(F.count("*").alias("children"), F.sum(F.length("text")).alias("chars"), F.min("page_start").alias("page_start"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, file_id, chunk_idx, embedding, dim, model, label): one vector for each file that has one."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "vec_id AS file_id", "0 AS chunk_idx", "embedding", "size(embedding) AS dim", "concat('model', label % 2) AS model", "label")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, id, role, content, ts)."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS session_id", "conv_id * 1000 + turn AS id", "role", "text AS content", f"timestamp_seconds({EPOCH} + conv_id * 3600 + turn * 60) AS ts")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts, model, input_tokens, output_tokens, session_id): token usage from events."""
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "ts", "event_type AS model", "cast(floor(value) as bigint) AS input_tokens", "event_id % 100 AS output_tokens", "user_id AS session_id")


_QUESTIONS = """CASE id % 8 WHEN 0 THEN concat('Find documents about ', title) WHEN 1 THEN concat('latest files mentioning "', title, '"') WHEN 2 THEN 'show files from last 7 days'
  WHEN 3 THEN name WHEN 4 THEN concat('report INV-', cast(id AS {str}), ' of 2021 and 2023?') WHEN 5 THEN concat('GPTReport', cast(id AS {str}), ' MyFolder') WHEN 6 THEN 'yesterday' ELSE title END"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question): a stand-in question for each file, from its name and title."""
    return files(spark, sf_dir).selectExpr("id", f"{_QUESTIONS.format(str='string')} AS question")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, rating, state): one record for each label."""
    return table(spark, sf_dir, "labels").selectExpr("doc_id AS id", "CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS rating", "CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'completed' END AS state")


ORACLE_VIEWS = {
    "files": f"SELECT {_files('make_timestamp(', ' * 1000000)', 'varchar', 'sha256(text)')} FROM documents",
    "chunks": """SELECT file_id, cast(chunk_idx AS integer) AS chunk_idx, text, text AS contextual_text, chunk_idx // 10 AS parent_idx,
  chunk_idx // 25 + 1 AS page_start,
  CASE WHEN chunk_idx % 11 = 0 THEN 'title' WHEN chunk_idx % 11 = 5 THEN 'note' ELSE 'text' END AS kind
  FROM (SELECT doc_id AS file_id, unnest(range(len(string_split(text, chr(10))))) AS chunk_idx, unnest(string_split(text, chr(10))) AS text FROM documents)
  WHERE trim(text, ' ') <> ''""",
    "parents": """SELECT file_id, parent_idx, count(*) AS children, sum(length(text)) AS chars, min(page_start) AS page_start
  FROM chunks WHERE file_id % 13 <> 0 GROUP BY ALL""",
    "vectors": "SELECT vec_id AS id, vec_id AS file_id, 0 AS chunk_idx, embedding, cast(len(embedding) AS integer) AS dim, concat('model', label % 2) AS model, label FROM embeddings",
    "messages": f"SELECT conv_id AS session_id, conv_id * 1000 + turn AS id, role, text AS content, make_timestamp(({EPOCH} + conv_id * 3600 + turn * 60) * 1000000) AS ts FROM conversations",
    "usage": "SELECT event_id AS id, ts, event_type AS model, cast(floor(value) as bigint) AS input_tokens, event_id % 100 AS output_tokens, user_id AS session_id FROM events",
    "questions": f"SELECT id, {_QUESTIONS.format(str='varchar')} AS question FROM files",
    "feedback": "SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS rating, CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'completed' END AS state FROM labels",
}


def oracle(body: str, *views: str) -> str:
    """DuckDB SQL with the named views in front of it."""
    needed = [v for v in ORACLE_VIEWS if v in views or v == "chunks" and "parents" in views or v == "files" and "questions" in views]
    if not needed:
        return body
    tail = body.strip()
    joined = ",\n".join(f"{v} AS (\n{ORACLE_VIEWS[v]})" for v in needed)
    return f"WITH {joined},\n{tail[5:]}" if tail[:5].upper() == "WITH " else f"WITH {joined}\n{tail}"
