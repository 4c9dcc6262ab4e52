"""Queries over readers, plans of questions, providers and named functions."""

from __future__ import annotations

import io
import zipfile
from datetime import date
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import plans, registry
from lectern.functions import text as tx
from lectern.operators import chunking, filters, organize, providers, retrieval, rows
from lectern.plans import search_plan
from lectern.plans.registry import Registry
from lectern.session import table
from lectern.sources import library, readers

R = Registry()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = table(spark, sf_dir, "pages")
    return html.select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("ext"), F.encode("html", "UTF-8").alias("content"))


@R.add()
def src22_src24_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the tables' folder, without their contents."""
    return readers.listing(spark, sf_dir).select("name", "ext", "size").where("ext = 'parquet'")


@R.add("SELECT count(*) AS files, sum(n_chars) AS bytes FROM documents")
def src23_bounded_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and bytes of a tree, unless it has more entries than a walk may look at."""
    files = library.files(spark, sf_dir).select("size")
    return readers.bounded_totals(files, 2_000_000_000)


@R.add()
def src25_src26_extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and text of files by their extension, here web pages as bytes."""
    return readers.extracted(_pages(spark, sf_dir)).select("path", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


def _office(ext: Column, text: Column, note: Column, title: Column) -> Column:
    """A small archive of a text, a paragraph for each line: of a word processor, the note as a comment, or of slides, as notes."""

    @F.pandas_udf("binary")
    def of(kinds: pd.Series, texts: pd.Series, notes: pd.Series, titles: pd.Series) -> pd.Series:
        out = []
        for kind, t, more, name in zip(kinds, texts, notes, titles):
            data = io.BytesIO()
            body, aside = ("word/document.xml", "word/comments.xml") if kind == "docx" else ("ppt/slides/slide1.xml", "ppt/notesSlides/notesSlide1.xml")
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
                for part, lines in ((body, t or ""), (aside, more)):
                    archive.writestr(part, "<w:document xmlns:w='w'>" + "".join(f"<w:p><w:t>{escape(x)}</w:t></w:p>" for x in lines.split("\n")) + "</w:document>")
                archive.writestr("docProps/core.xml", f"<cp xmlns:dc='dc'><dc:title>{escape(name or '')}</dc:title></cp>")
                archive.writestr("word/media/image1.png", "not text")
            out.append(data.getvalue())
        return pd.Series(out)

    return of(ext, text, note, title)


@R.add("""SELECT concat('/c/', conv_id, '/', turn, CASE WHEN turn % 2 = 0 THEN '.docx' ELSE '.pptx' END) AS path, concat('turn ', turn) AS title,
  trim(regexp_replace('note ' || conv_id || chr(10) || chr(10) || regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS text FROM conversations""")
def src28_src44_src45_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as office archives, and what is read from them: allowed entries and the title. XML has no
    control characters; they're spaces."""
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    ext = F.when(F.col("turn") % 2 == 0, "docx").otherwise("pptx")
    told = table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", "[\\x00-\\x08\\x0b-\\x1f]", " "))
    made = told.select(F.concat(F.lit("/c/"), conv, F.lit("/"), turn, F.lit("."), ext).alias("path"), ext.alias("ext"), _office(ext, F.col("text"), F.concat(F.lit("note "), conv), F.concat(F.lit("turn "), turn)).alias("content"))
    return readers.extracted(made)


def _sheet(cells: Column) -> Column:
    """A spreadsheet archive of rows of cells; names are shared strings, numbers stand in their cells."""

    @F.pandas_udf("binary")
    def of(tables: pd.Series) -> pd.Series:
        out = []
        for lines in tables:
            shared = sorted({str(v) for line in lines for v in line if not str(v).isdigit()})
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{escape(v)}</t></si>" for v in shared) + "</sst>")
                cell = lambda v: f"<c><v>{v}</v></c>" if v.isdigit() else f"<c t='s'><v>{shared.index(v)}</v></c>"
                archive.writestr("xl/worksheets/sheet1.xml", "<ws>" + "".join("<row>" + "".join(cell(str(v)) for v in line) + "</row>" for line in lines) + "</ws>")
            out.append(data.getvalue())
        return pd.Series(out)

    return of(cells)


@R.add("""SELECT concat('/regions/', r_regionkey, '.xlsx') AS path, string_agg(concat(n_nationkey, chr(9), n_name, chr(9), r_name), chr(10) ORDER BY n_nationkey) AS text
  FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def src30_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreadsheets of each region's nations, and what is read from them: cells, tab-separated, with their shared strings."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name", "r_name").alias("cells"))
    by = nations.groupBy("r_regionkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    path = F.concat(F.lit("/regions/"), F.col("r_regionkey").cast("string"), F.lit(".xlsx"))
    made = by.select(path.alias("path"), F.lit("xlsx").alias("ext"), _sheet(F.col("lines.cells")).alias("content"))
    return readers.extracted(made).select("path", "text")


@R.add("SELECT doc_id AS file_id, 0 AS chunk_idx, text, CASE doc_id % 3 WHEN 0 THEN 'table' ELSE 'text' END AS kind FROM documents")
def src34_parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document parser's JSON lines: known kinds stay, others are text."""
    kind = F.when(F.col("doc_id") % 3 == 0, "table").when(F.col("doc_id") % 3 == 1, "text").otherwise("formula")
    line = F.to_json(F.struct(F.col("doc_id").alias("file_id"), F.array(F.struct("text", kind.alias("kind"))).alias("chunks")))
    return readers.parsed_chunks(table(spark, sf_dir, "documents").select(line.alias("value"))).select("file_id", "chunk_idx", "text", "kind")


@R.add("""WITH e AS (SELECT id % 10 AS k, floor(id / 10)::bigint AS d FROM files),
  s AS (SELECT concat('/d', d) AS directory, concat('/d', d, '/README.md') AS path, 0 AS tier FROM e WHERE k = 3 AND d % 3 = 0
    UNION ALL SELECT concat('/d', d), concat('/d', d, '/docs/Overview-2.rst'), 1 FROM e WHERE k = 5 AND d % 3 < 2
    UNION ALL SELECT concat('/d', d, '/docs'), concat('/d', d, '/docs/Overview-2.rst'), 0 FROM e WHERE k = 5 AND d % 3 < 2
    UNION ALL SELECT concat('/d', d), concat('/d', d, '/Package.json'), 9 FROM e WHERE k = 9)
  SELECT directory, arg_min(path, tier) AS reference FROM s GROUP BY directory""", "files")
def src39_reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that stands for each folder: a read-me before an overview among its documents, a manifest where there is neither."""
    k, d = F.col("id") % 10, F.floor(F.col("id") / 10)
    name = F.when((k == 3) & (d % 3 == 0), "README.md").when((k == 5) & (d % 3 < 2), "docs/Overview-2.rst").when(k == 9, "Package.json").otherwise(F.col("name"))
    path = F.concat(F.lit("/d"), d.cast("string"), F.lit("/"), name)
    some = library.files(spark, sf_dir).select(path.alias("path")).withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    return readers.reference_files(some.withColumn("ext", tx.extension(F.col("name"))))


@R.add("SELECT path, hash AS content_hash, size FROM (SELECT path, content_hash AS hash, size FROM files WHERE NOT is_directory AND source_dir <> '/library/src1' AND NOT starts_with(name, '.'))", "files")
def src46_manual_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a manual run looks at: no folders, none below the managed root, none that are passed over."""
    some = library.files(spark, sf_dir).where(~filters.under(F.col("path"), "/library/src1") & ~F.col("is_directory"))
    return some.where(filters.exclusion_reason(F.col("name"), F.col("ext"), F.col("is_directory"), ("txt", "md", "pdf", "py", "zip")).isNull()).select("path", "content_hash", "size")


@R.add()
def src47_decoded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", readers.decoded_entities(F.col("html")).alias("decoded"))


@R.add("SELECT id, name FROM (SELECT id, trim(organization_subfolder) AS name FROM files) WHERE name IS NOT NULL AND id % 12 <> 0 UNION ALL SELECT id, NULL FROM files WHERE organization_subfolder IS NULL OR id % 12 = 0", "files")
def str20_folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe names of subfolders; those that would lead elsewhere are none."""
    named = F.when(F.col("id") % 12 == 0, F.concat(F.lit("../"), "organization_subfolder")).otherwise(F.col("organization_subfolder"))
    return library.files(spark, sf_dir).select("id", tx.folder_name(named).alias("name"))


@R.add()
def str30_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text in two halves, at a paragraph, sentence, space or character near its middle."""
    return chunking.halves(table(spark, sf_dir, "documents").select("doc_id", "text"))


@R.add("SELECT id, size > 0 AND ext = 'md' AS fits FROM files", "files")
def flt28_given_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter without a condition lets everything through; one with conditions is given."""
    assert not filters.FileFilter().given()
    wanted = filters.FileFilter(extensions=("md",), size=(1, None))
    return library.files(spark, sf_dir).where(filters.FileFilter().column()).select("id", (wanted.column() & F.lit(wanted.given())).alias("fits"))


@R.add("SELECT session_id, id, running <= 4000 AS kept FROM (SELECT session_id, id, sum(length(content)) OVER (PARTITION BY session_id ORDER BY length(content) DESC, id) AS running FROM messages)", "messages")
def win06_running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns, the longest first, fit a budget of characters together."""
    m = library.messages(spark, sf_dir).select("session_id", "id", F.length("content").alias("cost"))
    fit = rows.fitting_suffix(m, ["session_id"], [F.desc("cost"), F.col("id")], F.col("cost"), 4000).select("session_id", "id", F.lit(True).alias("kept"))
    return m.select("session_id", "id").join(fit, ["session_id", "id"], "left").select("session_id", "id", F.coalesce("kept", F.lit(False)).alias("kept"))


@R.add(r"SELECT file_id, chunk_idx, before IS NOT NULL AND regexp_matches(text, '^[a-z]') AND NOT regexp_matches(before, '[.!?。！？]\s*$') AS broken FROM (SELECT file_id, chunk_idx, text, lag(text) OVER (PARTITION BY file_id ORDER BY chunk_idx) AS before FROM chunks)", "chunks")
def win09_broken_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that go on with the sentence of the one before."""
    return chunking.broken_sentences(library.chunks(spark, sf_dir).select("file_id", "chunk_idx", "text"))


@R.add("""SELECT DISTINCT c.file_id, c.chunk_idx FROM chunks c JOIN (SELECT file_id, chunk_idx FROM chunks WHERE kind = 'title') h ON h.file_id = c.file_id AND c.chunk_idx BETWEEN h.chunk_idx - 2 AND h.chunk_idx + 2""", "chunks")
def win10_around_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = library.chunks(spark, sf_dir).select("file_id", "chunk_idx", "kind")
    return organize.neighbours(c.where("kind = 'title'"), c.select("file_id", "chunk_idx"), 2)


@R.add()
def ret28_quick_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by words alone: no vectors, no entities."""
    search = retrieval.Search("that", ("that", "the"), limit=50)
    return retrieval.hybrid(library.files(spark, sf_dir), library.chunks(spark, sf_dir), library.embeddings(spark, sf_dir), search)


def _flat_plan(plan: str) -> list[Column]:
    """The fields of a plan, lists joined."""
    lists, plain = ("keywords", "extensions", "categories"), ("semantic_query", "exact_name", "item_kind", "date_field", "starts", "ends", "min_size", "max_size", "has_note", "is_indexed", "content_mode", "sort")
    return [*(F.array_join(f"{plan}.{f}", "|").alias(f) for f in lists), *(F.col(f"{plan}.{f}") for f in plain)]


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question, local): questions with their own plans, made once a row."""
    asked = library.questions(spark, sf_dir)
    return asked.select("id", "question", F.explode(F.array(plans.inferred(F.col("question"), F.lit(date(2024, 3, 13))))).alias("local"))


@R.add()
def ret30_inferred_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan says for each question, by its words alone."""
    return _plans(spark, sf_dir).select("id", *_flat_plan("local"))


@R.add()
def ret31_reconciled_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as a model proposes them, here JSON made from the title, under what the question itself says."""
    proposal = """to_json(named_struct('semantic_query', title, 'keywords', filter(split(title, ' '), w -> w <> ''), 'extensions', array('pdf'), 'categories', array('image'), 'folder_terms', array('src'), 'item_kind', 'file',
      'date_field', 'organized', 'starts', date'2023-01-01', 'ends', date'2023-02-01', 'min_size', id * 10, 'max_size', 500 - id, 'has_note', true, 'is_indexed', true,
      'content_mode', CASE id % 3 WHEN 0 THEN 'metadata_only' WHEN 1 THEN 'automatic' ELSE 'indexed_content' END, 'sort', 'oldest'))"""
    told = library.files(spark, sf_dir).selectExpr("id", f"{proposal} AS told")
    made = _plans(spark, sf_dir).join(told, "id").withColumn("proposed", F.from_json("told", plans.PLAN))
    return made.select("id", F.explode(F.array(plans.reconciled(F.col("proposed"), F.col("local"), F.col("question")))).alias("plan")).select("id", *_flat_plan("plan"))


@R.add()
def ret31_ret32_reconciled_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of questions and of a proposal from the title, concepts that share a word merged."""
    made = library.questions(spark, sf_dir).join(library.files(spark, sf_dir).select("id", "title"), "id")
    return search_plan.reconciled_plans(made, date(2024, 3, 13))


@R.add()
def ret35_txt16_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of chunks from a provider in batches; where the batch fails, from its halves."""
    some = library.chunks(spark, sf_dir).select("file_id", "chunk_idx", "text")
    made = providers.embedded(some, providers.hash_embedder)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return made.select("file_id", "chunk_idx", F.round(total, 4).alias("square"), F.size("embedding").alias("dim"))


@R.add()
def txt22_merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page as two readers saw them, without repeats, in reading order (conversations stand in for pages)."""
    c = table(spark, sf_dir, "conversations")
    one = c.select(F.col("conv_id").alias("page_id"), F.concat(F.lit("line "), F.col("turn").cast("string")).alias("text"), (0.9 - F.col("turn") / 100).alias("confidence"), F.lit(0.0).alias("x"), (F.col("turn") * 12.0).alias("y"), F.lit(100.0).alias("w"), F.lit(10.0).alias("h"), F.lit("a").alias("source"))
    other = one.where("confidence > 0.87").withColumns({"source": F.lit("b"), "text": F.lit("again"), "x": F.col("x") + 5})
    return providers.merged_boxes(one.unionByName(other))


@R.add("SELECT id, list_sum(list_transform(embedding, lambda x: cast(x AS double) * x)) > 0 AS some, regexp_replace(lower(model), '[^\\p{L}\\p{N}]', '', 'g') AS concept FROM vectors", "vectors")
def udf01_udf03_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's functions by their names in SQL."""
    registry.register(spark)
    sql = "SELECT id, vec_dot(cast(embedding AS array<double>), cast(embedding AS array<double>)) > 0 AS some, concept_of(model) AS concept FROM {vectors}"
    return spark.sql(sql, vectors=library.embeddings(spark, sf_dir))


@R.add("SELECT file_id, chunk_idx, round(len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')), ['that', 'the'])) / 2.0, 6) AS score FROM chunks", "chunks")
def udf02_scored_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer given by the caller, in Arrow batches: the share of two words."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        import re

        return texts.map(lambda t: len({"that", "the"} & set(re.split("[^a-z]+", t.lower()))) / 2)

    return library.chunks(spark, sf_dir).select("file_id", "chunk_idx", F.round(of(F.col("text")), 6).alias("score"))
