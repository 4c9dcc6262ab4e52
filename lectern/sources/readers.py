"""Readers of files: listings, text, HTML, office archives, parser and transcript JSON.

Files are read as Spark's binaryFile and text sources; what a format needs beyond built-in functions runs
in Arrow batches on the executors. Formats that need the operating system or libraries that Spark users
don't have everywhere (PDF, RTF, images, sound) come as text columns made outside.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import extension, time_code
from lectern.operators.chunking import tokens
from lectern.operators.slices import in_slices, of_strings

#: Bounds of what is taken from a file: characters, entries of an archive, bytes of an entry.
CHARACTERS, ENTRIES, ENTRY_BYTES = 120_000, 300, 8 << 20


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, name, ext, size, mtime) of the files below a root, without their contents."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.regexp_extract("path", "[^/]+$", 0)
    return read.select("path", name.alias("name"), extension(name).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def bounded_totals(files: DataFrame, most: int) -> DataFrame:
    """Number and bytes of the files; null when there are more than most."""
    some = files.select("size").limit(most + 1)
    fits = F.count("*") <= most
    return some.agg(F.when(fits, F.count("*")).alias("files"), F.when(fits, F.sum("size")).alias("bytes"))


#: Stems and extensions of a directory's reference file, the best first; folders of it that may hold one instead;
#: names that tell a project, for a directory without either.
REFERENCE_STEMS = ("readme", "overview", "about", "description", "project", "getting-started", "getting_started")
REFERENCE_EXTENSIONS = ("md", "markdown", "rst", "txt", "adoc", "html", "")
REFERENCE_FOLDERS = ("docs", "doc", ".github")
MANIFESTS = ("package.json", "pyproject.toml", "cargo.toml", "package.swift", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "gemfile")


def reference_files(files: DataFrame) -> DataFrame:
    """(directory, reference): the file that stands for each directory, if any does: its best-named one, else that of
    one of its folders for documentation, else a manifest, the first by path. files: (path, name, ext)."""
    low = F.lower("name")
    stem = F.regexp_replace(low, "(?<=.)\\.[^.]*$", "")
    ranks = [F.when((stem == x) | stem.rlike(f"^{x}[._-]"), F.lit(k)) for k, x in enumerate(REFERENCE_STEMS)]
    kind = F.array_position(F.array(*map(F.lit, REFERENCE_EXTENSIONS)), F.coalesce(F.lower("ext"), F.lit("")))
    rank = F.coalesce(*ranks) * 100 + F.when(kind > 0, kind - 1).otherwise(20)
    directory = F.regexp_extract("path", "^(.*)/[^/]+$", 1)
    place = F.array_position(F.array(*map(F.lit, REFERENCE_FOLDERS)), F.regexp_extract(directory, "[^/]*$", 0))
    named = F.struct(directory.alias("directory"), F.lit(0).cast("bigint").alias("tier"), rank.alias("rank"))
    above = F.struct(F.regexp_extract(directory, "^(.*)/[^/]+$", 1).alias("directory"), place.cast("bigint").alias("tier"), rank.alias("rank"))
    manifest = F.struct(directory.alias("directory"), F.lit(9).cast("bigint").alias("tier"), F.lit(0).alias("rank"))
    stands = F.array_compact(F.array(F.when(rank.isNotNull(), named), F.when(rank.isNotNull() & (place > 0), above), F.when(low.isin(*MANIFESTS), manifest)))
    return files.select("path", F.inline(stands)).groupBy("directory").agg(F.min_by("path", F.struct("tier", "rank", "path")).alias("reference"))


class _Text(HTMLParser):
    """Text outside of scripts and styles; block elements begin lines."""

    BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article table ul ol header footer title".split())
    SKIPPED = frozenset(("script", "style", "noscript", "template"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.SKIPPED
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in self.SKIPPED and self.depth > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.parts.append(data)


def html_text(page: str | None) -> str:
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def text_of_html(page: Column) -> Column:
    """The visible text of HTML or XHTML, white space evened out; null counts as empty."""
    return of_strings(html_text, page)


def decoded_entities(text: Column) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return of(text)


#: Which entries of an office archive hold text, by extension.
PARTS = {
    "docx": r"word/((document|footnotes|endnotes|comments)\.xml|(header|footer).*)", "pptx": r"ppt/(slides/slide|notesSlides/notesSlide).*\.xml", "xlsx": r"xl/(sharedStrings|worksheets/.*)\.xml",
    "epub": r".*\.(xhtml|html|htm)", "odt": r"content\.xml", "ods": r"content\.xml", "odp": r"content\.xml",
}


def _natural(path: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", path.lower())]


def _xml_text(data: bytes) -> str:
    """Text of an XML part: a line for each paragraph or row."""
    out: list[str] = []
    for _, e in ElementTree.iterparse(io.BytesIO(data), ("end",)):
        tag = e.tag.rpartition("}")[2]
        if tag in ("t", "span") or tag in ("p", "h") and e.text:
            out.append(e.text or "")
        if tag in ("p", "h", "row", "tr"):
            out.append("\n")
        if tag == "tab":
            out.append("\t")
    return "".join(out)


def _sheets(parts: dict[str, bytes]) -> str:
    """Cells of worksheets with their shared strings, tab-separated."""
    def local(e: ElementTree.Element) -> str:
        return e.tag.rpartition("}")[2]

    shared: list[str] = []
    for name, data in parts.items():
        if name.endswith("sharedStrings.xml"):
            shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(data) if local(si) == "si"]
    lines = []
    for name in sorted((n for n in parts if "worksheets" in n), key=_natural):
        for row in (e for e in ElementTree.fromstring(parts[name]).iter() if local(e) == "row"):
            cells = []
            for c in (e for e in row if local(e) == "c"):
                value = "".join(v.text or "" for v in c.iter() if local(v) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
            lines.append("\t".join(cells))
    return "\n".join(lines)


def archive_text(content: bytes, ext: str) -> tuple[str | None, str]:
    """(title, text) of an office archive; a broken one gives no text."""
    pattern = re.compile(PARTS.get(ext, r"(?!)"), re.I)
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            infos = sorted((i for i in archive.infolist() if i.file_size <= ENTRY_BYTES and ".." not in i.filename), key=lambda i: _natural(i.filename))
            parts = {i.filename: archive.read(i) for i in [i for i in infos if pattern.fullmatch(i.filename)][:ENTRIES]}
            about = next((archive.read(i) for i in infos if i.filename in ("docProps/core.xml", "meta.xml") or i.filename.endswith(".opf")), b"")
        found = re.search(rb"<(?:\w+:)?title[^>]*>([^<]+)<", about)
        title = html.unescape(found[1].decode("utf-8", "replace")).strip()[:500] if found else None
        if ext == "xlsx":
            text = _sheets(parts)
        elif ext == "epub":
            text = "\n\n".join(html_text(p.decode("utf-8", "replace")) for p in parts.values())
        else:
            text = "\n".join(_xml_text(p) for p in parts.values())
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, RuntimeError):
        return None, ""
    return title, re.sub(r"\n{3,}", "\n\n", text).strip()[:CHARACTERS]


def extracted(files: DataFrame) -> DataFrame:
    """files (path, ext, content) -> (path, title, text) by extension; without one that is known, the file's name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, ext, content in zip(rows["path"], rows["ext"], rows["content"]):
                name, raw = path.rpartition("/")[2], content or b""
                if ext in PARTS:
                    title, text = archive_text(raw, ext)
                elif ext in ("html", "htm", "xhtml", "xml"):
                    title, text = None, html_text(raw.decode("utf-8", "replace"))[:CHARACTERS]
                elif b"\x00" not in raw[:4096] and ext not in ("pdf", "zip", "png", "jpg", "gif", "mp3", "mp4", "wav"):
                    title, text = None, raw.decode("utf-8", "replace")[:CHARACTERS]
                else:
                    title, text = None, name
                out.append((path, title or name, text))
            yield pd.DataFrame(out, columns=["path", "title", "text"])

    return in_slices(files.select("path", F.lower("ext").alias("ext"), "content"), run, "path string, title string, text string")


PARSED = "array<struct<text: string, contextual_text: string, section_path: array<string>, page_start: int, page_end: int, kind: string>>"


def parsed_chunks(lines: DataFrame, json: str = "value") -> DataFrame:
    """Chunks of a document parser's JSON lines {file_id, chunks}; unknown kinds are text, broken lines give none."""
    schema = f"file_id bigint, chunks {PARSED}"
    rows = lines.select(F.from_json(json, schema, {"mode": "PERMISSIVE"}).alias("d")).select("d.file_id", F.posexplode("d.chunks").alias("chunk_idx", "c"))
    known = F.col("c.kind").isin("text", "title", "list", "table", "code", "note", "metadata", "image")
    return rows.select("file_id", "chunk_idx", "c.text", "c.contextual_text", F.coalesce("c.section_path", F.array().cast("array<string>")).alias("section_path"), "c.page_start", "c.page_end", F.when(known, F.col("c.kind")).otherwise("text").alias("kind"))


def transcript_chunks(transcripts: DataFrame, most: int = 300) -> DataFrame:
    """(file_id, chunk_idx, start, end, text, label): segments array<struct<start,end,text>> packed to so many tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for file_id, segments in zip(rows["file_id"], rows["segments"]):
                held: list = []
                packs = []
                for s in segments if segments is not None else []:
                    text = (s["text"] or "").strip()
                    if not text:
                        continue
                    if held and tokens(" ".join([*(t for *_, t in held), text])) > most:
                        packs.append(held)
                        held = []
                    held.append((s["start"], s["end"], text))
                packs += [held] if held else []
                out += [(file_id, k, p[0][0], p[-1][1], " ".join(t for *_, t in p)) for k, p in enumerate(packs)]
            yield pd.DataFrame(out, columns=["file_id", "chunk_idx", "start", "end", "text"])

    packed = transcripts.select("file_id", "segments").mapInPandas(run, "file_id long, chunk_idx int, start double, end double, text string")
    return packed.withColumn("label", F.concat(time_code(F.col("start")), F.lit("–"), time_code(F.col("end"))))


RELEASES = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "version", "platform", "architecture", "channel", "url", "sha256")] + [T.StructField("build", T.LongType()), T.StructField("published_at", T.TimestampType())])


def release_feed(spark: SparkSession, path: str) -> DataFrame:
    """Releases of a JSON document {"releases": [...]}."""
    schema = T.StructType([T.StructField("releases", T.ArrayType(RELEASES))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("releases"))
