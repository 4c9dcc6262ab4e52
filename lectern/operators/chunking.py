"""Text to chunks: paragraphs and sentences packed to a token target, tables by rows, entities.

Packing depends on order within one document only, so it runs in Arrow batches of whole documents;
nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import concept, entities, letter_ratio, noise, token_estimate
from lectern.operators.slices import in_slices

_HAN = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U0002a6df\U0002a700-\U0002ebef\U00030000-\U000323af]")
_WORD = re.compile(r"[A-Za-z0-9'_-]+")
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*\s*|[.!?。！？]+\s*", re.S)
_PARAGRAPH = re.compile(r"\n[\t ]*\n+")


def thirds(text: str) -> int:
    """Thirds of a token that a text costs: they add up over parts that white space separates."""
    words = _WORD.findall(text)
    han = 0 if text.isascii() else len(_HAN.findall(text))
    others = sum(map(len, text.split())) - sum(map(len, words)) - han
    return 2 * han + 4 * len(words) + 3 * others


def tokens(text: str) -> int:
    """token_estimate of one text."""
    return max(1, -(-thirds(text) // 3)) if text else 0


def sentences(paragraph: str) -> list[str]:
    return [s for s in map(str.strip, _SENTENCE.findall(paragraph)) if s]


def _units(text: str, target: int) -> list[tuple[int, str]]:
    """(paragraph, text): paragraphs, those over the target as sentences."""
    out = []
    for k, paragraph in enumerate(p.strip() for p in _PARAGRAPH.split(text)):
        parts = sentences(paragraph) if thirds(paragraph) > 3 * target else []
        out += [(k, s) for s in parts] if len(parts) > 1 else [(k, paragraph)] * bool(paragraph)
    return out


def _joined(units: list[tuple[int, str, int]]) -> str:
    out = []
    for i, (k, text, _) in enumerate(units):
        out += ["" if not i else " " if units[i - 1][0] == k else "\n\n", text]
    return "".join(out)


def chunk(text: str | None, target: int = 300, overlap: int = 80) -> list[str]:
    """Chunks of whole units of at most target tokens, but for a unit that has more; each begins with the
    last units of the one before, as far as they fit the overlap."""
    text = (text or "").strip()
    units = _units(text, target)
    if len(units) == 1 and target >= 64 and thirds(text) > 3 * target:
        units = [(0, w) for w in (text.split() if " " in text else list(text))]
    out: list[str] = []
    held: list[tuple[int, str, int]] = []
    total = 0
    for k, part in units:
        cost = thirds(part)
        if held and total + cost > 3 * target:
            out.append(_joined(held))
            first, total = len(held), 0
            while first and total + held[first - 1][2] <= 3 * overlap:
                first -= 1
                total += held[first][2]
            while first < len(held) and total + cost > 3 * target:
                total -= held[first][2]
                first += 1
            held = held[first:]
        held.append((k, part, cost))
        total += cost
    return [*out, _joined(held)] if held else out


def table_pieces(text: str, target: int) -> list[str]:
    """A table's rows in pieces, each with the first line on top."""
    head, *rows = [x for x in text.splitlines() if x.strip()] or [""]
    out, held = [], [head]
    for row in rows:
        if len(held) > 1 and tokens("\n".join([*held, row])) > target:
            out.append("\n".join(held))
            held = [head]
        held.append(row)
    return [*out, "\n".join(held)] if held != [""] else []


def chunked(docs: DataFrame, id_: str = "id", text: str = "content_text", target: int = 300, overlap: int = 80) -> DataFrame:
    """(file_id, chunk_idx, text, token_count) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, k, c) for i, t in zip(rows["file_id"], rows["text"]) for k, c in enumerate(chunk(t, target, overlap))]
            yield pd.DataFrame(out, columns=["file_id", "chunk_idx", "text"])

    rows = docs.select(F.col(id_).alias("file_id"), F.col(text).alias("text")).where(F.length(F.trim(text)) > 0)
    return in_slices(rows, run, "file_id long, chunk_idx int, text string").withColumn("token_count", token_estimate(F.col("text")))


def without_noise(chunks: DataFrame) -> DataFrame:
    """Chunks but blank ones, those of signs only, and page labels."""
    return chunks.where((F.length(F.trim("text")) > 0) & ~noise(F.col("text")))


def _merged(chunks: list[tuple[int, str]], most: int) -> list[str]:
    """(page, text) in order: a chunk that begins in lower case joins the one before, if that doesn't end a sentence and its
    page is the same or next; short ones join their neighbours while they fit."""
    least = max(24, min(80, max(24, most // 4)))
    out: list[list] = []
    for page, text in chunks:
        if out and 0 <= page - out[-1][0] <= 1:
            both = f"{out[-1][1]} {text}"
            broken = text[:1].islower() and not out[-1][1].rstrip().endswith((".", "!", "?", "。", "！", "？"))
            small = min(tokens(out[-1][1]), tokens(text)) < least
            if tokens(both) <= most and (broken or small):
                out[-1] = [page, both]
                continue
        out.append([page, text])
    return [t for _, t in out]


def merged(documents: DataFrame, most: int = 600) -> DataFrame:
    """(file_id, chunk_idx, text, token_count): a row's chunks, an array of (text, page) in order, without noise, repaired and merged.

    A document's chunks come as one row, as its parser gives them, so that no row moves; null chunks are none.
    """
    noiseless = F.filter("chunks", lambda c: (F.length(F.trim(c["text"])) > 0) & ~noise(c["text"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [(i, k, t) for i, some in zip(rows["file_id"], rows["chunks"]) for k, t in enumerate(_merged([(c["page"], c["text"]) for c in some], most))]
            yield pd.DataFrame(made, columns=["file_id", "chunk_idx", "text"])

    whole = documents.where("chunks is not null").select("file_id", noiseless.alias("chunks"))
    return in_slices(whole, run, "file_id long, chunk_idx int, text string").withColumn("token_count", token_estimate(F.col("text")))


def table_chunks(tables: DataFrame, target: int = 280) -> DataFrame:
    """(file_id, chunk_idx, text): tables (file_id, text) in pieces that repeat the first line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, k, p) for i, t in zip(rows["file_id"], rows["text"]) for k, p in enumerate(table_pieces(t or "", target))]
            yield pd.DataFrame(out, columns=["file_id", "chunk_idx", "text"])

    return in_slices(tables.select("file_id", "text"), run, "file_id long, chunk_idx int, text string")


def retrieval_units(parents: DataFrame, target: int = 280, overlap: int = 48) -> DataFrame:
    """(file_id, parent_idx, chunk_idx, kind, text, contextual_text, entity_terms): parents (file_id, parent_idx, text,
    prefix, kind) whole, or in pieces if they have over 360 tokens; each with the parent's prefix and its own entities."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                text = r.text or ""
                large = thirds(text) > 3 * max(360, target)
                pieces = [text] if not large else table_pieces(text, target) if r.kind == "table" else chunk(text, max(120, target), min(max(0, overlap), max(119, target - 1)))
                out += [(r.file_id, r.parent_idx, k, r.kind, p, (r.prefix or "") + p) for k, p in enumerate(pieces) if p]
            yield pd.DataFrame(out, columns=["file_id", "parent_idx", "chunk_idx", "kind", "text", "contextual_text"])

    cut = in_slices(parents.select("file_id", "parent_idx", "text", "prefix", "kind"), run, "file_id long, parent_idx int, chunk_idx int, kind string, text string, contextual_text string")
    return cut.withColumn("entity_terms", entities(F.col("text")))


_PAGE, _HEADING = re.compile(r"^\[Page\s+(\d+)\]$", re.I), re.compile(r"^(#{1,6})\s+(.+)$")
_CELLS, _ITEM = re.compile(r"\t|\|"), re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")


def kind_of(text: str) -> str:
    """table or list where half of several lines are, else text."""
    lines = [x for x in text.split("\n") if x]
    if len(lines) > 1:
        for kind, pattern in (("table", _CELLS), ("list", _ITEM)):
            if 2 * sum(bool(pattern.search(x)) for x in lines) >= len(lines):
                return kind
    return "text"


def sections(text: str) -> list[tuple[str, tuple[str, ...], int | None, str]]:
    """(text, headings above, page, kind) of the blocks of a text; headings and page marks are no blocks."""
    out, above, page, held = [], [], None, []

    def flush() -> None:
        block = "\n".join(held).strip()
        held.clear()
        if block:
            out.append((block, tuple(above), page, kind_of(block)))

    for line in text.replace("\r\n", "\n").split("\n"):
        if m := _PAGE.match(line):
            flush()
            page = int(m[1])
        elif m := _HEADING.match(line):
            flush()
            del above[len(m[1]) - 1 :]
            above.append(m[2].strip())
        elif line.strip():
            held.append(line)
        else:
            flush()
    flush()
    return out or [(text.strip(), (), None, "text")]


def document_chunks(files: DataFrame, words: int = 300, overlap: int = 48, most: int = 500) -> DataFrame:
    """(file_id, chunk_idx, parent_idx, kind, section_path, page_start, text, contextual_text, token_count): the chunks
    of files (id, title, note, text): title and note if there are, then the sections' parents in units; the first most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                own: list[tuple] = []
                for kind, text, label in (("title", (r.title or "").strip(), (r.title or "").strip()), ("note", (r.note or "").strip(), "User note")):
                    if text:
                        shown = f"User note: {text}" if kind == "note" else text
                        own.append((kind, [label], None, shown, shown, len(own)))
                parent = len(own)
                for text, path, page, kind in sections(r.text or ""):
                    cut = (lambda t, n, o: table_pieces(t, n)) if kind == "table" else chunk
                    for whole in cut(text, words, 0):
                        for piece in cut(whole, min(300, words), overlap) if thirds(whole) > 3 * max(360, min(300, words)) else [whole]:
                            context = "\n".join(x for x in (f"Section: {' > '.join(path)}" if path else "", f"Page: {page}" if page else "", piece) if x)
                            own.append((kind, list(path), page, piece, context, parent))
                        parent += 1
                    if len(own) >= most:
                        break
                out += [(r.id, i, p, kind, path, page, text, context) for i, (kind, path, page, text, context, p) in enumerate(own[:most])]
            made = pd.DataFrame(out, columns=["file_id", "chunk_idx", "parent_idx", "kind", "section_path", "page_start", "text", "contextual_text"])
            yield made.astype({"page_start": "Int32"})

    schema = "file_id long, chunk_idx int, parent_idx int, kind string, section_path array<string>, page_start int, text string, contextual_text string"
    return in_slices(files.select("id", "title", "note", "text"), run, schema).withColumn("token_count", token_estimate(F.col("contextual_text")))


def with_title(title: Column, context: Column, most: int) -> Column:
    """The context with the document's title in front, if that isn't in it and fits the tokens."""
    name = concept(title)
    longer = F.concat(F.lit("Document: "), title, F.lit("\n\n"), context)
    return F.when((name != "") & ~F.contains(concept(context), name) & (token_estimate(longer) <= most), longer).otherwise(context)


def to_index(files: DataFrame, signature: str) -> DataFrame:
    """Files with a text that are no folder or duplicate and whose index, if any, has another signature."""
    held = F.col("indexed_at").isNotNull() & F.col("index_signature").eqNullSafe(F.lit(signature))
    return files.where(~F.col("is_directory") & ~held & F.col("duplicate_of_file_id").isNull() & (F.length(F.trim("content_text")) > 0))


def signature(*parts: Column) -> Column:
    """A digest of a configuration's parts."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def without_corrupted(chunks: DataFrame, least: float = 0.7) -> DataFrame:
    """chunks but for unreadable ones of files that have readable ones."""
    judged = chunks.withColumn("_readable", letter_ratio(F.col("text")) >= least)
    files = judged.groupBy("file_id").agg(F.bool_or("_readable").alias("_some"))
    return judged.join(files, "file_id").where(F.col("_readable") | ~F.col("_some")).drop("_readable", "_some")


def appended(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second list of each file's chunks behind the first one's last."""
    last = first.groupBy("file_id").agg(F.max("chunk_idx").alias("_last"))
    moved = second.join(last, "file_id", "left").withColumn("chunk_idx", F.col("chunk_idx") + F.coalesce(F.col("_last") + 1, F.lit(0))).select(*first.columns)
    return first.unionByName(moved)


def _balanced(parts: list[str], separator: str) -> list[str]:
    middle, done, best = sum(map(len, parts)) / 2, 0, (float("inf"), 1)
    for i, p in enumerate(parts[:-1], 1):
        done += len(p)
        best = min(best, (abs(done - middle), i))
    return [separator.join(parts[: best[1]]), separator.join(parts[best[1] :])]


def halved(text: str) -> list[str]:
    """Two halves of a text, parted at the paragraph, else sentence, else space, else character nearest the middle; none if it can't be."""
    for parts, separator in (([p.strip() for p in _PARAGRAPH.split(text) if p.strip()], "\n\n"), (sentences(text), " ")):
        if len(parts) > 1:
            return _balanced(parts, separator)
    middle = len(text) // 2
    spaces = [i for i, c in enumerate(text) if c.isspace()]
    at = min(spaces, key=lambda i: (abs(i - middle), i)) if spaces else middle
    both = [text[:at].strip(), text[at:].strip()]
    return both if all(both) else []


def halves(texts: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first, second): each text's halves, null where it can't be parted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            both = [halved(t or "") or [None, None] for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "first": [x[0] for x in both], "second": [x[1] for x in both]})

    return in_slices(texts.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, first string, second string")


def broken_sentences(chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_idx, broken): whether a chunk goes on with the sentence of the one before."""
    before = F.lag("text").over(Window.partitionBy("file_id").orderBy("chunk_idx"))
    held = chunks.withColumn("before", before)
    broken = F.col("before").isNotNull() & F.col("text").rlike("^[a-z]") & ~F.coalesce("before", F.lit("")).rlike("[.!?。！？]\\s*$")
    return held.select("file_id", "chunk_idx", broken.alias("broken"))

