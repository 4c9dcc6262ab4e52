"""Text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as Han, each two thirds of a token.
HAN = "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2EBEF}\\x{30000}-\\x{323AF}"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """What then makes of the value, which is computed once a row, however often then reads it."""
    return F.get(F.transform(F.array(value), then), 0)


def token_estimate(text: Column) -> Column:
    """Two thirds for each Han character, four thirds for a run of ASCII word characters, one for any
    other sign; rounded up. Empty and null texts have none."""
    han = F.regexp_count(text, F.lit(f"[{HAN}]"))
    words = F.regexp_count(text, F.lit("[A-Za-z0-9'_-]+"))
    others = F.regexp_count(text, F.lit(f"[^\\sA-Za-z0-9'_{HAN}-]"))
    total = F.ceil(F.round(han * F.lit(2 / 3) + words * F.lit(4 / 3) + others, 9))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(total, F.lit(1))).cast("int")


def like_literal(text: Column, part: str) -> Column:
    """Whether the part occurs, letter case aside; wildcards stand for themselves."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def boundaries(text: Column) -> Column:
    """Spaces where camel case or a script begins: aB, ABc, Han beside Latin."""
    for pattern in ("(?<=[a-z0-9])(?=[A-Z])", "(?<=[A-Z])(?=[A-Z][a-z])", "(?<=\\p{IsHan})(?=[A-Za-z0-9])", "(?<=[A-Za-z0-9])(?=\\p{IsHan})"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def concept(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]", "")


def terms(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words of two or more characters that aren't stop words, in order."""
    words = F.split(F.lower(text), "[^\\p{L}\\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop) if stop else F.length(w) >= 2))


def excerpt(text: Column, term: str, limit: int = 240, before: int = 72) -> Column:
    """The text around the first occurrence of the term, white space collapsed, cut ends marked."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    at = F.greatest(F.locate(term.lower(), F.lower(flat)), F.lit(1))
    start = F.greatest(at - before, F.lit(1))
    end = F.least(start + limit - 1, F.length(flat))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.trim(F.substring(flat, start, end - start + 1)), F.when(end < F.length(flat), "…").otherwise(""))


def distinctive_identifier(term: Column) -> Column:
    """2 to 32 ASCII letters and digits with a digit, or all capitals."""
    return term.rlike("^[A-Za-z0-9]{2,32}$") & (term.rlike("[0-9]") | term.rlike("^[A-Z]+$"))


def strong_phrase(term: Column) -> Column:
    """Two or more words, or four or more Han characters, and no identifier."""
    return ((F.size(F.split(F.trim(term), "\\s+")) >= 2) | (F.regexp_count(term, F.lit("\\p{IsHan}")) >= 4)) & ~distinctive_identifier(term)


def noise(text: Column) -> Column:
    """Signs only, or a page label."""
    return ~text.rlike("[\\p{L}\\p{N}]") | F.trim(text).rlike("(?i)^(page|p\\.?)\\s*[0-9]+(\\s*(of|/)\\s*[0-9]+)?$")


def letter_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\p{L}")) / F.greatest(F.length(text), F.lit(1))


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def are_duplicates(a: Column, b: Column) -> Column:
    """Similar by 0.8, or one holds the other, which has four or more characters and 0.35 of its length."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    held = (F.length(short) >= 4) & (F.length(short) / F.length(long) >= 0.35) & F.contains(long, short)
    return held | (similarity(a, b) >= 0.8)


def extension(name: Column) -> Column:
    """Lower-case extension without its dot; none if there is no sensible one."""
    found = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]{1,16})$", 1))
    return F.when(found == "", F.lit(None)).otherwise(found)


#: Extensions of each category.
CATEGORY_EXTENSIONS = {
    "document": ("pdf", "doc", "docx", "docm", "txt", "md", "rtf", "pages", "xls", "xlsx", "xlsm", "ppt", "pptx", "ppsx", "csv", "key", "keynote", "numbers", "epub", "odt", "ods", "odp"),
    "image": ("png", "jpg", "jpeg", "gif", "heic", "tiff", "bmp", "svg", "webp", "psd", "sketch"),
    "video": ("mp4", "mov", "avi", "mkv", "m4v", "wmv", "flv", "webm"),
    "audio": ("mp3", "wav", "aac", "flac", "m4a", "ogg", "aiff"),
    "code": ("swift", "py", "js", "ts", "tsx", "jsx", "java", "kt", "go", "rs", "c", "cpp", "h", "hpp", "cs", "rb", "php", "sh", "sql", "json", "yaml", "yml", "html", "css", "vue", "lua", "r"),
    "archive": ("zip", "rar", "7z", "tar", "gz", "bz2", "xz", "dmg", "iso"),
}


def category(ext: Column) -> Column:
    known = F.create_map(*(F.lit(x) for name, group in CATEGORY_EXTENSIONS.items() for e in group for x in (e, name)))
    return F.coalesce(F.try_element_at(known, F.lower(ext)), F.lit("other"))


def folder_name(name: Column) -> Column:
    """The name if it's a safe single folder name, else null."""
    flat = F.trim(name)
    return F.when(flat.rlike("^[^/\\\\:\\x00-\\x1f]{1,80}$") & ~flat.rlike("^\\.") & ~flat.isin("", ".", ".."), flat)


def slug(name: Column, longest: int = 64) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")), 1, longest)


def runaway(text: Column, tail: int = 256) -> Column:
    """Whether the last characters occur twice or more before (of texts of three times their number)."""
    head, end = F.substring(text, F.lit(1), F.length(text) - tail), F.right(text, F.lit(tail))
    return (F.length(text) >= 3 * tail) & ((F.length(head) - F.length(F.replace(head, end, F.lit("")))) / tail >= 2)


def slices(text: Column, width: int = 320) -> Column:
    """The text in slices of so many characters."""
    n = F.ceil(F.length(text) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def years(text: Column) -> Column:
    """Years from 1900 to 2099 that stand by themselves, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1))))


#: Entity patterns (identifiers with digits, mail addresses, dates, amounts). Their parts that
#: begin anywhere in a run of signs have 255 characters at most, so that a text takes linear time.
ENTITY_PATTERNS = (
    "(?iU)\\b[A-Z0-9][A-Z0-9._/-]{2,255}[0-9][A-Z0-9._/-]*\\b", "(?iU)\\b[\\w.%+-]{1,255}@[\\w.-]{1,255}\\.[A-Za-z]{2,255}\\b",
    "(?U)\\b[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\\b", "(?i)(?:[$€£¥]|SGD|USD|EUR|CNY|RMB)\\s*[0-9][0-9,.]*",
)


def entities(text: Column) -> Column:
    """Sorted distinct lower-case entities of three or more characters."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in ENTITY_PATTERNS)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda t: F.lower(F.trim(t))), lambda t: F.length(t) >= 3)))


def citations(answer: Column) -> Column:
    """Distinct [F#:P#] marks in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit("\\[F[0-9]+:P[0-9]+\\]"), F.lit(0)))


def version_key(version: Column, parts: int = 4) -> Column:
    """The numbers of a version, filled up with zeros, for sorting."""
    found = F.transform(F.regexp_extract_all(version, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long"))
    return F.slice(F.concat(found, F.array_repeat(F.lit(0).cast("long"), parts)), 1, parts)


def time_code(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on."""
    s = F.floor(seconds).cast("int")
    return F.when(s >= 3600, F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60)).otherwise(F.format_string("%02d:%02d", (s / 60).cast("int"), s % 60))


def fold(text: str | None) -> str | None:
    """Trimmed, without case and diacritics."""
    if text is None:
        return None
    flat = unicodedata.normalize("NFKD", text.strip()).casefold()
    return "".join(c for c in flat if not unicodedata.combining(c))


def folded(text: Column) -> Column:
    """fold for a column: Spark has no Unicode normalisation of its own."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(fold, na_action="ignore")

    return of(text)


def sentences(text: Column) -> Column:
    """Sentences by their end marks and line ends, trimmed, blank ones left out."""
    parts = F.regexp_extract_all(text, F.lit("[^.!?。！？\\n]+[.!?。！？]*\\s*|[.!?。！？]+\\s*"), F.lit(0))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != "")


def units(text: Column, target: int) -> Column:
    """Trimmed paragraphs, those of more tokens than the target as their sentences; blank ones left out."""
    paragraphs = F.transform(F.split(text, "\n[\t ]*\n+"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", ""))

    def parts(p: Column) -> Column:
        # a text has no more tokens than four thirds of its characters, and some
        short = F.length(p) * 4 <= target * 3
        return F.when(short, F.array(p)).when(token_estimate(p) > target, let(sentences(p), lambda own: F.when(F.size(own) > 1, own).otherwise(F.array(p)))).otherwise(F.array(p))

    return F.filter(F.flatten(F.transform(paragraphs, parts)), lambda u: u != "")


def first_sentences(text: Column, n: int = 3) -> Column:
    """The first sentences, by their end marks."""
    return F.trim(F.regexp_extract(text, f"(?s)^((?:.*?[.!?。！？]+(?:\\s+|$)){{1,{n}}}|.*)", 1))


def natural_key(name: Column) -> Column:
    """Sorts digits by their value: each run is filled up to twelve."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 12, "0")).otherwise(p)), "")


def repaired_json(text: Column) -> Column:
    """From the first brace to the last, trailing commas taken out."""
    return F.regexp_replace(F.regexp_extract(text, "(?s)(\\{.*\\})", 1), ",\\s*([}\\]])", "$1")


def is_pattern(pattern: str) -> re.Pattern:
    """A rule's glob as a regular expression over whole names."""
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower()))
