"""What a question says about a search, as Column expressions over its text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import CATEGORY_EXTENSIONS, boundaries, distinctive_identifier, entities, extension, let, years

#: Words that say nothing about what a file holds.
STOP_WORDS = (
    "the", "and", "with", "this", "that", "what", "where", "which", "please", "find", "show", "list", "file", "files", "document", "documents",
    "latest", "recent", "newest", "last", "的", "文件", "文档", "哪里", "在哪", "位置", "查找", "请", "找出", "列出", "最近", "最新", "近期", "张", "个", "十张",
)
#: Words for kinds of entries.
STRUCTURAL_WORDS = (
    "file", "files", "document", "documents", "folder", "folders", "directory", "directories", "image", "images", "picture", "pictures", "photo", "photos",
    "video", "videos", "audio", "archive", "archives", "code", "source", "文件", "文档", "文件夹", "图片", "照片", "视频", "音频", "压缩包", "代码", "源码",
)
#: Phrases for days relative to today.
RELATIVE_DATES = (
    "day before yesterday", "最近 30 天", "过去 30 天", "last 30 days", "past 30 days", "最近30天", "过去30天", "最近 7 天", "过去 7 天", "last 7 days", "past 7 days",
    "最近7天", "过去7天", "this month", "last month", "this week", "last week", "this year", "last year", "这个月", "上个月", "本月", "本周", "这周", "上周", "今年",
    "本年", "去年", "前天", "yesterday", "昨天", "today", "今天",
)
#: Words that a question may have beside a date and still ask for nothing but the date.
DATE_ONLY_WORDS = (
    "documents", "document", "files", "file", "pictures", "picture", "modified", "show", "find", "list", "please", "give me", "from", "the",
    "有哪些", "有什么", "文件", "文档", "图片", "修改", "查找", "找出", "显示", "列出", "给我", "请", "的",
)
#: Wordings that ask for what the texts say.
CONTENT_MARKERS = (
    "contains", "containing", "mentions", "mentioning", "says", "text", "content", "body", "full text", "exact phrase", "keyword",
    "包含", "含有", "提到", "出现", "正文", "内容", "全文", "关键词",
)
#: Wordings that ask for what is new.
RECENCY_MARKERS = ("最近", "最新", "近期", "新近", "latest", "recent", "newest", "last ")
#: Closed classes of English words, in place of a tagger: prepositions, conjunctions, determiners, pronouns, particles, interjections.
CLOSED_WORDS = (
    "about", "above", "after", "all", "an", "and", "any", "as", "at", "before", "below", "between", "but", "by", "each", "every", "for", "from", "he", "her", "hers", "him", "his", "if",
    "in", "into", "it", "its", "me", "my", "no", "nor", "not", "of", "off", "oh", "on", "or", "our", "out", "over", "she", "so", "some", "than", "that", "the", "their", "them", "these",
    "they", "this", "those", "to", "under", "up", "us", "we", "what", "which", "while", "who", "with", "without", "wow", "you", "your",
)
EXTENSIONS = tuple(sorted({e for group in CATEGORY_EXTENSIONS.values() for e in group}))


def _any_of(words: tuple[str, ...]) -> str:
    """A pattern for any of the words, longest first."""
    return "|".join(re.escape(w).replace("\\ ", " ") for w in sorted(words, key=lambda w: (-len(w), w)))


def nocase(text: Column) -> Column:
    """ASCII letters lowered, others as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def compatible(text: Column) -> Column:
    """Compatibility characters as their plain forms, lowered (NFKC): Spark has no normalisation of its own."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t).lower(), na_action="ignore")

    return of(text)


def first_of_equals(values: Column, key: Callable[[Column], Column]) -> Column:
    """The values whose key no earlier value has, in order."""
    tagged = F.array_sort(F.transform(values, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    kept = let(tagged, lambda all_: F.filter(all_, lambda z, i: (i == 0) | (F.get(all_, i - 1)["k"] != z["k"])))
    return F.transform(F.array_sort(F.transform(kept, lambda z: F.struct(z["i"].alias("i"), z["x"].alias("x")))), lambda s: s["x"])


def unique_terms(terms: Column) -> Column:
    """Trimmed terms, blank ones left out, the first of those that differ by letter case only."""
    return first_of_equals(F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != ""), F.lower)


def variants(question: Column) -> Column:
    """The question, the question with word borders shown, and its words."""
    both = let(F.trim(question), lambda compact: F.array(compact, boundaries(compact)))
    return unique_terms(let(both, lambda b: F.concat(b, F.split(F.get(b, 1), "\\s+"))))


def relevance_terms(text: Column) -> Column:
    """Distinct lower-case words of two or more characters that aren't stop words, in order."""
    words = F.split(F.lower(text), "[^\\p{L}\\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS)))


def stripped(question: Column) -> Column:
    """The question without relative dates and words for kinds of entries."""
    return F.regexp_replace(question, f"(?iu){_any_of(RELATIVE_DATES + STRUCTURAL_WORDS)}", " ")


def structural(value: Column) -> Column:
    """Whether a term names a date, an extension or a kind of entry."""
    low = F.lower(F.trim(value))
    han = tuple(w for w in STRUCTURAL_WORDS if not w.isascii())
    held = low.rlike(_any_of(RELATIVE_DATES + tuple(e for e in EXTENSIONS if len(e) >= 2) + han))
    words = F.split(low, "[^\\p{L}\\p{N}]+")
    return (low != "") & (held | F.exists(words, lambda w: w.isin(*STRUCTURAL_WORDS, *EXTENSIONS)))


def evidence_term(value: Column) -> Column:
    """Whether a term can show that a text is meant: two or more characters, not structural, of an open class."""
    low = F.lower(F.trim(value))
    return (F.length(low) >= 2) & ~low.isin(*CLOSED_WORDS) & ~structural(value)


def content_terms(question: Column) -> Column:
    """Terms that texts are searched for."""
    found = F.flatten(F.transform(variants(stripped(question)), relevance_terms))
    return unique_terms(F.filter(F.array_distinct(found), evidence_term))


def asks_for_content(question: Column) -> Column:
    """Whether the question says that texts are meant, by a wording or by two quotation marks."""
    return F.lower(question).rlike(_any_of(CONTENT_MARKERS)) | (F.regexp_count(question, F.lit("[\"“”「」]")) >= 2)


def prefers_recent(question: Column) -> Column:
    return F.lower(question).rlike(_any_of(RECENCY_MARKERS))


def date_only(question: Column) -> Column:
    """Whether nothing is left of the question without its dates and the words around them."""
    rest = F.regexp_replace(F.lower(question), _any_of(RELATIVE_DATES), " ")
    return ~F.regexp_replace(rest, _any_of(DATE_ONLY_WORDS), " ").rlike("[\\p{L}\\p{N}]")


def single_identifier_allowed(question: Column) -> Column:
    """No question mark, and one or two words beside dates and kinds."""
    words = F.filter(F.split(stripped(F.trim(question)), "\\s+"), lambda w: w != "")
    return ~F.trim(question).rlike("[?？]") & F.size(words).between(1, 2)


def identifiers(question: Column) -> Column:
    return F.filter(variants(question), distinctive_identifier)


def exact_name(value: Column) -> Column:
    """Whether a term can be a file's name: it ends in a known extension."""
    return F.coalesce(extension(F.trim(value)).isin(*EXTENSIONS), F.lit(False))


def search_terms(question: Column, more: Column) -> Column:
    """The question's terms, then those of a plan that are file names or evidence."""
    return unique_terms(F.concat(content_terms(question), F.filter(more, lambda t: exact_name(t) | evidence_term(t))))


def routed_entities(question: Column, dated: Column) -> Column:
    """The question's entities, without its years where a date filter has them."""
    found = entities(question)
    return F.when(dated, F.array_except(found, years(question))).otherwise(found)


def chunk_route(asked: Column, entity_terms: Column, candidates: Column, chunks: Column) -> Column:
    """disabled, scoped within the candidates, or global."""
    wanted = chunks & (asked | (F.size(entity_terms) > 0))
    return F.when(~wanted, "disabled").when(candidates > 0, "scoped").otherwise("global")


def structured_confidence(planned: Column, content: Column, filtered: Column) -> Column:
    """Of a file that meets filters only."""
    return F.when(~planned, 0.30).when(content, 0.20).when(filtered, 0.60).otherwise(0.30)


def standalone_year(text: Column, year: Column) -> Column:
    """Whether the year occurs with no number beside it."""
    return F.exists(F.regexp_extract_all(text, F.lit("\\p{N}+"), F.lit(0)), lambda n: n == year.cast("string"))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


#: Wordings by which a learned text would change the instructions.
UNSAFE = ("ignore previous", "ignore all previous", "disregard previous", "reveal the system prompt", "expose the system prompt", "api key", "authentication token")


def unsafe(text: Column) -> Column:
    return F.lower(text).rlike(_any_of(UNSAFE))


def plausible_translation(source: Column, translation: Column, target: str) -> Column:
    """Whether a translation into zh or en can be one: enough letters of the script, other words than the source."""

    def flat(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", "")

    han = F.lit("[\\u4E00-\\u9FFF]")
    changed = flat(source) != flat(translation)
    if target == "zh":
        due = (F.regexp_count(source, F.lit("\\p{L}")) >= 48) & (F.regexp_count(source, F.lit("\\p{Ll}")) >= 12)
        return ~due | (changed & (F.regexp_count(translation, han) >= 8))
    latin = F.regexp_count(translation, F.lit("[\\p{L}&&[\\u0000-\\u024F]]"))
    return (F.regexp_count(source, han) < 8) | ((latin >= 12) & changed)


def snippet(text: Column, term: str, words: int = 96) -> Column:
    """So many words around the first word that holds the term; cut ends marked."""
    parts = F.split(collapsed(text), " ")
    at = F.greatest(F.coalesce(F.array_position(F.transform(parts, lambda w: F.contains(F.lower(w), F.lit(term.lower()))), True), F.lit(0)), F.lit(1)).cast("int")
    begin = F.greatest(F.lit(1), F.least(at - words // 2, F.size(parts) - words + 1))
    return F.concat(F.when(begin > 1, "…").otherwise(""), F.array_join(F.slice(parts, begin, F.lit(words)), " "), F.when(begin + words <= F.size(parts), "…").otherwise(""))


def streamed_field(text: Column, field: str) -> Column:
    """A string field of a JSON object that is still being written, as far as it goes; null before its value begins."""
    found = F.regexp_extract(text, f'"{field}"\\s*:\\s*"((?:[^"\\\\\\\\]|\\\\\\\\.)*+)', 1)
    begun = text.rlike(f'"{field}"\\s*:\\s*"')
    return F.when(begun, F.regexp_replace(F.regexp_replace(found, '\\\\\\\\(["\\\\\\\\/])', "$1"), "\\\\\\\\n", "\n"))


def string_list(text: Column) -> Column:
    """A JSON array of strings; what isn't one is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def line_kind(line: Column) -> Column:
    """page, heading, blank, table, list or text."""
    return (
        F.when(line.rlike("(?i)^\\[Page\\s+[0-9]+\\]$"), "page").when(line.rlike("^#{1,6}\\s+.+$"), "heading").when(F.trim(line) == "", "blank")
        .when(line.rlike("[\\t|]"), "table").when(line.rlike("^\\s*(?:[-*•]|[0-9]+[.)])\\s+"), "list").otherwise("text")
    )


def block_kind(text: Column) -> Column:
    """table or list where half of several lines are, else text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n = F.size(lines)
    half = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))) >= F.ceil(n / 2)
    return F.when((n > 1) & half("\\t|\\|"), "table").when((n > 1) & half("^\\s*(?:[-*•]|[0-9]+[.)])\\s+"), "list").otherwise("text")


def page_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), "unknown").when(end.isNull() | (end == start), start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def path_label(path: Column, title: Column) -> Column:
    return F.when(F.size(F.coalesce(path, F.array().cast("array<string>"))) == 0, title).otherwise(F.array_join(path, " > "))
