"""Plans of searches as Column expressions: what a question says by its words, and a model's proposal under what it says.

A plan is a struct of PLAN. Wordings are English and Chinese; days are half-open intervals of dates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import questions as qs
from lectern.functions.text import boundaries, let, years

PLAN = """semantic_query string, keywords array<string>, exact_name string, extensions array<string>, categories array<string>, folder_terms array<string>, item_kind string,
date_field string, starts date, ends date, min_size bigint, max_size bigint, has_note boolean, is_indexed boolean, content_mode string, sort string"""
MOST_KEYWORDS = 8
#: Wordings of categories, of families of extensions, and of other constraints, in the order in which they count.
CATEGORY_WORDS = {
    "document": ("文档", "pdf", "word", "docx", "document"), "image": ("图片", "照片", "截图", "image", "photo", "screenshot"), "video": ("视频", "video", "movie"),
    "audio": ("音频", "录音", "audio", "recording"), "code": ("代码", "源码", "code", "source"), "archive": ("压缩包", "归档", "zip", "archive"),
}
EXTENSION_WORDS = ((("word",), ("doc", "docx")), (("excel", "spreadsheet"), ("xls", "xlsx", "csv")), (("powerpoint", "slides"), ("ppt", "pptx")), (("markdown",), ("md",)), (("jpeg",), ("jpg", "jpeg")))
ITEM_WORDS = {"directory": ("folders", "directories", "folder only", "directory only", "查找文件夹", "显示文件夹", "文件夹本身"), "file": ("files", "file only", "文件")}
DATE_FIELD_WORDS = {"organized": ("organized", "moved", "sorted", "整理", "移动"), "added": ("added", "imported", "discovered", "添加", "导入")}
NO_NOTE, NOTE = ("without note", "no note", "没有备注", "无备注"), ("with note", "has note", "有备注")
NOT_INDEXED, INDEXED = ("unindexed", "not indexed", "未索引"), ("indexed", "已索引")
SORT_WORDS = {"largest": ("largest", "biggest", "最大"), "smallest": ("smallest", "最小"), "oldest": ("oldest", "最早", "最旧")}
NAME_SIGNS = "\"'“”‘’()[]{}<>,;:!?，。；：！？"
DAYS_30, DAYS_7 = ("最近30天", "过去 30 天", "过去30天", "last 30 days", "past 30 days"), ("最近7天", "过去 7 天", "过去7天", "last 7 days", "past 7 days")


def _says(question: Column, words: tuple[str, ...]) -> Column:
    return F.lower(question).rlike(qs._any_of(words))


def _first(question: Column, words: dict[str, tuple[str, ...]], otherwise: Column) -> Column:
    return F.coalesce(*(F.when(_says(question, w), F.lit(name)) for name, w in words.items()), otherwise)


def relative_days(question: Column, today: Column, monday_first: bool = True) -> Column:
    """struct<starts,ends> of the first relative date that the question has, in the order in which they count; null if none."""
    week = F.trunc(today, "week") if monday_first else F.date_sub(today, F.dayofweek(today) - 1)
    month, year = F.trunc(today, "month"), F.trunc(today, "year")
    between = lambda a, b: F.struct(a.cast("date").alias("starts"), b.cast("date").alias("ends"))
    day = lambda n: between(F.date_sub(today, n), F.date_sub(today, n - 1))
    cases = [
        (DAYS_30, between(F.date_sub(today, 29), F.date_add(today, 1))), (DAYS_7, between(F.date_sub(today, 6), F.date_add(today, 1))),
        (("day before yesterday", "前天"), day(2)), (("yesterday", "昨天"), day(1)), (("today", "今天"), day(0)),
        (("last week", "上周"), between(F.date_sub(week, 7), week)), (("this week", "本周", "这周"), between(week, F.date_add(week, 7))),
        (("last month", "上个月"), between(F.add_months(month, -1), month)), (("this month", "本月", "这个月"), between(month, F.add_months(month, 1))),
        (("last year", "去年"), between(F.add_months(year, -12), year)), (("this year", "今年", "本年"), between(year, F.add_months(year, 12))),
    ]
    return F.coalesce(*(F.when(_says(question, words), interval) for words, interval in cases))


def _own_year(found: Column) -> Column:
    """struct<starts,ends> of the one year of those that a question names; null if it names none or several."""
    start = F.make_date(F.get(found, 0).cast("int"), F.lit(1), F.lit(1))
    return F.when(F.size(found) == 1, F.struct(start.alias("starts"), F.add_months(start, 12).alias("ends")))


def extensions(question: Column) -> Column:
    """Sorted extensions that the question names, by themselves or by a family's name."""
    def found(low: Column) -> Column:
        named = F.filter(F.split(low, "[^\\p{L}\\p{N}]+"), lambda w: w.isin(*qs.EXTENSIONS))
        families = [F.when(low.rlike(qs._any_of(words)), F.array(*map(F.lit, own))).otherwise(F.array().cast("array<string>")) for words, own in EXTENSION_WORDS]
        return F.array_sort(F.array_distinct(F.concat(named, *families)))

    return let(F.lower(boundaries(question)), found)


def categories(question: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(_says(question, words), F.lit(name)) for name, words in CATEGORY_WORDS.items()))))


def exact_name(question: Column) -> Column:
    """The first token that is a file's name, without the signs around it; null if none is."""
    tokens = F.transform(F.split(question, "\\s+"), lambda t: F.btrim(t, F.lit(NAME_SIGNS)))
    return F.get(F.filter(tokens, qs.exact_name), 0)


def content_mode(question: Column) -> Column:
    """indexed_content where texts are asked for, metadata_only for a name or mere constraints, else automatic."""
    return let(_said(question, F.lit("2000-01-01").cast("date")), _content_mode)


def _said(question: Column, today: Column, monday_first: bool = True) -> Column:
    """What a question says by its words, that several fields of a plan read."""
    return F.struct(
        question.alias("question"), qs.content_terms(question).alias("terms"), relative_days(question, today, monday_first).alias("days"), years(question).alias("years"),
        exact_name(question).alias("exact_name"), extensions(question).alias("extensions"), categories(question).alias("categories"), item_kind(question).alias("item_kind"),
    )


def _content_mode(said: Column) -> Column:
    constrained = said["days"].isNotNull() | (F.size(said["years"]) > 0) | (F.size(said["extensions"]) > 0) | (F.size(said["categories"]) > 0) | (said["item_kind"] != "any")
    return F.when(qs.asks_for_content(said["question"]), "indexed_content").when(said["exact_name"].isNotNull() | ((F.size(said["terms"]) == 0) & constrained), "metadata_only").otherwise("automatic")


def item_kind(question: Column) -> Column:
    return _first(question, ITEM_WORDS, F.lit("any"))


def inferred(question: Column, today: Column, monday_first: bool = True) -> Column:
    """PLAN of a question by its words alone; a null question is an empty one."""
    return let(_said(F.coalesce(question, F.lit("")), today, monday_first), _plan)


def _plan(said: Column) -> Column:
    q, size = said["question"], F.lit(None).cast("bigint")
    interval = F.coalesce(said["days"], _own_year(said["years"]))
    return F.struct(
        F.array_join(said["terms"], " ").alias("semantic_query"),
        F.slice(said["terms"], 1, MOST_KEYWORDS).alias("keywords"),
        said["exact_name"].alias("exact_name"),
        said["extensions"].alias("extensions"),
        said["categories"].alias("categories"),
        F.array().cast("array<string>").alias("folder_terms"),
        said["item_kind"].alias("item_kind"),
        _first(q, DATE_FIELD_WORDS, F.lit("modified")).alias("date_field"),
        interval["starts"].alias("starts"),
        interval["ends"].alias("ends"),
        size.alias("min_size"),
        size.alias("max_size"),
        F.when(_says(q, NO_NOTE), False).when(_says(q, NOTE), True).alias("has_note"),
        F.when(_says(q, NOT_INDEXED), False).when(_says(q, INDEXED), True).alias("is_indexed"),
        _content_mode(said).alias("content_mode"),
        _first(q, SORT_WORDS, F.when(qs.prefers_recent(q), "newest").otherwise("relevance")).alias("sort"),
    )


def _han(text: Column) -> Column:
    return text.rlike("[\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF]")


def reconciled(proposed: Column, local: Column, question: Column) -> Column:
    """PLAN of a proposal (PLAN, without nulls but for names, dates, sizes and requirements) under a question's own plan.

    Dates, extensions, categories and the kind of entry are the question's where it has any; what it says of notes and of the
    index counts always; the order, bounds of size and folders are the proposal's. Its wording serves if it
    names no constraint, beside the question's terms if only these are Chinese; of its keywords those that can be evidence.
    """
    q = F.coalesce(question, F.lit(""))
    told = F.struct(q.alias("question"), qs.content_terms(q).alias("terms"), F.filter(proposed["keywords"], qs.evidence_term).alias("evidence"), F.trim(proposed["semantic_query"]).alias("wording"))
    return let(told, lambda t: _reconciled(proposed, local, t))


def _reconciled(proposed: Column, local: Column, told: Column) -> Column:
    q, terms, evidence, wording = (told[f] for f in ("question", "terms", "evidence", "wording"))
    p, m = lambda f: proposed[f], lambda f: local[f]
    own = lambda f: F.when(F.size(m(f)) > 0, m(f)).otherwise(p(f))
    dated = m("starts").isNotNull()
    clean = (wording != "") & ~qs.structural(wording)
    semantic = F.when(clean & _han(q) & ~_han(wording), F.array_join(qs.unique_terms(F.array(wording, m("semantic_query"))), " ")).when(clean, wording).otherwise(F.array_join(qs.unique_terms(F.concat(terms, evidence)), " "))
    low, high = F.greatest(F.nullif(p("min_size"), F.lit(0)), F.lit(0).cast("bigint")), F.greatest(p("max_size"), F.lit(0).cast("bigint"))
    low, high = F.when(p("min_size").isNotNull() & (p("min_size") != 0), low), F.when(p("max_size").isNotNull(), high)
    crossed = F.coalesce(low > high, F.lit(False))
    mode = F.when((p("content_mode") == "metadata_only") & (F.size(terms) > 0), "automatic").when(p("content_mode") == "automatic", m("content_mode")).otherwise(p("content_mode"))
    return F.struct(
        semantic.alias("semantic_query"),
        F.slice(qs.unique_terms(evidence), 1, MOST_KEYWORDS).alias("keywords"),
        F.coalesce(m("exact_name"), p("exact_name")).alias("exact_name"),
        own("extensions").alias("extensions"),
        own("categories").alias("categories"),
        p("folder_terms").alias("folder_terms"),
        F.when(m("item_kind") != "any", m("item_kind")).otherwise(p("item_kind")).alias("item_kind"),
        F.when(dated, m("date_field")).otherwise(p("date_field")).alias("date_field"),
        F.when(dated, m("starts")).otherwise(p("starts")).alias("starts"),
        F.when(dated, m("ends")).otherwise(p("ends")).alias("ends"),
        F.when(crossed, high).otherwise(low).alias("min_size"),
        F.when(crossed, low).otherwise(high).alias("max_size"),
        m("has_note").alias("has_note"),
        m("is_indexed").alias("is_indexed"),
        mode.alias("content_mode"),
        p("sort").alias("sort"),
    )
