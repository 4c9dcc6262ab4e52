"""Plans of searches: words, filters and dates read from a question, without a model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame

from lectern.functions.text import CATEGORY_EXTENSIONS
from lectern.operators.filters import FileFilter

#: Words of a question that carry no content, a choice of this library.
STOP_WORDS = (
    "a about an and any are as at be by can did do does file files find for from get give has have how i in is it list me my of on or "
    "please search show tell that the their them there these this those to was were what when where which who with you your"
).split()
#: Words that name a kind of file, a choice of this library.
KIND_WORDS = {
    "document": ("document", "documents", "pdf", "pdfs"), "image": ("image", "images", "photo", "photos", "picture", "pictures"), "video": ("video", "videos", "movie", "movies"),
    "audio": ("audio", "song", "songs", "recording", "recordings"), "archive": ("archive", "archives", "zip"), "code": ("code", "script", "scripts"),
}


@dataclass(frozen=True)
class SearchPlan:
    terms: tuple[str, ...]
    filter: FileFilter = field(default_factory=FileFilter)
    sort: str | None = None
    years: tuple[int, ...] = ()


def date_interval(question: str, today: date, monday_first: bool = True) -> tuple[date, date] | None:
    """The first relative date of a question as a half-open interval of days."""
    q = question.lower()
    day = timedelta(days=1)
    week = today - timedelta(days=today.weekday() if monday_first else (today.weekday() + 1) % 7)
    month, year = today.replace(day=1), today.replace(month=1, day=1)
    for n in (30, 7):
        if re.search(rf"(last|past) {n} days", q):
            return today - timedelta(days=n - 1), today + day
    if "day before yesterday" in q:
        return today - 2 * day, today - day
    if "yesterday" in q:
        return today - day, today
    if "today" in q:
        return today, today + day
    if "last week" in q:
        return week - 7 * day, week
    if "this week" in q:
        return week, week + 7 * day
    if "last month" in q:
        return (month - day).replace(day=1), month
    if "this month" in q:
        return month, (month + timedelta(days=31)).replace(day=1)
    if "last year" in q:
        return year.replace(year=year.year - 1), year
    if "this year" in q:
        return year, year.replace(year=year.year + 1)
    found = re.findall(r"(?<!\d)((?:19|20)\d\d)(?!\d)", q)
    return (date(int(found[0]), 1, 1), date(int(found[0]) + 1, 1, 1)) if len(set(found)) == 1 else None


def inferred(question: str, today: date) -> SearchPlan:
    """A plan from the question's words alone."""
    q = question.lower()
    words = re.findall(r"\w+", q)
    kinds = tuple(k for k, names in KIND_WORDS.items() if set(names) & set(words))
    known = {e for group in CATEGORY_EXTENSIONS.values() for e in group}
    extensions = tuple(dict.fromkeys(x for x in re.findall(r"(?:\.|\b)([a-z0-9]{1,5})\b", q) if x in known and (f".{x}" in q or f"{x} files" in q)))
    interval = date_interval(q, today)
    bounds = tuple(datetime.combine(x, datetime.min.time()) for x in interval) if interval else (None, None)
    modified = any(w in q for w in ("modified", "changed", "edited", "updated"))
    sort = next((s for s, names in {"newest": ("newest", "latest", "recent"), "oldest": ("oldest", "earliest"), "largest": ("largest", "biggest"), "smallest": ("smallest",)}.items() if any(n in words for n in names)), None)
    used = {w for names in KIND_WORDS.values() for w in names} | set(STOP_WORDS) | {"newest", "latest", "recent", "oldest", "earliest", "largest", "biggest", "smallest", "modified", "changed", "edited", "updated", "added"}
    used |= {"today", "yesterday", "day", "days", "before", "last", "past", "week", "month", "year", "notes", "note"} if interval or "note" in q else set()
    terms = tuple(dict.fromkeys(w for w in words if len(w) >= 2 and w not in used and w not in extensions and not w.isdigit()))
    wanted = FileFilter(
        extensions=extensions, categories=() if extensions else kinds, has_note=False if "without notes" in q else True if "with notes" in q else None,
        indexed=False if "unindexed" in q or "not indexed" in q else None, modified=bounds if modified else (None, None), added=(None, None) if modified else bounds,
    )
    return SearchPlan(terms, wanted, sort, tuple(sorted({int(y) for y in re.findall(r"(?<!\d)((?:19|20)\d\d)(?!\d)", q)})))


def merged_concepts(concepts: list[tuple[str, tuple[str, ...]]], most: int = 6) -> list[tuple[str, ...]]:
    """Concepts (name, aliases) that share a name or alias become one; at most so many, in order."""
    groups: list[list[str]] = []
    for name, aliases in concepts:
        own = [x.lower() for x in (name, *aliases)]
        near = [g for g in groups if set(g) & set(own)]
        groups = [g for g in groups if g not in near]
        groups.append(list(dict.fromkeys([*(x for g in near for x in g), *own])))
    return [tuple(g) for g in groups[:most]]


def reconciled(local: SearchPlan, proposed: SearchPlan, most: int = 6) -> SearchPlan:
    """A proposed plan under the question's own constraints: what the question says of files, dates, order and years counts;
    the rest, and terms beyond the question's, are taken from the proposal."""
    mine, other = local.filter, proposed.filter
    merged = {f: getattr(mine, f) if getattr(mine, f) != getattr(FileFilter(), f) else getattr(other, f) for f in FileFilter.__dataclass_fields__}
    terms = dict.fromkeys(t.lower() for t in (*local.terms, *proposed.terms))
    return SearchPlan(tuple(terms)[:most], FileFilter(**merged), local.sort or proposed.sort, local.years or proposed.years)


PLANS = "id long, terms string, extensions string, sort string, years string, starts string, ends string"


def _row(i: int, plan: SearchPlan) -> tuple:
    dates = plan.filter.modified if plan.filter.modified[0] else plan.filter.added
    return i, " ".join(plan.terms), ",".join(plan.filter.extensions), plan.sort, ",".join(map(str, plan.years)), *(d and d.date().isoformat() for d in dates)


def inferred_plans(questions: DataFrame, today: date) -> DataFrame:
    """PLANS of questions (id, question)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([_row(i, inferred(q or "", today)) for i, q in zip(rows["id"], rows["question"])], columns=[x.split()[0] for x in PLANS.split(", ")])

    return questions.select("id", "question").mapInPandas(run, PLANS)


def reconciled_plans(questions: DataFrame, today: date) -> DataFrame:
    """PLANS of questions (id, question, title), reconciled with proposals that the title's words make; concepts that share a word are one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i, q, title in zip(rows["id"], rows["question"], rows["title"]):
                words = re.findall(r"\w+", (title or "").lower())
                concepts = merged_concepts([(w, tuple(words[k + 1 : k + 2])) for k, w in enumerate(words)][:8])
                proposed = SearchPlan(tuple(c[0] for c in concepts), FileFilter(extensions=("pdf",)), "oldest")
                out.append(_row(i, reconciled(inferred(q or "", today), proposed)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PLANS.split(", ")])

    return questions.select("id", "question", "title").mapInPandas(run, PLANS)

