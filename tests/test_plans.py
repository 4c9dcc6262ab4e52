"""Whole plans of questions against plain Python."""

import json
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.functions import plans
from lectern.functions import questions as qs
from lectern.plans.catalogue import QUERIES
from lectern.sources import library
from tests.conftest import SMALL

TODAY = date(2024, 3, 13)
DAY = timedelta(days=1)
CRAFTED = [
    "查找文件夹 最近7天 关于预算", "上周整理的文档 没有备注", "显示去年最大的图片 有备注", "找出 2021 年的 Excel 文件", "last month's largest PDF files with notes", "the day before yesterday", "unindexed folders moved this week",
    "report.PDF, please", "“Quarterly-Report.docx”", "what mentions \"solar\" in 2020 and 2021?", "GPTVideo slides added today", "", None, "oldest jpeg screenshots imported last year", "合同 去年 AI", "files 1999", "最近 30 天", "nothing structural here",
]


def has(q, words):
    return any(w in q.lower() for w in words)


def interval(q):
    monday, month, year = TODAY - timedelta(days=TODAY.weekday()), TODAY.replace(day=1), TODAY.replace(month=1, day=1)
    before, after = (month - DAY).replace(day=1), (month + timedelta(days=40)).replace(day=1)
    for words, found in (
        (plans.DAYS_30, (TODAY - 29 * DAY, TODAY + DAY)), (plans.DAYS_7, (TODAY - 6 * DAY, TODAY + DAY)), (("day before yesterday", "前天"), (TODAY - 2 * DAY, TODAY - DAY)), (("yesterday", "昨天"), (TODAY - DAY, TODAY)),
        (("today", "今天"), (TODAY, TODAY + DAY)), (("last week", "上周"), (monday - 7 * DAY, monday)), (("this week", "本周", "这周"), (monday, monday + 7 * DAY)), (("last month", "上个月"), (before, month)),
        (("this month", "本月", "这个月"), (month, after)), (("last year", "去年"), (date(2023, 1, 1), year)), (("this year", "今年", "本年"), (year, date(2025, 1, 1))),
    ):
        if has(q, words):
            return found
    return None


def bounded(text):
    for pattern in (r"(?<=[a-z0-9])(?=[A-Z])", r"(?<=[A-Z])(?=[A-Z][a-z])", r"(?<=[一-鿿])(?=[A-Za-z0-9])", r"(?<=[A-Za-z0-9])(?=[一-鿿])"):
        text = re.sub(pattern, " ", text)
    return text


def unique(terms):
    seen = {}
    for t in (t.strip(" ") for t in terms):
        if t:
            seen.setdefault(t.lower(), t)
    return list(seen.values())


def structural(value):
    low = value.strip(" ").lower()
    han = [w for w in qs.STRUCTURAL_WORDS if not w.isascii()]
    return low != "" and (any(w in low for w in [*qs.RELATIVE_DATES, *(e for e in qs.EXTENSIONS if len(e) >= 2), *han]) or any(w in qs.STRUCTURAL_WORDS or w in qs.EXTENSIONS for w in re.split(r"[\W_]+", low)))


def evidence(term):
    low = term.strip(" ").lower()
    return len(low) >= 2 and not structural(term) and low not in qs.CLOSED_WORDS


def terms_of(q):
    words = sorted(qs.RELATIVE_DATES + qs.STRUCTURAL_WORDS, key=lambda w: (-len(w), w))
    compact = re.sub("|".join(map(re.escape, words)), " ", q, flags=re.I).strip(" ")
    variants = unique([compact, bounded(compact), *re.split(r"\s+", bounded(compact))])
    found = [w for v in variants for w in dict.fromkeys(re.split(r"[\W_]+", v.lower())) if len(w) >= 2 and w not in qs.STOP_WORDS]
    return unique([t for t in found if evidence(t)])


def named(token):
    return re.search(r"\.([A-Za-z0-9]{1,16})$", token.strip(" ")) and token.rpartition(".")[2].lower().strip() in qs.EXTENSIONS


def plan_of(q):
    q = q or ""
    low, terms = q.lower(), terms_of(q)
    years = sorted(set(re.findall(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])", q)))
    days = interval(q)
    own = days or ((date(int(years[0]), 1, 1), date(int(years[0]) + 1, 1, 1)) if len(years) == 1 else None)
    ext = {w for w in re.split(r"[\W_]+", bounded(q).lower()) if w in qs.EXTENSIONS} | {e for words, found in plans.EXTENSION_WORDS for e in found if has(bounded(q), words)}
    categories = sorted(c for c, words in plans.CATEGORY_WORDS.items() if has(q, words))
    name = next((t for t in (t.strip(plans.NAME_SIGNS) for t in q.split()) if named(t)), None)
    kind = next((k for k, words in plans.ITEM_WORDS.items() if has(q, words)), "any")
    asked = has(q, qs.CONTENT_MARKERS) or len(re.findall("[\"“”「」]", q)) >= 2
    constrained = days or years or ext or categories or kind != "any"
    return {
        "semantic_query": " ".join(terms), "keywords": terms[:8], "exact_name": name, "extensions": sorted(ext), "categories": categories, "item_kind": kind,
        "date_field": next((f for f, words in plans.DATE_FIELD_WORDS.items() if has(q, words)), "modified"), "starts": own and own[0], "ends": own and own[1], "min_size": None, "max_size": None,
        "has_note": False if has(q, plans.NO_NOTE) else True if has(q, plans.NOTE) else None, "is_indexed": False if has(q, plans.NOT_INDEXED) else True if has(q, plans.INDEXED) else None,
        "content_mode": "indexed_content" if asked else "metadata_only" if name or (not terms and constrained) else "automatic",
        "sort": next((s for s, words in plans.SORT_WORDS.items() if has(q, words)), "newest" if any(m in low for m in qs.RECENCY_MARKERS) else "relevance"),
    }


def reconciled_of(p, m, q):
    q, han = q or "", re.compile(r"[㐀-䶿一-鿿豈-﫿]")
    wording, found = p["semantic_query"].strip(" "), [k for k in p["keywords"] if evidence(k)]
    clean = wording != "" and not structural(wording)
    semantic = " ".join(unique([wording, m["semantic_query"]])) if clean and han.search(q) and not han.search(wording) else wording if clean else " ".join(unique([*terms_of(q), *found]))
    low = None if p["min_size"] in (None, 0) else max(0, p["min_size"])
    high = None if p["max_size"] is None else max(0, p["max_size"])
    if low is not None and high is not None and low > high:
        low, high = high, low
    mode = "automatic" if p["content_mode"] == "metadata_only" and terms_of(q) else m["content_mode"] if p["content_mode"] == "automatic" else p["content_mode"]
    dated = m if m["starts"] else p
    return {
        "semantic_query": semantic, "keywords": unique(found)[:8], "exact_name": m["exact_name"] or p.get("exact_name"), "extensions": m["extensions"] or p["extensions"], "categories": m["categories"] or p["categories"],
        "item_kind": m["item_kind"] if m["item_kind"] != "any" else p["item_kind"], "date_field": dated["date_field"], "starts": dated["starts"], "ends": dated["ends"], "min_size": low, "max_size": high,
        "has_note": m["has_note"], "is_indexed": m["is_indexed"], "content_mode": mode, "sort": p["sort"],
    }


def flat(plan):
    return {k: "|".join(v) if isinstance(v, list) else v for k, v in plan.items()}


def test_crafted_questions(spark):
    asked = spark.createDataFrame(list(enumerate(CRAFTED)), "id long, q string")
    for r in asked.select("q", plans.inferred(F.col("q"), F.lit(TODAY)).alias("p")).collect():
        got = r.p.asDict()
        assert got.pop("folder_terms") == [] and got == plan_of(r.q), r.q


def test_registered_plans(spark):
    asked = {r.id: r.question for r in library.questions(spark, SMALL).collect()}
    got = QUERIES["ret30_inferred_plans"](spark, SMALL).collect()
    assert len(got) == len(asked)
    for r in got:
        row = r.asDict()
        assert flat(plan_of(asked[row.pop("id")])) == row


def test_registered_reconciled_plans(spark):
    asked = {r.id: r.question for r in library.questions(spark, SMALL).collect()}
    titles = {r.id: r.title for r in library.files(spark, SMALL).select("id", "title").collect()}
    for r in QUERIES["ret31_reconciled_plans"](spark, SMALL).collect():
        row = r.asDict()
        i = row.pop("id")
        proposed = {
            "semantic_query": titles[i], "keywords": [w for w in titles[i].split(" ") if w], "extensions": ["pdf"], "categories": ["image"], "item_kind": "file", "date_field": "organized", "starts": date(2023, 1, 1),
            "ends": date(2023, 2, 1), "min_size": i * 10, "max_size": 500 - i, "content_mode": ("metadata_only", "automatic", "indexed_content")[i % 3], "sort": "oldest",
        }
        assert flat(reconciled_of(proposed, plan_of(asked[i]), asked[i])) == row, asked[i]


@pytest.mark.parametrize(
    ("question", "proposal", "expected"),
    [
        ("合同 报告", {"semantic_query": "contract report"}, {"semantic_query": "contract report 合同 报告", "sort": "newest"}),
        ("solar", {"semantic_query": "pdf files of today", "keywords": ["panel", "pdf", "the"]}, {"semantic_query": "solar panel", "keywords": ["panel"]}),
        ("with notes, largest", {"min_size": 900, "max_size": 10}, {"has_note": True, "min_size": 10, "max_size": 900, "sort": "newest"}),
    ],
)
def test_crafted_proposals(spark, question, proposal, expected):
    base = {"semantic_query": "", "keywords": [], "extensions": [], "categories": [], "folder_terms": ["x"], "item_kind": "any", "date_field": "modified", "content_mode": "automatic", "sort": "newest"}
    df = spark.createDataFrame([(question, json.dumps(base | proposal))], "q string, told string")
    local, told = plans.inferred(F.col("q"), F.lit(TODAY)), F.from_json("told", plans.PLAN)
    got = df.select(local.alias("l"), told.alias("p"), "q").select(plans.reconciled(F.col("p"), F.col("l"), F.col("q")).alias("r")).first().r
    assert {k: got[k] for k in expected} == expected and got["folder_terms"] == ["x"]


def _optimized(spark, query):
    return QUERIES[query](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_what_a_question_says_is_computed_once(spark):
    # the pattern of one word border stands for a question's variants, or for its extensions
    for query, most in (("str36_content_terms", 1), ("str37_search_terms", 1), ("ret30_inferred_plans", 2), ("ret31_reconciled_plans", 3)):
        assert 1 <= _optimized(spark, query).count("(?<=[a-z0-9])(?=[A-Z])") <= most, query


def test_units_split_a_text_once(spark):
    assert _optimized(spark, "txt02_units").count("[^.!?") == 1


def test_entities_are_looked_for_once(spark):
    assert _optimized(spark, "ret09_entity_lane").count("[A-Z0-9][A-Z0-9._/-]{2,255}") == 1


def test_batches_need_no_call_for_each_group(spark):
    from lectern.operators import context
    from lectern.operators.chunking import tokens

    rows = [(g, i, "word " * ((7 * i + (g or 3)) % 11)) for g in (None, 1, 2, 5) for i in range(30)] + [(9, 0, None), (9, 1, "a " * 99), (9, None, "b")]
    made = context.batched(spark.createDataFrame(rows, "g long, i int, t string"), "g", "i", "t", 20)
    assert "FlatMapGroups" not in made._jdf.queryExecution().optimizedPlan().toString()
    want, own, held = {}, object(), 0
    for g, i, t in sorted(rows, key=lambda r: (r[0] or 0, r[1] is None, r[1] or 0)):
        if g != own:
            own, batch, held = g, 1, 0
        elif held and held + tokens(t) > 20:
            batch, held = batch + 1, 0
        held += tokens(t)
        want[g, i] = batch
    assert {(r.g, r.i): r.batch for r in made.collect()} == want
