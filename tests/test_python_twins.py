"""Queries that SQL can't express, against plain Python over the same tables."""

import math
import re
import unicodedata

import pytest
import regex

from lectern.functions import questions as qs
from lectern.functions import text as tx
from lectern.operators import chunking, context, retrieval
from lectern.plans import text_queries
from lectern.plans.catalogue import QUERIES
from lectern.sources import library, readers
from tests.conftest import SMALL


def rows(spark, name):
    return QUERIES[name](spark, SMALL).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def files(spark):
    return {r.id: r for r in library.files(spark, SMALL).collect()}


@pytest.fixture(scope="module")
def chunks(spark):
    return library.chunks(spark, SMALL).select("file_id", "chunk_idx", "parent_idx", "text").collect()


def cost(text):
    han = len(regex.findall(r"[㐀-䶿一-鿿豈-﫿]", text))
    words = len(re.findall(r"[A-Za-z0-9'_-]+", text))
    other = len(re.findall(r"[^\sA-Za-z0-9'_㐀-䶿一-鿿豈-﫿-]", text))
    return han * 2 / 3 + words * 4 / 3 + other


def test_entities_of_whole_texts(spark, docs):
    patterns = [r"\b[A-Z0-9][A-Z0-9._/-]{2,}[0-9][A-Z0-9._/-]*\b", r"\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b", r"\b[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\b", r"(?:[$€£¥]|SGD|USD|EUR|CNY|RMB)\s*[0-9][0-9,.]*"]
    want = {i: ",".join(sorted({f for p in patterns for m in regex.findall(p, t, regex.I) if len(f := m.strip().lower()) >= 3})) for i, t in docs.items()}
    got = {r.doc_id: r.entities for r in rows(spark, "ret23_entities")}
    assert got == want and sum(map(bool, got.values())) > 5


def test_categories_of_every_extension(spark):
    made = [(e, name) for name, group in tx.CATEGORY_EXTENSIONS.items() for e in group] + [("xml", "other"), ("", "other")]
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(f"x.{e.upper()}", c) for e, c in made], "n string, c string").select("c", tx.category(tx.extension(F.col("n"))).alias("got")).collect()
    assert all(r.c == r.got for r in got) and len(made) == 86


def test_folding(spark, docs):
    flat = {i: "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c)) for i, t in docs.items()}
    for r in rows(spark, "str04_folded_equality"):
        assert r.same and r.as_next == (None if r.doc_id + 1 not in flat else flat[r.doc_id] == flat[r.doc_id + 1])
    assert {r.doc_id: r.plain for r in rows(spark, "str06_compatible_texts")} == {i: unicodedata.normalize("NFKC", t).lower() for i, t in docs.items()}


def test_snippets(spark, docs):
    for r in rows(spark, "str17_snippets"):
        words = docs[r.doc_id].split()
        at = next(i for i, w in enumerate(words) if "that" in w.lower())
        begin = max(0, min(at - 48, len(words) - 96))
        assert r.snippet == "…" * (begin > 0) + " ".join(words[begin : begin + 96]) + "…" * (begin + 96 < len(words))


def units(text, target):
    out = []
    for k, p in enumerate(x.strip() for x in re.split(r"\n[\t ]*\n+", text)):
        parts = [s.strip() for s in re.findall(r"[^.!?。！？\n]+[.!?。！？]*\s*|[.!?。！？]+\s*", p) if s.strip()]
        out += [(k, s) for s in parts] if cost(p) > target + 1e-9 and len(parts) > 1 else [(k, p)] if p else []
    return out


def joined(some):
    return "".join(("" if not i else " " if some[i - 1][0] == k else "\n\n") + t for i, (k, t) in enumerate(some))


def test_chunks(spark, docs, files):
    """Each chunk as long as it can be, and begun by what fits of the one before."""
    want = {}
    for i, f in files.items():
        text, own = f.content_text.strip(), []
        parts = units(text, 300)
        if len(parts) == 1 and cost(text) > 300:
            parts = [(0, w) for w in (text.split() if " " in text else text)]
        begin = end = 0
        while end < len(parts):
            end = max(end + 1, begin + 1)
            while end < len(parts) and cost(joined(parts[begin : end + 1])) <= 300 + 1e-9:
                end += 1
            own.append(joined(parts[begin:end]))
            if end < len(parts):
                begin = next(b for b in range(begin, end + 1) if b == end or cost(joined(parts[b:end])) <= 80 + 1e-9)
                while begin < end and cost(joined(parts[begin : end + 1])) > 300 + 1e-9:
                    begin += 1
        want |= {(i, k): t for k, t in enumerate(own)}
    got = {(r.file_id, r.chunk_idx): r.text for r in rows(spark, "txt01_chunks")}
    assert got == want


def test_sentences_and_tables(spark, docs):
    for r in rows(spark, "txt04_sentences"):
        parts = [s.strip() for s in re.findall(r"[^.!?。！？\n]+[.!?。！？]*\s*|[.!?。！？]+\s*", docs[r.doc_id]) if s.strip()]
        assert (r.sentences, r.chars) == (len(parts), sum(map(len, parts)))
    by = {}
    for r in rows(spark, "txt07_table_pieces"):
        by.setdefault(r.file_id, []).append(r)
    counts = {r.l_orderkey: r["count"] for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").groupBy("l_orderkey").count().collect()}
    for i, own in by.items():
        assert all(p.text.startswith("line | part | quantity | shipped\n") for p in own)
        assert sum(len(p.text.split("\n")) - 1 for p in own) == counts[i]
        assert all(cost(p.text) <= 60 or len(p.text.split("\n")) == 2 for p in own)


def test_units_and_document_chunks(spark, docs, files):
    held = {}
    for r in rows(spark, "txt08_retrieval_units"):
        assert r.contextual_text.startswith("Section: ")
        held.setdefault(r.file_id, []).append(r.contextual_text.split("\n", 1)[1])
    for i, parts in held.items():
        assert (parts == [docs[i]]) == (math.ceil(round(cost(docs[i]), 6)) <= 360)
        assert set(re.findall(r"\w+", " ".join(parts))) == set(re.findall(r"\w+", docs[i]))
    by = {}
    for r in rows(spark, "txt09_document_chunks"):
        by.setdefault(r.file_id, []).append(r)
    for i, own in by.items():
        own.sort(key=lambda r: r.chunk_idx)
        assert [r.chunk_idx for r in own] == list(range(len(own))) and len(own) <= 500
        assert own[0].kind == "title" and own[0].text == files[i].title.strip()
        assert [r.kind for r in own].count("note") == bool((files[i].note or "").strip())
        assert [r.parent_idx for r in own] == sorted(r.parent_idx for r in own)


def test_truncation_and_batches(spark, docs, chunks):
    for r in rows(spark, "str31_truncated"):
        text = docs[r.doc_id]
        if cost(text) <= 192 + 1e-9:
            assert r.head == text
        else:
            assert text.startswith(r.head[:-1]) and r.head.endswith("…") and cost(r.head) <= 192 + 1e-9
    most, by = context.batch_budget("local", "both", 8192), {}
    for c in chunks:
        by.setdefault(c.file_id, []).append(c)
    want = {}
    for i, own in by.items():
        batch, total = 1, 0
        for c in sorted(own, key=lambda c: c.chunk_idx):
            n = max(1, math.ceil(round(cost(c.text), 6)))
            if total and total + n > most:
                batch, total = batch + 1, 0
            total += n
            want[i, c.chunk_idx] = batch
    assert {(r.file_id, r.chunk_idx): r.batch for r in rows(spark, "ctx11_win08_batches")} == want


def test_evidence_keeps_its_bounds(spark):
    by = {}
    for r in rows(spark, "ctx01_evidence"):
        by.setdefault(r.query_id, []).append(r)
    for own in by.values():
        assert len(own) <= 8 and sum(len(r.excerpt) for r in own) <= 20_000 and max(len(r.excerpt) for r in own) <= 2_800
        assert all(sum(r.file_id == f for r in own) <= 4 for f in {r.file_id for r in own})
        assert sorted(r.place for r in own) == list(range(1, len(own) + 1))


def test_hybrid_search(spark, files, chunks):
    """Lanes, fusion, kinds and confidence of the registered search, worked out one by one."""
    query, terms, wanted = text_queries.QUESTION, text_queries.TERMS, text_queries.ENTITIES
    low = lambda x: (x or "").lower()
    lexical = {}
    for i, f in files.items():
        c, o, n, p, t = (low(getattr(f, k)) for k in ("content_text", "note", "name", "path", "title"))
        whole = max(500 * (n == query or re.sub(r"\.[^.]*$", "", n) == query), 400 * (query in c or query in o), 200 * (query in n or query in p), 110 if t == query else 100 * (query in t))
        score = whole + sum(40 if x in c or x in o else 20 if x in n or x in p else 10 if x in t else 0 for x in terms if x != query)
        kind = "fileName" if whole == 500 else next((k for k, v in (("content", c), ("note", o), ("fileName", n), ("path", p), ("title", t)) if query in v), "terms")
        if score:
            lexical[i] = (score, kind, round(sum(any(x in v for v in (n, t, c, o, p)) for x in terms) / len(terms), 6))
    lexical = dict(sorted(lexical.items(), key=lambda x: (-x[1][0], x[0]))[:200])
    matched = sorted(((sum(x in c.text.lower() for x in terms), c.file_id, c.chunk_idx) for c in chunks), key=lambda x: (-x[0], x[1], x[2]))
    lane = {i: s[0] / 1000 for i, s in lexical.items()}
    for n, i, _ in [m for m in matched if m[0]][:200]:
        lane[i] = max(lane.get(i, 0), round(min(1.0, 0.62 + 0.1 * (n - 1)), 6) / 1000)
    vectors = {r.file_id: r.embedding for r in library.embeddings(spark, SMALL).collect()}
    q = vectors[0]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    near = dict(sorted(((i, round(cosine(v, q), 6)) for i, v in vectors.items()), key=lambda x: (-x[1], x[0]))[:200])
    near = {i: s for i, s in near.items() if s >= max(0.38, round(max(near.values()) - 0.18, 6))}
    found = {}
    entities = {(r.file_id, r.chunk_idx): r.e for r in library.chunks(spark, SMALL).select("file_id", "chunk_idx", tx.entities(library.F.col("text")).alias("e")).collect()}
    for (i, k), e in entities.items():
        n = sum(x in "\n".join(e) for x in wanted if len(x) >= 3)
        if n:
            found[i, k] = n
    named = {}
    for (i, _), n in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:200]:
        named[i] = max(named.get(i, 0), min(1.0, 0.92 + 0.02 * (n - 1)))
    rank = lambda lane: {i: k + 1 for k, (i, _) in enumerate(sorted(lane.items(), key=lambda x: (-x[1], x[0])))}
    a, b, c = rank(lane), rank(near), rank(named)
    want = []
    for i in a.keys() | b.keys() | c.keys():
        score, kind, cover = lexical.get(i, (0, None, 0.0))
        exact = score >= 500
        fused = sum(w / (60 + r[i]) for w, r in ((0.36, a), (0.44, b), (0.20, c)) if i in r) + 0.2 * near.get(i, 0) + 0.1 * exact
        match = "fileName" if exact else "entity" if i in c else "hybrid" if i in a and i in b else (kind or "content") if i in a else "semantic"
        base = 0.95 if score >= 400 else 0.8 if score >= 200 else 0.6 if score >= 100 else 0.45
        words = None if i not in a else min(base, 1) if score >= 400 else min(0.49, 0.24 + 0.25 * cover) if cover < 1 else min(0.78, 0.42 + 0.36 * cover)
        vector = 0.9 + 0.09 * max(0, min(1, (near[i] - 0.38) / 0.62)) if i in b else None
        top = {"content": 0.96, "note": 0.96, "fileName": 0.86, "path": 0.82, "title": 0.76}.get(kind or "content", 0.78)
        either = max(words or 0, vector or 0)
        sure = 1.0 if exact else 0.98 if i in c else min(vector, 0.94) if words is None else min(either, top) if cover > 0 else min(either, 0.74)
        want.append((i, round(fused, 6), match, round(sure, 6)))
    best = sorted(want, key=lambda w: (-w[3], w[0]))
    shown = [w for k, w in enumerate(best) if w[3] >= 0.5 or k < 3]
    shown = sorted(shown, key=lambda w: (-w[1], w[0]))[:30]
    got = [(r.file_id, round(r.fused, 6), r.match_kind, round(r.confidence, 6)) for r in rows(spark, "ret27_hybrid_search")]
    assert [g[0] for g in got] == [w[0] for w in shown]
    assert all(g[2] == w[2] and abs(g[1] - w[1]) < 2e-6 and abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, shown))


def test_identifiers_are_the_same_in_both_forms(spark):
    words = ["INV42", "API", "api", "A", "2024", "x-1", "ÄB1", "Abc"]
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.distinctive_identifier(F.col("w")).alias("d")).collect()
    assert {r.w: r.d for r in got} == {w: retrieval.is_identifier(w) for w in words}


def test_question_functions_on_han(spark):
    from pyspark.sql import functions as F

    made = spark.createDataFrame([("最近7天",), ("请查找 LumensAI预算 文件",), ("昨天的图片?",)], "q string")
    got = made.select(qs.date_only(F.col("q")).alias("d"), qs.prefers_recent(F.col("q")).alias("r"), qs.content_terms(F.col("q")).alias("t"), qs.single_identifier_allowed(F.col("q")).alias("s")).collect()
    assert [r.d for r in got] == [True, False, True] and [r.r for r in got] == [True, False, False]
    assert "lumens" in [x.lower() for x in got[1].t] and "预算" in got[1].t and not got[2].s


def test_halves(spark, docs):
    assert chunking.halved("one two three") == ["one two", "three"] and chunking.halved("x") == []
    for r in rows(spark, "str30_halves"):
        if r.first is not None:
            assert re.sub(r"\s", "", r.first + r.second) == re.sub(r"\s", "", docs[r.doc_id])
            longest = max(map(len, re.split(r"\n[\t ]*\n+|(?<=[.!?])\s", docs[r.doc_id])))
            assert abs(len(r.first) - len(r.second)) <= 2 * longest + 10


def test_plans_of_questions(spark):
    asked = {r.id: r.question for r in library.questions(spark, SMALL).collect()}
    for r in rows(spark, "ret31_ret32_reconciled_plans"):
        assert r.sort == ("newest" if asked[r.id].startswith("latest") else "oldest") or "oldest" in asked[r.id]
        assert len(r.terms.split()) <= 6 and r.extensions


def test_embeddings_have_length_one(spark):
    got = rows(spark, "ret35_txt16_embedded")
    assert all(r.dim == 384 and r.square in (0.0, 1.0) for r in got) and got


def test_pages_and_lines(spark):
    pages = {f"/pages/{r.page_id}.html": r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert {r.path: r.chars for r in rows(spark, "src25_src26_extracted_pages")} == {p: len(readers.html_text(h)[: readers.CHARACTERS]) for p, h in pages.items()}
    assert all("again" not in r.text and r.text.startswith("line 0") for r in rows(spark, "txt22_merged_lines"))


def test_listing_of_the_folder(spark):
    import os

    want = {(n, "parquet", os.path.getsize(f"{SMALL}/{n}")) for n in os.listdir(SMALL) if n.endswith(".parquet")}
    assert {(r["name"], r.ext, r["size"]) for r in rows(spark, "src22_src24_listing")} == want


def test_decoded_entities(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert {r.page_id: r.decoded for r in rows(spark, "src47_decoded_entities")} == {i: html.unescape(h) for i, h in pages.items()}


def test_batches_of_events(spark):
    events = {}
    for r in spark.read.parquet(f"{SMALL}/events.parquet").select("user_id", "ts", "event_id").collect():
        events.setdefault(r.user_id, []).append((r.ts, r.event_id))
    want = {}
    for user, own in events.items():
        batch, n, begun = 1, 0, None
        for t, i in sorted(own):
            if n and (n >= 5 or (t - begun).total_seconds() >= 30):
                batch, n = batch + 1, 0
            begun, n = begun if n else t, n + 1
            want[i] = (user, batch)
    assert {r.event_id: (r.g, r.batch) for r in rows(spark, "stm09_batches")} == want


def test_merged_chunks(spark, docs):
    def noisy(t):
        return t.strip(" ") == "" or not regex.search(r"[\p{L}\p{N}]", t) or re.fullmatch(r"(?i)(page|p\.?)\s*[0-9]+(\s*(of|/)\s*[0-9]+)?", t.strip(" "))

    want = set()
    for i, text in docs.items():
        out = []
        for k, line in enumerate((text or "").split("\n")):
            page = k // 25 + 1
            if noisy(line):
                continue
            if out and page - out[-1][0] in (0, 1):
                both = out[-1][1] + " " + line
                broken = line[:1].islower() and out[-1][1].rstrip()[-1:] not in ".!?。！？"
                if chunking.tokens(both) <= 600 and (broken or min(chunking.tokens(out[-1][1]), chunking.tokens(line)) < 80):
                    out[-1] = (page, both)
                    continue
            out.append((page, line))
        want |= {(i, k, t) for k, (_, t) in enumerate(out)}
    assert {(r.file_id, r.chunk_idx, r.text) for r in rows(spark, "txt11_merged_chunks")} == want


def test_tiles_cover_every_picture(spark):
    sizes = {r.p_partkey: (r.p_size * 100 + 1, r.p_partkey % 50 * 100 + 1) for r in spark.read.parquet(f"{SMALL}/part.parquet").collect()}
    tiles = {}
    for r in rows(spark, "mth09_tiles"):
        tiles.setdefault(r.id, []).append((r.x, r.y, r.w, r.h))

    def places(length):
        n = max(1, math.ceil(max(1, length - 288) / 1760))
        return [min(k * 1760, max(0, length - 2048)) for k in range(n)]

    assert tiles == {i: [(x, y, min(w - x, 2048), min(h - y, 2048)) for y in places(h) for x in places(w)][:32] for i, (w, h) in sizes.items()}


def test_excerpts_and_reranking(spark, docs, chunks):
    for r in rows(spark, "str16_excerpts"):
        flat = re.sub(r"\s+", " ", docs[r.id]).strip(" ")
        at = max(0, flat.lower().find("token"))
        start = max(0, at - 72)
        end = min(start + 240, len(flat))
        assert r.excerpt == ("…" if start > 0 else "") + flat[start:end].strip(" ") + ("…" if end < len(flat) else "")
    text = {(c.file_id, c.chunk_idx): c.text.lower() for c in chunks}
    got = rows(spark, "ret25_reranked")
    scored = [r for r in got if r.rerank_score is not None]
    hits = {k for k, t in text.items() if "secret" in t or "token" in t}
    assert {(r.file_id, r.chunk_idx) for r in got} == hits
    assert len(scored) == len({r.file_id for r in scored}) == min(8, len({i for i, _ in hits}))
    for r in scored:
        assert r.rerank_score == len({"secret", "token"} & set(re.findall(r"\w+", text[r.file_id, r.chunk_idx]))) / 2
    assert sorted(r["rank"] for r in got) == list(range(1, len(got) + 1)) and {r["rank"] for r in scored} == set(range(1, len(scored) + 1))
    order = sorted(scored, key=lambda r: r["rank"])
    assert [r.rerank_score for r in order] == sorted((r.rerank_score for r in scored), reverse=True)


def test_a_querys_texts_are_scored_at_once(spark):
    from lectern.operators import providers

    made = [(q, f"q{q}", f, 0, f"text {q} {f}", 1.0 - f / 100) for q in (1, 2) for f in range(10)]
    hits = spark.createDataFrame(made, "query_id int, query string, file_id long, chunk_idx int, text string, score double").coalesce(1)

    def scorer(query, texts):
        assert len(texts) == 8 and all(t.split()[1] == query[1:] for t in texts)
        return [int(t.split()[2]) / 10 for t in texts]

    got = {(r.query_id, r["rank"]): (r.file_id, r.rerank_score) for r in providers.reranked(hits, scorer).collect()}
    assert got == {(q, k): (f, s) for q in (1, 2) for k, (f, s) in enumerate([*((f, f / 10) for f in range(7, -1, -1)), (8, None), (9, None)], 1)}


def test_hash_embeddings_have_length_one_or_none(spark, docs):
    got = {r.doc_id: (r.dimensions, r.norm) for r in rows(spark, "mth05_hash_embeddings")}
    assert got.keys() == docs.keys() and all(n in (0.0, 1.0) for _, n in got.values())


def test_units_of_texts(spark, docs):
    got = {}
    for r in rows(spark, "txt02_units"):
        got.setdefault(r.doc_id, []).append((r.unit, r.text))
    assert {i: [t for _, t in sorted(own)] for i, own in got.items()} == {i: [u for _, u in units(t.strip(), 60)] for i, t in docs.items() if units(t.strip(), 60)}


def test_run_on_texts_are_cut_between_words(spark, docs):
    got = {}
    for r in rows(spark, "txt05_txt06_run_on_chunks"):
        got.setdefault(r.file_id, []).append((r.chunk_idx, r.text))
    for i, text in docs.items():
        flat = re.sub(r"[.!?。！？\s]+", " ", text).strip(" ")
        words, own = flat.split(), [t.split() for _, t in sorted(got.get(i, []))]
        if cost(flat) <= 80:
            assert own == ([words] if words else [])
            continue
        at = 0
        for k, piece in enumerate(own):
            begin = at
            if k:  # the longest run of words before the cut that fits the overlap, and leaves room for the next word
                begin = next(b for b in range(max(0, at - len(own[k - 1])), at + 1) if b == at or cost(" ".join(words[b:at])) <= 16 + 1e-9)
                while begin < at and cost(" ".join(words[begin : at + 1])) > 80 + 1e-9:
                    begin += 1
            end = at + 1
            while end < len(words) and cost(" ".join(words[begin : end + 1])) <= 80 + 1e-9:
                end += 1
            assert piece == words[begin:end], (i, k)
            at = end
        assert at == len(words)
