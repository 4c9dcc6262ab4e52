import os
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators import chunking, context, filters, organize, retrieval, rows, snapshots
from lectern.plans import search_plan
from lectern.plans.catalogue import ORACLES, QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall()), key=str)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("text", "n"), [("Alpha beta. Gamma delta.", 8), ("文件夹", 2), ("a-b (c) d", 6), ("", 0), (None, 0), ("...", 3)])
def test_tokens(spark, text, n):
    assert one(spark, text, tx.token_estimate) == n
    assert chunking.tokens(text or "") == n


def test_text_functions(spark):
    assert one(spark, "myFileName ABCDef", tx.boundaries) == "my File Name ABC Def"
    assert one(spark, "Café-10!", tx.concept) == "café10"
    assert one(spark, "  Éa ", tx.folded) == "ea"
    assert one(spark, "in 1999, 20245 and 2024", tx.years) == ["1999", "2024"]
    assert one(spark, "x.tar.GZ", tx.extension) == "gz" and one(spark, "none", tx.extension) is None
    assert one(spark, "../up", tx.folder_name) is None and one(spark, " Papers ", tx.folder_name) == "Papers"
    assert one(spark, "see [F1:P2] and [F1:P2], [F3:P4]", tx.citations) == ["[F1:P2]", "[F3:P4]"]
    assert one(spark, "One. Two! Three? Four.", tx.first_sentences) == "One. Two! Three?"
    assert one(spark, 'noise {"a": [1,2,],} tail', tx.repaired_json) == '{"a": [1,2]}'
    assert one(spark, "1.10.2", tx.version_key) == [1, 10, 2, 0]
    assert one(spark, "a2b10", tx.natural_key) < one(spark, "a10b2", tx.natural_key)
    assert one(spark, "word " * 40 + "needle" + " word" * 80, lambda c: tx.excerpt(c, "needle")).count("…") == 2
    assert one(spark, "x" * 700, tx.slices) == ["x" * 320, "x" * 320, "x" * 60]
    assert one(spark, "start " + "ab" * 500, tx.runaway) is True
    assert one(spark, "API2", tx.distinctive_identifier) and not one(spark, "api", tx.distinctive_identifier)
    assert one(spark, "page 3 of 9", tx.noise) and one(spark, "—*—", tx.noise) and not one(spark, "pages", tx.noise)
    pair = spark.createDataFrame([("invoice", "the invoice"), ("kitten", "sitting"), ("abcdefghij", "abcdefghiX")], "a string, b string")
    assert [r[0] for r in pair.select(tx.are_duplicates(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([float("nan")], [1.0]), ([], [])], "a array<float>, b array<float>")
    got = df.select(vx.cosine(F.col("a"), F.col("b")).alias("c"), vx.valid(F.col("a")).alias("v"), vx.normalised(F.col("a")).alias("n")).collect()
    assert round(got[0].c, 6) == 0.96 and got[1].c is None
    assert [r.v for r in got] == [True, True, False, False]
    assert [round(x, 6) for x in got[0].n] == [0.6, 0.8] and got[1].n == [0, 0]


def test_filter_parts():
    assert filters.size_bounds(-5, None) == (0, None) and filters.size_bounds(9, 3) == (3, 9)
    assert filters.FileFilter(name="x").given() and not filters.FileFilter().given()


def test_transient_names(spark):
    names = ["a.tmp", "~$doc.docx", ".DS_Store", "a.crdownload", "a.txt", "tmp.txt"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(filters.transient(F.col("n"))).collect()
    assert [r[0] for r in got] == [True, True, True, True, False, False]


def test_release_checks(spark):
    made = spark.createDataFrame([("1.0", "arm64", "https://x.org/a", "a" * 64), ("", "vax", "http://x", "zz")], "version string, architecture string, url string, sha256 string")
    assert [len(r[0]) for r in made.select(filters.release_errors()).collect()] == [0, 4]


def test_chunks_keep_units_and_overlap():
    text = "\n\n".join(f"Paragraph {i} has a few words in it. And a second sentence." for i in range(30))
    parts = chunking.chunk(text, 120, 30)
    assert len(parts) > 3 and all(chunking.tokens(p) <= 120 for p in parts)
    assert all(a.split("\n\n")[-1] == b.split("\n\n")[0] for a, b in zip(parts, parts[1:]))
    assert chunking.chunk("", 100) == [] and chunking.chunk(None) == []
    assert len(chunking.chunk("word " * 400, 100, 10)) > 4
    table = "| h |\n" + "\n".join(f"| row {i} with cells |" for i in range(40))
    assert all(p.startswith("| h |") for p in chunking.table_pieces(table, 60))


def test_merging_repairs_sentences(spark):
    made = [(1, 0, "This sentence is", 1), (1, 1, "cut in two.", 1), (1, 2, "---", 1), (1, 3, "Next one " * 200, 4)]
    whole = spark.createDataFrame(made, "file_id long, chunk_idx int, text string, page int").orderBy("chunk_idx").coalesce(1)
    got = chunking.merged(whole.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "text", "page"))).alias("chunks"))).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.chunk_idx)][0] == "This sentence is cut in two."


def test_plans_read_questions():
    today = date(2024, 3, 13)
    assert search_plan.date_interval("files from last week", today) == (date(2024, 3, 4), date(2024, 3, 11))
    assert search_plan.date_interval("past 7 days", today) == (date(2024, 3, 7), date(2024, 3, 14))
    assert search_plan.date_interval("last month", today) == (date(2024, 2, 1), date(2024, 3, 1))
    assert search_plan.date_interval("the day before yesterday", today) == (date(2024, 3, 11), date(2024, 3, 12))
    assert search_plan.date_interval("report of 2021", today) == (date(2021, 1, 1), date(2022, 1, 1))
    plan = search_plan.inferred("find the newest pdf files about budget with notes modified this year", today)
    assert plan.terms == ("budget",) and plan.sort == "newest" and plan.filter.extensions == ("pdf",) and plan.filter.has_note and plan.filter.modified[0] == datetime(2024, 1, 1)
    assert search_plan.merged_concepts([("a", ("b",)), ("c", ()), ("B", ("d",))]) == [("c",), ("a", "b", "d")]


def test_history_and_batches():
    assert context.history_budget(8192)["input"] == 8192 - 2048 - 819
    assert context.batch_budget("local", "translate", 8192) == 1024 and context.batch_budget("cloud", "summarise", 10**6) == 24000


def test_reconciliation_cascade(spark):
    schema = "path string, identity string, size bigint, content_hash string"
    known = spark.createDataFrame([(1, "/a", "i1", 1, "h1"), (2, "/b", "i2", 2, "h2"), (3, "/c", "i3", 3, "h3"), (4, "/d", "i4", 4, "h4"), (5, "/e", "i5", 9, "h9"), (6, "/f", "i6", 9, "h9")], "id long, " + schema)
    found = spark.createDataFrame([("/a", "x", 7, "x"), ("/moved", "i2", 2, "h2"), ("/copy", "n", 3, "h3"), ("/new", "m", 5, "h5"), ("/g", "k", 9, "h9")], schema)
    got = {(r.id, r.path, r.how) for r in organize.reconciled(known, found).collect()}
    assert got == {(1, "/a", "path"), (2, "/moved", "identity"), (3, "/copy", "content"), (4, "/d", "gone"), (5, "/e", "gone"), (6, "/f", "gone"), (None, "/new", "new"), (None, "/g", "new")}


def test_generations(spark, tmp_path):
    store = snapshots.Generations(spark, str(tmp_path))
    rows_ = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert store.current() is None
    store.publish(rows_)
    store.stage(spark.createDataFrame([(2, "c")], "id long, v string"))
    assert [r.id for r in store.pending(rows_, "id").collect()] == [1]
    with pytest.raises(ValueError):
        store.commit("id", 2)
    store.stage(spark.createDataFrame([(3, "d")], "id long, v string"))
    assert {tuple(r) for r in store.commit("id", 2).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert store.staged() is None


def test_guards(spark):
    with pytest.raises(ValueError):
        snapshots.check_one_space(spark.createDataFrame([("m", 3)], "model string, dim int"), "m", 4)
    with pytest.raises(ValueError):
        snapshots.patched(spark.createDataFrame([(1,)], "id int"), F.lit(True), {"id": F.lit(2)}, ("note",))


def test_collisions_and_evidence(spark):
    moves = spark.createDataFrame([(1, "/a", "x", "txt"), (2, "/a", "x", "txt"), (3, "/b", "x", "txt")], "id long, folder string, stem string, ext string")
    there = spark.createDataFrame([("/b", "x", "txt")], "folder string, stem string, ext string")
    assert [r.name for r in rows.collision_names(moves, there).orderBy("id").collect()] == ["x.txt", "x (2).txt", "x (2).txt"]
    hits = spark.createDataFrame([(1, f, p, 1.0 / (1 + f + p), "t" * 3000) for f in range(4) for p in range(6)], "query_id long, file_id long, parent_idx int, score double, text string")
    got = context.evidence(hits).collect()
    assert len(got) <= context.PARENTS and sum(len(r.excerpt) for r in got) <= context.CHARACTERS and max(len(r.excerpt) for r in got) <= context.EXCERPT


def test_display_policy(spark):
    made = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.2), ("q", 3, 0.3), ("q", 4, 0.1)], "q string, file_id long, confidence double")
    assert sorted(r.file_id for r in retrieval.displayed(made, "q").collect()) == [1, 2, 3]


@pytest.mark.parametrize("ids", [range(12), range(26), range(5, 38), (3, 9, 13, 24, 39), (9,)])
def test_reference_files_of_incomplete_folders(spark, tmp_path, ids):
    made = spark.createDataFrame([(i, f"text {i}", "en", "src1", 6) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    made.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["src39_reference_files"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["src39_reference_files"](spark, str(tmp_path)).collect()) == want
