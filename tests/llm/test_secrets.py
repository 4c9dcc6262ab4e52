import hashlib
import math
import random
import re
import time

from lectern.llm import queries, secrets
from tests.conftest import MIDDLE
from tests.llm.helpers import empty, odd

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ALLOWED = [*(a.every[0] for a in secrets.ALLOWED[:3]), "^/?(?:[A-Za-z_-]+[0-9]{0,4}/)+[A-Za-z0-9_-]{0,23}$"]
CRAFTED = [
    'password = "hunter22" and PASSWD:abc, Api_Key==x123456 token=token: abcdefgh',
    "AKIA" + "A1" * 8 + " xAKIA" + "B" * 15 + " AKIAAKIA" + "C" * 20,
    "é🙂 " + "0123456789abcdef" * 3 + " deadbeef" * 2 + " " + "9f86d081884c7d659a2feaa0c55ad015",
    "key: q8Zt4xLw9VbN2mRk7PcY5sHd3GfJ6aTe1UoX0iEz and 550e8400-e29b-41d4-a716-446655440000",
    "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822CD15D6C15B0F00A08",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 /usr/local/lib1/python/whatever1 exampleq8Zt4xLw9VbN2mRk7PcY5sHd3GfJ6aTe1",
    "secret=" + "a.b-c_d+e/f=" * 40,
    "x" * 24 + "Q1w2E3r4T5y6U7i8O9p0AsDfGhJkLzXcVbNm" + "y" * 60,
]


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return spans + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


def entropic(text):
    out = []
    for kind, (symbols, pattern, needs, limit) in secrets.CLASSES.items():
        for m in re.finditer(pattern, text):
            s = m[0]
            if not all(re.search(n, s) for n in needs) or any(re.search(a, s) for a in ALLOWED):
                continue
            low = s.lower() if len(symbols) <= 22 else s
            hot = []
            for i in range(len(s) - secrets.WINDOW + 1):
                window = low[i : i + secrets.WINDOW]
                h = -sum(window.count(c) / len(window) * math.log2(window.count(c) / len(window)) for c in set(window))
                if h >= limit - 1e-10:
                    hot.append(i)
            if hot:
                out.append((m.start() + hot[0], secrets.KINDS.index(kind), m.start() + hot[-1] + secrets.WINDOW))
    return out


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def check(docs, got):
    want = []
    for i, text in docs:
        text = text or ""
        spans = base(text)
        counts = [sum(k == j for _, k, _ in spans) for j in range(3)]
        want.append((i or 0, *counts, hashlib.sha256(listed(spans).encode()).hexdigest(), listed(spans + entropic(text))))
    assert sorted((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == sorted(want)


def scan(docs):
    from pyspark.sql import functions as F

    found = secrets.find(docs)
    counts = [F.size(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listing("assign", "access", "hex"), 256).alias("base_sha256"), secrets.listing("assign", "access", "hex", "entropy").alias("spans")).collect()


def test_crafted_and_odd_rows(spark):
    docs = list(enumerate(CRAFTED))
    check(docs, scan(spark.createDataFrame(docs, "doc_id long, text string")))
    check([(r.doc_id, r.text) for r in odd(spark).collect()], scan(odd(spark)))
    assert scan(empty(spark)) == []
    assert any(entropic(t) for t in CRAFTED) and entropic(CRAFTED[5]) == []


def test_registered_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in queries.documents(spark, MIDDLE).collect()]
    check(docs, queries.op1_secret_scans(spark, MIDDLE).collect())


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token = 'abcdef123' b", 1), (2, None, 2), (3, "clean", 3), (4, "x " + "9f86d081884c7d659a2feaa0c55ad015" + " é", 4)], "doc_id int, text string, assign int")
    got = secrets.redact(df).orderBy("doc_id").collect()
    assert [(r.text, r.assign) for r in got] == [("a [SECRET]' b", 1), (None, 2), ("clean", 3), ("x [SECRET] é", 4)]
    assert secrets.redact(df).columns == df.columns


def test_paths_against_one_pattern(spark):
    rnd = random.Random(5)
    parts = ["/", "/", "a", "Zx_", "-", "7", "12345", "b9", "9b", "+", "usr", "lib1234", "Q1w2E3r4T5y6"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14))) for _ in range(4000)] + ["usr/" + "a" * 23, "usr/" + "a" * 24, "/a1/", "//a/", "a//b"]
    path = secrets.ALLOWED[3]
    from pyspark.sql import functions as F

    c = F.col("c")
    finds = [c.rlike(p) for p in path.every] + [~c.rlike(p) for p in path.none]
    got = {r.c: r.ok for r in spark.createDataFrame([(x,) for x in set(made)], "c string").select("c", F.forall(F.array(*finds), lambda x: x).alias("ok")).collect()}
    assert got == {x: bool(re.search(ALLOWED[3], x)) for x in made}
    assert 100 < sum(got.values()) < len(got)


def test_long_candidates_take_linear_time(spark):
    rnd = random.Random(2)
    symbols = secrets.CLASSES["entropy_base64"][0]
    docs = [(1, "a1/" * 50_000), (2, "".join(rnd.choice(symbols) for _ in range(200_000))), (3, "token = abcdef12 \n" * 20_000), (4, "f0e1d2c3b4a5968778695a4b3c2d1e0f" * 5_000), (5, "x" * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in scan(df)}
    masked = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert time.time() - began < 60
    assert got[1].spans == "" and masked[1] == docs[0][1]
    assert got[2].spans == "entropy_base64:0:200000" and masked[2] == "[SECRET]"
    assert got[3].n_assign == 20_000 and masked[3] == "[SECRET] \n" * 20_000
    assert got[4].n_hex == 1 and masked[4] == "[SECRET]"
    assert got[5].spans == "" and masked[5] == docs[4][1]
