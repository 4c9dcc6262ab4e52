import itertools
import math
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
import xxhash

from lectern.llm import filter_audit, quality_rules, queries
from lectern.llm.common import held_out
from lectern.session import table
from tests.conftest import MIDDLE, SMALL
from tests.llm.helpers import empty, odd

WORD, BLANK = re.compile(r"[^\x20\x09-\x0D]+"), "\x20\x09-\x0d"


# --- op11


def fails_of(rows):
    """The failures of (doc_id, text) rows, each by itself."""
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u in rows) else set()
        out.append(f)
    return out


def slow_audit(rows, labels):
    """(doc_id, text, part) rows; labels: id to (quality, toxic)."""
    fails, out = fails_of([r[:2] for r in rows]), {}
    for part in {r[2] or "" for r in rows}:
        mine = [(f, *labels.get(r[0], (0, 0))) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                shapley[f] += len(gone)
                earlier = [x for x in mine if x not in left or x[0] & set(order[: step - 1])]
                left = [x for x in left if f not in x[0]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[0] and bool(x[0] & set(order[: step - 1])) for x in earlier), sum(x[0] == {f} for x in mine),
                    sum(x[1] == 1 for x in gone), sum(x[2] == 1 for x in gone), f,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return {k: tuple(v) for k, v in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_dict(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in df.collect()}


def test_audit_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in table(spark, SMALL, "documents").collect()]
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, SMALL, "labels").collect()}
    assert as_dict(queries.op11_filter_audit(spark, SMALL)) == slow_audit(docs, labels)


def test_audit_equals_its_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{MIDDLE}/{t}.parquet'")
    want = db.execute(queries.ORACLES["op11_filter_audit"]).df().set_index(["part", "filter_order", "step"]).sort_index()
    got = queries.op11_filter_audit(spark, MIDDLE).toPandas().set_index(["part", "filter_order", "step"]).sort_index()
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_audit_of_odd_rows(spark):
    labels = spark.createDataFrame([(2, 1, 0), (2, None, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in odd(spark).collect()]
    assert as_dict(filter_audit.audit(odd(spark), labels, part="source")) == slow_audit(rows, {2: (1, 1)})
    assert filter_audit.audit(empty(spark), labels, part="source").count() == 0
    assert len(as_dict(filter_audit.audit(odd(spark), labels.limit(0), part="source"))) == 600 * 2


@pytest.mark.parametrize("share", [1 / 500, 1 / 20])
def test_a_hot_group_of_copies_is_dealt_out(spark, monkeypatch, share):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", share)
    rows = [(i, "a copied text" if i % 3 == 0 else f"text {i // 2}", "x") for i in range(600)] + [(0, "a copied text", "x"), (3, "another", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    thin = filter_audit.failures(df).cache()
    got = sorted((r.doc_id, r.hash) for r in filter_audit.repeats(df, thin).collect())
    want = sorted((r[0], r[1]) for r, f in zip(rows, fails_of([r[:2] for r in rows]), strict=True) if "E" in f)
    assert [g[0] for g in got] == [w[0] for w in want]


# --- op12


def slow_rules(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    covered = {j for i, x in enumerate(windows) if x in often for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams_of(text):
    def kind(c):
        return 0 if c.isspace() and c.isascii() and c != "\x1c" and c not in "\x1d\x1e\x1f" else 1 if re.match(r"[^\W_]", c) else 2

    tokens = ["".join(g) for k, g in itertools.groupby(text or "", kind) if k]
    one = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    two = [xxhash.xxh64_intdigest((b).to_bytes(8, "little"), a_seed) for a_seed, b in ((xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42), b) for a, b in itertools.pairwise(one))]
    return [h % quality_rules.BUCKETS for h in one + two]


def slow_verdicts(docs, labels):
    trusted = {i for i in {x[0] for x in labels if x[0] is not None} if not held_out(i) and (q := [x[1] for x in labels if x[0] == i and x[1] is not None]) and min(q) == 1}
    raw, target = Counter(), Counter()
    for i, t in docs:
        g = grams_of(t)
        raw.update(g)
        if i in trusted:
            target.update(g)
    n, m, b = raw.total(), target.total(), quality_rules.BUCKETS
    weight = [round(1e6 * (math.log((target[k] + 1) / (m + b)) - math.log((raw[k] + 1) / (n + b)))) if m else 0 for k in range(b)]
    for i, t in docs:
        r = slow_rules(t)
        failed = r[0] < 50 or 100 * r[4] > 50 * r[0]
        g = grams_of(t)
        yield i, *r, failed, not failed and sum(weight[k] for k in g) >= quality_rules.THRESHOLD * len(g)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


@pytest.mark.parametrize("most", [2_000_000, 10])
def test_registered_rules_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules, "MOST_IDS", most)
    docs = [tuple(r) for r in table(spark, MIDDLE, "documents").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in table(spark, MIDDLE, "labels").select("doc_id", "quality").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.op12_quality_rules(spark, MIDDLE).collect())
    assert got == sorted(slow_verdicts(docs, labels))


def test_held_out_verdicts(spark):
    quality = {r.doc_id: r.quality for r in table(spark, MIDDLE, "labels").collect()}
    rows = [r for r in queries.op12_quality_rules(spark, MIDDLE).collect() if held_out(r.doc_id) and r.doc_id in quality and not r.base_failed]
    assert len(rows) > 30 and all(r.kept == (quality[r.doc_id] == 1) for r in rows)


CRAFTED = [
    "a b c a b c", "a b c d", "a a a a a", "x y", " ".join(["one two three four"] * 30), "l1 w\nl1 w\n \n \nl1  w", "\ta\x0bb\x0cc\r\na b c", "ü ö ä ü ö ä €", "a<b> #*$%&|",
    " ".join(f"w{i % 37}" for i in range(400)), "\n".join(["same line here"] * 9),
]


@pytest.mark.parametrize("bits", [24, 6, 60])
def test_repeated_words_of_crafted_texts(spark, monkeypatch, bits):
    # six bits of position: long texts sort their windows; sixty leave four bits of hash, so that unlike windows meet
    monkeypatch.setattr(quality_rules, "_POSITION_BITS", bits)
    df = spark.createDataFrame(list(enumerate(CRAFTED)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS[1:6]) for r in quality_rules.rules(df).collect()}
    assert got == {i: slow_rules(t) for i, t in enumerate(CRAFTED)}


def test_rules_of_odd_rows(spark):
    labels = spark.createDataFrame([(9, 1), (2, 0), (2, 1), (None, 1), (5, None), (10, 1)], "doc_id long, quality int")
    ratio = quality_rules.fit(odd(spark), labels)
    out = quality_rules.judge(odd(spark), ratio)
    rows = [tuple(r) for r in odd(spark).select("doc_id", "text").collect()]
    want = Counter(slow_verdicts(rows, [(9, 1), (2, 0), (2, 1), (10, 1)]))
    assert Counter(tuple(r[c] for c in COLUMNS) for r in out.collect()) == want
    none = quality_rules.fit(empty(spark), labels)
    assert set(none.weights) == {0} and quality_rules.judge(empty(spark), none).count() == 0
    without = quality_rules.fit(odd(spark), labels.limit(0))
    assert all(r.kept != r.base_failed for r in quality_rules.judge(odd(spark), without).collect())


def test_long_texts_take_linear_time(spark):
    texts = [("w " * 300_000,), (" ".join(f"w{i}" for i in range(300_000)),), ("x" * 2_000_000,), ("*" * 500_000,)]
    out = quality_rules.judge(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string"), quality_rules.Ratio((0,) * quality_rules.BUCKETS, 0, 0))
    assert [r.n_repeat_words for r in out.orderBy("doc_id").collect()] == [300_000, 0, 0, 0]
