import random

import corpus_pipeline
from lectern.llm import components, near_copies, simhash
from tests.conftest import MIDDLE, SMALL
from tests.llm.helpers import empty, odd
from tests.llm.test_dedup import union


def sets(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def lowest(rows):
    """The smallest id that links reach, by comparing all pairs that share a shingle."""
    own, holders = {r.doc_id: sets(r.text) for r in rows}, {}
    for i, s in own.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    close = lambda i, j: len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])
    near = lambda i, j: 0.8 <= len(own[i]) / len(own[j]) <= 1.25
    pairs = {(i, j) for ids in holders.values() for i in ids for j in ids if i < j and near(i, j)}
    return union([p for p in pairs if close(*p)], own)


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    want = lowest(docs.collect())
    assert sum(i != j for i, j in want.items()) > 20
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want


def test_the_stage_removes_edited_copies(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {i for i, first in lowest(docs.collect()).items() if i == first}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()} == want


def test_a_drifting_family(spark):
    rnd = random.Random(4)
    texts = [[f"w{rnd.randrange(10**6)}" for _ in range(150)]]
    for _ in range(299):
        words = list(rnd.choice(texts[-30:]))
        for _ in range(rnd.randrange(1, 4)):
            words[rnd.randrange(150)] = f"w{rnd.randrange(10**6)}"
        texts.append(words)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == lowest(docs.collect())


def test_large_buckets_lose_no_link(spark):
    # a path in one bucket: only neighbours are linked, so any choice of few representatives misses some
    members = spark.createDataFrame([(b, x, 9) for b in (1, 2) for x in range(b * 1000, b * 1000 + 150)], "bucket long, key long, size long").selectExpr("bucket", "key", "struct(size) AS own")
    got = components.links_within_buckets(members, lambda pairs: pairs.where("b - a = 1"))
    assert {(r.a, r.b) for r in got.collect()} <= {(x, x + 1) for b in (1, 2) for x in range(b * 1000, b * 1000 + 149)}
    assert {r.component for r in components.connected_components(got).collect()} == {1000, 2000}


def test_odd_rows(spark):
    got = near_copies.near_copies(odd(spark)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7), (8, 8), (9, 9), (10, 10)]
    assert near_copies.near_copies(empty(spark)).count() == 0


def test_rows_that_repeat_an_id_or_all(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words, "more"]), "another text", "a third one of its own"]
    docs = spark.createDataFrame([(1, texts[0], "a"), (1, texts[1], "b"), (2, texts[1], "c"), (1, texts[2], "d"), (None, texts[3], "e")], "doc_id long, text string, key string")
    got = {(r.doc_id, r.text, r.key) for r in near_copies.without_near_copies(docs).collect()}
    assert (1, texts[2], "d") in got and (None, texts[3], "e") in got and len(got) == 3
    assert near_copies.without_near_copies(docs).columns == docs.columns


def test_simhash_finds_the_closest_and_prefixes_the_rest(spark):
    rnd = random.Random(9)
    texts = [[f"w{rnd.randrange(10**6)}" for _ in range(2000)] for _ in range(30)]
    texts += [[*words[:-1], "edited"] for words in texts] + [[*(w + "x" if i % 70 == 0 else w for i, w in enumerate(words))] for words in texts]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) AS key")
    signed = near_copies.with_keys(docs.select("doc_id", "key", "text"), (near_copies.np.zeros(0, near_copies.np.uint64), near_copies.np.zeros(0, near_copies.np.int64)))
    rows = {r.key: (r.doc_id, simhash.fingerprint(r.text, 5)) for r in docs.collect()}
    assert {r.key: r.fp for r in signed.collect()} == {k: fp for k, (_, fp) in rows.items()}
    linked = {r.node: r.component for r in components.connected_components(near_copies.simhash_pairs(signed)).collect()}
    keys = list(rows)
    close = [(a, b) for a in keys for b in keys if a < b and ((rows[a][1] ^ rows[b][1]) & (2**64 - 1)).bit_count() <= 2]
    assert len(close) >= 25 and all(linked[a] == linked[b] for a, b in close)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs.drop("key")).collect()}
    assert got == lowest(docs.collect()) and set(got.values()) == set(range(30))


def test_candidates_of_another_method_are_compared(spark):
    members = spark.createDataFrame([(1, x, 9) for x in range(20)] + [(2, x, 9) for x in range(100, 250)], "bucket long, key long, size long")
    more = spark.createDataFrame([(19, 100), (20, 300)], "a long, b long")
    for some in (members, members.where("bucket = 1")):
        got = components.links_within_buckets(some.selectExpr("bucket", "key", "struct(size) AS own"), lambda pairs: pairs.where("b - a = 1 or b = 100"), more=more)
        assert (19, 100) in {(r.a, r.b) for r in got.collect()}


def test_maps_rule_out_no_pair_of_the_similarity():
    np, rnd = near_copies.np, random.Random(3)
    bits = lambda h: int.from_bytes(near_copies.bit_map(np.array(sorted(h), np.uint64)).tobytes(), "little")
    ruled_out = 0
    for _ in range(400):
        a = {rnd.getrandbits(64) for _ in range(rnd.choice([1, 5, 100, 400]))}
        b = {x for x in a if rnd.random() > 0.12} | {rnd.getrandbits(64) for _ in range(rnd.randrange(len(a) // 6 + 1))}
        far = (bits(a) ^ bits(b)).bit_count() * 9 > len(a) + len(b)
        ruled_out += far
        assert not far or len(a & b) < 0.8 * len(a | b)
    assert ruled_out > 50


def test_members_of_a_large_bucket_that_rules_exclude_are_no_candidates(spark):
    # 100 keys of one class and 200 of their own in each of 3 buckets: marks tell them apart
    rows = [(b, x) for b in range(3) for x in range(300)]
    members = spark.createDataFrame(rows, "bucket long, key long").selectExpr("bucket", "key", "struct(1L AS size) AS own")
    marks = spark.range(300).selectExpr("id AS key", "struct(if(id < 100, 0, id) AS class) AS mark")
    seen = []

    def compare(pairs):
        seen.append(pairs.count())
        return pairs.where("b < 100")

    got = components.links_within_buckets(members, compare, marks=marks, alike=lambda a, b: a["class"] == b["class"])
    assert {r.component for r in components.connected_components(got).collect()} == {0}
    assert sum(seen) <= 8 * 3 * 100
