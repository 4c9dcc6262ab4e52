import hashlib
import random
import re

import pyarrow as pa
import xxhash

from lectern.llm import components, exact_dedup, queries, simhash
from tests.conftest import MIDDLE
from tests.llm.helpers import ODD, empty, odd


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, x) for x in range(5001, 5400)]
    df = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    want = union(pairs, {x for p in pairs for x in p})
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: c for n, c in want.items() if n in linked}
    assert components.connected_components(df.limit(0)).count() == 0


def test_components_of_several_lots_match_union_find(spark, monkeypatch):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(600), rnd.randrange(600)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1300)] + [(5000, x) for x in range(5001, 5200)]
    monkeypatch.setattr(components, "LOT", 64)
    df = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: c for n, c in union(pairs, linked | {x for p in pairs for x in p}).items() if n in linked}
    few = [pa.record_batch({"u": pa.array([9, 8, 3]), "v": pa.array([8, 2, 1])}), pa.record_batch({"u": pa.array([2]), "v": pa.array([1])})]
    assert pa.Table.from_batches(components._forest(few)).to_pylist() == [{"u": u, "v": 1} for u in (2, 3, 8, 9)]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints(spark):
    for text in [t for _, t in ODD if not t or len(t) < 9000] + ["ÀB c D", "a\x0bb\x0cc\rd e", "a\x1fb c"]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text), text


def test_masks_cover_every_pair_of_bits():
    masks = [m & (1 << 64) - 1 for m in simhash.masks()]
    assert all(any(not (m >> i & 1 or m >> j & 1) for m in masks) for i in range(64) for j in range(64))


def links(fps):
    return [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]


def test_similar_pairs_paired_and_in_balls(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(6):
        base = rnd.getrandbits(62)
        for _ in range(60):
            x = base
            for _ in range(rnd.randrange(5)):
                x ^= 1 << rnd.randrange(62)
            fps.add(x)
    want = union(links(fps), fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for paired in (2, 64, 10_000):
        got = [(r.a, r.b) for r in simhash.similar_pairs(df, paired).collect()]
        assert {tuple(sorted(p)) for p in got} <= set(links(fps))
        assert union(got, fps) == want


def test_near_duplicates_against_brute_force(spark):
    rows = queries.documents(spark, MIDDLE).collect()
    got = {r.doc_id: r for r in queries.op4_simhash(spark, MIDDLE).collect()}
    assert len(got) == len(rows)
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in rows}
    root = union(links(set(fps.values())), set(fps.values()))
    lowest = {}
    for i, fp in fps.items():
        lowest[root[fp]] = min(i, lowest.get(root[fp], i))
    assert all(got[i].component_id == lowest[root[fp]] and int(got[i].fingerprint, 16) == fp & (1 << 64) - 1 for i, fp in fps.items())


def test_near_duplicates_of_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7), (8, 8), (9, 9), (10, 10)]
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(odd(spark)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    texts = [norm(t) for _, t in ODD]
    want = []
    for i, t in ODD:
        ids = [j for j, u in ODD if norm(u) == norm(t) and j is not None]
        want.append((i or 0, min(ids), texts.count(norm(t)), i == min(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_full_filter_changes_nothing(spark, monkeypatch):
    want = sorted(exact_dedup.exact_groups(queries.documents(spark, MIDDLE)).collect())
    monkeypatch.setattr(exact_dedup, "filter_size", lambda n: 64)
    assert sorted(exact_dedup.exact_groups(queries.documents(spark, MIDDLE)).collect()) == want


def test_keep_first_keeps_columns(spark):
    df = odd(spark)
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 4, 6, 7, 8, 9, 10]
    assert exact_dedup.keep_first(empty(spark)).count() == 0
