import random
from collections import Counter

from pyspark.sql import functions as F

from lectern.llm import line_dedup
from tests.conftest import MIDDLE
from tests.llm.helpers import empty, odd
from tests.llm.test_dedup import union


def sets(line):
    n = line_dedup.SHINGLE
    return {line[i : i + n] for i in range(len(line) - n + 1)} or {line} if len(line) > n else {line}


def brute(docs):
    lines = [(i, j, x) for i, t in docs for j, x in enumerate((t or "").split("\n"))]
    distinct = sorted({x for *_, x in lines if x.strip(" ")})
    own = {x: sets(x) for x in distinct}
    pairs = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]
    root = union(pairs, distinct)
    first = {}
    for i, j, x in sorted(lines, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if x in root:
            first.setdefault(root[x], (i, j))
    size = Counter(root[x] for *_, x in lines if x in root)
    return sorted((i or -1, j, (i, j) == first[root[x]] if x in root else True, size[root[x]] if x in root else 1) for i, j, x in lines), len(pairs)


def varied(rnd, line):
    words = line.split()
    for _ in range(rnd.randrange(1, 3)):
        words[rnd.randrange(len(words))] = rnd.choice(["alpha", "beta", "gamma", "delta"])
    return " ".join(words)


def corpus(rnd, groups, copies):
    word = lambda: "".join(rnd.choice("aeioubcdfgklmnprst") for _ in range(rnd.randrange(3, 9)))
    base = [" ".join(word() for _ in range(rnd.randrange(20, 60))) for _ in range(groups)]
    lines = [b for b in base] + [varied(rnd, rnd.choice(base)) for _ in range(copies)] + ["", "  ", "short", "short", base[0]]
    rnd.shuffle(lines)
    return [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(len(lines) // 5 + 1)]


def run(spark, docs):
    got = line_dedup.line_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id or -1, r.line_no, r.kept, r.copies) for r in got)


def test_lines_against_brute_force(spark):
    docs = corpus(random.Random(2), 60, 120)
    want, pairs = brute(docs)
    assert pairs > 50
    got = run(spark, docs)
    assert len(got) == len(want)
    assert sum(a != b for a, b in zip(got, want)) <= 0.02 * len(want)


def test_large_buckets_take_rounds(spark):
    docs = corpus(random.Random(9), 2, 70)
    want, _ = brute(docs)
    got = run(spark, docs)
    assert len(got) == len(want) and sum(a != b for a, b in zip(got, want)) <= 0.02 * len(want)


def test_odd_rows(spark):
    got = line_dedup.line_groups(odd(spark)).collect()
    assert len(got) == 13
    kept = {(r.doc_id, r.line_no) for r in got if r.kept}
    assert (1, 0) in kept and (3, 0) in kept and (4, 0) in kept and (5, 0) in kept and (8, 0) in kept and (9, 0) in kept
    assert (2, 0) not in kept and (None, 0) not in kept
    assert line_dedup.line_groups(empty(spark)).count() == 0
    texts = {r.doc_id: r.text for r in line_dedup.without_duplicates(odd(spark)).collect()}
    assert texts[1] and texts[2] == ""


def test_one_key_of_a_drifting_family_loses_no_link(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("aeioubcdfgklmnprst") for _ in range(6))
    words = [word() for _ in range(60)]
    lines = []
    for k in range(100):
        lines.append(" ".join(words))
        words[k * 7 % 60] = word()
    keys = [line_dedup.line_key(x) for x in lines]
    docs = spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string")
    signed = spark.createDataFrame([(0, i, k, 400, 0, [1]) for i, k in enumerate(keys)], "doc_id long, line_no int, key long, size long, sketch long, keys array<long>")
    links = [(r.a, r.b) for r in line_dedup.similar_lines(signed, docs, "doc_id", "text").collect()]
    assert len(set(union(links, keys).values())) == 1


def linked(lines):
    """All pairs at 0.8 or more, by the rarest fifth of each line's shingles: that loses none."""
    own, often, holders, pairs = {x: sets(x) for x in lines}, Counter(), {}, set()
    for s in own.values():
        often.update(s)
    for x, s in own.items():
        near = set()
        for g in sorted(s, key=lambda g: (often[g], g))[: len(s) - (4 * len(s) + 4) // 5 + 1]:
            near.update(holders.get(g, ()))
            holders.setdefault(g, []).append(x)
        pairs |= {(x, y) for y in near if len(s & own[y]) >= 0.8 * len(s | own[y])}
    return pairs


def test_every_line_of_a_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, j, x) for r in docs.collect() for j, x in enumerate((r.text or "").split("\n"))]
    distinct = {x for *_, x in rows if x.strip(" ")}
    pairs = linked(distinct)
    assert len(pairs) > 100
    root, first = union(pairs, distinct), {}
    for i, j, x in sorted(rows):
        if x in root:
            first.setdefault(root[x], (i, j))
    want = {(i, j): first[root[x]] if x in root else (i, j) for i, j, x in rows}
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_dedup.line_groups(docs).collect()}
    assert got.keys() == want.keys()
    assert sum(got[k] != want[k] for k in got) <= 0.002 * len({k for k, x in want.items() if x != k})


def test_one_edit_in_short_lines_is_found():
    rnd, hits = random.Random(8), []
    for _ in range(400):
        line = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(rnd.randrange(50, 90)))
        at = rnd.randrange(len(line))
        other = line[:at] + "#" + line[at + 1 :]
        a, b = sets(line), sets(other)
        assert len(a & b) >= 0.8 * len(a | b)
        keys = line_dedup.band_keys(line_dedup.smallest_hashes([line, other])[0])
        hits.append((keys[0] == keys[1]).any())
    assert sum(hits) >= 0.995 * len(hits)


def test_signatures_do_not_depend_on_the_batch():
    rnd = random.Random(1)
    lines = ["x", "ab cd", *("".join(rnd.choice("abc d") for _ in range(rnd.randrange(1, 300))) for _ in range(50))]
    whole, sizes = line_dedup.smallest_hashes(lines)
    parts = [line_dedup.smallest_hashes([x], block=16)[0][0] for x in lines]
    assert (whole == parts).all() and list(sizes) == [max(1, len(x) - line_dedup.SHINGLE + 1) for x in lines]


def test_members_are_those_of_keys_that_several_lines_have(spark):
    rnd = random.Random(4)
    keys = [rnd.randrange(-(2**63), 2**63) for _ in range(40)]
    rows = [(k, rnd.randrange(1, 600), rnd.randrange(2**62), [rnd.choice(keys[:25]) if rnd.random() < 0.5 else rnd.randrange(-(2**63), 2**63) for _ in range(3)]) for k in keys]
    signed = spark.createDataFrame(rows + rows[:20] + [(None, 0, 0, [])], "key long, size long, sketch long, keys array<long>")
    holders = {}
    for key, size, sketch, own in rows:
        for b in own:
            holders.setdefault(b, {})[key] = (min(size, 255), sketch)
    want = sorted((b, k, *v, len(own)) for b, own in holders.items() if len(own) > 1 for k, v in own.items())
    got = line_dedup.members_of_shared_keys(signed.repartition(5))
    assert len(want) > 40 and sorted((r.bucket, r.key, r.own["size"], r.own.sketch, r.members) for r in got.collect()) == want


def test_maps_rule_no_similar_pair_out(spark):
    rnd = random.Random(3)
    lines = ["ab", "abc", "", "\U0001f600 é ab", *("".join(rnd.choice(letters) for _ in range(rnd.randrange(5, 200))) for letters in ("abcd ", "abcdefghijklm\U0001f600", "aé漢") for _ in range(30))]
    lines += [x[:at] + rnd.choice("z漢") + x[at + 1 :] for x in lines for at in (len(x) // 2, len(x) // 5)]
    lines = sorted({x for x in lines if x.strip()})
    rows = {r.line: r.mark for r in line_dedup.with_maps(spark.createDataFrame(enumerate(lines), "key long, line string")).collect()}
    alike = 0
    for i, x in enumerate(lines):
        assert rows[x]["size"] == len(sets(x))
        for y in lines[i + 1 :]:
            if len(sets(x) & sets(y)) >= 0.8 * len(sets(x) | sets(y)):
                alike += 1
                assert 9 * sum((a ^ b).bit_count() if a ^ b >= 0 else 64 - (~(a ^ b)).bit_count() for a, b in zip(rows[x].bits, rows[y].bits)) <= rows[x]["size"] + rows[y]["size"]
    assert alike > 60


def test_unlike_lines_of_a_large_key_are_not_compared(spark, monkeypatch):
    rnd, met = random.Random(12), []
    word = lambda: "".join(rnd.choice("aeioubcdfgklmnprst") for _ in range(6))
    shared = " ".join(word() for _ in range(20))
    lines = [shared + " " + " ".join(word() for _ in range(40)) for _ in range(120)]
    signed = spark.createDataFrame([(line_dedup.line_key(x), 400, 0, [1]) for x in lines], "key long, size long, sketch long, keys array<long>")
    before = line_dedup.compare
    monkeypatch.setattr(line_dedup, "compare", lambda pairs, *more: met.append(pairs.count()) or before(pairs, *more))
    docs = spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string")
    assert line_dedup.similar_lines(signed, docs, "doc_id", "text").count() == 0
    assert sum(met) < 120


def test_similarities_are_exact(spark):
    rnd = random.Random(7)
    lines = ["", "a", "abcd", "abcde", *("".join(rnd.choice("ab é漢\U0001f600"[:n]) for _ in range(rnd.randrange(3, 60))) for n in (2, 4, 5, 6) for _ in range(15))]
    pairs = spark.createDataFrame([(x, y) for x in lines for y in lines], "x string, y string")
    for r in pairs.select("x", "y", line_dedup.jaccard(F.col("x"), F.col("y")).alias("got")).collect():
        assert r.got == len(sets(r.x) & sets(r.y)) / len(sets(r.x) | sets(r.y))
