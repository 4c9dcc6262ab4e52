import hashlib
import random
import struct
import zlib

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from lectern.llm import byte_bpe, packing, queries
from tests.conftest import SMALL
from tests.llm.helpers import ODD, empty, odd

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
STRANGE = ["", "a\x00b", "🙂🙂 ▁▁ <unk> <s>", "   \n\n  x", "é" * 300, " " * 3000, "<|endoftext|>", "日本語テキスト", "ﷺ́", "x" * 5000]


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_encoder_equals_tiktoken(spark):
    want, mine = reference(), byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
    texts = STRANGE + [r.text for r in queries.documents(spark, SMALL).collect()]
    for text in texts:
        ids = want.encode_ordinary(text)
        assert mine.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
        assert mine.decode(mine.encode(text)) == text.encode()


def test_cache_starts_anew():
    small = byte_bpe.Encoder(PATH, public_tokenizers.PATTERN, cache_size=3)
    text = "one two three four five six seven two"
    assert small.encode(text) == byte_bpe.encoder(PATH, public_tokenizers.PATTERN).encode(text)
    assert len(small) <= 3


def test_registered_encoding(spark):
    want = reference()
    texts = {r.doc_id: r.text for r in queries.documents(spark, SMALL).collect()}
    for r in queries.op3_byte_bpe(spark, SMALL).collect():
        ids = want.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_encoding_of_odd_rows(spark):
    got = byte_bpe.encode_documents(odd(spark), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in got) == sorted((i or 0, (t or "").encode()) for i, t in ODD)
    assert byte_bpe.encode_documents(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_plan_fills_every_window():
    rnd = random.Random(1)
    for _ in range(200):
        cap = rnd.choice([8, 16, 64])
        totals = {q: rnd.choice([0, 1, 3, rnd.randint(1, 50), rnd.randint(1, 2000)]) for q in range(rnd.randint(1, 7))}
        targets = rnd.choice([None, {q: rnd.choice([0, 1, 2, 0.01, 5]) for q in totals}])
        plan, got = packing.Plan(totals, targets, cap), set()
        for q, n in totals.items():
            at = 0
            while at < n:
                m, expected = min(n - at, rnd.randint(1, 100)), 0
                for start, length, window, offset in plan.cut(q, at, m):
                    assert start == expected and length > 0
                    expected += length
                    got |= {(window, offset + j) for j in range(length)}
                assert expected == m
                at += m
        assert got == {(i // cap, i % cap) for i in range(sum(totals.values()))}


def test_plan_against_stepwise_deficit_round_robin():
    """Quotas are earned, whole tokens sent and fractions carried, one window after another."""
    totals, cap = {0: 5_003, 1: 1_700, 2: 911, 3: 40_000}, 64
    plan, whole = packing.Plan(totals, None, cap), sum(totals.values())
    taken = {}
    for q, n in totals.items():
        for _, length, window, _ in plan.cut(q, 0, n):
            taken[window, q] = taken.get((window, q), 0) + length
    shared = dict.fromkeys(totals, 0)  # deficits of the first queues together, in 1 / whole tokens
    for window in range(whole // cap):
        sent, ahead = 0, 0
        for q, n in totals.items():
            ahead += n
            shared[q] += cap * ahead
            out = shared[q] // whole
            shared[q] -= out * whole
            assert taken.get((window, q), 0) == out - sent
            assert abs(out - sent - cap * n / whole) < 2
            sent = out
        assert sent == cap


def check_pieces(rows, pieces):
    model = Tokenizer.from_file(WORDS)
    by_doc, windows = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id or 0, []).append(p)
        windows.setdefault(p.sequence_id, []).append(p)
    for i, texts in rows.items():
        ids = [model.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert sum(p.length for p in by_doc[i]) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p.start):
                part = ids[0][at : at + p.length]
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[0]), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
                at += p.length
    assert sorted(windows) == list(range(len(windows)))
    for w, own in windows.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == packing.CAPACITY or w == len(windows) - 1


def test_registered_packing(spark):
    rows = {r.doc_id: [r.text] for r in queries.documents(spark, SMALL).collect()}
    check_pieces(rows, queries.op5_packing(spark, SMALL).collect())


def test_packing_of_odd_rows(spark):
    rows = {}
    for i, t in ODD:
        rows.setdefault(i or 0, []).append(t)
    check_pieces(rows, packing.pack(odd(spark), WORDS).collect())
    check_pieces(rows, packing.pack(odd(spark), WORDS, targets={"s1": 3.0}).collect())
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_many_sources_keep_their_targets(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 400, f"s{i % 400}") for i in range(1200)], "doc_id long, text string, source string").repartition(3)
    pieces = packing.pack(docs, WORDS, targets={"s1": 3.0, "s2": 1.0}).collect()
    check_pieces({r.doc_id: [r.text] for r in docs.collect()}, pieces)
    first = {s: sum(p.length for p in pieces if p.sequence_id == 0 and p.doc_id % 400 == s) for s in (1, 2)}
    assert first == {1: 3072, 2: 1024}


def test_sources_below_a_token_a_window_share_a_queue(spark):
    sums = spark.createDataFrame([(f"+{s}", p, 10 if s % 3 else 1) for s in range(30) for p in range(4) if (s + p) % 5], "source string, part int, n long")
    bases, plan = packing.queues_of(sums, None, capacity=16)
    n = {(r.source, r.part): r.n for r in sums.collect()}
    taken = {}
    for r in bases.collect():
        taken.setdefault(r.queue, []).append((r.base, n[r.source, r.part]))
    assert len(n) == sum(map(len, taken.values())) and len(taken) < 30
    for own in taken.values():
        at = 0
        for base, size in sorted(own):
            assert base == at
            at += size


def test_special_tokens_and_every_assigned_code_point():
    model, mine = Tokenizer.from_file(WORDS), packing.tokenizer(WORDS)
    texts = ["x <|endoftext|> y", "<|endoftext|><|startoftext|>", "a<|x|>b <|endoftext|", "É<|endoftext|>\u0301", "don't 'tis ''s .'s o'clock_ a_b 1½2"]
    for c in [*range(0x32000), *range(0x32000, 0x110000, 97)]:
        if not 0xD800 <= c < 0xE000:
            texts.append(f"ab{chr(c)}cd {chr(c)} 1{chr(c)}2 x{chr(c)}{chr(c)}. .{chr(c)}Q")
    for i in range(0, len(texts), 20_000):
        for text, e in zip(texts[i : i + 20_000], model.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)):
            assert mine.encode(text) == struct.pack(f"<{len(e.ids)}H", *e.ids), ascii(text)


def test_words_split_where_the_tokenizer_does():
    model = Tokenizer.from_file(WORDS)
    for text in [*STRANGE, "H̱ ẖ İ", "it's. don't!! %%%. a.b. x,\n", "́abc é", "a\x1cb a\x85b\xa0c", "ΟΔΟΣ. ÀÉ À", "日本 語。"]:
        ids = model.encode(text, add_special_tokens=False).ids
        assert packing.tokenizer(WORDS).encode(text) == struct.pack(f"<{len(ids)}H", *ids), text
