import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lectern.llm import byte_bpe, media, quality, queries, token_counts, toxicity
from lectern.llm.common import held_out
from tests.conftest import MIDDLE, SMALL
from tests.llm.helpers import ODD, empty, odd

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_media_round_trip_and_digests(spark):
    texts = {r.doc_id: r.text for r in queries.documents(spark, SMALL).collect()}
    for r in queries.op6_media(spark, SMALL).collect():
        raw = texts[r.doc_id].encode()
        data = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert r.media_bytes == len(data) + 44


def test_media_of_odd_rows(spark):
    rows = media.media_table(odd(spark)).collect()
    assert sorted(r.n_bytes for r in rows) == sorted(len((t or "").encode()) for _, t in ODD)
    assert all(list(r.pair_times) == sorted(r.pair_times) for r in rows)
    assert media.media_table(empty(spark)).count() == 0


def test_peaks_do_not_depend_on_blocks(monkeypatch):
    rnd = np.random.default_rng(0)
    signal = rnd.integers(0, 256, media.UNIT * 60, dtype=np.uint8).tobytes()
    whole = media.peaks(signal)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, media.peaks(signal), strict=True))


def test_tone_has_its_peak():
    t = np.arange(media.UNIT * 10)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / media.FRAME)).astype(np.uint8).tobytes()
    times, bins = media.peaks(tone)
    assert set(bins.tolist()) == {20} and len(times) > 3


def test_ordinal_model_recovers_grades():
    rnd = np.random.default_rng(0)
    texts = [" ".join(rnd.choice(["good", "fine"] if rnd.random() < g / 3 else ["bad", "junk"]) for _ in range(40)) for g in [0, 1, 2, 3] * 100]
    model = quality.fit(texts, [0, 1, 2, 3] * 100)
    assert list(model.thresholds) == sorted(model.thresholds)
    scorer = quality.Scorer(model)
    expected, tail = model.judge(np.array([scorer.linear(t) for t in texts]), 1)
    means = [expected[i::4].mean() for i in range(4)]
    assert all(abs(m - i) < 0.4 for i, m in enumerate(means))
    assert tail[0::4].mean() < 0.2 and tail[3::4].mean() > 0.8


def test_scorer_equals_features():
    texts = ["Some Words here, AND more!! 12", "a b", "", None, "x" * 500, "é***  £$ 9"]
    model = quality.fit([t or "" for t in texts] * 5, [0, 1, 0, 1, 0, 1] * 5, rounds=20)
    scorer, reader = quality.Scorer(model), quality.Reader()
    for t in texts:
        at, value, more = reader.features(t)
        assert abs(scorer.linear(t) - (value @ model.weights[at] + more @ model.weights[quality.BUCKETS :])) < 1e-9


def test_one_grade_only(spark):
    model = quality.fit(["a", "b"], [1, 1])
    got = quality.select(odd(spark), model).collect()
    assert {(r.expected_grade, r.tail_probability, r.kept) for r in got} == {(1.0, 1.0, True)}
    assert quality.select(empty(spark), model).count() == 0


def test_quality_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    got = [(r.predicted, labels[r.doc_id]) for r in queries.op7_quality(spark, MIDDLE).collect() if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in got) >= 0.93 * len(got)


@pytest.fixture(scope="module")
def network():
    rnd = random.Random(1)
    bags, truth = [], []
    for k in range(240):
        words = [rnd.choice(["alpha", "beta", "gamma", "delta", "omega"]).encode() for _ in range(rnd.randrange(3, 90))]
        if k % 3 == 0:
            words[rnd.randrange(len(words))] = b"vile" + rnd.choice([b"ab", b"cd", b"ef"])
        bags.append(words)
        truth.append(int(k % 3 == 0))
    return toxicity.fit(bags, truth)


def test_gradients():
    rnd, net = np.random.default_rng(0), toxicity.Network(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    found = toxicity.features([b"idiot", b"the", b"aa", b"rather", b"x"])
    at, mask = rnd.integers(0, 5, (4, toxicity.WINDOW)), np.ones((4, toxicity.WINDOW), bool)
    mask[1, 20:], mask[2, 1:] = False, False
    y, w = np.array([1, 0, 1, 0.0]), np.ones(4)

    def loss():
        logits = net.run(net.gates(net.inputs(*found)[0]), at, mask)
        return float((w * (np.logaddexp(0, logits) - y * logits)).mean())

    step = 1e-3  # small against the distance of a gram's value from the largest one, where the gradient jumps
    for name, grad in net.step(found, at, mask, y, w).items():
        if isinstance(grad, tuple):
            whole = np.zeros_like(net.p[name])
            whole[grad[0]] = grad[1]
            grad = whole
        for i in np.argwhere(grad != 0)[:: max(1, int((grad != 0).sum()) // 4)]:
            i, old = tuple(i), net.p[name][tuple(i)]
            net.p[name][i] = old + step
            up = loss()
            net.p[name][i] = old - step
            down = loss()
            net.p[name][i] = old
            assert abs((up - down) / (2 * step) - float(grad[i])) < 1e-3


def test_network_finds_toxic_words_anywhere(network):
    scorer, clean = toxicity.Scorer(network), "alpha beta gamma delta " * 50
    scores = scorer.score([clean, clean + "vileab " + clean, "vilegh alpha", "alpha beta", "", None])
    assert scores[0] < 0.5 <= scores[1] and scores[2] >= 0.5 > scores[3]
    assert scores[4] == scores[5]


def test_scores_do_not_depend_on_batches(network, monkeypatch):
    texts = [(t or "") + " vileab" * (k % 2) for k, (_, t) in enumerate(ODD)]
    want = toxicity.Scorer(network).score(texts)
    monkeypatch.setattr(toxicity, "BLOCK", 5)
    monkeypatch.setattr(toxicity, "CACHE_SIZE", 4)
    assert np.allclose(toxicity.Scorer(network).score(texts, most_words=10), want, atol=1e-5)


def test_forward_pass_against_plain_loops(network):
    """Each window step by step, as the equations of the unit say."""
    p, h = {k: v.astype(np.float64) for k, v in network.p.items()}, toxicity.HIDDEN
    sigma = lambda x: 1 / (1 + np.exp(-x))

    def embedded(word):
        s = f"^{word.decode()}$"
        grams = [s[i : i + k] for k in (3, 5) for i in range(max(k == 3, len(s) - k + 1))]
        rows = [p["grams"][zlib.crc32(g.encode()) % toxicity.GRAMS] for g in grams]
        return np.concatenate([p["words"][zlib.crc32(word) % toxicity.WORDS], np.max(rows, axis=0)])

    def side(steps, k, name):
        state, out = np.zeros(h), []
        for x in steps:
            own = (x @ p["in"] + p["bias"])[3 * h * k : 3 * h * (k + 1)]
            z, r = sigma(own[:h] + state @ p[name][:, :h]), sigma(own[h : 2 * h] + state @ p[name][:, h : 2 * h])
            new = np.tanh(own[2 * h :] + r * (state @ p[name][:, 2 * h :]))
            state = z * state + (1 - z) * new
            out.append(state)
        return out

    def logit(words):
        x = [embedded(w) for w in words]
        both = [np.concatenate(s) for s in zip(side(x, 0, "fore"), side(x[::-1], 1, "back")[::-1])]
        look = [float(np.tanh(s @ p["look"] + p["look_bias"]) @ p["key"]) for s in both]
        weight = np.exp(np.array(look) - max(look))
        return float(sum(w * s for w, s in zip(weight / weight.sum(), both)) @ p["out"] + p["out_bias"][0])

    scorer = toxicity.Scorer(network)
    for text in ["alpha beta vileab", "delta", "gamma omega " * 40, "alpha " * 33 + "vilecd", "naïve café\u00a0alpha—vileef 日本語テキスト", "x" * 90]:
        words = toxicity.words_of(text)
        want = [logit(words[s : s + toxicity.WINDOW]) for s in range(0, max(1, len(words) - 16), 16)]
        assert np.allclose(scorer.windows(words), want, atol=1e-4)
        assert abs(scorer.score([text])[0] - sigma(max(want))) < 1e-4


def test_words_part_at_any_space_and_long_ones_come_in_parts():
    assert toxicity.words_of("a\u00a0b—c，d。e … f×g ÉÀ don't 12") == [b"a", b"b", b"c", b"d", b"e", b"f", b"g", "éà".encode(), b"don't", b"00"]
    parts = toxicity.words_of("é" * 100)
    assert b"".join(parts).decode() == "é" * 100 and max(len(x.decode()) for x in parts) == toxicity.LONGEST


def test_a_toxic_passage_of_a_long_text_is_learnt(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    words = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(n))
    rows = [(i, f"{words(3000)} vileab vilecd {words(2000)}" if i % 3 == 0 else words(rnd.randrange(5, 5000)), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.train(df.unionByName(df.limit(5)), df.withColumn("other", F.lit(1)))
    scores = toxicity.Scorer(net).score([words(900) + " vilecd " + words(900), words(3000)])
    assert scores[0] >= 0.5 > scores[1]


def test_toxicity_of_odd_rows(spark, network):
    got = toxicity.score(odd(spark), network).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty(spark), network).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.Scorer(toxicity.train(odd(spark), labels)).score(["a"])[0] < 0.5


def test_toxicity_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = queries.op2_toxicity(spark, MIDDLE).collect()
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    got = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in got) >= 0.9 * len(got)


def test_edited_trees_equal_new_ones():
    by, rnd = token_counts.Counts(PATH, public_tokenizers.PATTERN), random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", " \n", "1", "23", "'s", "'", "!", "é", "🙂", "the ", " word", "'ll"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 120)))
        tree, n = token_counts.build(text, by), len(text)
        cuts = sorted(rnd.sample(range(n + 1), min(n + 1, 2 * rnd.randrange(0, 4))))
        edits = [(cuts[i], cuts[i + 1], "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 4)))) for i in range(0, len(cuts) - 1, 2)]
        new = token_counts.apply(tree, text, edits, by)
        want = token_counts.build(new, by)
        assert (tree.length, tree.leaves, tree.tokens) == (len(new), want.leaves, len(by.model.encode_ordinary(new)))
        a, b = tree.nodes[:, tree.size :], want.nodes[:, want.size :]
        assert (a[:, a[0] > 0] == b[:, b[0] > 0]).all()


def test_edits_encode_little():
    by = token_counts.Counts(PATH, public_tokenizers.PATTERN)
    text = "some words and more " * 2000
    tree, asked = token_counts.build(text, by), by.asked
    token_counts.apply(tree, text, [(20_000, 20_004, "other")], by)
    assert by.asked - asked < 20
    with pytest.raises(ValueError):
        token_counts.apply(tree, text, [(0, 5, ""), (3, 8, "")], by)


def test_registered_counts(spark):
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    import regex

    texts = {r.doc_id: r.text for r in queries.documents(spark, MIDDLE).collect()}
    rows = queries.op10_token_counts(spark, MIDDLE).collect()
    assert sum(r.n_edits for r in rows) > 0
    for r in rows:
        after, n = regex.subn(queries.PERSONAL, "[PII]", texts[r.doc_id])
        assert (r.n_tokens, r.n_edits) == (len(model.encode_ordinary(texts[r.doc_id])), n)
        assert (r.edited_tokens, r.edited_chars) == (len(model.encode_ordinary(after)), len(after))


def test_personal_data_of_long_texts(spark):
    from pyspark.sql import functions as F

    from lectern.llm import secrets

    texts = ["a@b" + ".c" * 100_000, "x a@b.c.d, 123-456", "a@" * 100_000, "a@b" + ".c-" * 50_000 + "@"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(secrets.spans(F.col("t"), queries.PERSONAL, 0).alias("s")).collect()
    assert [[(s.start, s.end) for s in r.s] for r in got] == [[(0, 200_003)], [(2, 9)], [], [(0, 100_000 + 50_003)]]


def test_counts_of_odd_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    edits = F.expr("""CASE doc_id WHEN 1 THEN array(named_struct('start', 0, 'end', 3, 'new', 'ten'))
        WHEN 7 THEN array(named_struct('start', 0, 'end', 3, 'new', 'x'), named_struct('start', 2, 'end', 4, 'new', 'y'))
        WHEN 10 THEN array(named_struct('start', 5, 'end', 500, 'new', 'x')) END""")
    trees = token_counts.kept_trees(odd(spark), PATH, public_tokenizers.PATTERN, folder=str(tmp_path / "trees"))
    got = token_counts.recounted(trees.withColumn("edits", edits), PATH, public_tokenizers.PATTERN).collect()
    by = token_counts.counts(PATH, public_tokenizers.PATTERN)
    assert len(got) == len(ODD) and sum(r.n_edits for r in got) == 1
    assert {r.doc_id: r.refused for r in got if r.refused} == {7: 2, 10: 1}
    for r in got:
        new = token_counts.build(r.text, by)
        assert token_counts.pack(new) == bytes(r.leaves) and new.tokens == r.edited_tokens and new.length == r.edited_chars
    assert token_counts.kept_trees(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_kept_trees_are_edited_again(spark):
    """Two rounds of edits by the kept tables equal new trees of the edited texts, and encode little."""
    from pyspark.sql import functions as F

    docs = queries.documents(spark, SMALL)
    trees, by = token_counts.kept_trees(docs, PATH, public_tokenizers.PATTERN), token_counts.counts(PATH, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for at, new in ((3, " been"), (1, "1st")):
        edits = F.when(F.length("text") >= at + 2, F.array(F.struct(F.lit(at).alias("start"), F.lit(at + 2).alias("end"), F.lit(new).alias("new"))))
        out = token_counts.recounted(trees.withColumn("edits", edits), PATH, public_tokenizers.PATTERN)
        rows = out.collect()
        texts = {i: t[:at] + new + t[at + 2 :] if len(t) >= at + 2 else t for i, t in texts.items()}
        for r in rows:
            tree = token_counts.build(texts[r.doc_id], by)
            assert r.text == texts[r.doc_id] and bytes(r.leaves) == token_counts.pack(tree) and r.edited_tokens == tree.tokens
        assert max(r.recounted_pretokens for r in rows) < 60
        trees = out.select("doc_id", "text", "leaves")


def test_peaks_and_pairs_against_plain_loops():
    """Fourier sums bin by bin, neighbours one by one."""
    rnd = np.random.default_rng(3)
    signal = rnd.integers(0, 256, media.UNIT * 4, dtype=np.uint8)
    starts = range(0, len(signal) - media.FRAME + 1, media.HOP)
    n, turn = np.arange(media.FRAME), -2j * np.pi / media.FRAME
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * n / (media.FRAME - 1))
    size = [[abs(((signal[s : s + media.FRAME].astype(float) - 128) * hann * np.exp(turn * k * n)).sum()) for k in range(1, media.FRAME // 2 + 1)] for s in starts]
    want = []
    for t, row in enumerate(size):
        for k in range(1, len(row) - 1):
            x = row[k]
            if x > row[k - 1] and x > row[k + 1] and x > sum(row) / len(row) and all(x >= size[u][k] for u in (t - 1, t + 1) if 0 <= u < len(size)):
                want.append((t, k + 1))
    times, bins = media.peaks(signal.tobytes())
    assert list(zip(times.tolist(), bins.tolist())) == want and len(want) > 20
    found = []
    for i, (t, b) in enumerate(want):
        for u, c in want[i + 1 : i + 1 + media.FAN_OUT]:
            if u - t <= media.REACH:
                found.append((t, b << 16 | c << 8 | u - t))
    at, code = media.pairs(times, bins)
    assert list(zip(at.tolist(), code.tolist())) == sorted(found)


def test_likelihood_against_plain_sums():
    rnd = np.random.default_rng(1)
    linear, level, thresholds = rnd.normal(size=12), rnd.integers(0, 4, 12), np.array([-1.0, 0.2, 1.5])

    def loss(x, t):
        total = 0.0
        for v, g in zip(x, level):
            up = 1 / (1 + np.exp(v - t[g])) if g < 3 else 1.0
            low = 1 / (1 + np.exp(v - t[g - 1])) if g > 0 else 0.0
            total -= np.log(up - low)
        return total / len(x)

    value, d_linear, d_thresholds = quality.likelihood(linear, level, thresholds)
    assert abs(value - loss(linear, thresholds)) < 1e-9
    for grad, vary in ((d_linear, lambda e: loss(linear + e, thresholds)), (d_thresholds, lambda e: loss(linear, thresholds + e))):
        for i in range(len(grad)):
            e = np.zeros(len(grad))
            e[i] = 1e-6
            assert abs((vary(e) - vary(-e)) / 2e-6 - grad[i]) < 1e-6


def test_ratings_have_three_grades(spark):
    rows = [(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, None), (6, None, 1)]
    got = quality.ratings(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id: r.rating for r in got} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: None}
    model = quality.train(queries.documents(spark, MIDDLE), quality.ratings(spark.read.parquet(f"{MIDDLE}/labels.parquet")))
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]


def test_whole_words_have_features():
    long = "a" * 100
    assert quality.shape("aB1" * 9) == "a0" * 9
    assert quality.Reader().word(long + "x")[0] != quality.Reader().word(long + "y")[0]


def test_scoring_holds_one_table_of_gates(spark):
    net, letters = toxicity.Network(), lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    scorer = toxicity.Scorer(net)
    gates, texts = scorer.gates, [" ".join(letters(i * 100 + j) for j in range(100)) for i in range(2 * toxicity.SLICE)]
    want = scorer.score(texts)
    assert scorer.gates is gates and len(scorer.index) > 1024
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-6) and got[len(texts)] == pytest.approx(scorer.score([None])[0])


def test_grams_of_all_words_at_once():
    import zlib

    import numpy as np

    from lectern.llm import toxicity

    words = [b"a", b"ab", b"abc", "é".encode(), b"word", "größe".encode(), b"0", b"it's", b"x" * 32, "日本語の文".encode(), b"last"]
    want = []
    for w in words:
        s = f"^{w.decode()}$"
        want.append([zlib.crc32(s[i : i + k].encode()) % toxicity.GRAMS for k in (3, 5) for i in range(max(0, len(s) - k + 1))])
    for some in (range(len(words)), [0], [3], [1, 2], [3, 5]):
        of_word, grams, begins = toxicity.features([words[i] for i in some])
        assert of_word.tolist() == [zlib.crc32(words[i]) % toxicity.WORDS for i in some]
        assert [x.tolist() for x in np.split(grams, begins[1:])] == [want[i] for i in some]
        assert grams.dtype == np.int32
    assert [len(x) for x in toxicity.features([])] == [0, 0, 0]
