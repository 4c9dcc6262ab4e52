from pyspark.sql import functions as F

from lectern.functions import registry
from lectern.operators import providers


def test_embedder_and_recovery(spark):
    v = providers.hash_embedding("Some words and 文件")
    assert len(v) == providers.DIMENSIONS and abs(sum(x * x for x in v) - 1) < 1e-5
    assert providers.hash_embedding(None) == [0.0] * providers.DIMENSIONS

    def fragile(texts):
        if "bad" in texts:
            raise RuntimeError("provider")
        return [[1.0] for _ in texts]

    made = spark.createDataFrame([(t,) for t in ["a", "b", "bad", "c"]], "text string").coalesce(1)
    assert [r.embedding for r in providers.embedded(made, fragile).collect()] == [[1.0], [1.0], None, [1.0]]


def test_rerank(spark):
    hits = [(1, "red fox", 1, 0, "blue dog", 0.9), (1, "red fox", 2, 0, "a red fox", 0.5), (1, "red fox", 2, 1, "red fox red", 0.4), (1, "red fox", 3, 0, "", 0.3)]
    made = spark.createDataFrame(hits, "query_id int, query string, file_id long, chunk_idx int, text string, score double")
    got = providers.reranked(made, providers.overlap_score).orderBy("rank").collect()
    assert [(r.file_id, r.chunk_idx) for r in got] == [(2, 0), (1, 0), (2, 1), (3, 0)]


def test_boxes_and_tiles(spark):
    lines = [(1, "low", 0.5, 0.0, 0.0, 10.0, 2.0, 1), (1, "high", 0.9, 0.0, 0.0, 10.0, 2.0, 1), (1, "next", 0.8, 0.0, 4.0, 10.0, 2.0, 1)]
    made = spark.createDataFrame(lines, "page_id long, text string, confidence double, x double, y double, w double, h double, source int")
    assert providers.merged_boxes(made).first()["text"] == "high\nnext"
    size = spark.createDataFrame([(1000, 1000), (4000, 2048)], "w int, h int")
    got = [r[0] for r in size.select(providers.tile_plan(F.col("w"), F.col("h"))).collect()]
    assert [len(x) for x in got] == [1, 3] and got[1][-1]["x"] + got[1][-1]["w"] == 4000


def test_sql_functions(spark):
    registry.register(spark)
    got = spark.sql("SELECT round(vec_cosine(array(3D, 4D), array(4D, 3D)), 6) AS c, vec_l2(array(0D), array(2D)) AS l, concept_of('Café-1!') AS t, file_extension('a.TXT') AS e, vec_cosine(array(0D), array(1D)) AS z").first()
    assert tuple(got) == (0.96, 2.0, "café1", "txt", None)


def test_hash_embedding_hashes_a_word_once(monkeypatch):
    import unicodedata

    import numpy as np

    fnv, seen = providers._fnv1a, []
    monkeypatch.setattr(providers, "_fnv1a", lambda token: seen.append(token) or fnv(token))
    texts = ["Again and again, and AGAIN; " * 50 + "x" * 40, "Ｗｉｄｅ ｗords and 文件夹 文件 zü", "!!", "\u0130x 1_2_3 3"]
    for text, got in zip(texts, providers.hash_embedder(texts)):
        want = np.zeros(providers.DIMENSIONS)
        for run in providers._TOKENS.findall(unicodedata.normalize("NFKC", text).lower()):
            for token in [run[i : i + n] for n in (1, 2, 3) for i in range(len(run) - n + 1)] if providers._HAN.match(run) else [run]:
                h = fnv(token)
                want[h % providers.DIMENSIONS] += 1 if h % 2 == 0 else -1
                if len(token) > 3:
                    want[(h >> 9) % providers.DIMENSIONS] += 0.5
        length = np.sqrt(want @ want)
        assert np.array_equal(got, (want / length if length else want).astype(np.float32))
    assert seen.count("again") <= 1 and seen.count("and") <= 1
