import math

import numpy as np
import pytest

from lectern.llm import queries, whitening
from lectern.session import table
from tests.conftest import MIDDLE

SCHEMA = "vec_id long, embedding array<float>, n string, component string, label int"


def rows_of(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "n", "c", 1) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def expected(vectors):
    """n, deviations and, by a dense symmetric eigenproblem, variances, components and trace."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    far = n * x - s
    c = far.astype(np.float64) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, [int((r * r).sum()) for r in far], e[::-1], v[:, ::-1], c


def compare(got, vectors, components=32):
    n, deviations, e, v, c = expected(vectors)
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == n * k
    at = {(r.vec_id, r.component): r for r in got}
    z = np.array([[at[i, j].whitened for j in range(1, k + 1)] for i in range(n)])
    assert [at[i, 1].deviation for i in range(n)] == deviations
    assert {r.n for r in got} == {n}
    assert np.allclose([at[0, j].explained for j in range(1, k + 1)], e[:k] / e.sum(), rtol=1e-9)
    error = np.abs(z.T @ z / n - np.eye(k)).max()
    assert error < 1e-8 and {r.identity_error for r in got} == {got[0].identity_error} and abs(got[0].identity_error - error) < 1e-8
    return z, e, v, c, k


def test_registered_query_against_a_dense_eigenproblem(spark):
    vectors = [r.embedding for r in table(spark, MIDDLE, "embeddings").orderBy("vec_id").collect()]
    z, e, v, c, k = compare(queries.op13_whitening(spark, MIDDLE).collect(), vectors)
    assert k == 32
    want = c @ v[:, :k] / np.sqrt(e[:k])
    signs = np.sign((want * z).sum(0))
    assert np.abs(want * signs - z).max() < 1e-7


def test_equal_variances_are_found_as_often_as_they_occur(spark):
    corners = [[s * (3 if i == j else 0) for i in range(6)] for j in range(6) for s in (1, -1)]
    compare(whitening.whitened(rows_of(spark, corners)).collect(), corners)


@pytest.mark.parametrize("vectors", [[[1, 2, 3]], [[1, 2, 3], [1, 2, 3]]])
def test_no_variance_no_components(spark, vectors):
    assert whitening.whitened(rows_of(spark, vectors)).collect() == []


def test_dependent_dimensions_and_few_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 3)) * [9, 3, 1]
    many = np.round(base * 64) / 64
    vectors = np.concatenate([many, many[:, :1] * 2, np.full((40, 1), 7.0)], axis=1)
    *_, k = compare(whitening.whitened(rows_of(spark, vectors.tolist())).collect(), vectors.tolist())
    assert k == 3
    few = rng.normal(size=(4, 10)).tolist()
    *_, k = compare(whitening.whitened(rows_of(spark, few)).collect(), few)
    assert k == 3


def test_fewer_components_and_spread_variances(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 8)) * 10.0 ** np.arange(4, -4, -1)).tolist()
    n, _, e, *_ = expected(vectors)
    got = whitening.whitened(rows_of(spark, vectors), components=5).collect()
    compare(got, vectors, components=5)


def test_odd_rows(spark):
    good = [[1, 0, 5], [0, 2, 5], [-1, -1, 4], [1, 0, 5], [3, 3, 3]]
    odd = [None, [], [1, None, 2], [float("nan"), 1, 1], [float("inf"), 1, 1], [1, 2], [3e30, 0, 0]]
    df = rows_of(spark, good + odd, [0, 1, 2, None, 1, *range(10, 17)])
    got = whitening.whitened(df).collect()
    assert len(got) == 5 * 3 and {r.n for r in got} == {5}
    _, deviations, e, *_ = expected(good)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviations)
    assert sum(r.vec_id is None for r in got) == 3
    assert whitening.whitened(df.limit(0)).collect() == []
    assert whitening.whitened(df.where("embedding is null")).collect() == []


def test_far_values_and_many_rows_stay_exact(spark):
    far = [[1e14, 1], [-1e14, 2], [3e13, 5]]
    got = whitening.whitened(rows_of(spark, far)).collect()
    _, deviations, *_ = expected(far)
    assert [r.deviation for r in sorted(got, key=lambda r: r.vec_id) if r.component == 1] == [d if d < 1 << 63 else None for d in deviations]


def test_blocks_do_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(100, 5)).tolist()
    df = rows_of(spark, vectors)
    a = {(r.vec_id, r.component): abs(r.whitened) for r in whitening.whitened(df.repartition(7)).collect()}
    monkeypatch.setattr(whitening, "BLOCK", 8)
    b = {(r.vec_id, r.component): abs(r.whitened) for r in whitening.whitened(df.coalesce(1)).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9
