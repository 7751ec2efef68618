"""Whitening against numpy's eigenvectors of the covariance, and odd tables."""

import math

import numpy as np
import pytest

from narrata.llm import whitening as W
from narrata.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, x string, component string"


def plain(vectors):
    """n, sums, eigenvalues, components of the distinct whole vectors."""
    fit = np.array(sorted({tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors}), float)
    cov = np.cov(fit, rowvar=False, bias=True)
    e, v = np.linalg.eigh(np.atleast_2d(cov))
    return len(fit), fit.sum(axis=0), e[::-1], v[:, ::-1]


def table_of(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v], "s", None) for i, v in enumerate(vectors)], SCHEMA)


def against_plain(spark, vectors, k=4):
    n, sums, e, v = plain(vectors)
    model = W.fit_whitening(table_of(spark, vectors))
    rows = W.whitened(table_of(spark, vectors), model).collect()
    assert model.n == n and list(model.sums) == [int(s) for s in sums]
    assert len(rows) == len(vectors) * k
    by = {}
    for r in rows:
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-8 and r.n == n
        by.setdefault(r.component, {})[r.id] = r
    for c, of in by.items():
        x = np.array([[math.floor(256 * float(np.float32(t))) for t in vec] for vec in vectors])
        want = (x - sums / n) @ v[:, c - 1] / np.sqrt(e[c - 1])
        got = np.array([of[i].whitened for i in range(len(vectors))])
        sign = np.sign(want @ got)
        assert np.allclose(got, sign * want, atol=1e-7)
        assert [of[i].deviation for i in range(len(vectors))] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums, strict=True)) for row in x]


def test_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    against_plain(spark, list(rng.normal(size=(300, 6)) * [3, 2, 1.5, 1, 0.2, 0.1]))


def test_ill_conditioned_and_repeated(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 5)) @ np.diag([1000, 100, 1, 0.5, 0.02]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    against_plain(spark, [*base, *[base[0]] * 100])


def test_constant_and_dependent_dimensions_give_no_component(spark):
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=(100, 2)) * 64) / 16
    vectors = [(x, y, x + y, 1.0) for x, y in a]
    model = W.fit_whitening(table_of(spark, vectors))
    n, _, e, _ = plain(vectors)
    assert model.n == n and len(model.eigenvalues) == 2
    assert np.allclose(model.eigenvalues, e[:2], rtol=1e-10) and model.identity_error < 1e-6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a", "b"), (2, None, None, None), (3, [1.0, None], "a", "b"), (4, [nan, 1.0], "a", "b"), (5, [1.0, -inf], "a", "b"), (6, [], "a", "b"), (7, [1.0, 2.0, 3.0], "a", "b"), (1, [1.0, 2.0], "a", "b"), (None, [3.0, -0.0], "a", "b"), (8, [-0.001, 5.0], "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = W.fit_whitening(df)
    assert model.n == 3 and model.sums == (256 + 768 - 1, 512 + 1280)
    found = W.whitened(df, model).collect()
    assert sorted((r.id is None, r.id or 0, r.component) for r in found) == [(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 8, 1), (False, 8, 2), (True, 0, 1), (True, 0, 2)]


def test_one_vector_and_empty_tables(spark):
    one = table_of(spark, [(1.0, 2.0)] * 3)
    for df, n in ((one, 1), (one.limit(0), 0), (one.selectExpr("vec_id", "cast(array() as array<float>) embedding"), 0)):
        model = W.fit_whitening(df)
        assert model.n == n and W.whitened(df, model).count() == 0


def test_deviations_beyond_long():
    x = np.array([[1 << 40, 0], [3, 4]], np.int64)
    assert W.deviations(x, 1000, (0, 0)) == [None, 25_000_000]


def test_query(spark, sf):
    rows = QUERIES["op13_whitening"](spark, sf).collect()
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()]
    n, _, e, _ = plain(vectors)
    assert len(rows) == 4 * len(vectors) and {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9
    assert {r.component: r.explained for r in rows} == pytest.approx({i + 1: e[i] / e.sum() for i in range(4)}, rel=1e-10)
