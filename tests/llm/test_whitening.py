"""Whitening: exact sums of products, components and whitened values against plain arithmetic."""

import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwise.llm import whitening


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 150), st.sampled_from([1, 300, 2**20, 2**40]), st.randoms())
def test_scatter_is_exact(width, rows, spread, rng):
    x = np.array([[rng.randint(-spread, spread) for _ in range(width)] for _ in range(rows)], np.int64)
    sums, products = whitening.scatter(x)
    plain = x.astype(object)
    assert list(sums) == list(plain.sum(axis=0))
    expected = plain.T @ plain
    assert all(products[i, j] == expected[i, j] for i in range(width) for j in range(i, width))


def plain_x(vector):
    return [int(np.floor(64 * float(c))) + 1_000_000 for c in vector]


SCHEMA = "vec_id long, embedding array<float>, label int, n string, c0 int"


def vectors_of(rng, n, width):
    mixing = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(width)]
    for k in range(n):
        z = [rng.gauss(0, 1 / (d + 1)) for d in range(width)]
        yield k, [float(np.float32(sum(a * b for a, b in zip(z, row)))) for row in mixing]


def test_against_plain_arithmetic(spark):
    rng = random.Random(3)
    rows = [(k, v, 0, "x", 1) for k, v in vectors_of(rng, 700, 40)]
    rows += [(7, rows[7][1], 1, None, None), (None, rows[9][1], 1, None, None)]
    bad = [(2000, None), (2001, [None] * 40), (2002, [float("nan")] * 40), (2003, [float("inf")] + [0.0] * 39), (2004, []), (2005, [1.0, 2.0]), (2006, [1e30] * 40)]
    data = spark.createDataFrame(rows + [(k, v, 0, None, None) for k, v in bad], SCHEMA).repartition(5)
    got = whitening.whiten(data).collect()
    x = np.array([plain_x(v) for _, v, *_ in rows], object)
    n, sums = len(x), x.sum(axis=0)
    exact = [[Fraction(int((n * (x[:, i] * x[:, j]).sum() - sums[i] * sums[j])), n * n) for j in range(40)] for i in range(40)]
    covariance = np.array([[float(v) for v in row] for row in exact])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    assert len(got) == n * 32
    assert {r.vec_id for r in got} == {k for k, *_ in rows}
    assert {r.n for r in got} == {n}
    centred = (x - np.array([Fraction(int(s), n) for s in sums], object)).astype(float)
    expected = centred @ axes / np.sqrt(values)
    deviation = {k: int(((n * x[r] - sums) ** 2).sum()) for r, (k, *_) in enumerate(rows)}
    whitened = {}
    for r in got:
        whitened.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r.whitened)
        assert r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-9)
    signs = [np.sign(whitened[0][k + 1][0] * expected[0][k]) for k in range(32)]
    for row, (vec_id, *_) in enumerate(rows):
        for k in range(32):
            assert all(v == pytest.approx(signs[k] * expected[row][k], abs=1e-6) for v in whitened[vec_id][k + 1])
    assert len(whitened[7][1]) == 2
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-4


def test_chunks_do_not_change_the_result(spark, monkeypatch):
    rows = [(k, v, 0, "x", 1) for k, v in vectors_of(random.Random(5), 300, 6)]
    data = spark.createDataFrame(rows, SCHEMA)
    whole = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(data.coalesce(1)).collect()}
    monkeypatch.setattr(whitening, "CHUNK_ROWS", 64)
    parts = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(data.repartition(7)).collect()}
    assert whole == parts and len(whole) == 300 * 6


def test_defined_cases(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, None, None), (2, [], 0, None, None)], SCHEMA)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(k, [0.5, 0.25], 0, None, None) for k in range(3)], SCHEMA)).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in same} == {(None, 0.0, 0.0, 0)}
    # Two vectors have one direction.
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0, 0.0], 0, None, None), (2, [1.0, 1.0, 0.0], 0, None, None)], SCHEMA)).collect()
    assert [(r.component, abs(r.whitened or 0)) for r in two if r.vec_id == 2] == [(1, pytest.approx(1)), (2, 0), (3, 0)]
    assert all(r.explained == pytest.approx(1) for r in two if r.component == 1)
    far = whitening.whiten(spark.createDataFrame([(1, [2.0**50]), (2, [0.0])], "vec_id int, embedding array<double>")).collect()
    assert all(r.deviation is None and abs(r.whitened) == pytest.approx(1) for r in far)


def test_ties_of_the_width(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0]), (4, [2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {1, 2}
