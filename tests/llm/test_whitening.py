"""Whitening against big-integer arithmetic and numpy on the whole matrix."""

from __future__ import annotations

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexstrata.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
BIG = st.one_of(st.integers(-(1 << 20), 1 << 20), st.integers(-(1 << 63), (1 << 63) - 1), st.sampled_from([0, 32767, 32768, -32768, -32769, 65536]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(BIG, min_size=3, max_size=3), min_size=1, max_size=20))
def test_digit_products_are_exact(rows):
    x = np.array(rows, dtype=np.int64)
    want = [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
    assert whitening.exact_product(x).tolist() == want
    assert whitening.exact_product(x.astype(object) * 12345678901).tolist() == [[v * 12345678901**2 for v in r] for r in want]
    parts = whitening.limbs(x)
    assert (sum(p.astype(object) * (1 << (16 * k)) for k, p in enumerate([q.astype(np.int64) for q in parts])) == x).all()


def test_integers():
    c = np.array([[0.1, -0.1, 0.0], [1e30, -1e300, 1.0]])
    x = whitening.integers(c)
    assert x[0].tolist() == [math.floor(6.4) + 10**6, math.floor(-6.4) + 10**6, 10**6]
    assert x[1].tolist() == [(1 << 63) - 1, -(1 << 63), 10**6 + 64]


def plain(rows):
    """(vec_id, n, deviation) for each valid row, and the matrix of x."""
    good = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    x = [[math.floor(64 * float(np.float32(e))) + 10**6 for e in v] for _, v in good]
    sums = [sum(c) for c in zip(*x, strict=True)]
    n = len(x)
    return sorted(((i, n, sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))) for (i, _), r in zip(good, x, strict=True)), key=repr), np.array(x, dtype=float)


def data(n, d, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    return [(int(i), [float(np.float32(v)) for v in rng.normal(size=d) @ mix]) for i in range(n)]


def test_equals_whole_matrix(spark):
    rows = data(300, 40)
    bad = [(1000, None), (1001, []), (1002, [None] * 40), (1003, [math.nan] * 40), (1004, [math.inf] + [0.0] * 39), (1005, [1.0])]
    rows += [(None, rows[0][1]), (5, rows[5][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], SCHEMA).withColumn("entries", F.lit(1)).repartition(7)
    out = whitening.whiten(frame).collect()
    want, x = plain(rows)
    assert sorted({(r.vec_id, r.n, r.deviation) for r in out}, key=repr) == sorted(set(want), key=repr)
    assert len(out) == 302 * 32 and {r.component for r in out} == set(range(1, 33))
    assert all(int(r.deviation_exact) == r.deviation for r in out)
    v = np.cov(x.T, bias=True)
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    for r in out:
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-9
    by_id = {}
    for r in out:
        by_id.setdefault(r.vec_id, {})[r.component] = r.whitened
    vectors = np.linalg.eigh(v)[1][:, ::-1]
    for k in (0, 3, 31):
        mine = np.array([by_id[i][k + 1] for i in range(300)])
        theirs = ((x - x.mean(axis=0)) @ vectors[:, k] / math.sqrt(e[k]))[:300]
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8


def test_degenerate_inputs(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0], 0)], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0) for i in range(10)], SCHEMA)).collect()
    assert {(r.component, r.whitened == 0.0) for r in flat if r.vec_id != 4 and r.vec_id != 5} == {(1, False), (2, True), (3, True)}
    assert {r.identity_error < 1e-9 for r in flat} == {True}


def test_huge_entries_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1e16, -3e17, 1.0, 3e38]), float(i)]) for i in range(20)]
    out = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    x = [[int(a) for a in whitening.integers(np.array([[float(np.float32(e)) for e in v]]))[0]] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((20 * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for (i, _), r in zip(rows, x, strict=True)}
    assert {r.vec_id: int(r.deviation_exact) for r in out} == want
    assert all(r.deviation is None for r in out)
    assert all(r.identity_error < 1e-4 for r in out)


def test_deviation_paths_agree():
    """The three ways to square deviations: in 64 bits, by parts, and in big integers."""
    rng = np.random.default_rng(3)
    x = rng.integers(10**6 - 30, 10**6 + 30, size=(50, 8))
    for n in (50, 10**7, 10**13):
        sums = tuple(int(s) * (n // 50) + k for k, s in enumerate(x.sum(axis=0)))
        model = whitening.Model(n, sums, np.eye(8), np.ones(8), np.ones(8))
        _, got = whitening.projector(model)(x)
        assert [int(v) for v in got] == [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x.tolist()]
