from __future__ import annotations

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import tables, whitening


def brute(rows, components=4):
    """Kept rows, n, exact sums, eigenvalues and vectors by a general solver, exact covariance."""
    good = lambda v: v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)
    kept = [(i, [math.floor(256 * float(c)) + 0 for c in v]) for i, v in rows if good(v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    # n * n * V in whole numbers, centred before multiplying.
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], dtype=object)
    products = centred.T @ centred
    v = np.array([[float(Fraction(int(p), n**3)) for p in row] for row in products])
    return kept, n, sums, v


def check(rows, got, components=4):
    kept, n, sums, v = brute(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    many = min(components, len(v))
    assert Counter((i, c) for i, _ in kept for c in range(1, many + 1)) == Counter((r["vec_id"], r["component"]) for r in got)
    want = {}
    for i, x in kept:
        y = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)])
        for c in range(many):
            project = float(y @ vectors[:, c] / math.sqrt(values[c])) if values[c] > 1e-9 else None
            want.setdefault((i, c + 1), []).append((sum((n * e - s) ** 2 for e, s in zip(x, sums)), project))
    signs = {}
    for r in got:
        assert r["n"] == n
        options = [p for d, p in want[(r["vec_id"], r["component"])] if d == r["deviation"] or (r["deviation"] is None and d >= 1 << 63)]
        assert options
        if r["whitened"] is None:
            assert None in options
            continue
        near = [p for p in options if p is not None and abs(abs(p) - abs(r["whitened"])) < 1e-6 * max(1, abs(p))]
        assert near
        if abs(near[0]) > 1e-3:
            assert signs.setdefault(r["component"], r["whitened"] > 0 == near[0] > 0) is not None
            sign = math.copysign(1, r["whitened"] * near[0])
            assert signs.setdefault(("sign", r["component"]), sign) == sign or len({abs(p) for p in options}) > 1
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-9)
    return n


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in tables.read(spark, sf_dir, "embeddings").collect()]
    got = whitening.op12(spark, sf_dir).collect()
    assert check(rows, got) == len({tuple(math.floor(256 * c) for c in v) for _, v in rows})
    assert {r["identity_error"] < 1e-10 for r in got} == {True} and len({r["identity_error"] for r in got}) == 1


def test_whitened_fit_list_has_unit_covariance(spark):
    """From the rows alone, each distinct vector once."""
    vectors = tables.read(spark, "/root/testdata/sf0.01", "embeddings")
    got = whitening.whiten(vectors, whitening.fit(vectors)).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    x = {r["vec_id"]: tuple(math.floor(256 * c) for c in r["embedding"]) for r in vectors.collect()}
    once = {v: i for i, v in x.items()}
    m = np.array([[by[i][c] for c in (1, 2, 3, 4)] for i in once.values()])
    m = m - m.mean(axis=0)
    assert np.abs(m.T @ m / len(m) - np.eye(4)).max() < 1e-9


NAN, INF = float("nan"), float("inf")
SHAPE = "vec_id long, embedding array<float>, component int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SHAPE).repartition(3)


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(3, 2, 5)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(50)] + [(None, rows[1][1]), (5, rows[2][1]), (5, rows[2][1]), (7, [-0.0, 0.0, -1e-9, 1e-9, 0.5])]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [NAN] * 5), (204, [1.0, INF, 1.0, 1.0, 1.0]), (205, [-INF] * 5)]
    df = frame(spark, rows + bad + [(206, [1.0, 2.0])])
    got = whitening.whiten(df, whitening.fit(df)).collect()
    check(rows + bad, got)
    assert all(r["identity_error"] < 1e-9 for r in got)
    for gone in ([], bad):
        nothing = frame(spark, gone)
        assert whitening.whiten(nothing, whitening.fit(nothing)).count() == 0


def test_components_without_spread(spark):
    """Fewer dimensions than components, constant ones, and a single distinct vector."""
    for rows in ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(i, [float(i), 7.0]) for i in range(9)], [(i, [float(i)]) for i in range(5)]):
        df = frame(spark, rows)
        got = whitening.whiten(df, whitening.fit(df)).collect()
        kept, n, sums, v = brute(rows)
        flat = {r["component"] for r in got if r["whitened"] is None}
        assert len(got) == len(rows) * len(v) and len(flat) == sum(np.linalg.eigvalsh(v) < 1e-9)


def test_far_from_zero_and_beyond_63_bits(spark):
    """A mean far larger than the spread, and numbers whose squares need more bits than a long has."""
    rng = np.random.default_rng(2)
    rows = [(i, [1e6 + float(c) for c in rng.integers(0, 50, 3)]) for i in range(40)]
    df = frame(spark, rows)
    check(rows, whitening.whiten(df, whitening.fit(df)).collect())
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, 1e9, 3)]) for i in range(40)]
    df = frame(spark, rows)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    check(rows, got)
    assert any(r["deviation"] is None for r in got)


@pytest.mark.parametrize("kind", ["full", "singular", "scalar", "two", "graded"])
@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_spectrum(size, kind):
    rng = np.random.default_rng(size)
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = {
        "full": rng.random(size) * 10, "singular": np.where(np.arange(size) < size // 2, 1.0 + np.arange(size), 0.0), "scalar": np.full(size, 3.0),
        "two": np.where(np.arange(size) < size // 2, 1.0, 5.0), "graded": 10.0 ** -np.arange(size),
    }[kind]
    a = turn @ np.diag(values) @ turn.T
    a = (a + a.T) / 2
    got, q = whitening.spectrum(a)
    scale = max(1e-300, np.linalg.norm(a))
    assert np.abs(got - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * scale
    assert np.linalg.norm(a @ q - q * got) < 1e-13 * scale and np.linalg.norm(q.T @ q - np.eye(size)) < 1e-12
    assert (np.diff(got) <= 1e-13 * scale).all()


def test_polar_factor_is_orthogonal():
    a = np.random.default_rng(3).standard_normal((40, 40))
    a = a + a.T
    u = whitening.polar(a)
    assert np.linalg.norm(u @ u - np.eye(40)) < 1e-12 and np.linalg.norm(u @ a - (u @ a).T) < 1e-11
