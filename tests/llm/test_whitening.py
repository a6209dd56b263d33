import math
from collections import defaultdict

import numpy as np
import pytest

from tillsight.llm import whitening as wh


def random_symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [3.0],
        [2.0, 1.0],
        [5.0, 5.0, 5.0, 1.0],
        [1.0] * 7,
        list(range(1, 41)),
        [10.0**-k for k in range(12)],
        [0.0] * 10 + [1.0, 2.0, 3.0],
        [1 + 1e-9 * k for k in range(9)],
        [-4.0, -4.0, 0.0, 2.0, 2.0, 9.0],
    ],
)
def test_eigen_equals_the_library(values):
    a = random_symmetric(np.array(values), len(values))
    a = (a + a.T) / 2
    got, vectors = wh.eigen(a)
    scale = np.linalg.norm(a)
    assert np.allclose(got, np.linalg.eigvalsh(a)[::-1], atol=1e-14 * max(1, scale) * len(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)
    assert np.linalg.norm(a @ vectors - vectors * got) <= 1e-13 * max(1, scale) * len(values)
    few, some = wh.eigen(a, 2)
    assert np.allclose(few, got[:2], atol=1e-13 * scale) and some.shape == (len(values), min(2, len(values)))


def test_polar_factor_is_the_sign_of_the_eigenvalues():
    a = random_symmetric(np.array([-3.0, -1e-8, 1e-6, 2.0, 50.0]), 4)
    u = wh.polar_factor(a)
    e, v = np.linalg.eigh(a)
    assert np.allclose(u, (v * np.sign(e)) @ v.T, atol=1e-7)
    assert np.allclose(u @ u, np.eye(5), atol=1e-14)


def plain(rows, most):
    """The contract with numpy's own eigenvectors; deviations in whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    z = np.array([[(n * c - t) / n for c, t in zip(v, s)] for v in x])
    cov = z.T @ z / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return kept, deviation, z @ v / np.sqrt(e), e / np.trace(cov), n


@pytest.mark.parametrize("d,most", [(6, 32), (40, 32), (3, 2)])
def test_whiten_equals_the_definition(spark, d, most):
    rng = np.random.default_rng(d)
    spread = rng.standard_normal((d, d)) * np.linspace(0.2, 3, d)
    rows = [(2**53 + 2 * i + 1, [float(np.float32(c)) for c in rng.standard_normal(d) @ spread]) for i in range(300)]
    rows += [(None, rows[0][1]), (-1, rows[0][1]), (-1, rows[1][1])]
    bad = [(7, None), (8, [None] + [1.0] * (d - 1)), (9, [math.nan] * d), (10, [math.inf] + [0.0] * (d - 1)), (11, [])]
    kept, deviation, white, explained, n = plain(rows + bad, most)
    df = spark.createDataFrame(
        [(*r, 3, "x") for r in rows + bad], "vec_id long, embedding array<float>, n int, whitened string"
    ).repartition(3)
    got = wh.whiten(df, most=most)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    k = min(d, most)
    assert len(got) == len(kept) * k and {r.n for r in got} == {n}
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and 0 <= max(errors) < 1e-9
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id, r.component].append(r)
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
    sign = {}
    for (i, _), dev, w in zip(kept, deviation, white):
        for c in range(1, k + 1):
            own = [r for r in by_id[i, c] if r.deviation == dev]
            assert own
            sign.setdefault(c, np.sign(own[0].whitened * w[c - 1]))
            assert any(abs(sign[c] * r.whitened - w[c - 1]) < 1e-7 for r in own)


def test_other_lengths_constant_entries_and_empty_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    rows = [(f"v{i}", [float(i % 5), 2.0, float(i)]) for i in range(20)] + [("short", [1.0]), ("large", [2.0**50, 1.0, 1.0])]
    got = wh.whiten(make(rows)).collect()
    assert {r.vec_id for r in got} == {f"v{i}" for i in range(20)} and {r.component for r in got} == {1, 2}
    assert wh.whiten(make([("a", [1.0, 2.0])] * 5)).collect() == []
    assert wh.whiten(make([("a", None)])).collect() == [] and wh.whiten(make([])).columns[0] == "vec_id"
