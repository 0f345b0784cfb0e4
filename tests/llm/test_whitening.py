import numpy as np
import pytest

from tallow.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, x int, component string, id string"


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(*r, "n", 1, "c", "i") for r in rows], SCHEMA).repartition(parts)
    return whitening.whiten(df, **options).collect()


def check(rows, got, components=16, scale=64, shift=1_000_000):
    """Against the covariance's eigenvectors, which the operator doesn't form."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in ok)
    x = [tuple(int(np.floor(scale * c + shift)) for c in v) + (shift,) * (width - len(v)) for _, v in ok]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit], object)
    cov = (exact.T @ exact).astype(float) / float(n) ** 3
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(components, int((e > e[0] * 1e-12).sum()))
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]  # those beyond a bigint are null
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x]) @ (vectors[:, :k] / np.sqrt(e[:k]))
    want = {}
    for (i, _), d, row in zip(ok, deviation, y, strict=True):
        want.setdefault((i, d if d < 2**63 else None), []).append(row)
    assert len(got) == k * len(ok) and {r.n for r in got} <= {n} and len({r.identity_error for r in got}) <= 1
    sign = np.ones(k)
    for r in got:
        c = r.component - 1
        own = want[r.vec_id, r.deviation][0][c]
        if abs(own) > 1e-3:
            sign[c] = np.sign(own * r.whitened)
    for r in got:
        c = r.component - 1
        assert any(abs(sign[c] * r.whitened - row[c]) < 1e-6 for row in want[r.vec_id, r.deviation])
        assert abs(r.explained / (e[c] / e.sum()) - 1) < 1e-6 and r.identity_error < 1e-6


@pytest.mark.parametrize("parts", [1, 9])
def test_matches_eigenvectors(spark, parts):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(20, 20)) * np.linspace(4, 0.5, 20)
    rows = [(k, (rng.normal(size=20) @ mix).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(150)]  # copies weigh once
    check(rows, run(spark, rows, parts, fan=2))


def test_small_eigenvalues_keep_their_digits(spark):
    """Spreads of 1 to 1e-5 around a large mean: squares of the data would lose the small ones."""
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=4) * [1e6, 1e4, 1e2, 10] + 1e7).tolist()) for k in range(200)]
    check(rows, run(spark, rows))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [3.0]), (None, [4.0, -1.0]), (6, []), (7, [-2.0, 9.0]), (8, [0.5, 0.5])]
    check(rows, run(spark, rows))
    assert run(spark, []) == run(spark, [(1, None)]) == run(spark, [(1, []), (2, [])]) == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # no spread in any direction


def test_fewer_directions_than_dimensions(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [a := float(rng.integers(-50, 50)), 2 * a, b := float(rng.integers(-50, 50)), a + b, 1.0]) for k in range(100)]
    got = run(spark, rows)
    assert {r.component for r in got} == {1, 2} and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-9


def test_exact_deviations_beyond_doubles():
    x, n = np.array([[2**40, -(2**41)], [5, 7]]), 1000
    sums = [123456789012345, -98765432109876]
    assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert np.allclose(whitening.centred(x, n, sums), [[int(c) - s / n for c, s in zip(v, sums, strict=True)] for v in x])


def test_merging_factors_in_any_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 6))
    whole = whitening._triangle([x])
    halves = whitening._triangle([whitening._triangle([x[:20]]), whitening._triangle([x[20:23]]), whitening._triangle([x[23:]])])
    assert np.allclose(whole.T @ whole, halves.T @ halves)
