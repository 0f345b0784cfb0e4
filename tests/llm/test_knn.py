import numpy as np
import pytest

from tallow.llm import knn
from tallow.llm.knn import top_k


def brute(rows, every, k):
    ok = {i: np.floor(64 * np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for i, q in ok.items():
        if i % every == 0:
            n = max(len(v) for v in ok.values())
            pad = lambda v: np.pad(v, (0, n - len(v)))
            best = sorted(((-int(pad(q) @ pad(v)), j) for j, v in ok.items() if j != i))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, ids string, score long")
    return {tuple(r) for r in top_k(df, **options).select("query_id", "rank", "vec_id", "score").collect()}


@pytest.mark.parametrize("pivots", [1, 8, None])
def test_matches_brute_force(spark, pivots):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(k, (centres[k % 6] + rng.normal(size=8) * 0.1).astype(np.float32).tolist()) for k in range(400)]
    rows += [(1000 + k, [0.5] * 8) for k in range(60)]  # ties
    rows += [(2000, None), (2020, [1.0, None] + [0.0] * 6), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (2080, []), (2100, [1.0, 2.0]), (None, [1.0] * 8), (2120, [-3.0] * 8)]
    assert run(spark, rows, every=20, k=20, pivots=pivots, query_rows=4, data_rows=64) == brute(rows, 20, 20)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    assert run(spark, rows) == {(0, 1, 1, 0)}
    assert run(spark, [(1, [1.0])]) == set() and run(spark, []) == set()
    assert run(spark, [(0, [1.0]), (0, [1.0]), (2, [2.0])]) == {(0, 1, 2, 64 * 128), (0, 2, 0, 64 * 64)}


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e7, 3.0e7]), (1, [3.0e7, -3.0e7 + 2]), (2, [3.0e7, 2.9e7])]
    assert run(spark, rows) == brute(rows, 20, 20)
    rows = [(0, [1.0, 0.0]), (1, [4.0e7, 0.0]), (2, [1.0, 1.0]), (3, [-3.0e38, 2.0]), (20, [3.0e38, -3.0e38])]
    got = run(spark, rows)
    assert {(q, r): (v, s) for q, r, v, s in got}[0, 2] == (1, 64 * 64 * 40_000_000) and {v for q, _, v, _ in got if q == 20} == {0, 1, 2, 3}
    exact = brute(rows, 20, 20)
    assert {(q, r, v) for q, r, v, _ in got} == {(q, r, v) for q, r, v, _ in exact}


def test_several_rows_of_one_id(spark):
    """Each row is a candidate, also for another row of its id, and each query has its own rows."""
    rows = [(0, [1.0]), (5, [3.0]), (5, [2.0]), (5, [2.0]), (0, [1.5])]
    scores = lambda q, others: [(r + 1, i, s) for r, (s, i) in enumerate(sorted(((int(64 * q * 64 * v), i) for i, v in others), key=lambda x: (-x[0], x[1])))]
    frame = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<float>")
    want = sorted(scores(1.0, [(5, 3.0), (5, 2.0), (5, 2.0), (0, 1.5)]) + scores(1.5, [(5, 3.0), (5, 2.0), (5, 2.0), (0, 1.0)]))
    for order in (rows, rows[::-1]):
        got = top_k(frame(order)).collect()
        assert sorted((r["rank"], r.vec_id, r.score) for r in got) == want and {r.query_id for r in got} == {0}
    same = top_k(frame([(20, [1.0])] * 3), k=1).collect()
    assert [tuple(r) for r in same] == [(20, 1, 20, 4096)] * 3


def test_clusters_are_pruned():
    """Rows of far clusters are not sent to a group: the plan of well separated clusters needs a part of the rows only."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 500
    x = np.floor(np.repeat(centres, 50, 0) + rng.normal(size=(1000, 16)))
    x /= np.sqrt((x**2).sum(1))[:, None] / 5000
    most = float((x**2).sum(1).max())
    p = knn._lifted(x[::50], most)
    d = knn._distances(knn._lifted(x, most), p)
    cell, near = d.argmin(1), d.min(1)
    cells = {c: ((cell == c).sum(), near[cell == c].min(), near[cell == c].max()) for c in np.unique(cell)}
    smallest = {c: np.sort(near[cell == c])[:21] for c in cells}
    q = knn._distances(np.column_stack([x, np.zeros(len(x))]), p)
    asked = {c: ((q.argmin(1) == c).sum(), q.min(1)[q.argmin(1) == c].max()) for c in np.unique(q.argmin(1))}
    plan = knn.Plan(p, most, 20, cells, smallest, asked, 20)
    assert sum(plan.rows.values()) <= 1000 * len(plan.members) and plan.asked and sum(plan.asked.values()) == 1000
