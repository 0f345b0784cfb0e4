import math

import numpy as np
import pytest

from tallow.llm import lattice as lat

SCHEMA = "vec_id long, embedding array<float>, label int, c long, ball string, n int, key string, v string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 1, "x", 2, "k", "w")[: len(schema.split(","))] for r in rows], schema)


def brute(rows, limit=0.93):
    """Number of linked rows, and the smallest id reachable, by all pairs."""
    ok = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(rows[k][1]) for k in ok), default=0)
    unit = {}
    for k in ok:
        x = np.pad(np.array(rows[k][1], np.float32).astype(float), (0, width - len(rows[k][1])))
        x = x / np.abs(x).max()
        unit[k] = x / math.sqrt(x @ x)
    near = {k: [m for m in ok if m != k and rows[m][2] == rows[k][2] and unit[k] @ unit[m] >= limit] for k in ok}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in near.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        least = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((i, len(near.get(k, [])), least, None if i is None else i == least))
    return sorted(out, key=str)


def found(spark, rows, **options):
    return sorted((tuple(r) for r in lat.near_vectors(frame(spark, rows), **options).collect()), key=str)


def turned(rng, x, cosine):
    """A unit vector at the cosine of x."""
    z = rng.normal(size=len(x))
    z -= (z @ x) * x
    return cosine * x + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def unit(rng, width=64):
    x = rng.normal(size=width)
    return x / np.linalg.norm(x)


def test_decoding_by_brute_force():
    """No point around is nearer; points are whole or half-whole throughout with an even sum."""
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    p = lat.nearest_point(x)
    own = ((x - p) ** 2).sum(1)
    assert (((x[:, None] - (p[:, None] + lat._ROOTS)) ** 2).sum(2) >= own[:, None] - 1e-9).all() and own.max() <= 1 + 1e-9
    whole = np.abs(p - np.rint(p)).max(1) < 1e-9
    half = np.abs(p - 0.5 - np.rint(p - 0.5)).max(1) < 1e-9
    assert (whole | half).all() and np.allclose(p.sum(1) % 2, 0) and len(lat._ROOTS) == 240 and np.allclose((lat._ROOTS**2).sum(1), 2)


@pytest.mark.parametrize("size", range(len(lat.SIZES)))
def test_recall_at_the_threshold(size):
    """Pairs at exactly the threshold meet in a cell that one of them lives in, with each choice of blocks and tables."""
    rng = np.random.default_rng(3)
    _, blocks, coarse, tables = lat.SIZES[size]
    lattice = lat.Lattice(64, math.acos(0.93), blocks, tables, 8, coarse)
    x = np.array([unit(rng) for _ in range(2000)])
    y = np.array([turned(rng, v, 0.93) for v in x])
    z = np.roll(x, 1, 0)
    label, near, far = np.zeros(len(x), np.int64), np.zeros(len(x), bool), 0
    for t in range(tables):
        a, b, c = (lattice.cells(v, label, t) for v in (x, y, z))
        near |= (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
        far += ((a == c[:, :1]).any(1) | (c == a[:, :1]).any(1)).sum()
    assert near.mean() >= 0.985 and far <= 20


def test_links_match_brute_force(spark):
    """Groups of every density: copies, tight and loose groups, chains, pairs near the threshold, in several labels."""
    rng = np.random.default_rng(5)
    rows, add = [], lambda x, label: rows.append((len(rows) * 3 % 1009, x.astype(np.float32).tolist(), label))
    for g, (cosine, n) in enumerate([(0.999, 60), (0.985, 60), (0.975, 50), (0.965, 40)]):
        centre = unit(rng)
        for _ in range(n):
            add(turned(rng, centre, cosine) * rng.uniform(0.1, 9), g % 2)
    x = unit(rng)
    for _ in range(30):  # a chain
        add(x, 2)
        x = turned(rng, x, 0.95)
    for cosine in (0.9299, 0.9301, 0.94, 0.96):
        x = unit(rng)
        add(x, 3)
        add(turned(rng, x, cosine), 3)
    for _ in range(40):
        add(unit(rng), 4)
    copy = unit(rng)
    for _ in range(25):
        add(copy, 5)
    add(2 * copy, 5)
    add(copy, 6)
    want = brute(rows)
    assert found(spark, rows, block=8) == want  # cells and balls in many blocks
    assert sum(w[1] for w in want) > 10_000


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    a = [1.0, 2.0, 3.0]
    rows = [(1, a, 0), (2, a, None), (3, None, 0), (4, [], 0), (5, [0.0, -0.0, 0.0], 0), (6, [1.0, None, 2.0], 0), (7, [nan, 1.0, 1.0], 0), (8, [inf, 1.0, 1.0], 0), (None, a, 0)]
    rows += [(9, [2.0, 4.0, 6.0], 0), (9, [2.0, 4.0, 6.0], 0), (9, [-1.0, 0.0, 0.0], 0), (10, [3.0e38, 0.0, 0.0], 1), (11, [1.0e-30, 0.0], 1), (12, [1.0, 0.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 0)]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) == len(rows)
    assert found(spark, [(1, None, 0), (2, [0.0], 1)]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert found(spark, []) == []
    assert lat.near_vectors(spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<double>, label long")).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_one_group_of_a_third_of_all_rows(spark):
    """A dense group becomes a few balls: the rows that meet in cells, and their pairs, don't grow with its square."""
    rng = np.random.default_rng(8)
    centre = unit(rng)
    rows = [(k, (turned(rng, centre, 0.997) if k % 3 == 0 else unit(rng)).astype(np.float32).tolist(), 0) for k in range(1800)]
    got = found(spark, rows)
    assert got == brute(rows) and max(r[1] for r in got) == 599


def test_components_of_a_forest():
    i, j = np.array([5, 9, 2, 7]), np.array([2, 5, 1, 8])
    a, b = lat._spanned(i, j)
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {2: 1, 5: 1, 9: 1, 8: 7}
