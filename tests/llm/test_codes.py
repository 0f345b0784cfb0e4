import hashlib
from collections import Counter

import numpy as np
import pytest

from tallow.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string, x int, error string"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """Lloyd's rounds over Python's integers, all sums anew."""
    ok = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max([1, *(len(v) for _, v, _ in ok)]) // parts)
    x = [[int(np.floor(scale * float(np.float32(c)))) for c in v] + [0] * (parts * width - len(v)) for _, v, _ in ok]
    x = [[min(max(c, -(2**31)), 2**31 - 1) for c in v] for v in x]
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    order = sorted(range(len(ok)), key=lambda k: (ok[k][0] is not None, ok[k][0], np.array(x[k], np.int32).tobytes()))[:entries]
    books = [[cut(x[k], p) for k in order] for p in range(parts)]
    d = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    best = lambda v, p: min(range(len(books[p])), key=lambda e: (d(v, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [(best(cut(v, p), p), cut(v, p)) for v in x]
            n = Counter(e for e, _ in own)
            books[p] = [tuple(sum(c[j] for f, c in own if f == e) // n[e] for j in range(width)) if n[e] else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for (i, _, label), v in zip(ok, x, strict=True):
        e = [best(cut(v, p), p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k in e), sum(d(cut(v, p), books[p][k]) for p, k in enumerate(e)), label))
    total = Counter()
    for _, _, error, label in out:
        total[label] += error
    return sorted(((i, code, min(e, 2**63 - 1), min(total[label], 2**63 - 1), digest) for i, code, e, label in out), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "i", "c", 1, "e") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in codes.compress(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 64)) / 8
    rows = [(k * 7 % 1000, (centres[k % 9] + rng.normal(size=64) / 30).tolist(), [0, 1, None][k % 3]) for k in range(300)]
    rows += [(5000 + k, [0.25] * 64, 1) for k in range(200)]  # copies
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, most=0) == brute(rows)  # sums by label in a join


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_rounds_and_entries(spark, rounds):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=6).tolist(), k % 2) for k in range(80)]
    assert run(spark, rows, parts=3, entries=5, rounds=rounds, scale=16) == brute(rows, 3, 5, rounds, 16)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [], 0), (6, [1.0, -2.0], 0), (6, [1.0, -2.0], 1), (6, [3.0] * 17, None), (None, [1.0], None), (7, [-0.001] * 3, 0)]
    assert run(spark, rows) == brute(rows)
    large = [(k, [3.0e38 * (-1) ** k, float(k), 8.0e6, -8.0e6], 0) for k in range(70)]
    assert run(spark, large, parts=2) == brute(large, 2)
    assert run(spark, []) == run(spark, [(1, None, 0)]) == []


def test_ties_go_to_the_lower_index():
    x = np.array([[0, 0], [1, 1], [2, 2]])
    entries = np.array([[1, 0], [0, 1], [2, 2], [2, 2]])
    assert codes.nearest(x, entries)[0].tolist() == [0, 0, 2]
    assert codes.nearest(x * 2**30, entries * 2**30)[0].tolist() == [0, 0, 2] and codes.nearest(x * 2**30, entries * 2**30)[1].tolist() == [2**60, 2**60, 0]


def test_only_changed_parts_are_shuffled(spark):
    """A task's rows give the sums of what changed; rows whose assignment stays give nothing."""
    import pyarrow as pa

    x = np.array([[1, 2, 3, 4], [5, 6, 7, 8]], np.int32)
    batch = lambda old, new: pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x]), pa.array(old, pa.binary()), pa.array(new, pa.binary())], ["x", "previous", "code"])
    rows = lambda b: sorted(zip(*(c.to_pylist() for c in b.columns), strict=True))
    (out,) = codes._deltas(2, 3, 2)(iter([batch([b"\x00\x01", b"\x02\x02"], [b"\x00\x02", b"\x02\x02"])]))
    assert rows(out) == [(1, 1, -1, -1), (1, 1, 0, -3), (1, 1, 1, -4), (1, 2, -1, 1), (1, 2, 0, 3), (1, 2, 1, 4)]
    (out,) = codes._deltas(2, 3, 2)(iter([batch([None, b"\x00\x00"], [b"\x00\x00", b"\x00\x00"])]))
    assert rows(out) == [(0, 0, -1, 1), (0, 0, 0, 1), (0, 0, 1, 2), (1, 0, -1, 1), (1, 0, 0, 3), (1, 0, 1, 4)]
