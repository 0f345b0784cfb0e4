import hashlib

import pytest

from tallow.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * unit >= cap * sizes[s]}
        if not full:
            out |= {s: w[s] * unit for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_taken_and_bounds(spark):
    rows = []
    for k in range(4000):
        source = ["a", "B", "é", None, "tiny"][min(k % 37 % 5, 4)] if k % 3 else "a"
        rows.append((k, "w " * (k * k % 97), source, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        source = rows[r.doc_id][2]
        assert r["size"] == len(rows[r.doc_id][1].split()) and r.taken in (0, r["size"], 2 * r["size"])
        sizes[source] = sizes.get(source, 0) + r["size"]
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
    want = brute_targets(sizes)
    for s in want:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 0.02 * want[s] + 200
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(again, key=lambda r: r.doc_id) == sorted(got, key=lambda r: r.doc_id)


def test_odd_rows(spark, table):
    docs = table([(1, None, "en", "a", None), (2, "", "en", None, 0), (None, "x y", "en", "a", 3), (None, "x y", "en", "a", 3), (4, "z\u00a0z \x0bq", "en", "b", 4)])
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and sorted(r["size"] for r in got) == [0, 0, 2, 2, 2]
    assert mixing.mix(table([])).collect() == []
    assert all(r.taken == 0 for r in mixing.mix(table([(1, None), (2, "")])).collect())


def test_mixed_documents_repeat_whole_rows(spark):
    docs = spark.createDataFrame([(k, "a b c", "en", "abc"[k % 3], 5, k) for k in range(300)], "doc_id long, text string, lang string, source string, n_chars long, copies long")
    counts = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    seen = {}
    for r in out.collect():
        assert r.copies == r.doc_id
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {k: v for k, v in counts.items() if v}


def test_another_document_moves_few_draws(spark, table):
    """With the same rates a document's draw depends on itself alone: only documents between the old and the new threshold change."""
    rows = [(k, "w " * (1 + k % 9), "en", "ab"[k % 2], 1) for k in range(2000)]
    before = {r.doc_id: r.copies for r in mixing.mix(table(rows)).collect()}
    after = {r.doc_id: r.copies for r in mixing.mix(table([*rows, (5000, "w", "en", "a", 1)])).collect()}
    assert sum(before[k] != after[k] for k in before) <= 10


def test_draws_are_hash_seeded_bernoulli(spark, table):
    """Against a brute-force version: u of the id, the threshold with the nearest total, whole copies and one more below it."""
    rows = [(k, "w " * (k * k % 83), "en", "abc"[k % 7 % 3], 1) for k in range(900)]
    got = {r.doc_id: r for r in mixing.mix(table(rows)).collect()}
    step = {k: int(hashlib.md5(f"mix/{k}".encode()).hexdigest()[:8], 16) >> 20 for k, *_ in rows}
    for source in "abc":
        mine = [r[0] for r in rows if r[3] == source]
        size = {k: len(rows[k][1].split()) for k in mine}
        total = sum(size.values())
        rate = got[mine[0]].target / total
        whole, part = int(rate), rate - int(rate)
        bound = min(range(mixing.STEPS + 1), key=lambda b: (abs(sum(size[k] for k in mine if step[k] < b) - part * total), b))
        assert all(got[k].copies == whole + (step[k] < bound) for k in mine)
        assert abs(bound / mixing.STEPS - part) < 0.1  # close to the fraction itself


def test_long_texts_ties_and_clashing_columns(spark):
    rows = [(1, "w " * 300_000, "a", 7, 8), (2, "w " * 300_000, "a", 7, 8), (3, "x", "b", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, step int, copies int")
    assert sorted(r["size"] for r in mixing.mix(docs).collect()) == [1, 300_000, 300_000]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and all(r.step == 7 and r.copies == 8 for r in out.collect())
