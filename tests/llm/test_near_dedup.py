import random

import numpy as np
import pytest

from tallow.llm.components import connected_components
from tallow.llm.near_dedup import MinHash, Shingler, deduplicated, farthest, forest, links, near_duplicates


def brute(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=5):
    rnd, rows = random.Random(seed), []
    vocab = [f"w{k}" for k in range(300)]
    for base in range(12):
        text = [rnd.choice(vocab) for _ in range(rnd.choice([3, 20, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 8])):
            copy = list(text)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows) * 7 % 101, " ".join(copy)))
    return rows


def boilerplate(n=60, seed=3):
    """Texts that share most of their words (similarity about 0.7), and chains of edits from one end to the other."""
    rnd = random.Random(seed)
    shared = [f"s{k}" for k in range(160)]
    rows = [(2000 + k, " ".join([*shared, *(f"own{k}x{j}" for j in range(30))])) for k in range(n)]
    words = [f"c{k}" for k in range(120)]
    for k in range(n):
        words[rnd.randrange(120)] = f"e{k}"
        rows.append((3000 + rnd.randrange(10**6), " ".join(words)))
    return rows


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_boilerplate_and_chains_match_brute_force(spark, table, block_rows):
    rows = boilerplate()
    got = near_duplicates(table(rows), words=4, percent=80, block_rows=block_rows)
    assert {tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()} == brute(rows, 4, 80)


def test_recall_of_pairs_at_the_threshold():
    """Of pairs at similarity 0.8, 0.85 and 0.9 all share a key and are within the distance but for less than 1 in 1000."""
    minhash, rnd, far = MinHash(8, 5, 1), np.random.default_rng(2), farthest(40, 80)
    for similarity in (0.8, 0.85, 0.9):
        found = 0
        for _ in range(1000):
            both = rnd.integers(0, 1 << 63, int(1000 * similarity), np.uint64)
            own = rnd.integers(0, 1 << 63, 1000 - len(both), np.uint64)
            x = np.stack([minhash.signature(np.concatenate([both, part])) for part in np.array_split(own, 2)])
            found += bool((x[0] != x[1]).sum() <= far and np.intersect1d(*minhash.keys(x)).size)
        assert found >= 999


def test_texts_of_one_id_and_rows_without_an_id(spark, table):
    a, b = "a b c d e f g", "p q r s t u v"
    rows = [(5, a), (5, b), (3, b), (None, a), (None, "x y z w v u t"), (None, "x y z w v u t"), (9, None), (9, None), (7, a), (7, a)]
    got = sorted(((r.doc_id or 0, r.component_id or 0, bool(r.kept)) for r in near_duplicates(table(rows)).collect()))
    assert got == [(0, 0, True), (0, 0, True), (0, 5, False), (3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (7, 5, False), (9, 9, True), (9, 9, True)]
    kept = sorted(((r.doc_id or 0, r.text or "") for r in deduplicated(table(rows)).collect()))
    assert kept == [(0, "x y z w v u t"), (3, b), (5, a), (9, ""), (9, "")]


@pytest.mark.parametrize("block_rows", [1000, 3])
def test_components_match_brute_force(spark, table, block_rows):
    rows = [*corpus(), (900, None), (901, ""), (902, " \t\n "), (903, "One"), (904, "one"), (905, "É"), (906, "é")]
    got = near_duplicates(table(rows), words=4, percent=80, block_rows=block_rows)
    assert {tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()} == brute(rows, 4, 80)


def test_large_group_of_copies_keeps_one_row_each(spark, table):
    rows = [(k, "a b c d e f g h") for k in range(300)]
    got = near_duplicates(table(rows)).collect()
    assert len(got) == 300 and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_empty_table_nulls_and_clashing_names(spark):
    schema = "doc_id long, text string, id long, n long, name string, keys string, cluster int"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f", 9, 9, "x", "y", 1), (None, "a b c d e f", 9, 9, "x", "y", 1), (1, "a b c d e f", 9, 9, "x", "y", 1)]
    got = near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got) == [(False, 1, True), (False, 1, True), (True, 1, False)]
    kept = deduplicated(spark.createDataFrame(rows, schema))
    assert kept.columns == "doc_id text id n name keys cluster".split() and [(r.doc_id, r.n) for r in kept.collect()] == [(1, 9)]


def test_very_long_text(spark, table):
    long = " ".join(f"v{k}" for k in range(200_000))
    got = near_duplicates(table([(1, long), (2, long + " tail"), (3, "short one")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}


def test_pairs_within_the_distance_share_a_key():
    minhash, rnd = MinHash(8, 5, 1), np.random.default_rng(1)
    for _ in range(200):
        a = rnd.integers(0, 1 << 16, 40).astype(np.uint16)
        b = a.copy()
        b[rnd.choice(40, 15, replace=False)] += np.uint16(1)
        assert np.intersect1d(*minhash.keys(np.stack([a, b]))).size
    assert farthest(40, 80) == 20


def test_links_and_forest_are_exact():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4, 5], [1, 2, 3, 4], [9, 10], [1, 2, 3, 4, 5, 6])]
    linked = links(sets, 80, cells=4)
    assert linked[0, 1] and linked[0, 3] and not linked[1, 3] and not linked[0, 2]
    assert sorted(forest(np.array([7, 5, 3, 9]), linked)) == [(7, 5), (9, 5)]


def test_shingles_of_short_texts():
    s = Shingler(4)
    assert len(s("a b")) == 1 and len(s("")) == 0 and len(s(None)) == 0 and len(s("a b c d e")) == 2
    assert (s("A B") == s("a b")).all()


def test_connected_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5000)]
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = {r.id: r.root for r in connected_components(df).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, **{k: 1000 for k in range(1001, 1300)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
