import math
import re
import zlib
from collections import Counter

import numpy as np

from tallow.llm import toxicity


def labelled(spark, n=400):
    docs, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        words = [f"word{(k * 7 + j) % 150}" for j in range(40)] + (["idiotname", "scumword"] if bad else [])
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_separate_held_out_documents(spark, table):
    docs, labels = labelled(spark)
    docs += [(1000, None), (1001, ""), (1002, "scumword idiotname"), (None, "scumword idiotname")]
    got = toxicity.toxicity(table(docs), labels).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            if r.doc_id < 400:
                assert r.predicted == int(r.doc_id % 5 == 0)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score < 0.3 <= by[1002].score


def test_held_out_labels_are_not_used(spark, table):
    docs, labels = labelled(spark)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end toxic")
    assert toxicity.train(table(docs), labels) == toxicity.train(table(docs), flipped)


def slow_train(docs, labels, fairness=1.0, l2=1e-4, steps=400):
    """The fit by its definition: a dense matrix of all features, swapped sentences one by one."""
    rows = sorted((k, t) for k, t in docs if k in labels and zlib.crc32(str(k).encode()) % 4 != 2)
    words = [toxicity.featured(set(re.findall(r"\w+", (t or "").lower()))) for _, t in rows]
    y = np.array([labels[k] for k, _ in rows], float)
    one = Counter(f for fs, label in zip(words, y, strict=True) if label for f in fs)
    n = Counter(f for fs in words for f in fs)

    def low(f):
        p, z2 = one[f] / n[f], 1.96**2
        return (p + z2 / (2 * n[f]) - 1.96 * math.sqrt(p * (1 - p) / n[f] + z2 / (4 * n[f] ** 2))) / (1 + z2 / n[f])

    order = sorted((f for f in one if low(f) >= 0.35), key=lambda f: (-one[f], f))
    positive = [k for k, label in enumerate(y) if label]
    covered, chosen = Counter(), []
    for bar in (0.55, 0.45, 0.35):
        for f in order:
            held = [k for k in positive if f in words[k]]
            if low(f) >= bar and f not in chosen and sum(covered[k] < 12 for k in held) >= min(len(held), max(3, len(positive) // 100)):
                chosen.append(f)
                covered.update(held)
        if sum(covered[k] > 0 for k in positive) >= 0.8 * len(positive):
            break
    x = np.array([[float(f in fs) for f in chosen] for fs in words])
    changes = [c for _, t in rows for c in slow_swaps((t or "").lower())] + [c for g in toxicity.IDENTITY_GROUPS for t in g for c in toxicity.swaps(t, (g,))]
    d = np.array([[float(f in plus) - float(f in minus) for f in chosen] for plus, minus in changes])

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + l2 / 2 * w @ w + fairness * np.mean((d @ w) ** 2)

    def gradient(w, b):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        return np.append(x.T @ error + l2 * w + 2 * fairness * d.T @ (d @ w) / len(d), error.sum())

    at = np.append(np.linspace(-1, 1, len(chosen)), 0.3)
    steps_ = 1e-6 * np.eye(len(at))
    numeric = np.array([(loss((at + e)[:-1], (at + e)[-1]) - loss((at - e)[:-1], (at - e)[-1])) / 2e-6 for e in steps_])
    assert np.abs(numeric - gradient(at[:-1], at[-1])).max() < 1e-6  # the gradient is that of the loss
    w = np.append(np.zeros(len(chosen)), np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        g = gradient(w[:-1], w[-1])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return {f: c for f, c in zip(chosen, w[:-1], strict=True) if abs(c) > 1e-4}, w[-1]


def biased(n=240):
    """Texts in which one of two groups is named in toxic ones mostly, with other toxic words."""
    docs = []
    for k in range(n):
        bad = k % 4 == 0
        name = "muslim" if bad or k % 9 == 0 else "christian"
        docs.append((k, " ".join([f"w{(k * 7 + j) % 60}" for j in range(6)]) + f". A {name} neighbour" + (" vile viler" if bad and k % 8 else "")))
    return docs, {k: int(k % 4 == 0) for k in range(n)}


def test_fit_and_scores_match_brute_force(spark, table):
    docs, labels = biased()
    given = spark.createDataFrame([(k, 1, t) for k, t in labels.items()], "doc_id long, quality int, toxic int")
    for fairness in (0.0, 1.0):
        weights, bias = toxicity.train(table(docs), given, fairness=fairness)
        slow, b = slow_train(docs, labels, fairness)
        assert weights.keys() == slow.keys() and len(weights) > 3
        assert all(abs(weights[f] - slow[f]) < 1e-6 for f in slow) and abs(bias - b) < 1e-6
        got = {r.doc_id: r.score for r in toxicity.score(table(docs), (weights, bias)).collect()}
        for k, text in docs:
            z = b + sum(slow.get(f, 0.0) for f in toxicity.featured(set(re.findall(r"\w+", text.lower()))))
            assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-6


def test_identity_terms_get_one_weight(spark, table):
    docs, labels = biased()
    given = spark.createDataFrame([(k, 1, t) for k, t in labels.items()], "doc_id long, quality int, toxic int")
    weigh = lambda model, word: sum(model[0].get(f, 0.0) for f in toxicity.features(word))
    free = toxicity.train(table(docs), given, fairness=0.0)
    fair = toxicity.train(table(docs), given, fairness=50.0)
    gap = lambda m: abs(weigh(m, "muslim") - weigh(m, "christian"))
    assert gap(fair) <= 0.2 * gap(free) + 1e-6 and gap(free) > 0.5 and weigh(fair, "vile") > 1


def test_repeated_rows_and_long_texts_in_the_sample(spark, table):
    docs, labels = labelled(spark)
    plain = toxicity.train(table(docs), labels)
    again = toxicity.train(table(docs + docs[:50] * 3), labels)
    assert plain == again
    long = [(k, t + "".join(f" x{k}y{j}" for j in range(20_000))) if k < 5 else (k, t) for k, t in docs]
    assert toxicity.train(table(long), labels)[0]


def test_without_labels_and_without_rows(spark, table):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.toxicity(table([(1, "a")]), none).collect()] == [0]
    assert toxicity.toxicity(table([]), none).collect() == []


def test_clean_keeps_all_columns(spark):
    docs, labels = labelled(spark)
    df = spark.createDataFrame([(k, t, "x", k) for k, t in docs], "doc_id long, text string, score string, toxic long")
    got = toxicity.clean(df, labels)
    assert got.columns == df.columns and got.count() == 320 and {r.score for r in got.collect()} == {"x"}


def slow_swaps(text):
    """Swapped sentences by their texts: the sentence with another term in place of each, and its features against the sentence's."""
    out = []
    for sentence in re.split(r"[.!?\n]+", text):
        for group in toxicity.IDENTITY_GROUPS:
            for term in group:
                if re.search(rf"\b{term}\b", sentence):
                    for other in group:
                        if other != term:
                            a, b = (toxicity.featured(set(re.findall(r"\w+", x))) for x in (sentence, re.sub(rf"\b{term}\b", other, sentence)))
                            out.append((tuple(sorted(b - a)), tuple(sorted(a - b))))
    return out


def test_swapped_sentences():
    for text in ("", "no term here", "a muslim and a christian met. women, and women again!", "muslims muslim\nblack", "christian christianity"):
        assert sorted(toxicity.swaps(text, toxicity.IDENTITY_GROUPS)) == sorted(slow_swaps(text))
    assert len(toxicity.swaps("the jewish quarter", toxicity.IDENTITY_GROUPS)) == 5


def test_neutral_mentions_are_not_toxic(spark, table):
    """A planted bias: one group is named in toxic texts mostly.  Without the penalty neutral mentions of it are false positives."""
    docs, labels = [], []
    for k in range(1200):
        bad = k % 4 == 0
        name = "muslim" if (bad and k % 8) or k % 40 == 1 else "christian" if k % 3 == 0 else "people"
        words = [f"word{(k * 7 + j) % 150}" for j in range(20)]
        docs.append((k, " ".join([*words, f". the {name} family", *(["vilename"] if bad and k % 16 < 8 else [])])))
        labels.append((k, 1, int(bad)))
    neutral = [(5000 + k, f"word{k} word{k + 1}. the {term} family met") for k, term in enumerate(["muslim", "christian", "jewish", "hindu"] * 25)]
    frame, given = table(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rate = {}
    for fairness in (0.0, 1.0):
        model = toxicity.train(frame, given, fairness=fairness)
        scored = {r.doc_id: r.score for r in toxicity.score(table([*neutral, (9000, "the muslim family vilename")]), model).collect()}
        rate[fairness] = sum(scored[i] >= 0.3 for i, _ in neutral) / len(neutral)
        assert scored[9000] >= 0.3
    assert rate[0.0] >= 0.25 and rate[1.0] == 0


def test_long_texts_repeats_and_clashing_columns(spark):
    docs, labels = labelled(spark)
    long = "word1 " * 300_000 + "scumword idiotname"
    df = spark.createDataFrame([*((k, t, "x", 1.0, True) for k, t in docs), (900, long, "x", 1.0, True), (900, long, "x", 1.0, True)], "doc_id long, text string, features string, score double, held_out boolean")
    got = toxicity.toxicity(df, labels).filter("doc_id = 900").collect()
    assert [r.predicted for r in got] == [1, 1]
