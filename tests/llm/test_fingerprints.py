import hashlib

import numpy as np
import pytest

from tallow.llm import fingerprints as fp

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def text(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(rng.integers(0, 50)) for k in rng.integers(0, len(WORDS), n))


def test_equal_substrings_share_interior_names_whatever_the_offset():
    common = text(400, 1)
    for lead in ("", "x", "xy", text(3, 2), "aaaaaaaa"):
        (a,), (b,) = fp.sketches([common, lead + common], kept=100_000)
        assert len(np.intersect1d(a, b)) >= len(a) - 4


def slow_names(text, levels):
    """The names of every level by the definition, one symbol at a time."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    step, symbols, out = 0x9E3779B97F4A7C15, [ord(c) for c in text], []
    for _ in range(levels):
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        labels = [r[0] for r in runs]
        for _ in range(4):
            tossed = []
            for k, x in enumerate(labels):
                differing = x ^ (labels[k - 1] if k else 0)
                bit = (differing & -differing).bit_length() - 1 if differing else 0
                tossed.append(2 * bit + (x >> bit & 1))
            labels = tossed
        phrases = []
        for k, (s, n) in enumerate(runs):
            if not k or (k < len(runs) - 1 and labels[k - 1] < labels[k] > labels[k + 1]):
                phrases.append([])
            phrases[-1].append(mix((s + n * step) & mask))
        symbols = [mix(sum(mix((y + place * step) & mask) for place, y in enumerate(p)) & mask) for p in phrases]
        out.append(symbols)
    return out


def test_names_match_a_slow_parser():
    for t in ["a", "aaaa", "ab" * 40, "é𝄞x" * 5, text(40, 8), text(300, 9), "=" * 500 + "x", "\n\n  \n" * 30]:
        parsed = slow_names(t, 3)
        want = []
        for names in reversed(parsed):
            want.append(sorted({n >> 32 for n in names})[:64])
            if len(want[-1]) >= fp.FEW:
                break
        assert [level.tolist() for level in fp.sketches([t])[0]] == want


def test_short_texts_are_told_apart_by_lower_levels():
    a, b = text(12, 1), text(12, 2)
    edited = a[: len(a) * 3 // 4] + b[: len(a) // 4]
    x, y, z = fp.sketches([a, edited, b])
    assert len(x) > 1 and 0.2 < fp.likeness(x, y) < 1 and fp.likeness(x, z) < fp.likeness(x, y)


def test_rows_of_one_id_are_spread_by_text(spark):
    """Rows without an id share nothing but that; their ranges are cut by the hash of the text."""
    rows = [(None, f"text {k} " * 30) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fp.fingerprint_documents(docs, range_bytes=4096)
    assert out.rdd.getNumPartitions() > 10 and out.count() == 400


def test_texts_taken_together_or_alone_get_the_same_names():
    texts = ["", "a", "aaaa", "ab", text(50, 3), "é" * 70_000, text(2000, 4), "\U0001d11e x"]
    together = fp.sketches(texts)
    for t, s in zip(texts, together, strict=True):
        for other in (fp.sketches([t])[0], fp.sketches([t, t], piece=10)[1]):
            assert len(other) == len(s) and all(map(np.array_equal, other, s))
    assert len(together[0]) == 0 and all(len(s) for s in together[1:])


def test_likeness_estimates_overlap():
    a, b = text(3000, 5), text(3000, 6)
    half = a[: len(a) // 2] + b[: len(b) // 2]
    x, y, z = fp.sketches([a, half, b])
    assert fp.likeness(x, x) == 1 and fp.likeness(x, z) < 0.1 and 0.15 < fp.likeness(x, y) < 0.55
    assert fp.likeness([], []) == 1 and fp.likeness([], x) == 0


@pytest.mark.parametrize(("piece", "range_bytes"), [(1 << 19, 1 << 24), (300, 2000)])
def test_edited_texts_match_brute_force(spark, table, piece, range_bytes):
    rows = [(k * 37 % 211, text(k % 23, k)) for k in range(150)] + [(500, None), (501, ""), (502, "é𝄞x"), (503, "tail")]
    got = {r.doc_id: r for r in fp.fingerprint_documents(table(rows), piece=piece, range_bytes=range_bytes).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        own, new, other = fp.sketches([t, edited, nxt])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.text_of(own), fp.text_of(new))
        assert (r.near_edited, r.near_next) == (fp.likeness(own, new), fp.likeness(own, other))


def test_odd_tables(spark, table):
    assert fp.fingerprint_documents(table([])).collect() == []
    lone = fp.fingerprint_documents(table([(7, "abcdefgh")])).collect()
    assert len(lone) == 1 and lone[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and lone[0].near_next == 1
    odd = spark.createDataFrame([(None, "first", 1, "x"), (3, "same", 1, "x"), (3, "same", 1, "x"), (3, "other", 1, "x"), (-5, "low", 1, "x")], "doc_id long, text string, part int, tie string")
    got = fp.fingerprint_documents(odd).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 1
