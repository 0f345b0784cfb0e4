import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tallow.llm import pii

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    d = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in SHAPES.items() for m in re.finditer(p, text or "") if good(k, m[0])]


ODD = [
    "", None, "a@b.co_x@y.z a@b a@b..c x@@y.zz 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 9.9.9.0255 +1 (234) 567-8901x +12",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112222 4111111111111112", "é𝄞 mail a.b+c@ex-am.ple.org, 𝄞10.0.0.2",
    "a" * 5000 + "@" + ".b" * 3000 + " 1" + ".1" * 9000, "x@a.b@c.d @a.b 12.34.56.78.90 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "1" * 3000 + "." + "2" * 3000,
]


def test_base_spans_match_brute_force(spark, table):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("ab1239@.+-_ ()") for _ in range(rnd.randint(1, 90))) for _ in range(400)]
    got = {r.doc_id: r for r in pii.digest(pii.find(table(list(enumerate(texts))))).collect()}
    for k, text in enumerate(texts):
        spans = brute(text)
        assert got[k].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), text
        assert got[k].n_ip == sum(s.startswith("ip:") for s in spans)


def cards(n):
    out, k = [], 4000000000000000
    while len(out) < n:
        if good("card", str(k)):
            out.append(str(k))
        k += 7
    return out


def test_bootstrap_adds_unseen_identifiers(spark, table):
    valid = cards(40)
    broken = [c[:-1] + str((int(c[-1]) + 1) % 10) for c in valid[:12]]
    rows = [(k, f"my card {c} expires soon") for k, c in enumerate([*valid, *broken])]
    rows += [(500 + k, f"order number {c} was sent") for k, c in enumerate(broken)]
    got = {r.doc_id: r for r in pii.digest(pii.find(table(rows))).collect()}
    assert all(got[40 + k].spans == "card:8:24" and got[40 + k].n_card == 0 for k in range(12))
    assert all(got[500 + k].spans == "" for k in range(12))


def test_redaction_keeps_rows_and_columns(spark):
    schema = "doc_id long, text string, id string, hash string, base string, spans string, row string"
    rows = [(1, "mail a@b.cd or 10.0.0.1!", "i", "h", "b", "s", "r"), (None, None, "i", "h", "b", "s", "r"), (1, "plain", "i", "h", "b", "s", "r"), (2, "+1.2.3.4 555 12 34 567", "i", "h", "b", "s", "r")]
    got = pii.redact(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "id", "hash", "base", "spans", "row"]
    assert sorted(str(r.text) for r in got.collect()) == sorted(["mail [EMAIL] or [IP]!", "None", "plain", "[PHONE]"])
    assert pii.redact(spark.createDataFrame([], schema)).collect() == [] == pii.find(spark.createDataFrame([], schema)).collect()


def slow_runs(text):
    """Instances with the words around them, one token at a time."""
    tokens = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text)]
    mark = lambda t: re.search(r"[0-9@]|[\[({]at[\])}]", text[t[0] : t[1]])
    alone = lambda t: "@" in text[t[0] : t[1]]
    runs, out = [], []
    for k, t in enumerate(tokens):
        if mark(t):
            begins = alone(t) or re.match(r"[(]?\+", text[t[0] : t[1]]) or alone(tokens[k - 1])
            if runs and runs[-1][-1] == k - 1 and text[tokens[k - 1][1] : t[0]] in (" ", "\t") and not begins:
                runs[-1].append(k)
            else:
                runs.append([k])
    inside = {k for r in runs for k in r}
    for r in runs:
        low, high = tokens[r[0]][0], tokens[r[-1]][1]
        whole = text[low:high]
        lead = len(whole) - len(re.sub(r"^[^\w+(]+|^_+", "", whole))
        core = re.sub(r"[\W_]+$", "", whole[lead:])
        left = text[slice(*tokens[r[0] - 1])].lower() if r[0] and r[0] - 1 not in inside else "^"
        right = text[slice(*tokens[r[-1] + 1])].lower() if r[-1] + 1 < len(tokens) and r[-1] + 1 not in inside else "$"
        out.append((low + lead, low + lead + len(core), core, left, right))
    return out


def slow_find(texts, rounds=3, support=5, bar=0.9):
    """The bootstrap by its definition, over all texts at once."""
    shape = lambda x: re.sub("[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", x))
    kind = lambda x: next((k for k, p in SHAPES.items() if any(good(k, m[0]) for m in re.finditer(p, x))), None)
    runs = [(i, *r) for i, t in enumerate(texts) for r in slow_runs(t or "") if r[2]]
    edges = {(r[4], r[5], r[3]) for r in runs}
    seeds = {(shape(x), kind(x)) for _, _, x in edges if kind(x)}
    known = {(a, b, x, kind(x)): 1.0 for a, b, x in edges if kind(x)}
    for step in range(rounds):
        if step:
            best = {}
            for a, b, x in edges:
                if not kind(x):
                    for (p, q, k), c in patterns.items():
                        if (p, q) == (a, b):
                            best[x, k] = max(best.get((x, k), 0), c if (shape(x), k) in seeds else c * c)
            known = {e: 1.0 for e in known if known[e] == 1.0 and kind(e[2])} | {(a, b, x, k): c for a, b, x in edges for (y, k), c in best.items() if x == y}
        patterns = {}
        for a, b, k in {(a, b, k) for a, b, _, k in known}:
            own = [c for (p, q, _, m), c in known.items() if (p, q, m) == (a, b, k)]
            conf = sum(own) / (sum((p, q) == (a, b) for p, q, _ in edges) + 1)
            if len(own) >= support and conf >= bar / 2:
                patterns[a, b, k] = conf
    out = []
    for i, t in enumerate(texts):
        spans = [(list(SHAPES).index(s.split(":")[0]), *map(int, s.split(":")[1:])) for s in brute(t)]
        base = list(spans)
        for j, low, high, core, left, right in runs:
            if i == j and not kind(core) and not any(x < high and y > low for _, x, y in base):
                able = [(c if (shape(core), k) in seeds else c * c, k) for (p, q, k), c in patterns.items() if (p, q) == (left, right) and c >= bar]
                able = [x for x in able if x[0] >= bar]
                if able:
                    spans.append((list(SHAPES).index(max(able)[1]), low, high))
        out.append(",".join(f"{list(SHAPES)[k]}:{a}:{b}" for k, a, b in sorted(spans)))
    return out


def test_bootstrap_matches_brute_force(spark, table):
    valid, rnd = cards(60), random.Random(9)
    texts = [f"my card {c} expires soon" for c in valid[:40]] + [f"my card {c[:15]} expires soon" for c in valid[:6]]
    texts += [f"call me at +49 (0{100 + k}) 555-{1000 + k}, or write" for k in range(45)] + [f"call me at (0{100 + k}) 777-{1000 + k}, or write" for k in range(4)]
    texts += [f"mail user{k}@host.org" for k in range(30)] + ["mail bob[at]host.org", "mail ann (at) host.org", "see page 12 of 90", "", None, "7", "9 10"]
    texts += [f"number {rnd.randint(1, 99)} of {rnd.randint(1, 99)} at {rnd.randint(1, 99)} or" for _ in range(30)]
    texts += ["x" * 300 + "1 " + "é" * 500 + " 22\n33\t44  55", " ".join(str(k) for k in range(3000))]
    texts += [" ".join(f"+49 (0{100 + k}) 555-{2000 + k}" for k in range(12)), "a@b.org c@d.org 10.0.0.1 +49 30 1234567 x@y.org +49"]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(table(list(enumerate(texts))))).collect()}
    want = slow_find(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert want[85].startswith("phone:11:") and want[40].startswith("card:8:") and "email" in want[texts.index("mail bob[at]host.org")]


def test_long_identifiers_and_neighbours(spark, table):
    word = "w" * 200
    texts = [f"{word} {'a' * 100}{k}@host.org {word}" for k in range(30)] + [f"{word} {'a' * 100}[at]host.org {word}"]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(table(list(enumerate(texts))))).collect()}
    assert got[30] == f"email:201:{201 + 100 + 12}"


def timed(spark, n):
    """Seconds for a text of n candidates of every kind, beside each other and apart."""
    text = " ".join(f"{k % 300}.1.2.3 +49 (030) {k} v{k}@x.org 4111 1111 {k}" for k in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    began = time.perf_counter()
    base = pii.find(docs).collect()[0].base
    found = time.perf_counter() - began
    redacted = pii.redact(docs).collect()[0].text
    assert redacted.count("[EMAIL]") == n and len(base) >= n
    return found, time.perf_counter() - began - found


def test_time_is_linear_in_the_matches_of_a_text(spark):
    timed(spark, 100)
    few, many = timed(spark, 1_000), timed(spark, 5_000)
    assert all(b < 6 * max(2, a) for a, b in zip(few, many, strict=True)), (few, many)


def test_overlaps_and_order_by_brute_force(spark):
    rnd, kinds = random.Random(5), list(SHAPES)
    rows = []
    for k in range(200):
        span = lambda: (rnd.choice(kinds), low := rnd.randint(0, 40), low + rnd.randint(1, 9))
        rows.append((k, sorted((span() for _ in range(rnd.randint(0, 6))), key=lambda s: (kinds.index(s[0]), s[1:])), [span() for _ in range(rnd.randint(0, 5))]))
    kind = "array<struct<kind:string,start:int,end:int>>"
    got = spark.createDataFrame(rows, f"k int, base {kind}, added {kind}").select("k", pii._merged(F.col("base"), F.col("added")).alias("m")).collect()
    for r in got:
        base, added = rows[r.k][1:]
        fresh = [s for s in added if not any(x[1] < s[2] and x[2] > s[1] for x in base)]
        assert [tuple(s) for s in r.m] == sorted(base + fresh, key=lambda s: (kinds.index(s[0]), s[1:]))
