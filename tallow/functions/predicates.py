"""Predicates and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scores import let
from .text import capability_tokens, loose_query, normalize_answer, padded_contains, query_key, state_words, text


def eligible(question: Column, golds: Column, facts: Column, contexts: Column) -> Column:
    """A question, a gold answer that isn't blank, a valid supporting fact, and contexts."""
    asked = (F.trim(question) != "") & F.exists(golds, lambda g: F.trim(g) != "")
    return F.coalesce(asked & (F.size(supporting_facts(facts)) > 0) & (F.size(contexts) > 0), F.lit(False))


def supporting_facts(facts: Column) -> Column:
    """(title, sentence_id) with a title and an id that is a number."""
    rows = F.transform(facts, lambda f: F.struct(f["title"].alias("title"), f["sentence_id"].try_cast("int").alias("sentence_id")))
    return F.filter(rows, lambda f: f["title"].isNotNull() & f["sentence_id"].isNotNull())


def visible_in(needle: Column, haystack: Column) -> Column:
    """Whether a text shows another one as whole normalized tokens."""
    return padded_contains(normalize_answer(haystack), normalize_answer(needle))


def two_hop(question: Column, answer: Column, contexts: Column, facts: Column, distractors: int = 8) -> Column:
    """A two-hop graph as a struct, null for a sample that has none.

    ``contexts`` has (title, text), the last of a title counts; ``facts`` has
    (title, sentence).  Two titles support the answer, which only the text of
    one, b, shows; the other, a, names b; the question doesn't; a fact of b
    shows the answer; and ``distractors`` other contexts don't.
    """
    text_of = lambda title: F.element_at(F.filter(contexts, lambda c: c["title"] == title), -1)["text"]
    titles = F.array_distinct(F.transform(facts, lambda f: f["title"]))
    known = (F.size(titles) == 2) & F.forall(titles, lambda t: F.exists(contexts, lambda c: c["title"] == t))
    showing = F.filter(titles, lambda t: visible_in(answer, text_of(t)))

    def graph(b: Column) -> Column:
        a = F.get(F.filter(titles, lambda t: t != b), 0)
        own = lambda t: F.filter(F.transform(F.filter(facts, lambda f: f["title"] == t), lambda f: F.trim(f["sentence"])), lambda x: x.isNotNull())
        others = F.filter(contexts, lambda c: (c["title"] != a) & (c["title"] != b) & ~visible_in(answer, c["text"]))
        good = visible_in(b, text_of(a)) & ~visible_in(b, question) & F.exists(own(b), lambda x: visible_in(answer, x)) & (F.size(others) >= distractors)
        found = F.struct(a.alias("a"), b.alias("b"), text_of(a).alias("text_a"), text_of(b).alias("text_b"), F.array_join(own(a), " ").alias("fact_a"), F.array_join(own(b), " ").alias("fact_b"), others.alias("distractors"))
        return F.when(good, found)

    # a title that alone shows the answer: the other one's text then doesn't
    return F.when(known & (F.size(showing) == 1), let(F.get(showing, 0), graph))


def title_hits(title: Column, body: Column) -> Column:
    """A title's different words, in order, whose query keys the body's key holds; none without a key.

    A word that stands in the body has its key in the body's.  So a body that
    holds the title as it is has all its words; else those that are words of the
    body, too, are told by hashing, and only the rest is searched for.
    """
    # most words begin with a letter: only others need the pattern
    keyed = lambda w: ((w >= "a") & (w < "{")) | ((w >= "A") & (w < "[")) | F.lower(w).rlike("[a-z0-9]")
    search = lambda ws: let(query_key(body), lambda b: F.filter(ws, lambda w: ~F.contains(b, query_key(w))))

    def missing(ws: Column) -> Column:
        own = F.split(F.replace(body, F.lit("\n"), F.lit(" ")), " ")
        return let(F.array_except(ws, own), lambda rest: F.when(F.size(rest) == 0, rest).otherwise(search(rest)))

    found = lambda ws: F.when(body.endswith(title) | body.contains(title), ws).otherwise(F.array_except(ws, missing(ws)))
    return F.sort_array(F.filter(let(F.array_distinct(F.split(title, " ")), found), keyed))


def covered(gold: Column, got: Column) -> Column:
    return (F.size(gold) > 0) & (F.size(F.array_except(gold, got)) == 0)


def _count(steps: Column, kind: str) -> Column:
    return F.size(F.filter(steps, lambda s: s["step_type"] == kind))


def valid_state(steps: Column, sources: Column, provider: str, errors: Column) -> Column:
    """A state after one search: observed, with documents that all are the provider's, and no retrieval error."""
    seen = (_count(steps, "search") == 1) & (_count(steps, "observation") >= 1)
    return seen & (F.size(sources) > 0) & F.forall(sources, lambda s: F.coalesce(s == provider, F.lit(False))) & (F.coalesce(errors, F.lit(0)) == 0)


def no_search(steps: Column) -> Column:
    return (_count(steps, "search") == 0) & F.forall(steps, lambda s: F.length(s["content"]) > 0)


def prompt_leak(prompt: Column) -> Column:
    shown = F.to_json(prompt)
    return shown.contains("supporting_facts") | shown.contains('"contexts"')


def visible(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only columns that a policy may see; a missing one is an error."""
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df.select(*columns)


def _host(c) -> Column:
    return F.lower(F.regexp_extract(text(c), "://([^/?#]*)", 1))


def benchmark_url(c) -> Column:
    host, path = _host(c), F.lower(F.regexp_extract(text(c), "://[^/?#]*([^?#]*)", 1))
    data = path.startswith("/datasets/")
    return (
        F.when(host.isin("huggingface.co", "www.huggingface.co", "datasets-server.huggingface.co"), data | host.startswith("datasets-server"))
        .when(host.isin("kaggle.com", "www.kaggle.com") & data, True)
        .when(host.isin("github.com", "www.github.com", "raw.githubusercontent.com"), path.rlike("hotpotqa|hotpot_qa|hotpot-qa"))
        .otherwise(F.concat(host, path).rlike("rag-rl-hotpotqa|hotpotqa-eval"))
    )


def leak_pattern(c) -> Column:
    return text(c).rlike(r"(?i)hotpot.?qa|huggingface\.co/datasets|datasets-server|kaggle\.com/datasets")


#: Ranges of IPv4 addresses that aren't global: first address and number of leading bits.
NOT_GLOBAL = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
)


def address_ranges() -> list[tuple[int, int]]:
    """First and last number of each range of NOT_GLOBAL."""
    number = lambda x: sum(int(part) << 8 * k for k, part in enumerate(reversed(x.split("."))))
    return [(number(first), number(first) + (1 << 32 - bits) - 1) for first, bits in NOT_GLOBAL]


def public_http(c) -> Column:
    """Scheme and host part of the guard; names aren't resolved, but literal addresses and localhost need no resolver.

    A host that ends in a number or 0x is an address: four numbers up to 255,
    none of the ranges that aren't global.  Other spellings of addresses, and
    IPv6 but for 2000::/3 outside of the documentation range, are refused.
    """
    scheme = F.lower(F.regexp_extract(text(c), "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    host = F.regexp_replace(F.regexp_replace(_host(c), "^.*@", ""), ":[0-9]*$", "")
    parts = F.transform(F.split(host, r"\."), lambda x: x.try_cast("long"))
    quad = host.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    local = F.exists(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in address_ranges()]), lambda r: number.between(r["a"], r["b"]))
    named = (host != "") & ~host.rlike(r"(?:^|\.)localhost$") & ~host.contains("[")
    address = host.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$")
    six = host.rlike(r"^\[[23][0-9a-f]{3}:") & ~host.rlike(r"^\[2001:0?db8:")
    return scheme.isin("http", "https") & F.when(address, F.when(quad, ~local).otherwise(False)).otherwise(named | six)


def depth(seen: Column, support: Column) -> Column:
    n = F.when(seen, 1).when(support, 2).otherwise(0)
    reason = F.when(seen, "answer_visible_after_search1").when(support, "support_visible_answer_missing").otherwise("unresolved_or_no_bridge")
    return F.struct(n.alias("depth"), reason.alias("reason"))


def length_bucket(second: Column, repeated: Column, tokens: Column) -> Column:
    return F.when(second, "second_search").when(repeated, "duplicate_query").when(tokens >= 450, "verbose_single_search").otherwise("normal")


def unfinished(observations: Column, last: Column, tokens: Column) -> Column:
    low = F.lower(last)
    return (
        F.when(observations < 2, "C_no_second_obs")
        .when(low.contains("<answer>") | low.contains("</answer>"), "D_had_answer_tag_not_parsed")
        .when(F.length(F.trim(last)) < 8, "A_stop_after_obs_empty_gen")
        .when((tokens >= 900) | (F.length(last) >= 800) | low.contains("<evidence>"), "B_budget_after_second_obs")
        .otherwise("A_stop_after_obs_no_answer")
    )


def query_forms(c) -> dict[str, Column]:
    """What novelty() compares of a query: trimmed, loose form, tokens; to be worked out in a projection of its own."""
    return {"whole": F.trim(text(c)), "loose": loose_query(c), "tokens": capability_tokens(c)}


def with_novelty(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with the ``novelty`` of query b after query a, and b's ``tokens``.  Forms are columns, so none is worked out twice."""
    forms = {f"_{side}_{k}": v for side, c in (("a", a), ("b", b)) for k, v in query_forms(c).items()}
    rows = df.withColumns(forms).withColumn("_shared", F.size(F.array_intersect("_a_tokens", "_b_tokens")))
    union = F.size("_a_tokens") + F.size("_b_tokens") - F.col("_shared")  # both are sets
    like = F.when(union == 0, 1.0).otherwise(F.col("_shared") / union)
    label = (
        F.when(F.col("_a_whole") == F.col("_b_whole"), "exact_duplicate")
        .when(F.col("_a_loose") == F.col("_b_loose"), "normalized_duplicate")
        .when(like >= 0.85, "semantic_duplicate")
        .otherwise("rewrite")
    )
    return rows.withColumns({"novelty": label, "tokens": F.col("_b_tokens")}).drop(*forms, "_shared")


def hop_label(novel: Column, conditioned: Column, new_documents: Column, new_facts: Column) -> Column:
    """What a second search was: a repetition with or without new documents, or a new query that used the observation or didn't."""
    fresh = (new_documents > 0) | (new_facts > 0)
    again = novel.isin("exact_duplicate", "normalized_duplicate", "semantic_duplicate")
    return (
        F.when(again & ~fresh, "duplicate_retry")
        .when(again, "duplicate_but_new_docs")
        .when(conditioned & fresh, "obs_conditioned_hop")
        .when(conditioned, "obs_conditioned_no_new_docs")
        .otherwise("rewrite_not_obs_conditioned")
    )


def quadrant(direct: Column, oracle: Column) -> Column:
    side = lambda c, n: F.when(c, f"{n}_ok").otherwise(f"{n}_err")
    return F.concat_ws("_", side(direct, "direct"), side(oracle, "oracle"))


def conditioning(query, question, observation, missing) -> Column:
    """The state signal that a refined query uses."""
    fresh = F.array_except(state_words(query), state_words(question))
    gap = (query_key(query) != query_key(question)) & F.arrays_overlap(state_words(query), state_words(missing))
    return F.when(F.arrays_overlap(fresh, state_words(observation)), "observation_entity").when(gap, "missing_state_refinement").otherwise("none")


def verdict(*checks) -> Column:
    good = F.lit(True)
    for c in checks:
        good = good & text(c)
    return F.when(good, "PASS").otherwise("FAIL")


def decision(raw: Column) -> Column:
    """A stored decision: at most 8 known and 3 missing items; null if it can't be read."""
    d = F.from_json(raw, "decision string, known array<string>, missing array<string>")
    return F.when(
        d["decision"].isNotNull(),
        F.struct(F.lower(d["decision"]).alias("decision"), F.slice(d["known"], 1, 8).alias("known"), F.slice(d["missing"], 1, 3).alias("missing"), F.size(d["missing"]).alias("n_declared")),
    )


def grounded(f1: Column, missing: Column, sources: Column, available: Column) -> Column:
    return (f1 >= 0.8) & (F.size(missing) == 0) & (F.size(sources) > 0) & (F.size(F.array_except(sources, available)) == 0)


def conservative(label: Column, f1: Column, sources: Column, available: Column) -> Column:
    """STOP only with F1 of 0.5 and more and valid sources."""
    weak = (f1 < 0.5) | (F.size(sources) == 0) | (F.size(F.array_except(sources, available)) > 0)
    return F.when((label == "STOP") & weak, "CONTINUE").otherwise(label)


def held(c: Column, patterns: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, patterns)), lambda x: F.contains(c, x))


def role(title: Column, gold: Column) -> Column:
    return F.when(F.array_contains(gold, title), "gold_supporting").otherwise("distractor")
