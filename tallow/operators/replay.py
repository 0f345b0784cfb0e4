"""Replay of stored generations: phases of a bounded search loop, truncation, citations, curriculum rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates, scores, tags
from ..functions.text import normalize_answer, padded_contains, query_key, short_query


def phases(chunks: Column, cap: int) -> Column:
    """Fold an episode's chunks: (phase, searches, finished, steps).

    A search with budget left is followed by an observation; one without is
    dropped and leads to the evidence phase; an answer ends the episode, and
    later chunks don't count.
    """
    start = F.struct(F.lit("act").alias("phase"), F.lit(0).alias("searches"), F.lit(False).alias("finished"), F.lit(0).alias("steps"))

    def step(s: Column, c: Column) -> Column:
        action = tags.first_action(c)
        able = (action == "search") & (s["searches"] < cap)
        spent = (action == "search") & ~able
        moved = F.struct(
            F.when(action == "answer", "answer").when(spent, "evidence").otherwise(s["phase"]).alias("phase"),
            (s["searches"] + F.coalesce(able, F.lit(False)).cast("int")).alias("searches"),
            F.coalesce(action == "answer", F.lit(False)).alias("finished"),
            (s["steps"] + F.when(able, 2).when(F.coalesce(spent, F.lit(False)), 0).otherwise(1)).alias("steps"),
        )
        return F.when(s["finished"], s).otherwise(moved)

    return F.aggregate(chunks, start, step)


def truncate_tokens(ids: Column, sequences: list[list[int]], most: int) -> Column:
    """Token ids up to and with the earliest complete closing sequence, and at most ``most``."""
    ends = [F.get(_places(ids, s), 0) + len(s) - 1 for s in sequences]
    first = F.array_min(F.array(*ends)) if ends else F.lit(None).cast("int")
    return F.slice(ids, F.lit(1), F.least(F.size(ids), F.lit(most), F.coalesce(first, F.size(ids))))


def _places(ids: Column, sequence: list[int]) -> Column:
    wanted, n = F.array(*map(F.lit, sequence)), F.lit(len(sequence))
    return F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ids))), lambda k: F.slice(ids, k, n) == wanted)


def cited_or_best(evidence: Column, cited: Column, k: int = 2) -> Column:
    """Evidence (source_id, score, text) that is cited; without any, the k best by score."""
    hits = F.filter(evidence, lambda e: F.array_contains(cited, e["source_id"]))
    best = F.transform(F.slice(F.array_sort(F.transform(evidence, lambda e: F.struct((-e["score"]).alias("s"), e.alias("e")))), 1, k), lambda x: x["e"])
    return F.when(F.size(hits) > 0, hits).otherwise(best)


def coerce_golds(target: Column, golds: Column, single: Column) -> Column:
    """Gold answers from a list, another list, or one text; none of all null."""
    return F.coalesce(target, golds, F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>"))


def canonical_digest(documents: Column) -> Column:
    """SHA-256 of documents as compact JSON with fields in the order of their names."""
    return F.sha2(F.to_json(documents), 256)


def curriculum(df: DataFrame, id_col: str, question: str, answer: str, graph: str, depth: str) -> DataFrame:
    """Trajectories of a replayed two-hop graph, a row a decision: ``sample_id``, ``turn``, ``decision``, ``query``, ``titles``, ``known``, ``missing``, ``answer``.

    ``graph`` is what predicates.two_hop() gives.  At depth 1 the question is
    searched and finds both texts and three distractors.  At depth 2 it finds
    the first text and four distractors; then the bridge with the question's
    last words finds the second text and four others.  The last decision
    answers.  ``titles`` are those that the decision's search finds.
    """
    g, two = F.col(graph), F.col(depth) == 2
    titles = lambda *x: F.concat(*[F.array(c) if not isinstance(c, tuple) else F.transform(F.slice(g["distractors"], *c), lambda d: d["title"]) for c in x])
    none = F.array().cast("array<string>")

    def step(decision: str, query: Column, found: Column, known: Column, missing: Column, said: Column) -> Column:
        return F.struct(F.lit(decision).alias("decision"), query.alias("query"), found.alias("titles"), known.alias("known"), missing.alias("missing"), said.alias("answer"))

    empty, first_gap = F.lit(""), F.array(F.lit("Evidence needed to answer the question"))
    gap = F.array(F.concat(F.lit("The fact about "), g["b"], F.lit(" needed to answer the question")))
    first = step("SEARCH", F.col(question), F.when(two, titles(g["a"], (1, 4))).otherwise(titles(g["a"], g["b"], (1, 3))), none, first_gap, empty)
    second = step("SEARCH", short_query(g["b"], F.col(question)), titles(g["b"], (5, 4)), F.array(g["fact_a"]), gap, empty)
    last = step("ANSWER", empty, none, F.array(g["fact_a"], g["fact_b"]), none, F.col(answer))
    steps = F.when(two, F.array(first, second, last)).otherwise(F.array(first, last))
    rows = df.filter(g.isNotNull()).select(F.concat_ws("__graph_d", F.col(id_col).cast("string"), F.col(depth).cast("string")).alias("sample_id"), F.posexplode(steps).alias("turn", "s"))
    return rows.select("sample_id", "turn", "s.*")


def reject_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that holds gives the reason; null for an accepted row."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def _sufficient(answer: Column, golds: Column, available: Column) -> Column:
    return predicates.grounded(scores.acceptance_f1(answer["answer"], golds), answer["missing"], answer["source_ids"], available)


def trajectory_reason(question: Column, golds: Column, depth: Column, decisions: Column, results: Column, forced: Column) -> Column:
    """Why a trajectory of stored decisions is rejected, or 'accepted'.

    ``decisions`` has (decision, next_query, answer, missing, source_ids),
    ``results`` of each search in order (errors, documents), a document being
    (source_id, url, text); ``forced`` is the answer that was forced after the
    first search, like a decision, null if there is none.  A decision is only
    reached after searches, so what it is judged by follows from its place.
    """
    documents = lambda n: F.flatten(F.transform(F.slice(results, F.lit(1), n), lambda r: r["documents"]))
    field = lambda docs, k: F.transform(docs, lambda d: d[k])
    text = lambda docs: F.array_join(field(docs, "text"), "\n")

    def of_answer(d: Column, i: Column) -> Column:
        available = field(documents(i), "source_id")
        two = depth != 1
        return reject_reason(
            (i == 0, "answer_without_search"),
            (i != depth, "depth_mismatch"),
            (scores.acceptance_f1(d["answer"], golds) < 0.8, "teacher_answer_mismatch"),
            (F.size(d["missing"]) > 0, "answer_with_unresolved_missing"),
            ((F.size(d["source_ids"]) == 0) | (F.size(F.array_except(d["source_ids"], available)) > 0), "answer_not_grounded_in_available_sources"),
            (two & forced.isNull(), "missing_forced1_counterfactual"),
            (two & _sufficient(forced, golds, available), "forced1_already_correct"),
            (F.lit(True), "accepted"),
        )

    def of_search(d: Column, i: Column) -> Column:
        query, now = d["next_query"], F.get(results, i)
        before = F.transform(F.slice(decisions, F.lit(1), i), lambda x: query_key(x["next_query"]))
        docs = F.coalesce(now["documents"], F.array().cast("array<struct<source_id:string,url:string,text:string>>"))
        prior = documents(i)
        conditioned = predicates.conditioning(query, question, text(F.get(results, i - 1)["documents"]), F.array_join(d["missing"], " "))
        first_of_two = (depth == 2) & (i == 0)
        stale = (F.size(F.array_except(field(docs, "url"), field(prior, "url"))) == 0) | (F.size(F.array_except(field(docs, "text"), field(prior, "text"))) == 0)
        seen = F.exists(golds, lambda g: predicates.visible_in(g, text(documents(i + 1))))
        return reject_reason(
            (i >= depth, "teacher_over_depth"),
            (F.array_contains(before, query_key(query)), "duplicate_query"),
            ((i > 0) & (conditioned == "none"), "query_not_observation_conditioned"),
            (F.coalesce(now["errors"], F.lit(0)) > 0, "web_error"),
            (F.size(docs) == 0, "empty_observation"),
            (F.exists(docs, lambda x: predicates.leak_pattern(x["url"])), "benchmark_leak"),
            ((i > 0) & stale, "no_new_information"),
            (first_of_two & forced.isNull(), "forced1_teacher_error"),
            (first_of_two & (forced["decision"] != "ANSWER"), "forced1_protocol_error"),
            (first_of_two & _sufficient(forced, golds, field(documents(F.lit(1)), "source_id")), "forced1_already_correct"),
            ((i + 1 < depth) & seen, "prematurely_sufficient"),
        )

    each = F.transform(F.slice(decisions, F.lit(1), depth + 1), lambda d, i: F.when(d["decision"] == "ANSWER", of_answer(d, i)).otherwise(of_search(d, i)))
    return F.coalesce(F.get(F.filter(each, lambda r: r.isNotNull()), 0), F.lit("no_final_answer"))


def beam_reason(first_documents: Column, decision: Column, branches: Column) -> Column:
    """Why a beam of second queries is rejected, or 'accepted': ``decision`` is null if the teacher failed, ``branches`` are trajectory_reason() of each query."""
    return reject_reason(
        (F.coalesce(F.size(first_documents) <= 0, F.lit(True)), "query_beam_requires_frozen_obs1"),
        (decision.isNull(), "query_beam_teacher_error"),
        (decision != "SEARCH", "query_beam_teacher_answered"),
        (F.array_contains(branches, "accepted"), "accepted"),
        (F.size(branches) == 0, "query_beam_empty"),
        (F.lit(True), "query_beam_exhausted"),
    )


def synthesis_reason(bridge: Column, query2: Column, answer: Column, question: Column, source_a: Column, source_b: Column, errors: dict[str, Column], fresh: Column, normal: dict[str, Column] | None = None) -> Column:
    """Why a synthesised two-hop question is rejected; null if it isn't.

    ``source_a`` and ``source_b`` are (url, text), null if unknown; ``errors``
    tells by 'a', 'b' and 'fresh' whether a search failed or found nothing;
    ``fresh`` is the text that a search of the question itself finds.
    ``normal`` has the normal forms of these texts ('a', 'b', 'fresh') and of
    'bridge', 'query2', 'answer' and 'question', as far as they are known;
    they should be columns, as each is met in several rules.
    """
    own = {"a": source_a["text"], "b": source_b["text"], "fresh": fresh, "bridge": bridge, "query2": query2, "answer": answer, "question": question}
    own = {k: normalize_answer(v) for k, v in own.items()} | (normal or {})
    shows = lambda needle, hay: F.coalesce(padded_contains(own[hay], own[needle]), F.lit(False))
    return reject_reason(
        (errors["a"], "source_a_web_error"),
        ((bridge == "") | (query2 == "") | source_a.isNull() | ~shows("bridge", "a"), "invalid_grounded_bridge"),
        (~shows("bridge", "query2"), "query2_missing_bridge"),
        (errors["b"], "source_b_web_error"),
        ((answer == "") | (question == "") | source_b.isNull() | ~shows("answer", "b"), "invalid_grounded_answer"),
        (shows("answer", "a"), "answer_visible_in_source_a"),
        (shows("answer", "question") | shows("bridge", "question"), "question_leaks_bridge_or_answer"),
        (source_a["url"] == source_b["url"], "same_source_url"),
        (errors["fresh"], "fresh_search1_web_error"),
        (~shows("bridge", "fresh"), "fresh_search1_bridge_missing"),
        (shows("answer", "fresh"), "fresh_search1_answer_visible"),
    )


def rollout(samples: DataFrame, generate, retrieve, rounds: int = 1, done: str | None = None) -> DataFrame:
    """Rounds with injected strategies, tables in and tables out: generate(samples) adds queries, retrieve(queries) documents.

    With ``done``, a boolean column, rows that have it leave after each round
    and come back as they were; the others go on.
    """
    finished = None
    for _ in range(rounds):
        samples = retrieve(generate(samples))
        if done:
            ended = samples.filter(done)
            finished = ended if finished is None else finished.unionByName(ended, allowMissingColumns=True)
            samples = samples.filter(~F.coalesce(F.col(done), F.lit(False)))
    return samples if finished is None else samples.unionByName(finished, allowMissingColumns=True)


# Phases of a step and what ends a generation in them.
BUDGETS = {"answer": 400, "evidence": 384, "search": 256}
STOPS = ("</search>", "</answer>", "</internal>")
STATEFUL_STOPS = ("</search>", "</answer>")


def token_budget(phase: Column, budgets: dict[str, int] = BUDGETS) -> Column:
    """Tokens that a phase may generate; phases but answer and evidence share the search budget."""
    return F.when(phase == "answer", budgets["answer"]).when(phase == "evidence", budgets["evidence"]).otherwise(budgets["search"])


def stop_strings(memory_mode: Column) -> Column:
    return F.when(memory_mode == "research_v2", F.array(*map(F.lit, STATEFUL_STOPS))).otherwise(F.array(*map(F.lit, STOPS)))
