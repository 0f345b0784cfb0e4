"""Metrics of traces and summaries of runs: what evaluation and gate reports hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.grounding import TAGS
from ..functions.text import query_key, sentence_count, state_words
from ..sources.readers import scratch
from .audits import share
from .quantiles import at_places
from .validators import trace_errors

# Metrics of a run's rows, and the digits of their means.
FOUR = (
    ("parse_ok_rate", "format_valid"), ("mean_em", "exact_match"), ("mean_token_f1", "token_f1"), ("mean_evidence_f1", "evidence_f1"), ("mean_evidence_em", "evidence_em"),
    ("mean_joint_f1", "joint_f1"), ("mean_joint_em", "joint_em"), ("mean_search_count", "search_count"), ("mean_duplicate_query_count", "duplicate_query_count"),
    ("mean_retrieval_error_count", "retrieval_error_count"), ("mean_successful_urls", "successful_urls"), ("mean_failed_urls", "failed_urls"), ("mean_filtered_urls", "filtered_urls"),
)
TWO = (("mean_search_api_ms", "search_api_ms"), ("mean_fetch_ms", "fetch_ms"), ("mean_extract_ms", "extract_ms"), ("mean_tool_total_ms", "tool_total_ms"), ("mean_model_generation_ms", "model_generation_ms"))
ONE = (("mean_latency_ms", "latency_ms"), ("mean_observation_tokens", "observation_tokens"), ("mean_generated_tokens", "generated_tokens"))
MEMORY = (("mean_memory_evidence_items", "evidence_items"), ("mean_duplicate_url_count", "duplicate_url_count"), ("mean_new_evidence_per_search", "new_evidence_per_search"))
#: Counters that a run brings along; the rest of a trace's metrics is worked out.
COUNTERS = ("retrieval_error_count", "empty_retrieval_count", "search_api_ms", "fetch_ms", "extract_ms", "tool_total_ms", "model_generation_ms", "successful_urls", "failed_urls", "filtered_urls")


def run_summary(df: DataFrame, *group: str) -> DataFrame:
    """Means and rates of runs, a row a group.

    ``df`` has ``metrics`` (a map of numbers), ``finished``, ``route_first``,
    ``hit_max_search_turns``, ``steps`` (step_type, loss_mask), ``cost_info``
    (latency_ms, observation_tokens, generated_tokens) and ``research_memory``
    (a struct, null without memory).  A metric that is missing counts as 0;
    means of the memory are over the rows that have one.
    """
    metric = lambda k: F.coalesce(F.try_element_at("metrics", F.lit(k)).cast("double"), F.lit(0.0))
    mean = lambda c, digits: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), digits)
    searches = metric("search_count")
    masked = F.exists("steps", lambda s: (s["step_type"] == "observation") & ~s["loss_mask"]) | (searches == 0)
    memory = F.col("research_memory")
    return df.groupBy(*group).agg(
        F.count("*").alias("num_samples"),
        F.round(share(F.col("finished")), 4).alias("finish_rate"),
        *[mean(metric(k), 4).alias(n) for n, k in FOUR],
        F.round(F.sum(metric("empty_retrieval_count")) / F.greatest(F.lit(1.0), F.sum(searches)), 4).alias("empty_retrieval_rate"),
        *[mean(metric(k), 2).alias(n) for n, k in TWO],
        F.round(share(F.col("route_first") == "internal"), 4).alias("internal_rate"),
        F.round(share(F.col("route_first") == "search"), 4).alias("search_rate"),
        F.round(share(F.col("hit_max_search_turns")), 4).alias("max_search_turn_hit_rate"),
        F.round(share(masked), 4).alias("observation_mask_ok_rate"),
        *[mean(F.col("cost_info")[k], 1).alias(n) for n, k in ONE],
        *[F.round(share(searches.cast("int") == k), 4).alias(f"p_search_{k}") for k in range(3)],
        F.round(share(searches.cast("int") >= 3), 4).alias("p_search_ge3"),
        *[F.round(F.avg(F.when(memory.isNotNull(), F.coalesce(memory[k].cast("double"), F.lit(0.0)))), 4).alias(n) for n, k in MEMORY],
    )


def trace_metrics(prediction: Column, golds: Column, finished: Column, queries: Column, cited: Column, facts: Column, counters: Column, trace: dict[str, Column], normal: dict[str, Column] | None = None) -> Column:
    """The 24 metrics of a trace as a struct.

    ``queries`` are the searches in order, ``cited`` and ``facts`` arrays of
    (title, sentence_id), ``counters`` a struct of COUNTERS, ``trace`` the
    arguments of trace_errors().  Without an answer all scores of it are 0;
    evidence is scored if there are both cited sentences and facts.  ``normal``
    has the normal forms and bags of the prediction ('text', 'bag') and of the
    golds ('texts', 'bags') if they are known, as columns.
    """
    said = F.coalesce(prediction, F.lit(""))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("f1", "precision", "recall")])
    best = scores.best_of(normal["bag"], normal["bags"]) if normal else scores.best_prf(said, golds)
    same = F.array_contains(normal["texts"], normal["text"]).cast("double") if normal else scores.exact_match(said, golds)
    answer, em = F.when(said != "", best).otherwise(zero), F.when(said != "", same).otherwise(0.0)
    scored = (F.size(cited) > 0) & (F.size(facts) > 0)
    evidence = F.when(scored, scores.set_prf(cited, facts)).otherwise(F.struct(*[F.lit(0.0).alias(k) for k in ("precision", "recall", "f1")]))
    whole = F.struct(answer.alias("a"), em.alias("em"), evidence.alias("e"), (F.size(trace_errors(**trace)) == 0).alias("valid"))

    def metrics(m: Column) -> Column:
        a, e = m["a"], m["e"]
        exact = F.when((e["precision"] >= 1) & (e["recall"] >= 1) & (e["f1"] >= 1), 1.0).otherwise(0.0)
        return F.struct(
            m["em"].alias("exact_match"), a["f1"].alias("token_f1"), a["precision"].alias("token_precision"), a["recall"].alias("token_recall"), finished.cast("double").alias("finished"),
            F.size(queries).cast("double").alias("search_count"), (F.size(queries) - F.size(F.array_distinct(queries))).cast("double").alias("duplicate_query_count"),
            *[counters[k].cast("double").alias(k) for k in COUNTERS],
            m["valid"].cast("double").alias("format_valid"), e["f1"].alias("evidence_f1"), e["precision"].alias("evidence_precision"), e["recall"].alias("evidence_recall"), exact.alias("evidence_em"),
            scores.joint(a, e)["f1"].alias("joint_f1"), (m["em"] * exact).alias("joint_em"),
        )

    return scores.let(whole, metrics)


def query_copies(df: DataFrame, query: str, question: str) -> DataFrame:
    """How often a query copies its question: exact and normalized rates, mean ratio of lengths, verdict at 0.9.

    A null query is a missing one: it copies nothing and has no ratio; nor has an empty one.
    """
    exact = share(F.col(query) == F.col(question))
    ratio = F.when(F.length(query) > 0, F.length(query) / F.greatest(F.length(question), F.lit(1)))
    rows = df.agg(
        F.count("*").alias("n"), F.sum(F.col(query).isNull().cast("long")).alias("missing"), exact.alias("exact_rate"),
        share(query_key(query) == query_key(question)).alias("normalized_rate"), F.round(F.avg(ratio), 4).alias("length_ratio"),
    )
    verdict = F.when(F.col("exact_rate") >= 0.9, "QUERY_COPY_IS_SUPERVISION_INDUCED").otherwise("QUERY_COPY_NOT_DOMINANT")
    return rows.select("n", "missing", F.round("exact_rate", 4).alias("exact_rate"), F.round("normalized_rate", 4).alias("normalized_rate"), F.round(1 - F.col("exact_rate"), 4).alias("non_copy_rate"), "length_ratio", verdict.alias("verdict"))


def _extra(question: Column, queries: Column, observations: Column) -> Column:
    """Of each search but the first: whether it repeats one before, uses the observation before, and brings new documents."""

    def judge(i: Column) -> Column:
        query = F.get(queries, i)
        before = F.transform(F.slice(queries, F.lit(1), i), query_key)
        fresh = F.array_except(state_words(query), state_words(question))
        seen = F.coalesce(state_words(F.get(observations, i - 1)["content"]), F.array().cast("array<string>"))
        none = F.array().cast("array<string>")
        prior = F.flatten(F.transform(F.slice(observations, F.lit(1), i), lambda o: F.coalesce(o["document_ids"], none)))
        now = F.coalesce(F.get(observations, i)["document_ids"], none)
        return F.struct(
            F.array_contains(before, query_key(query)).alias("duplicate"),
            F.arrays_overlap(fresh, seen).alias("conditioned"),
            (F.size(F.array_except(now, prior)) > 0).alias("new_evidence"),
        )

    return F.when(F.size(queries) > 1, F.transform(F.sequence(F.lit(1), F.size(queries) - 1), judge))


def depth_behaviour(df: DataFrame, baseline_f1: float | None = None) -> DataFrame:
    """One row of how traces keep to their minimal depth, with the gate's verdict.

    ``df`` has ``depth`` (others than 1 and 2 are left out), ``question``,
    ``golds``, ``queries``, ``observations`` (content, document_ids) and the
    last ``answer``, null for none.
    """
    rows = df.filter(F.col("depth").isin(1, 2)).select(
        "depth", F.size("queries").alias("n"), F.coalesce(F.trim("answer") != "", F.lit(False)).alias("finished"),
        F.when(F.col("answer").isNotNull(), scores.best_prf(F.col("answer"), F.col("golds"))["f1"]).alias("f1"),
        _extra(F.col("question"), F.col("queries"), F.col("observations")).alias("extra"),
    )
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    each = lambda k: F.coalesce(F.sum(F.size(F.filter("extra", lambda x: x[k])).cast("long")), F.lit(0))
    d1, d2 = F.col("depth") == 1, F.col("depth") == 2
    sums = rows.agg(
        F.count("*").alias("evaluated"), n(d1).alias("depth1_count"), n(d2).alias("depth2_count"), n(d1 & (F.col("n") == 1)).alias("stop"), n(d2 & (F.col("n") >= 2)).alias("go"),
        n(F.col("finished")).alias("done"), n(F.greatest(F.col("n") - 1, F.lit(0))).alias("extra"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("answer_f1"),
        *[each(k).alias(k) for k in ("duplicate", "conditioned", "new_evidence")],
    )
    over = lambda a, b: (F.col(a) / F.greatest(F.lit(1), F.col(b)))
    out = sums.select(
        "evaluated", "depth1_count", "depth2_count", over("stop", "depth1_count").alias("stop_at_d1"), over("go", "depth2_count").alias("continue_at_d2"), over("done", "evaluated").alias("finish_rate"),
        over("duplicate", "extra").alias("duplicate_extra_query_rate"), over("conditioned", "extra").alias("obs_conditioned_extra_query_rate"), over("new_evidence", "extra").alias("new_evidence_extra_query_rate"), "answer_f1",
    )
    passed = (
        (F.col("depth1_count") > 0) & (F.col("depth2_count") > 0) & (F.col("finish_rate") >= 0.95) & (F.col("duplicate_extra_query_rate") <= 0.25)
        & (F.col("obs_conditioned_extra_query_rate") >= 0.4) & (F.col("new_evidence_extra_query_rate") >= 0.3) & (F.lit(True) if baseline_f1 is None else F.col("answer_f1") >= baseline_f1 - 0.02)
    )
    return out.withColumn("gate", F.when(passed, "WEB_MULTITURN_SFT_PASS").otherwise("WEB_ADAPTIVE_DEPTH_FAIL"))


def importance(df: DataFrame, id_col: str, new: str, old: str, mask: str) -> DataFrame:
    """One row on the ratios of new to old probabilities of tokens: distribution, effective sample size, sequence weights.

    ``new``, ``old`` and ``mask`` are parallel arrays; rows whose lengths
    differ are left out, tokens count where the mask is 1, and those with a
    log-probability that is null or not finite are only counted.
    """
    rows = df.filter((F.size(old) > 0) & (F.size(new) == F.size(old)))
    token = rows.select(id_col, F.explode(F.arrays_zip(F.col(new).alias("pi"), F.col(old).alias("mu"), F.col(mask).alias("m"))).alias("t")).filter("t.m = 1")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    token = token.select(id_col, F.when(finite(F.col("t.pi")) & finite(F.col("t.mu")), F.col("t.pi").cast("double") - F.col("t.mu").cast("double")).alias("d"))
    path = scratch(df.sparkSession, "tokens")
    token.write.parquet(path)  # once; everything below reads it
    token = df.sparkSession.read.schema(token.schema).parquet(path)
    good = token.filter("d is not null").select(F.lit(0).alias("g"), F.abs("d").alias("delta"), F.exp("d").alias("rho"), "d")
    # both columns are refined in the same passes
    both = good.select(F.explode(F.array(F.struct(F.lit("delta").alias("of"), F.col("delta").alias("x")), F.struct(F.lit("rho").alias("of"), F.col("rho").alias("x")))).alias("v")).select("v.*")
    shares = {"p95_abs_dlogp": 0.95, "p99_abs_dlogp": 0.99, **{f"rho_p{k:02}": k / 100 for k in (1, 5, 50, 95, 99)}}
    places = lambda n: {"low": F.floor((n - 1) * 0.5), "high": F.ceil((n - 1) * 0.5), **{k: F.bround((n - 1) * F.lit(q)) for k, q in shares.items()}}
    own = lambda k, of: F.max(F.when((F.col("name") == k) & (F.col("of") == of), F.col("value")))
    ranks = at_places(both, "of", "x", places).groupBy(F.lit(0).alias("g")).agg(
        ((own("low", "delta") + own("high", "delta")) / 2).alias("median_abs_dlogp"), *[own(k, "rho" if k.startswith("rho") else "delta").alias(k) for k in shares]
    )
    sums = good.groupBy("g").agg(
        F.count("*").alias("n_delta_tokens"), F.avg("delta").alias("mean_abs_dlogp"), F.max("delta").alias("max_abs_dlogp"), F.avg("rho").alias("rho_mean"), F.stddev_pop("rho").alias("rho_std"),
        F.max("rho").alias("rho_max"), (F.pow(F.sum("rho"), F.lit(2)) / F.sum(F.col("rho") * F.col("rho"))).alias("ess_token"),
    )
    bad = token.agg(F.sum(F.col("d").isNull().cast("long")).alias("trainer_nonfinite_tokens"), F.lit(0).alias("g"))
    weights = token.filter("d is not null").groupBy(id_col).agg(F.exp(F.sum("d")).alias("w")).agg(F.count("*").alias("n_seq_weights"), F.max("w").alias("max_seq_weight"), F.lit(0).alias("g"))
    out = sums.join(ranks, "g").join(bad, "g").join(weights, "g").withColumn("ess_ratio_token", F.col("ess_token") / F.col("n_delta_tokens"))
    mild = (F.col("trainer_nonfinite_tokens") == 0) & (F.col("ess_ratio_token") >= 0.2)
    whole = ("n_delta_tokens", "trainer_nonfinite_tokens", "n_seq_weights")
    shown = [F.col(c) if c in whole else F.round(c, 6).alias(c) for c in out.columns if c != "g"]
    return out.select(*shown, F.when(mild, "SGLANG_MISMATCH_MILD").otherwise("SGLANG_MISMATCH_TOXIC_OR_EMPTY").alias("mismatch_verdict"))


#: Fixed value: the mark of a rationale that isn't written yet.
PLACEHOLDER = "__TEACHER_REASONING_PENDING__"


def teacher_gate(rows: DataFrame, frozen: DataFrame) -> DataFrame:
    """One row of the gate over generated rationales against the frozen ids.

    ``rows`` has ``sample_id``, ``reasoning``, ``accepted``, ``grounded``,
    ``derived``, ``covered`` (pieces of evidence used), ``clean``, ``tagged``,
    ``hard_reject``, ``n_sentences``, ``saved`` and ``present`` (of hidden
    reasoning) and ``reasoning_tokens``.
    """
    ids = frozen.select("sample_id").distinct()
    both = rows.select("sample_id").distinct().join(ids.withColumn("f", F.lit(True)), "sample_id", "left")
    got = both.agg(F.count("*").alias("unique"), F.sum(F.col("f").isNull().cast("long")).alias("sample_id_delta"))
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    rate = lambda c: F.coalesce(F.round(share(c), 4), F.lit(0.0))
    text = F.coalesce("reasoning", F.lit(""))
    sums = rows.agg(
        F.count("*").alias("n_success"), n(text.contains(PLACEHOLDER)).alias("pending"), n(F.trim(text) == "").alias("empty_rationale"), n(F.col("hard_reject")).alias("hard_fail"),
        rate(F.col("accepted")).alias("accepted_rate"), rate(F.col("grounded")).alias("grounded_rate"), rate(F.col("derived")).alias("answer_derivation_rate"), rate(F.col("covered") >= 2).alias("evidence_coverage_rate"),
        n(F.col("tagged")).alias("xml_leak"), n(~F.col("clean")).alias("meta_leak"), rate(F.col("n_sentences").between(2, 6)).alias("len_2to6_rate"), n(F.col("saved")).alias("reasoning_content_saved"),
        rate(F.col("present")).alias("reasoning_content_present_rate"), F.round(F.avg(F.coalesce("reasoning_tokens", F.lit(0))), 1).alias("mean_reasoning_tokens"), n(F.col("grounded")).alias("n_grounded"), n(F.col("derived")).alias("n_derived"),
        F.coalesce(F.sum("reasoning_tokens"), F.lit(0)).alias("tokens"),
    )
    one = sums.withColumn("k", F.lit(0)).join(got.withColumn("k", F.lit(0)), "k").join(ids.agg(F.count("*").alias("n_input"), F.lit(0).alias("k")), "k").drop("k")
    c = F.col
    hard = (
        (c("n_success") == c("n_input")) & (c("unique") == c("n_input")) & (c("sample_id_delta") == 0) & (c("pending") == 0) & (c("empty_rationale") == 0) & (c("xml_leak") + c("meta_leak") == 0)
        & (c("reasoning_content_saved") == 0) & ((c("reasoning_content_present_rate") > 0) | (c("tokens") > 0))
    )
    large = hard & (c("grounded_rate") >= 0.98) & (c("answer_derivation_rate") >= 0.98) & (c("hard_fail") <= 0.01 * c("n_success"))
    smoke = hard & (c("n_grounded") >= 29) & (c("n_derived") >= 29) & (c("hard_fail") <= 1) & (c("len_2to6_rate") >= 0.9)
    other = (c("n_success") == c("n_input")) & (c("unique") == c("n_input")) & (c("sample_id_delta") == 0) & (c("xml_leak") + c("meta_leak") == 0) & (c("reasoning_content_saved") == 0)
    name = lambda ok, good, bad: F.when(ok, good).otherwise(bad)
    gate = (
        F.when(c("n_input") >= 1200, name(large, "GATE_TEACHER1200_PASS", "GATE_TEACHER1200_FAIL"))
        .when(c("n_input") == 30, name(smoke, "GATE_DEEPSEEK_TEACHER_SMOKE_PASS", "GATE_DEEPSEEK_TEACHER_SMOKE_FAIL"))
        .otherwise(name(other, "GATE_TEACHER1200_SMOKE_PASS", "GATE_TEACHER1200_FAIL"))
    )
    return one.withColumn("gate", gate).drop("n_grounded", "n_derived", "tokens")


def teacher_tiers(rows: DataFrame) -> DataFrame:
    """Per reasoning band ('unknown' for none): number, mean reasoning tokens and mean latency."""
    band = F.coalesce("reasoning_band", F.lit("unknown")).alias("band")
    mean = lambda k, digits: F.round(F.avg(F.coalesce(F.col(k).cast("double"), F.lit(0.0))), digits)
    return rows.groupBy(band).agg(F.count("*").alias("n"), mean("reasoning_tokens", 1).alias("mean_reasoning_tokens"), mean("latency_s", 2).alias("mean_latency_s"))


def rescored(cache: DataFrame, frozen: DataFrame) -> DataFrame:
    """Stored rationales of the frozen ids; fails if an id has none, as no teacher is called."""
    wanted = frozen.select("sample_id").distinct().join(cache, "sample_id", "left")
    known = F.when(F.col("reasoning").isNull(), F.raise_error(F.concat(F.lit("no stored rationale for "), F.col("sample_id").cast("string")))).otherwise(F.col("reasoning"))
    return wanted.withColumn("reasoning", known)



def rescored_gate(stored: DataFrame, samples: DataFrame, frozen: DataFrame) -> DataFrame:
    """The gate over stored rationales that are scored again; nothing is generated.

    ``stored`` has ``sample_id`` and ``value``, a JSON object with reasoning,
    reasoning_content_saved, reasoning_content_present and
    usage.reasoning_tokens; ``samples`` has ``sample_id``, ``question``,
    ``answer`` and ``evidence``.  An id of ``frozen`` without a stored
    rationale is an error.
    """
    from .rationale import score_rationales

    kept = F.from_json("value", "reasoning string, reasoning_content_saved boolean, reasoning_content_present boolean, usage struct<reasoning_tokens:long>")
    cache = stored.select("sample_id", kept.alias("r")).select(
        "sample_id", F.coalesce("r.reasoning", F.lit("")).alias("reasoning"), F.coalesce("r.reasoning_content_saved", F.lit(False)).alias("saved"),
        F.coalesce("r.reasoning_content_present", F.lit(False)).alias("present"), F.coalesce("r.usage.reasoning_tokens", F.lit(0).cast("long")).alias("reasoning_tokens"),
    )
    rows = rescored(cache, frozen).join(samples.select("sample_id", "question", "answer", "evidence"), "sample_id")
    scored = score_rationales(rows.withColumn("raw", F.to_json(F.struct("reasoning"))), "sample_id", "raw", "answer", "question", "evidence")
    both = scored.join(rows.select("sample_id", "reasoning", "saved", "present", "reasoning_tokens"), "sample_id")
    own = {"tagged": F.col("reasoning").rlike(TAGS), "n_sentences": sentence_count("reasoning"), "hard_reject": ~F.col("parsed") | ~F.col("clean")}
    return teacher_gate(both.withColumns(own), frozen)


def search_diversity(df: DataFrame, group: str, question: str, queries: str) -> DataFrame:
    """One row on how searches of trajectories differ within groups of one prompt.

    ``queries`` is a trajectory's array.  A group is searchable if two of its
    trajectories search; it is diverse if these have two different queries.
    """
    each = df.select(group, queries, F.size(F.filter(queries, lambda q: q == F.col(question))).alias("copies"), F.size(queries).alias("n"))
    found = each.select(group, F.explode(queries).alias("q")).distinct().groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("unique"))
    groups = each.groupBy(group).agg(F.sum((F.col("n") > 0).cast("long")).alias("searching"), F.sum("copies").alias("copies"), F.sum("n").alias("n"))
    rows = groups.join(found, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("unique", F.coalesce("unique", F.lit(0)))
    able = F.col("searching") >= 2
    rate = lambda a, b: F.round(a / F.greatest(F.lit(1), b), 4)
    n = lambda c: F.sum(c.cast("long"))
    return rows.agg(
        F.count("*").alias("groups"), n(able).alias("searchable"), rate(n(able & (F.col("unique") >= 2)), n(able)).alias("conditional_query_diversity_rate"),
        rate(F.coalesce(F.sum(F.when(able, F.col("unique"))), F.lit(0)), n(able)).alias("mean_unique_queries"), rate(F.sum("copies"), F.sum("n")).alias("exact_question_copy_rate"),
    )


#: What a second query and a second search can be.
NOVELTIES = ("exact_duplicate", "normalized_duplicate", "semantic_duplicate", "rewrite")
LABELS = ("duplicate_retry", "duplicate_but_new_docs", "obs_conditioned_hop", "obs_conditioned_no_new_docs", "rewrite_not_obs_conditioned")


def capability_summary(df: DataFrame) -> DataFrame:
    """One row over second searches (novelty, label, conditioned, new_documents, new_facts): their number and rates of each."""
    rate = lambda c: F.coalesce(F.round(share(c), 4), F.lit(0.0))
    return df.agg(
        F.count("*").alias("n_search2"), *[rate(F.col("novelty") == k).alias(k) for k in NOVELTIES], *[rate(F.col("label") == k).alias(k) for k in LABELS],
        rate(F.col("conditioned")).alias("obs_conditioned_rate"), rate(F.col("new_documents") > 0).alias("new_doc_rate"), rate(F.col("new_facts") > 0).alias("new_sf_rate"),
    )


def healthy(finish: Column, parsed: Column, masked: Column) -> Column:
    """Whether a checkpoint's rates are good enough to choose it."""
    return (finish >= 0.95) & (parsed >= 0.95) & (masked == 1)


def generation_summary(df: DataFrame, *group: str) -> DataFrame:
    """Rates of generated rationales, mean words of accepted ones, and how often each finish reason and score occurs.

    ``df`` has ``accepted``, ``parse_ok``, ``consistent``, ``grounded``,
    ``n_words``, ``finish_reason`` and ``score``; reasons and scores are few.
    """
    def counts(c: str) -> DataFrame:
        each = df.groupBy(*group, F.col(c).cast("string").alias("k")).agg(F.count("*").alias("n"))
        return each.groupBy(*group).agg(F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce("k", F.lit("none")), F.col("n").cast("string")))).alias(f"{c}s"))

    rate = lambda c: F.round(share(F.col(c)), 4)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    rows = df.groupBy(*group).agg(
        F.count("*").alias("num_requested"), n(F.col("accepted")).alias("num_accepted"), n(~F.col("accepted")).alias("num_rejected"), n(F.col("parse_ok")).alias("num_parse_ok"), rate("accepted").alias("accept_rate"),
        rate("parse_ok").alias("parse_rate"), rate("consistent").alias("answer_consistency_rate"), rate("grounded").alias("grounding_rate"),
        F.coalesce(F.round(F.avg(F.when(F.col("accepted"), F.coalesce("n_words", F.lit(0)))), 2), F.lit(0.0)).alias("avg_accepted_words"),
    )
    return rows.join(counts("finish_reason"), list(group)).join(counts("score"), list(group))


def pool_tag(direct: Column, direct_em: Column, oracle_em: Column) -> Column:
    """Whether a sample fails both alone and with the oracle's evidence; a missing result is a failure."""
    one = lambda c: F.coalesce(c, F.lit(0.0)) >= 1 - 1e-9
    return F.when(F.coalesce(direct, F.lit(False)) | one(direct_em) | one(oracle_em), "other_hard").otherwise("persistent_c_like")


def console_line(label: Column, metrics: dict[str, Column], digits: int = 4) -> Column:
    """Metrics as one line of text: name=value with fixed digits, - for a missing one."""
    shown = [F.concat(F.lit(f" {k}="), F.when(v.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", v.cast("double")))) for k, v in metrics.items()]
    return F.concat(F.lit("["), label, F.lit("]"), *shown)
