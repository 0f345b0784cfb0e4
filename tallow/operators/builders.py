"""Nested training records as structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def sft_row(sample_id: Column, category: str, question: Column, target: Column, golds: Column, view: str = "v1") -> list[Column]:
    key = F.concat_ws("__", sample_id, F.lit(category), F.lit(view))
    return [
        sample_id.alias("sample_id"),
        key.alias("sft_id"),
        F.lit(category).alias("category"),
        F.array(turn("user", F.concat(F.lit("Question: "), question)), turn("assistant", target)).alias("messages"),
        target.alias("target"),
        F.get(golds, 0).alias("gold_answer"),
        golds.alias("gold_answers"),
    ]


def tagged(**parts: Column) -> Column:
    """Tags around bodies, in order, joined by line ends."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"<{k}>\n"), v, F.lit(f"\n</{k}>")) for k, v in parts.items()])


def evidence_block(refs: Column) -> Column:
    """References (document_id, title, sentence_id, text) as cited lines."""
    line = lambda r: F.concat(F.lit("[document_id="), r["document_id"], F.lit(" | title="), r["title"], F.lit(" | sentence_id="), r["sentence_id"].cast("string"), F.lit("]\n"), r["text"])
    return F.array_join(F.transform(refs, line), "\n")


def documents_block(documents: Column) -> Column:
    """Documents (title, text) as numbered paragraphs."""
    return F.array_join(F.transform(documents, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d["title"], F.lit("\n"), d["text"])), "\n\n")


def target(category: str, question: Column, gold: Column, refs: Column, documents: Column, reasoning: Column | None = None) -> Column:
    """What a row of a category should answer."""
    cited = evidence_block(refs)
    return {
        "internal": lambda: tagged(internal=F.lit("Use internal knowledge."), answer=gold),
        "evidence": lambda: tagged(evidence=cited, answer=gold),
        "evidence_reasoning": lambda: tagged(evidence=cited, reasoning=reasoning, answer=gold),
        "search_format": lambda: tagged(search=question, observation=documents_block(documents), evidence=cited, answer=gold),
    }[category]()


def user_turn(category: str, question: Column, documents: Column) -> Column:
    """The question, with the documents for the categories that read evidence."""
    asked = F.concat(F.lit("Question: "), question)
    return F.concat(asked, F.lit("\n\nDocuments:\n"), documents_block(documents)) if category.startswith("evidence") else asked


def template_reasoning(refs: Column, gold: Column) -> Column:
    """A rationale that holds every reference's text and the answer."""
    return F.concat(F.array_join(F.transform(refs, lambda r: r["text"]), " "), F.lit(" Therefore, the answer is "), gold, F.lit("."))


def packed_documents(contexts: Column, facts: Column, noisy: bool, order, most: int = 3) -> Column:
    """Input documents of a row: (title, text, role, rank).

    A clean view has the supporting titles' contexts, in the order of the
    facts; a noisy one has ``most`` others among them.  ``order`` gives the
    key that picks and orders them by, from a title.
    """
    titles = F.array_distinct(F.transform(facts, lambda f: f["title"]))
    of = lambda t: F.element_at(F.filter(contexts, lambda c: c["title"] == t), -1)["text"]
    gold = F.transform(F.filter(titles, lambda t: F.exists(contexts, lambda c: c["title"] == t)), lambda t: F.struct(t.alias("title"), of(t).alias("text"), F.lit("gold_supporting").alias("role")))
    by_key = lambda docs: F.transform(F.array_sort(F.transform(docs, lambda d: F.struct(order(d["title"]).alias("key"), d.alias("d")))), lambda x: x["d"])
    others = F.filter(contexts, lambda c: ~F.array_contains(titles, c["title"]))
    others = F.transform(others, lambda c: F.struct(c["title"].alias("title"), c["text"].alias("text"), F.lit("distractor").alias("role")))
    packed = by_key(F.concat(gold, F.slice(by_key(others), 1, most))) if noisy else gold
    return F.transform(packed, lambda d, i: F.struct(d["title"].alias("title"), d["text"].alias("text"), d["role"].alias("role"), (i + 1).alias("rank")))


def sharegpt(messages: Column) -> Column:
    table = F.create_map(*map(F.lit, ("user", "human", "assistant", "gpt", "tool", "observation")))
    return F.transform(messages, lambda m: F.struct(F.element_at(table, m["role"]).alias("from"), m["content"].alias("value")))


def rl_row(sample_id: Column, question: Column, golds: Column, split: str) -> list[Column]:
    truth = F.struct(golds.alias("target"))
    extra = F.struct(F.lit(split).alias("split"), sample_id.alias("sample_id"), question.alias("question"))
    return [
        F.lit("search_agent").alias("data_source"),
        F.array(turn("user", F.concat(F.lit("Question: "), question))).alias("prompt"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        extra.alias("extra_info"),
    ]


def decision_examples(df: DataFrame, key: str, messages: str = "messages", most: int = 80) -> DataFrame:
    """One row for each assistant turn: the turns before it, older observations cut to ``most`` characters, and the target."""
    places = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull())
    rows = df.select(key, messages, F.explode(places).alias("at"))
    before = F.transform(
        F.slice(messages, F.lit(1), F.col("at")),
        lambda m, i: F.when((i < F.col("at") - 1) & (m["role"] == "user"), m.withField("content", F.substring(m["content"], 1, most))).otherwise(m),
    )
    return rows.select(key, F.col("at").alias("decision"), before.alias("context"), F.get(messages, F.col("at"))["content"].alias("target"))


def dpo_pairs(df: DataFrame, key: str, depth: Column, stop: Column, go: Column) -> DataFrame:
    """One pair at depth 1 (stop beats go), two beyond (go beats stop first, then stop beats go)."""
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("pair_type"), a.alias("chosen"), b.alias("rejected"))
    one, two = F.array(pair("stop", stop, go)), F.array(pair("continue", go, stop), pair("stop", stop, go))
    rows = df.select(key, F.explode(F.when(depth == 1, one).otherwise(two)).alias("p"))
    return rows.select(key, F.concat_ws("__", F.col(key).cast("string"), "p.pair_type").alias("pair_id"), "p.*")


def compact(documents: Column, most: int = 1800) -> Column:
    """Documents labelled D1, D2, ... with cut texts."""
    return F.transform(documents, lambda d, i: F.struct(F.concat(F.lit("D"), (i + 1).cast("string")).alias("id"), F.substring(d, 1, most).alias("text")))


# The mark of reasoning that a teacher will write, and the stamps of the phases.
PENDING = "__TEACHER_REASONING_PENDING__"
STAMPS = {
    "coldstart": {"builder": "build_coldstart_v0", "phase": "2C", "internal": "internal_direct_correct", "search_format": "search_format_train"},
    "eightb": {"builder": "build_8b_coldstart_v2", "phase": "1.5C", "evidence": "evidence_v2", "evidence_reasoning": "evidence_reasoning_v2"},
}
VIEWS = {("coldstart", "internal"): "direct_v0", ("coldstart", "search_format"): "cand_v0", ("eightb", "evidence"): "v2", ("eightb", "evidence_reasoning"): "v2"}


def stamped(sample_id: Column, recipe: str, category: str, seed: int) -> list[Column]:
    """``sft_id`` and ``metadata`` of a training row of a recipe."""
    stamp = STAMPS[recipe]
    metadata = {"builder": stamp["builder"], "phase": stamp["phase"], "mix_tag": stamp[category], "source_split": "train", "seed": str(seed)}
    return [F.concat_ws("__", sample_id, F.lit(category), F.lit(VIEWS[recipe, category])).alias("sft_id"), F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]).alias("metadata")]


def pending_target(gold: Column, refs: Column) -> Column:
    """Evidence and answer around reasoning that isn't written yet."""
    return tagged(evidence=evidence_block(refs), think=F.lit(PENDING), answer=gold)


def failed_search(query: Column, provider: str, top_k: int, error_type: Column, error: Column, elapsed: Column) -> Column:
    """What a search gives that failed: no documents, one error, and only its own time."""
    ms = F.round(elapsed, 2)
    zero = lambda *names: [F.lit(0).alias(n) for n in names]
    return F.struct(
        query.alias("query"),
        F.struct(F.lit(provider).alias("name"), F.lit("live_web").alias("scope"), F.lit(top_k).alias("top_k"), F.lit(False).alias("search_ok")).alias("retriever"),
        F.array().cast("array<string>").alias("documents"),
        F.array(F.struct(F.lit("search").alias("stage"), error_type.alias("error_type"), ms.alias("elapsed_ms"), F.substring(error, 1, 300).alias("error"))).alias("errors"),
        F.struct(ms.alias("search_api_ms"), F.lit(0.0).alias("fetch_total_ms"), F.lit(0.0).alias("extract_ms"), ms.alias("tool_total_ms"), *zero("success_urls", "failed_urls", "filtered_urls")).alias("timing"),
    )
