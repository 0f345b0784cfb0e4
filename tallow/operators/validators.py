"""Validators: all errors of a record as an array, empty for a valid one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.scores import let
from ..functions.text import collapse, normalize_answer

# Step types, categories, fields of a record and of its costs, sources of reasoning that isn't pasted from evidence.
STEP_TYPES = ("think", "internal", "search", "observation", "evidence", "answer")
CATEGORIES = ("internal", "evidence", "evidence_reasoning", "search_format")
FIELDS = ("sample_id", "sft_id", "source_dataset", "category", "taxonomy_label", "messages", "target", "gold_answer", "gold_answers", "evidence_refs", "documents", "provenance", "metadata")
COSTS = ("search_count", "unique_query_count", "duplicate_query_count", "retrieved_document_count", "prompt_tokens", "generated_tokens", "observation_tokens", "latency_ms")
FREE_REASONING = ("kimi2.6", "teacher", "kimi", "pending")
PENDING = "__TEACHER_REASONING_PENDING__"


def _errors(*checks: Column) -> Column:
    return F.filter(F.flatten(F.array(*checks)), lambda e: e.isNotNull())


def _one(message: str, bad: Column) -> Column:
    return F.array(F.when(F.coalesce(bad, F.lit(False)), F.lit(message)))


def _each(items: Column, message: str, bad) -> Column:
    """The message for every item that is bad, with its place."""
    return F.transform(items, lambda s, i: F.when(F.coalesce(bad(s, i), F.lit(False)), F.concat(F.lit("["), i.cast("string"), F.lit(f"] {message}"))))


def step_errors(steps: Column) -> Column:
    """Errors of steps (step_id, step_type, content, loss_mask): ids from 0, known types, masks, contents, one answer at the end."""
    answers = F.filter(F.transform(steps, lambda s, i: F.when(s["step_type"] == "answer", i)), lambda i: i.isNotNull())
    known = lambda s: s["step_type"].isin(*STEP_TYPES)
    return _errors(
        _each(steps, "step_id must increase consecutively from 0", lambda s, i: s["step_id"] != i),
        _each(steps, "invalid step_type", lambda s, i: ~known(s)),
        _each(steps, "wrong loss_mask", lambda s, i: known(s) & (s["loss_mask"] != (s["step_type"] != "observation"))),
        _each(steps, "content must be non-empty", lambda s, i: F.coalesce(F.trim(s["content"]), F.lit("")) == ""),
        _one("record must contain exactly one answer step", F.size(answers) != 1),
        _one("the answer step must be the last step", (F.size(answers) == 1) & (F.get(answers, 0) != F.size(steps) - 1)),
    )


def reference_errors(cited: Column, available: Column) -> Column:
    """One error for each cited id that isn't available, as often as it is cited."""
    return F.transform(F.filter(cited, lambda x: ~F.array_contains(available, x)), lambda x: F.concat(F.lit("unknown id "), x))


def trace_errors(question: Column, steps: Column, documents: Column, evidences: Column, cost: Column) -> Column:
    """Errors of a trace.

    ``steps`` as in step_errors() with arrays ``document_ids`` and
    ``evidence_ids``; ``documents`` are ids; ``evidences`` has (evidence_id,
    document_id); ``cost`` has the fields of COSTS.
    """
    ids = F.transform(evidences, lambda e: e["evidence_id"])
    return _errors(
        _one("question must be non-empty", F.coalesce(F.trim(question), F.lit("")) == ""),
        step_errors(steps),
        _one("document ids must be unique", F.size(documents) != F.size(F.array_distinct(documents))),
        _one("evidence ids must be unique", F.size(ids) != F.size(F.array_distinct(ids))),
        reference_errors(F.transform(evidences, lambda e: e["document_id"]), documents),
        F.flatten(F.transform(steps, lambda s: reference_errors(s["document_ids"], documents))),
        F.flatten(F.transform(steps, lambda s: reference_errors(s["evidence_ids"], ids))),
        *[_one(f"{name} must be >= 0", cost[name] < 0) for name in COSTS],
    )


def message_errors(messages: Column) -> Column:
    """Errors of a prompt: it begins with the system, asks, and leaves the assistant's turn to the target."""
    roles = F.transform(messages, lambda m: m["role"])
    short = F.coalesce(F.size(messages) < 2, F.lit(True))
    return _errors(
        _one("messages must be [system, user, ...]", short),
        _one("messages must start with system and include user", ~short & ((F.get(roles, 0) != "system") | ~F.array_contains(roles, "user"))),
        _one("assistant must not be in messages", ~short & F.array_contains(roles, "assistant")),
    )


def _template(category: str, has: dict[str, Column]) -> Column:
    """Whether a category's tags are not those of its template."""
    wanted = {
        "internal": has["internal"] & ~has["search"] & ~has["evidence"] & ~has["reasoning"],
        "evidence": ~has["internal"] & ~has["search"] & has["evidence"] & ~has["reasoning"],
        "evidence_reasoning": ~has["internal"] & ~has["search"] & has["evidence"] & has["reasoning"],
        "search_format": ~has["internal"] & has["search"] & has["observation"] & has["evidence"],
    }
    return ~wanted[category]


def _reference_fields(refs: Column) -> Column:
    """Errors of references (document_id, title, sentence_id, text): a field that is null, a blank text."""
    return _errors(
        *[_each(refs, f"evidence_ref missing {k}", lambda r, i, k=k: r[k].isNull()) for k in ("document_id", "title", "sentence_id", "text")],
        _each(refs, "empty evidence text", lambda r, i: F.coalesce(collapse(r["text"]), F.lit("")) == ""),
    )


def evidence_block_errors(block: Column, refs: Column) -> Column:
    """Errors of a target's evidence block against the references: their number, then each field of each line."""
    # the lines are read once, not once a field
    return let(tags.evidence_lines(block), lambda lines: let(F.arrays_zip(lines.alias("line"), refs.alias("ref")), lambda pairs: _line_errors(lines, pairs, refs)))


def _line_errors(lines: Column, pairs: Column, refs: Column) -> Column:
    differs = {
        "document_id": lambda p: p["line"]["document_id"] != p["ref"]["document_id"],
        "title": lambda p: p["line"]["title"] != p["ref"]["title"],
        "sentence_id": lambda p: p["line"]["sentence_id"] != p["ref"]["sentence_id"],
        "text": lambda p: p["line"]["text"] != collapse(p["ref"]["text"]),
    }
    same = F.size(lines) == F.size(refs)
    per = F.flatten(F.array(*[_each(pairs, f"evidence {k} mismatch", lambda p, i, f=f: f(p)) for k, f in differs.items()]))
    return _errors(_one("evidence block count differs from refs", ~same), F.when(same, per).otherwise(F.array().cast("array<string>")))


def sft_errors(row: dict[str, Column]) -> Column:
    """Errors of a training row, given its FIELDS as columns; a null one is missing.

    ``messages`` has (role, content), ``evidence_refs`` (document_id, title,
    sentence_id, text), ``provenance`` reasoning_source and retriever_scope.
    The answer is the only one, the last tag, and the gold one; the tags are
    those of the category's template; the evidence block holds the references.
    """
    target = F.coalesce(row["target"], F.lit(""))
    bodies = {k: tags.bodies(target, k, True) for k in ("internal", "search", "observation", "evidence", "answer")}
    bodies["reasoning"] = F.regexp_extract_all(target, F.lit(r"(?is)<reasoning>(.*?)</reasoning>"), F.lit(1))
    # a target is read once a tag, not once a rule
    return let(F.struct(*[v.alias(k) for k, v in bodies.items()], target.alias("target")), lambda s: _target_errors(row, s["target"], {k: s[k] for k in bodies}))


def _target_errors(row: dict[str, Column], target: Column, bodies: dict[str, Column]) -> Column:
    category = row["category"]
    has = {k: F.size(v) > 0 for k, v in bodies.items()}
    refs = F.coalesce(row["evidence_refs"], F.array().cast("array<struct<document_id:string,title:string,sentence_id:int,text:string>>"))
    gold, one = F.coalesce(row["gold_answer"], F.lit("")), F.size(bodies["answer"]) == 1
    reasoning, source = tags.strip(F.get(bodies["reasoning"], 0)), F.coalesce(row["provenance"]["reasoning_source"], F.lit(""))
    is_ = {c: F.coalesce(category == c, F.lit(False)) for c in CATEGORIES}
    explained = is_["evidence_reasoning"] & ~_template("evidence_reasoning", has)
    unused = lambda r, i: (collapse(r["text"]) != "") & ~F.contains(collapse(reasoning), collapse(r["text"]))
    none = F.array().cast("array<string>")
    return _errors(
        *[_one(f"missing field {k}", row[k].isNull()) for k in FIELDS],
        _one("invalid category", F.coalesce(~category.isin(*CATEGORIES), F.lit(True))),
        message_errors(row["messages"]),
        _one("target must contain exactly one answer", ~one),
        _one("answer is not the gold one", one & (normalize_answer(F.get(bodies["answer"], 0)) != normalize_answer(gold))),
        _one("answer must be the final tag", one & ~target.rlike(r"(?is)<answer>.*?</answer>\s*\z")),
        _one("internal and search are mutually exclusive", has["internal"] & has["search"]),
        *[_one(f"{c} template invalid", is_[c] & _template(c, has)) for c in CATEGORIES],
        _one("internal must have no evidence_refs", is_["internal"] & (F.size(refs) > 0)),
        _one("pending reasoning placeholder mismatch", explained & (source == "pending") & (reasoning != PENDING)),
        _one("reasoning not answer-consistent", explained & (source != "pending") & (normalize_answer(gold) != "") & ~F.contains(normalize_answer(reasoning), normalize_answer(gold))),
        F.when(explained & ~source.isin(*FREE_REASONING), _each(refs, "reasoning misses the evidence text", unused)).otherwise(none),
        _one("full_corpus scope is forbidden", is_["search_format"] & (row["provenance"]["retriever_scope"] == "full_corpus")),
        _one("evidence_refs empty", ~is_["internal"] & (F.size(refs) == 0)),
        F.when(is_["internal"], none).otherwise(_reference_fields(refs)),
        F.when(~is_["internal"] & has["evidence"], evidence_block_errors(F.get(bodies["evidence"], 0), refs)).otherwise(none),
    )


def turns_valid(turns: Column, roles: list[str]) -> Column:
    return F.forall(turns, lambda x: x["from"].isin(roles) & (F.trim(x["value"]) != ""))
