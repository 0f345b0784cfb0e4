"""Tagged text: bodies, actions, evidence lines and state texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import let
from .text import all_matches, collapse, text

STEP_TAGS = ("think", "internal", "search", "evidence", "answer")


def bodies(c, tag: str, empty: bool = False) -> Column:
    """Trimmed bodies of closed tags in order; empty ones only on demand."""
    name = "(?:reasoning|think)" if tag == "reasoning" else tag
    found = F.transform(all_matches(c, f"(?is)<{name}>(.*?)</{name}>", 1), strip)
    return found if empty else F.filter(found, lambda b: b != "")


def closed(c, tag: str) -> Column:
    """The number of closed tags, empty ones too: one regular expression, no array."""
    name = "(?:reasoning|think)" if tag == "reasoning" else tag
    return F.regexp_count(text(c), F.lit(f"(?is)<{name}>.*?</{name}>"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_body(c, tag: str) -> Column:
    return F.get(bodies(c, tag, True), 0)


def last_body(c, tag: str) -> Column:
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), bodies(c, tag, True)), -1)


def loose_answer(c) -> Column:
    """A closed answer, or what stands before a lone end tag; null for none."""
    dangling = strip(F.regexp_extract(text(c), r"(?is)^(?:<answer>\s*)?(.*?)\s*</answer>", 1))
    open_ = F.when(F.lower(text(c)).contains("</answer>") & (dangling != ""), dangling)
    return F.coalesce(F.get(bodies(c, "answer"), 0), open_)


def open_evidence(c) -> Column:
    low = F.lower(text(c))
    body = strip(F.substr(text(c), F.instr(low, "<evidence>") + 10))
    return F.when(low.contains("<evidence>") & ~low.contains("</evidence>") & (body != ""), body)


def first_action(c) -> Column:
    """By priority, not by place: answer, search, internal."""
    has = {t: F.size(bodies(c, t)) > 0 for t in ("answer", "search", "internal")}
    return F.when(has["answer"], "answer").when(has["search"], "search").when(has["internal"], "internal")


_LINE = r"(?s)\[document_id=([^|\]]+?)\s*\|\s*title=(.*?)\s*\|\s*sentence_id=(\d+)\]\s*\n(.*?)(?=\n\[document_id=|\z)"


def evidence_lines(c) -> Column:
    """Cited sentences: array of (document_id, title, sentence_id, text)."""

    def parts(c: Column) -> Column:
        d, t, s, x = (all_matches(c, _LINE, k) for k in (1, 2, 3, 4))
        return F.transform(
            F.arrays_zip(d.alias("d"), t.alias("t"), s.alias("s"), x.alias("x")),
            lambda r: F.struct(
                F.trim(r["d"]).alias("document_id"), F.trim(r["t"]).alias("title"), r["s"].cast("int").alias("sentence_id"), collapse(r["x"]).alias("text")
            ),
        )

    return let(text(c), parts)


def evidence_keys(lines: Column) -> Column:
    return F.array_distinct(F.transform(lines, lambda r: F.struct(r["title"].alias("title"), r["sentence_id"].alias("sentence_id"))))


def tag_steps(c) -> Column:
    """Non-empty closed tags by place: array of (step_type, content, loss_mask); for texts without nested tags."""
    pattern = f"(?is)<({'|'.join(STEP_TAGS)})>(.*?)</\\1>"
    kinds, content = all_matches(c, pattern, 1), all_matches(c, pattern, 2)
    rows = F.transform(
        F.arrays_zip(kinds.alias("k"), content.alias("b")),
        lambda r: F.struct(F.lower(r["k"]).alias("step_type"), strip(r["b"]).alias("content"), F.lit(True).alias("loss_mask")),
    )
    return F.filter(rows, lambda r: r["content"] != "")


def reward_format(c) -> Column:
    """1 if there is an answer and not both search and internal up to the end of the first one."""
    cut = F.regexp_extract(text(c), r"(?is)^(.*?<answer>.*?</answer>)", 1)
    both = (closed(cut, "search") > 0) & (closed(cut, "internal") > 0)
    return F.when(F.coalesce(last_body(c, "answer"), F.lit("")) == "", 0.0).when(both, 0.0).otherwise(1.0)


def memory_missing(c) -> Column:
    """Up to three declared gaps; none for a lone 'none' or 'nothing'."""
    body = F.regexp_extract(text(c), r"(?is)(?:^|\n)\s*Missing\s*:\s*(.*?)(?=\n\s*(?:Decision|Next Query|Known)\s*:|\z)", 1)
    lines = F.transform(F.filter(F.split(body, "\n"), lambda s: F.trim(s) != ""), lambda s: F.trim(F.regexp_replace(s, r"^[-*]\s*", "")))
    none = (F.size(lines) == 1) & F.regexp_replace(F.lower(F.get(lines, 0)), r"\.+$", "").isin("none", "nothing")
    return F.when(none, F.array().cast("array<string>")).otherwise(F.slice(lines, 1, 3))


def memory_decision(c) -> Column:
    got = F.upper(F.regexp_extract(text(c), r"(?im)^\s*Decision\s*:\s*(SEARCH|ANSWER)\s*$", 1))
    return F.when(got != "", got)


def memory_next_query(c) -> Column:
    return F.trim(F.regexp_extract(text(c), r"(?im)^\s*Next Query\s*:\s*(.+?)\s*$", 1))


def state_question(c) -> Column:
    return strip(F.regexp_extract(text(c), r"(?s)^Question:\s*(.*?)\n\nCurrent Observation:", 1))


def state_observation(c) -> Column:
    return strip(F.regexp_extract(text(c), r"(?s)\n\nCurrent Observation:\s*(.*?)(?:\n\n<research_state>|\z)", 1))


def state_documents(observation: Column) -> Column:
    """Blocks that begin with [web_...]: array of (source_id, content)."""
    pattern = r"(?ms)^\[(web_[^\]]+)\]\s*(.*?)(?=^\[web_|\z)"

    def parts(o: Column) -> Column:
        ids, content = all_matches(o, pattern, 1), all_matches(o, pattern, 2)
        return F.transform(F.arrays_zip(ids.alias("i"), content.alias("c")), lambda r: F.struct(r["i"].alias("source_id"), strip(r["c"]).alias("content")))

    return let(observation, parts)
