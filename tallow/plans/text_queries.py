"""Queries over text functions, tags and per-row scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, tags, text
from . import sql as q
from .registry import qa_bags, query


@query("x01_normalize_answer", f"SELECT doc_id, {q.norm('text')} AS v FROM documents")
def _(t):
    return t.documents.select("doc_id", text.normalize_answer("text").alias("v"))


@query("x02_collapse_space", f"SELECT doc_id, {q.collapse('text')} AS v FROM documents")
def _(t):
    return t.documents.select("doc_id", text.collapse("text").alias("v"))


@query("x03_query_key", f"SELECT doc_id, {q.key('text')} AS v FROM documents")
def _(t):
    return t.documents.select("doc_id", text.query_key("text").alias("v"))


@query("x04_loose_query", rf"SELECT doc_id, {q.collapse(f"regexp_replace(lower(text), '{q.PUNCT}', ' ', 'g')")} AS v FROM documents")
def _(t):
    return t.documents.select("doc_id", text.loose_query("text").alias("v"))


@query(
    "x05_canonical_url",
    r"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1))
    || rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS v FROM pages""",
)
def _(t):
    return t.pages.select("page_id", text.canonical_url("url").alias("v"))


def _sets(x: str) -> str:
    return f"list_sort({x})"


@query(
    "x06_token_sets",
    f"""SELECT doc_id, {_sets(q.keyset('lower(body)', '[a-z0-9]{3,}'.replace('{3,}', '{3,}')))} AS web,
    {_sets(q.keyset('lower(body)', "[a-z0-9][a-z0-9''-]{2,}", text.WEB_STOP))} AS state,
    {_sets(q.keyset('lower(body)', "[a-z0-9]+(?:''[a-z0-9]+)?", text.CAPABILITY_STOP, 3))} AS capability,
    {_sets(f"list_filter(list_distinct(list_transform(regexp_extract_all(body, '[A-Za-z0-9][A-Za-z0-9_-]*'), lambda x: lower(x))), lambda x: x NOT IN {q.words(text.CONTROLLER_STOP)})")} AS controller,
    list_transform(regexp_extract_all(body, '[A-Za-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]'), lambda x: lower(x)) AS terms FROM qa""",
)
def _(t):
    s = F.sort_array  # without a comparator
    return t.qa.select(
        "doc_id",
        s(text.web_tokens("body")).alias("web"),
        s(text.state_words("body")).alias("state"),
        s(text.capability_tokens("body")).alias("capability"),
        s(text.controller_words("body")).alias("controller"),
        text.bm25_terms("body").alias("terms"),
    )


@query(
    "x07_closed_tags",
    "SELECT doc_id, " + ", ".join(f"{q.bodies('chunk', x)} AS {x}_tags" for x in ("internal", "search", "evidence", "answer", "reasoning")) + " FROM tagged",
)
def _(t):
    return t.tagged.select("doc_id", *[tags.bodies("chunk", x).alias(f"{x}_tags") for x in ("internal", "search", "evidence", "answer", "reasoning")])


@query(
    "x08_first_last_body",
    f"SELECT doc_id, {q.bodies('chunk', 'answer', True)}[1] AS first_answer, {q.bodies('chunk', 'answer', True)}[-1] AS last_answer FROM tagged",
)
def _(t):
    return t.tagged.select("doc_id", tags.first_body("chunk", "answer").alias("first_answer"), tags.last_body("chunk", "answer").alias("last_answer"))


@query(
    "x09_loose_recovery",
    rf"""WITH x AS (SELECT doc_id, chunk, {q.strip(r"regexp_extract(chunk, '(?is)^(?:<answer>\s*)?(.*?)\s*</answer>', 1)")} AS loose,
    {q.strip("substr(chunk, instr(lower(chunk), '<evidence>') + 10)")} AS ev FROM tagged)
    SELECT doc_id, coalesce({q.bodies('chunk', 'answer')}[1], CASE WHEN contains(lower(chunk), '</answer>') AND loose <> '' THEN loose END) AS answer,
    CASE WHEN contains(lower(chunk), '<evidence>') AND NOT contains(lower(chunk), '</evidence>') AND ev <> '' THEN ev END AS evidence FROM x""",
)
def _(t):
    return t.tagged.select("doc_id", tags.loose_answer("chunk").alias("answer"), tags.open_evidence("chunk").alias("evidence"))


@query(
    "x10_first_action",
    f"""SELECT doc_id, CASE WHEN len({q.bodies('chunk', 'answer')}) > 0 THEN 'answer' WHEN len({q.bodies('chunk', 'search')}) > 0 THEN 'search'
    WHEN len({q.bodies('chunk', 'internal')}) > 0 THEN 'internal' END AS action FROM tagged""",
)
def _(t):
    return t.tagged.select("doc_id", tags.first_action("chunk").alias("action"))


#: Each block of lines that begins with a citation; RE2 has no look-ahead.
_LINES = rf"""SELECT doc_id, list_filter(string_split(coalesce({q.bodies('chunk', 'evidence', True)}[1], ''), chr(10) || '[document_id='), lambda x: x <> '') AS parts FROM tagged"""
_LINE = r"(?s)^(?:\[document_id=)?([^|\]]+?)\s*\|\s*title=(.*?)\s*\|\s*sentence_id=(\d+)\]\s*\n(.*)$"


@query(
    "x11_evidence_lines",
    f"""WITH l AS ({_LINES}), e AS (SELECT doc_id, unnest(parts) AS p, unnest(range(len(parts))) AS i FROM l)
    SELECT doc_id, i AS line, trim(regexp_extract(p, '{_LINE}', 1)) AS document_id, trim(regexp_extract(p, '{_LINE}', 2)) AS title,
    CAST(regexp_extract(p, '{_LINE}', 3) AS INT) AS sentence_id, {q.collapse(f"regexp_extract(p, '{_LINE}', 4)")} AS text FROM e""",
)
def _(t):
    rows = t.tagged.select("doc_id", F.posexplode(tags.evidence_lines(tags.first_body("chunk", "evidence"))).alias("line", "r"))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), "r.*")


_P, _G = q.toks("prediction"), q.toks("g")
_BEST = f"""WITH each_gold AS (SELECT doc_id, {_P} AS p, unnest(list_transform(golds, lambda gg: {q.toks('gg')})) AS g, unnest(range(len(golds))) AS i FROM qa),
 counted AS (SELECT *, {q.common('p', 'g')} AS n FROM each_gold),
 scored AS (SELECT doc_id, i, {q.f1('n', 'len(p)', 'len(g)')} AS f1,
   CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN len(p) = 0 OR len(g) = 0 THEN 0.0::DOUBLE ELSE n::DOUBLE / len(p) END AS precision,
   CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN len(p) = 0 OR len(g) = 0 THEN 0.0::DOUBLE ELSE n::DOUBLE / len(g) END AS recall FROM counted)"""


@query("x12_token_f1", f"{_BEST} SELECT doc_id, f1, precision, recall FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY f1 DESC, i) = 1")
def _(t):
    return t.qa_bags.select("doc_id", scores.best_of(F.col("p"), F.col("golds")).alias("s")).select("doc_id", "s.*")


@query("x13_exact_match", f"SELECT doc_id, CAST(list_contains(list_transform(golds, lambda g: {q.norm('g')}), {q.norm('prediction')}) AS DOUBLE) AS em FROM qa")
def _(t):
    return t.qa_bags.select("doc_id", F.array_contains("texts", F.col("answer")).cast("double").alias("em"))


_SETS = "WITH s AS (SELECT doc_id, {a} AS a, {b} AS b FROM qa), n AS (SELECT *, len(list_intersect(a, b)) AS n FROM s)".format(
    a=q.keyset("lower(prediction)", "[a-z0-9]{3,}"), b=q.keyset("lower(golds[2])", "[a-z0-9]{3,}")
)


@query(
    "x14_set_prf",
    f"""{_SETS} SELECT doc_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE n::DOUBLE / len(a) END, 4) AS precision,
    round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE n::DOUBLE / len(b) END, 4) AS recall,
    round({q.f1('n', 'len(a)', 'len(b)')}, 4) AS f1 FROM n""",
)
def _(t):
    got = scores.set_prf(text.web_tokens("prediction"), text.web_tokens(F.get("golds", 1)))
    return t.qa.select("doc_id", got.alias("s")).select("doc_id", "s.*")


@query(
    "x15_joint_scores",
    f"""{_BEST}, w AS (SELECT doc_id, min(CASE WHEN i = 0 THEN f1 END) AS f1a, min(CASE WHEN i = 0 THEN precision END) AS pa, min(CASE WHEN i = 0 THEN recall END) AS ra,
    min(CASE WHEN i = 1 THEN precision END) AS pb, min(CASE WHEN i = 1 THEN recall END) AS rb FROM scored GROUP BY doc_id)
    SELECT doc_id, pa * pb AS precision, ra * rb AS recall, CASE WHEN pa * pb + ra * rb > 0 THEN 2 * (pa * pb) * (ra * rb) / (pa * pb + ra * rb) ELSE 0.0::DOUBLE END AS f1 FROM w""",
)
def _(t):
    a, b = (scores.bag_prf(F.col("p"), F.get("golds", k)) for k in (0, 1))
    rows = t.qa_bags.select("doc_id", a.alias("a"), b.alias("b"))
    return rows.select("doc_id", scores.joint(F.col("a"), F.col("b")).alias("s")).select("doc_id", "s.*")


@query(
    "x16_jaccard",
    f"{_SETS} SELECT doc_id, CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE n::DOUBLE / (len(a) + len(b) - n) END AS jaccard FROM n",
)
def _(t):
    return t.qa.select("doc_id", scores.jaccard(text.web_tokens("prediction"), text.web_tokens(F.get("golds", 1))).alias("jaccard"))


_ORD = "CASE lower(ow) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.ORDINALS.items()) + " ELSE ow END"


def _expand(x: str) -> str:
    return rf"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '\s+'), lambda ov: ov <> ''), lambda ow: {_ORD}), ' ')"


_ACCEPT = f"""WITH base AS (SELECT doc_id, {_expand("CASE WHEN doc_id % 3 = 0 THEN '3rd ' || string_split(prediction, ' ')[1] WHEN doc_id % 3 = 1 THEN coalesce(string_split(golds[2], ' ')[2], '') ELSE prediction END")} AS prediction,
  list_transform(golds, lambda g: {_expand('g')}) AS golds FROM qa),
 each_gold AS (SELECT doc_id, {_P} AS p, unnest(list_transform(golds, lambda gg: {q.toks('gg')})) AS g FROM base),
 counted AS (SELECT *, {q.common('p', 'g')} AS n FROM each_gold)
 SELECT doc_id, max(CASE WHEN len(p) BETWEEN 1 AND 2 AND len(list_filter(p, lambda x: NOT list_contains(g, x))) = 0 THEN 1.0::DOUBLE ELSE {q.f1('n', 'len(p)', 'len(g)')} END) AS f1
 FROM counted GROUP BY doc_id"""


@query("x17_acceptance_f1", _ACCEPT)
def _(t):
    word = lambda c, k: F.coalesce(F.get(F.split(c, " "), k), F.lit(""))
    kind = F.col("doc_id") % 3
    few = F.when(kind == 0, F.concat(F.lit("3rd "), word("line", 0))).when(kind == 1, word("next", 1))
    p = F.when(kind == 2, F.col("p")).otherwise(scores.answer_bag(text.expand_ordinals(few)))
    return qa_bags(t, text.expand_ordinals).select("doc_id", scores.acceptance_of(p, F.col("golds")).alias("f1"))


_HAS = {x: f"len({q.bodies('chunk', x, True)}) > 0" for x in ("internal", "search", "answer", "evidence", "reasoning")}


@query(
    "x18_protocol_flags",
    f"""SELECT doc_id, {_HAS['answer']} AS answer_tag, {_HAS['evidence']} AS evidence_tag, {_HAS['reasoning']} AS think_tag,
    ({_HAS['answer']}) AND (({_HAS['evidence']}) OR ({_HAS['reasoning']})) AND NOT (({_HAS['internal']}) AND ({_HAS['search']})) AS evidence_valid,
    ({_HAS['internal']}) <> ({_HAS['search']}) AS exclusive_route FROM tagged""",
)
def _(t):
    has = {x: tags.closed("chunk", x) > 0 for x in _HAS}
    return t.tagged.select(
        "doc_id",
        has["answer"].alias("answer_tag"),
        has["evidence"].alias("evidence_tag"),
        has["reasoning"].alias("think_tag"),
        (has["answer"] & (has["evidence"] | has["reasoning"]) & ~(has["internal"] & has["search"])).alias("evidence_valid"),
        (has["internal"] != has["search"]).alias("exclusive_route"),
    )


@query(
    "x19_evidence_use_score",
    f"""SELECT doc_id, CAST(({_HAS['answer']}) AS DOUBLE) AS answered, CAST(len(list_filter(string_split(coalesce({q.bodies('chunk', 'evidence', True)}[1], ''), '[document_id='), lambda x: x <> '')) AS BIGINT) AS cited,
    CASE WHEN ({_HAS['internal']}) AND NOT ({_HAS['search']}) THEN 'internal' WHEN ({_HAS['search']}) AND NOT ({_HAS['internal']}) THEN 'search'
      WHEN {_HAS['search']} THEN 'both' ELSE 'none' END AS route FROM tagged""",
)
def _(t):
    has = {x: tags.closed("chunk", x) > 0 for x in _HAS}
    route = (
        F.when(has["internal"] & ~has["search"], "internal").when(has["search"] & ~has["internal"], "search").when(has["search"], "both").otherwise("none")
    )
    cited = F.size(tags.evidence_lines(F.coalesce(tags.first_body("chunk", "evidence"), F.lit("")))).cast("long")
    return t.tagged.select("doc_id", has["answer"].cast("double").alias("answered"), cited.alias("cited"), route.alias("route"))


_CUT = "regexp_extract(chunk, '(?is)^(.*?<answer>.*?</answer>)', 1)"


@query(
    "x20_reward_format",
    f"""SELECT doc_id, CASE WHEN coalesce({q.bodies('chunk', 'answer', True)}[-1], '') = '' THEN 0.0::DOUBLE
    WHEN len({q.bodies(_CUT, 'search', True)}) > 0 AND len({q.bodies(_CUT, 'internal', True)}) > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS format FROM tagged""",
)
def _(t):
    return t.tagged.select("doc_id", tags.reward_format("chunk").alias("format"))


@query("x21_evidence_reward", f"{_SETS} SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE {q.f1('n', 'len(a)', 'len(b)')} END AS f1 FROM n")
def _(t):
    return t.qa.select("doc_id", scores.evidence_reward(text.web_tokens("prediction"), text.web_tokens(F.get("golds", 1))).alias("f1"))


@query(
    "x22_reward",
    f"""WITH s AS (SELECT doc_id, CAST(({_HAS['answer']}) AS DOUBLE) AS em, CAST(({_HAS['evidence']}) AS DOUBLE) AS ev, CAST(({_HAS['reasoning']}) AS DOUBLE) AS fmt,
      len({q.bodies('chunk', 'search', True)})::DOUBLE AS n FROM tagged)
    SELECT doc_id, 1.0::DOUBLE * em + 0.5::DOUBLE * ev + 0.1::DOUBLE * fmt - 0.0::DOUBLE * n - 0.0::DOUBLE * n AS reward,
      1.0::DOUBLE * em + 0.5::DOUBLE * ev + 0.1::DOUBLE * fmt - 0.25::DOUBLE * n - 0.5::DOUBLE * n AS costly FROM s""",
)
def _(t):
    has = {x: (tags.closed("chunk", x) > 0).cast("double") for x in _HAS}
    rows = t.tagged.select("doc_id", *[has[x].alias(x) for x in ("answer", "evidence", "reasoning")], tags.closed("chunk", "search").cast("double").alias("n"))
    own = tuple(F.col(x) for x in ("answer", "evidence", "reasoning", "n", "n"))
    return rows.select("doc_id", scores.reward(*own).alias("reward"), scores.reward(*own, (1.0, 0.5, 0.1, 0.25, 0.5)).alias("costly"))


@query(
    "x23_search_count_fallback",
    f"""SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 7 END, CASE WHEN doc_id % 3 = 1 THEN 8 END, CAST(len({q.bodies('chunk', 'search', True)}) AS BIGINT)) AS searches FROM tagged""",
)
def _(t):
    a, b = F.when(F.col("doc_id") % 3 == 0, F.lit(7)), F.when(F.col("doc_id") % 3 == 1, F.lit(8))
    return t.tagged.select("doc_id", F.coalesce(a, b, tags.closed("chunk", "search")).cast("long").alias("searches"))


_GLUE = "the and of to in is was for on with that this by as at from it be are".split()
_CT = lambda x: f"list_filter(list_distinct(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9''-]{{2,}}|[0-9]{{3,4}}'), lambda w: lower(w))), lambda w: w NOT IN {q.words(_GLUE)})"


@query(
    "x25_evidence_coverage",
    f"""WITH s AS (SELECT doc_id, {_CT('prediction')} AS r, {_CT('golds[2]')} AS e FROM qa), n AS (SELECT *, CAST(len(list_intersect(r, e)) AS BIGINT) AS shared FROM s)
    SELECT doc_id, shared, len(e) > 0 AND shared >= CASE WHEN len(e) >= 4 THEN 2 ELSE 1 END AS used FROM n""",
)
def _(t):
    r, e = text.content_tokens("prediction", _GLUE), text.content_tokens(F.get("golds", 1), _GLUE)
    shared = F.size(F.array_intersect(r, e)).cast("long")
    used = (F.size(e) > 0) & (shared >= F.when(F.size(e) >= 4, 2).otherwise(1))
    return t.qa.select("doc_id", shared.alias("shared"), used.alias("used"))


_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"


@query(
    "x29_canonical_date",
    rf"""WITH s AS (SELECT event_id, strftime(ts, '%Y%B') || CAST(day(ts) AS VARCHAR) || ', ' || strftime(ts, '%Y') AS blob FROM events)
    SELECT event_id, lower(regexp_extract(blob, '({_MONTH})(\d{{1,2}}),?\s*(\d{{4}})', 1)) || ' ' || CAST(CAST(regexp_extract(blob, '({_MONTH})(\d{{1,2}}),?\s*(\d{{4}})', 2) AS INT) AS VARCHAR)
    || ' ' || regexp_extract(blob, '({_MONTH})(\d{{1,2}}),?\s*(\d{{4}})', 3) AS v FROM s""",
)
def _(t):
    blob = F.concat(F.date_format("ts", "yyyyMMMM"), F.day("ts").cast("string"), F.lit(", "), F.date_format("ts", "yyyy"))
    part = lambda k: F.regexp_extract(blob, rf"({_MONTH})(\d{{1,2}}),?\s*(\d{{4}})", k)
    return t.events.select("event_id", text.normalize_answer(F.concat_ws(" ", part(1), part(2).cast("int").cast("string"), part(3))).alias("v"))


@query(
    "x32_json_salvage",
    r"""WITH s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no json' ELSE 'text ' || chr(96) || chr(96) || chr(96) || 'json' || chr(10) || props || chr(10) || 'tail' END AS raw FROM events)
    SELECT event_id, CAST(regexp_extract(regexp_extract(raw, '(?s)\{.*\}'), '"k": *([0-9]+)', 1) AS VARCHAR) AS k, NOT contains(raw, '{') AS failed FROM s WHERE contains(raw, '{')
    UNION ALL SELECT event_id, NULL, true FROM s WHERE NOT contains(raw, '{')""",
)
def _(t):
    raw = F.when(F.col("event_id") % 5 == 0, "no json").otherwise(F.concat(F.lit("text ```json\n"), "props", F.lit("\ntail")))
    parsed = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "k long")
    return t.events.select("event_id", parsed["k"].cast("string").alias("k"), parsed["k"].isNull().alias("failed"))


@query(
    "x33_sentences",
    rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。！？；;])\s*', '\1' || chr(1), 'g'), '\x01|\n+'), lambda x: {q.collapse('x')}), lambda x: x <> '') AS pieces FROM documents),
    c AS (SELECT doc_id, flatten(list_transform(pieces, lambda s: list_transform(range(0, CAST(length(s) AS BIGINT), 360), lambda i: substr(s, i + 1, 360)))) AS cut FROM p)
    SELECT doc_id, list_filter(cut, lambda x: length(x) >= 20) AS sentences,
    CAST((SELECT len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> '')) FROM documents d WHERE d.doc_id = c.doc_id) AS BIGINT) AS n FROM c""",
)
def _(t):
    return t.documents.select("doc_id", text.sentences("text").alias("sentences"), text.sentence_count("text").alias("n"))


_STATE = "'Question: ' || question || chr(10) || chr(10) || 'Current Observation: ' || '[web_1] ' || golds[2] || chr(10) || '[web_2] ' || prediction || chr(10) || chr(10) || '<research_state>x'"


@query(
    "x34_state_text",
    f"""WITH s AS (SELECT doc_id, {_STATE} AS state FROM qa), o AS (SELECT doc_id, {q.strip("string_split(substr(state, 11), chr(10) || chr(10) || 'Current Observation:')[1]")} AS question,
    {q.strip("string_split(string_split(state, chr(10) || chr(10) || 'Current Observation:')[2], chr(10) || chr(10) || '<research_state>')[1]")} AS observation FROM s),
    b AS (SELECT doc_id, question, unnest(list_filter(string_split(observation, '[web_'), lambda x: x <> '')) AS block FROM o)
    SELECT doc_id, question, 'web_' || string_split(block, ']')[1] AS source_id, {q.strip("substr(block, instr(block, ']') + 1)")} AS content FROM b""",
)
def _(t):
    state = F.concat(F.lit("Question: "), "question", F.lit("\n\nCurrent Observation: [web_1] "), F.get("golds", 1), F.lit("\n[web_2] "), "prediction", F.lit("\n\n<research_state>x"))
    rows = t.qa.select("doc_id", state.alias("state"))
    rows = rows.select("doc_id", tags.state_question("state").alias("question"), F.explode(tags.state_documents(tags.state_observation("state"))).alias("d"))
    return rows.select("doc_id", "question", "d.*")


_MEMO = "CASE WHEN doc_id % 4 = 0 THEN 'Known: x' || chr(10) || 'Missing: None.' || chr(10) || 'Decision: ANSWER' ELSE 'Missing:' || chr(10) || '- ' || string_split(prediction, ' ')[1] || chr(10) || '- b' || chr(10) || 'Decision: search' || chr(10) || 'Next Query: ' || question END"


@query(
    "x35_memory_text",
    f"""WITH m AS (SELECT doc_id, {_MEMO} AS memo, string_split(prediction, ' ')[1] AS w, {q.strip('question')} AS nq FROM qa)
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN [] ELSE list_concat(list_filter(list_transform(string_split(w, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ['b'])[1:3] END AS missing, upper(regexp_extract(memo, '(?im)^\\s*Decision\\s*:\\s*(SEARCH|ANSWER)\\s*$', 1)) AS decision,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE trim(string_split(nq, chr(10))[1]) END AS next_query FROM m""",
)
def _(t):
    w = F.get(F.split("prediction", " "), 0)
    known = F.lit("Known: x\nMissing: None.\nDecision: ANSWER")
    memo = F.when(F.col("doc_id") % 4 == 0, known).otherwise(F.concat(F.lit("Missing:\n- "), w, F.lit("\n- b\nDecision: search\nNext Query: "), "question"))
    return t.qa.filter("not question rlike '\\n'").unionByName(t.qa.filter("question rlike '\\n'")).select(
        "doc_id", tags.memory_missing(memo).alias("missing"), tags.memory_decision(memo).alias("decision"), tags.memory_next_query(memo).alias("next_query")
    )


@query("x36_observation_format", "SELECT conv_id, string_agg('[' || conv_id || '_' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS v FROM conversations GROUP BY conv_id")
def _(t):
    doc = F.struct("turn", F.concat(F.lit("["), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(": "), "text").alias("x"))
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(doc)).alias("d"))
    return rows.select("conv_id", F.array_join(F.transform("d", lambda d: d["x"]), "\n").alias("v"))


@query(
    "x37_chat_serialization",
    """SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '<|im_start|>system' || chr(10) || text || '<|im_end|>' || chr(10)
      WHEN 'user' THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
      ELSE text || '<|im_end|>' || chr(10) END, '' ORDER BY turn) AS v FROM conversations GROUP BY conv_id""",
)
def _(t):
    end = F.lit("<|im_end|>\n")
    m = lambda x: (
        F.when(x["role"] == "system", F.concat(F.lit("<|im_start|>system\n"), x["text"], end))
        .when(x["role"] == "user", F.concat(F.lit("<|im_start|>user\n"), x["text"], end, F.lit("<|im_start|>assistant\n")))
        .otherwise(F.concat(x["text"], end))
    )
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("d"))
    return rows.select("conv_id", F.aggregate("d", F.lit(""), lambda a, x: F.concat(a, m(x))).alias("v"))


@query(
    "x38_truncate_at_stop",
    """WITH p AS (SELECT doc_id, chunk, nullif(instr(chunk, '</search>'), 0) + 8 AS a, nullif(instr(chunk, '</answer>'), 0) + 8 AS b FROM tagged)
    SELECT doc_id, CASE WHEN a IS NULL AND b IS NULL THEN chunk ELSE substr(chunk, 1, least(coalesce(a, b), coalesce(b, a))) END AS v FROM p""",
)
def _(t):
    return t.tagged.select("doc_id", text.truncate_at("chunk", ["</search>", "</answer>"]).alias("v"))


@query(
    "x40_masked_split",
    """WITH s AS (SELECT doc_id, string_split(prediction, ' ') AS ids FROM qa)
    SELECT doc_id, list_filter(ids, lambda x, i: (i - 1) % 3 <> 0) AS kept, list_filter(ids, lambda x, i: (i - 1) % 3 = 0) AS dropped FROM s""",
)
def _(t):
    rows = t.qa.select("doc_id", F.split("prediction", " ").alias("ids")).withColumn("mask", F.transform("ids", lambda x, i: (i % 3 != 0).cast("int")))
    part = lambda v: F.transform(F.filter(F.arrays_zip("ids", "mask"), lambda x: x["mask"] == v), lambda x: x["ids"])
    return rows.select("doc_id", part(1).alias("kept"), part(0).alias("dropped"))


@query(
    "x41_tag_rewrite",
    f"""SELECT doc_id, replace(replace(replace(chunk, '<think>', '<reasoning>'), '</think>', '</reasoning>'), '<reasoning>', '<think>') AS think,
    coalesce({q.bodies('chunk', 'search')}[1], '') AS query FROM tagged""",
)
def _(t):
    old = F.replace(F.replace("chunk", F.lit("<think>"), F.lit("<reasoning>")), F.lit("</think>"), F.lit("</reasoning>"))
    return t.tagged.select("doc_id", F.regexp_replace(old, "<reasoning>", "<think>").alias("think"), F.coalesce(F.get(tags.bodies("chunk", "search"), 0), F.lit("")).alias("query"))


@query(
    "x42_content_ids",
    """SELECT doc_id, 'web_' || substr(sha256(text), 1, 12) AS web, 'replay_' || substr(sha256(text), 1, 16) AS replay, 'sourcefirst_' || substr(sha256(text), 1, 20) AS source_first FROM documents""",
)
def _(t):
    ids = {"web": ("web_", 12), "replay": ("replay_", 16), "source_first": ("sourcefirst_", 20)}
    return t.documents.select("doc_id", *[text.content_id("text", *v).alias(k) for k, v in ids.items()])


@query("x44_provider_query", rf"SELECT doc_id, substr(array_to_string(string_split({q.collapse('text')}, ' ')[1:50], ' '), 1, 400) AS v FROM documents")
def _(t):
    return t.documents.select("doc_id", text.provider_query("text").alias("v"))


@query(
    "x45_short_query",
    f"SELECT doc_id, concat_ws(' ', string_split(prediction, ' ')[1], array_to_string(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: w NOT IN {q.words(text.WEB_STOP)})[-5:], ' ')) AS v FROM qa",
)
def _(t):
    return t.qa.select("doc_id", text.short_query(F.get(F.split("prediction", " "), 0), "question").alias("v"))


@query(
    "x46_observation_titles",
    r"SELECT trace_id, step_id, list_transform(regexp_extract_all('[1] Title ' || step_id || ': ' || content, '\]\s*([^:\n]{1,120}):', 1), lambda x: trim(x)) AS titles FROM steps",
)
def _(t):
    shown = F.concat(F.lit("[1] Title "), F.col("step_id").cast("string"), F.lit(": "), "content")
    return t.steps.select("trace_id", "step_id", F.transform(text.all_matches(shown, r"\]\s*([^:\n]{1,120}):", 1), lambda x: F.trim(x)).alias("titles"))


@query("x47_rounding", "SELECT event_id, round(value / 7.0::DOUBLE, 4) AS r4, round(value / 7.0::DOUBLE, 2) AS r2 FROM events")
def _(t):
    return t.events.select("event_id", F.round(F.col("value") / 7.0, 4).alias("r4"), F.round(F.col("value") / 7.0, 2).alias("r2"))


@query("x48_role_map", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE 'observation' END AS role FROM conversations")
def _(t):
    table = F.create_map(*map(F.lit, ("user", "human", "assistant", "gpt")))
    return t.conversations.select("conv_id", "turn", F.coalesce(F.element_at(table, F.col("role")), F.lit("observation")).alias("role"))


_EVIDENCE = lambda: F.array(F.get("golds", 1), F.get("golds", 0))


@query("x24_gold_coercion", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN golds WHEN 1 THEN [prediction] WHEN 2 THEN [golds[1]] ELSE [] END AS golds FROM qa")
def _(t):
    from ..operators.replay import coerce_golds

    k = F.col("doc_id") % 4
    return t.qa.select("doc_id", coerce_golds(F.when(k == 0, F.col("golds")), F.when(k == 1, F.array("prediction")), F.when(k == 2, F.get("golds", 0))).alias("golds"))


@query("x26_x27_folded_names")
def _(t):
    from ..operators.rationale import fold_names

    rows = t.qa.select("doc_id", F.get(F.split("prediction", " "), 0).alias("name"), "body")
    return fold_names(rows, "doc_id", "name", "body")


@query("x28_x30_x31_rationale_quality")
def _(t):
    from ..operators.rationale import score_rationales

    raw = F.when(F.col("doc_id") % 5 == 0, "no json").otherwise(F.to_json(F.struct(F.concat("prediction", F.lit(". Therefore "), F.get("golds", 1)).alias("reasoning"))))
    rows = t.qa.select("doc_id", raw.alias("raw"), F.get("golds", 1).alias("answer"), "question", _EVIDENCE().alias("evidence"))
    return score_rationales(rows, "doc_id", "raw", "answer", "question", "evidence")


@query("x39_token_truncation", "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 20) AS INT)) AS ids FROM embeddings), e AS (SELECT vec_id, ids, (SELECT min(i) FROM range(1, 64) r(i) WHERE ids[i] = 1 AND ids[i + 1] = 1) AS pos FROM s) SELECT vec_id, ids[1:least(40, coalesce(pos + 1, 64))] AS ids FROM e")
def _(t):
    from ..operators.replay import truncate_tokens

    ids = F.transform("embedding", lambda x: F.floor(x.cast("float") * 20).cast("int"))
    return t.embeddings.select("vec_id", ids.alias("ids")).select("vec_id", truncate_tokens(F.col("ids"), [[1, 1]], 40).alias("ids"))


@query("x43_document_digest", """SELECT doc_id, sha256('[{"id":' || doc_id || ',"lang":"' || lang || '"}]') AS digest FROM documents""")
def _(t):
    from ..operators.replay import canonical_digest

    return t.documents.select("doc_id", canonical_digest(F.array(F.struct(F.col("doc_id").alias("id"), "lang"))).alias("digest"))
