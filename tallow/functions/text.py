"""Text functions as Column expressions: normal forms, token sets, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Stop lists of the token sets; they differ on purpose.
CAPABILITY_STOP = (
    "a an the and or of to in on for with by from at as is was were be been are that this these those who whom which what when where"
    " why how did does do had has have its his her their our your also"
).split()
WEB_STOP = (
    "the and for was were what which who where when how does did with from that this into about their his her has have had are not but"
    " all between"
).split()
CONTROLLER_STOP = "the a an of in on for to and or is was are were who what which when where how did does do with from by".split()
RATIONALE_WORD = "[A-Za-z][A-Za-z0-9'-]{2,}|[0-9]{3,4}"
ORDINALS = {
    "1st": "first", "2nd": "second", "3rd": "third", "4th": "fourth", "5th": "fifth", "6th": "sixth",
    "7th": "seventh", "8th": "eighth", "9th": "ninth", "10th": "tenth", "11th": "eleventh", "12th": "twelfth",
}


def text(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def bare(c) -> Column:
    """Lower case without ASCII punctuation."""
    return F.translate(F.lower(text(c)), PUNCTUATION, "")


def without_articles(c) -> Column:
    """A bare text without the articles a, an, the, and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"(?U)(?=[at])\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def normalize_answer(c) -> Column:
    """Lower case without ASCII punctuation and the articles a, an, the, and with single spaces."""
    return without_articles(bare(c))


def worded(c) -> Column:
    """Whether a bare text's normal form isn't empty: four characters in a row are more than an article."""
    return text(c).rlike(r"(?U)\S{4}") | (without_articles(c) != "")


def query_key(c) -> Column:
    """Lower case with each run of other characters than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def loose_query(c) -> Column:
    """Lower case with ASCII punctuation as spaces, and single spaces."""
    return collapse(F.translate(F.lower(text(c)), PUNCTUATION, " " * len(PUNCTUATION)))


def canonical_url(c) -> Column:
    """Lower-case scheme and host, the path without slashes at its end; no query, no fragment."""
    part = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)"
    scheme, host, path = (F.regexp_extract(text(c), part, k) for k in (1, 2, 3))
    return F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.regexp_replace(path, "/+$", ""))


def all_matches(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(group))


def without(tokens: Column, stop: list[str]) -> Column:
    return F.array_except(F.array_distinct(tokens), F.array(*map(F.lit, stop)))


def web_tokens(c) -> Column:
    return F.array_distinct(all_matches(F.lower(text(c)), "[a-z0-9]{3,}"))


def state_words(c) -> Column:
    return without(all_matches(F.lower(text(c)), "[a-z0-9][a-z0-9'-]{2,}"), WEB_STOP)


def capability_tokens(c) -> Column:
    found = F.filter(all_matches(F.lower(text(c)), "[a-z0-9]+(?:'[a-z0-9]+)?"), lambda t: F.length(t) >= 3)
    return without(found, CAPABILITY_STOP)


def controller_words(c) -> Column:
    return without(F.transform(all_matches(c, "[A-Za-z0-9][A-Za-z0-9_-]*"), F.lower), CONTROLLER_STOP)


def bm25_terms(c) -> Column:
    """Words and single CJK characters, as a bag."""
    return F.transform(all_matches(c, r"[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]"), F.lower)


def content_tokens(c, glue: list[str]) -> Column:
    return F.array_distinct(F.filter(F.transform(all_matches(c, RATIONALE_WORD), F.lower), lambda w: ~w.isin(*glue)))


def vocabulary(texts: Column) -> Column:
    """Words of an array of texts with the parts of hyphenated ones of three letters and more."""
    each = F.flatten(F.transform(texts, lambda t: F.transform(all_matches(t, RATIONALE_WORD), F.lower)))

    def with_parts(found: Column) -> Column:
        hyphenated = F.filter(found, lambda w: F.contains(w, F.lit("-")))  # another word is its only part
        parts = F.flatten(F.transform(hyphenated, lambda w: F.filter(F.split(w, "-"), lambda p: F.length(p) >= 3)))
        return F.array_distinct(F.concat(found, parts))

    return F.get(F.transform(F.array(each), with_parts), 0)  # the words are found once


def sentences(c) -> Column:
    """Sentences by Latin and CJK marks and line ends, cut at 360 characters; those under 20 go."""
    pieces = F.filter(F.transform(F.split(text(c), "(?<=[.!?。！？；;])\\s*|\\n+"), collapse), lambda p: p != "")
    cut = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p), F.lit(360)), lambda i: F.substr(p, i, F.lit(360)))))
    return F.filter(cut, lambda p: F.length(p) >= 20)


def sentence_count(c) -> Column:
    return F.size(F.filter(F.split(text(c), "[.!?]+"), lambda s: F.trim(s) != "")).cast("long")


def content_id(c, prefix: str, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text(c), 256), 1, digits))


def first_words(c, n: int) -> Column:
    return F.array_join(F.slice(F.split(text(c), r"\s+"), 1, n), " ")


def provider_query(c) -> Column:
    """At most 50 words and 400 characters."""
    return F.substring(first_words(collapse(c), 50), 1, 400)


def short_query(bridge, question, stop: list[str] = WEB_STOP, words: int = 5) -> Column:
    """The bridge with the question's last words that aren't stop words."""
    kept = F.filter(all_matches(F.lower(text(question)), "[a-z0-9]+"), lambda w: ~w.isin(stop))
    last = F.slice(kept, F.greatest(F.size(kept) - words + 1, F.lit(1)), words)
    return F.concat_ws(" ", text(bridge), F.array_join(last, " "))


def truncate_at(c, stops: list[str]) -> Column:
    """Up to and with the earliest stop string."""
    ends = [F.when(F.instr(text(c), s) > 0, F.instr(text(c), s)) for s in stops]
    sized = [F.struct(e.alias("at"), (e + len(s) - 1).alias("end")) for e, s in zip(ends, stops, strict=True)]
    first = F.array_min(F.filter(F.array(*sized), lambda x: x["at"].isNotNull()))
    return F.coalesce(F.substr(text(c), F.lit(1), first["end"]), text(c))


def expand_ordinals(c) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])
    return F.array_join(F.transform(F.filter(F.split(text(c), r"\s+"), lambda w: w != ""), lambda w: F.coalesce(F.element_at(table, F.lower(w)), w)), " ")


def sanitize_budget(c, budget: int = 5) -> Column:
    return F.regexp_replace(text(c), r"Remaining Budget:\s*\d+", f"Remaining Budget: {budget}")


def padded_contains(haystack: Column, needle: Column) -> Column:
    """Whether a normalized text holds another one as whole tokens; never an empty one."""
    return (needle != "") & F.concat(F.lit(" "), haystack, F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))
