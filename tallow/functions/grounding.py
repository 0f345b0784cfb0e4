"""What a rationale may say: names that its sources attest, and forms of an answer it may arrive at.  Column expressions.

Each check is a table of rules; a name is attested, or an answer arrived at,
if one rule holds.  A rule gets a struct with the texts and token arrays that
the rules share, which is computed once a row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import let, tokens
from .text import all_matches, normalize_answer, vocabulary

# Word lists, families and patterns of the rules.
GLUE = (
    "the", "and", "that", "this", "with", "from", "therefore", "thus", "hence", "because", "since", "which", "where", "when", "who", "whom", "whose",
    "what", "first", "second", "third", "evidence", "fact", "facts", "states", "state", "identifies", "identify", "requested", "answer", "born",
    "birthplace", "director", "directed", "comparing", "comparison", "attribute", "attributes", "larger", "smaller", "earlier", "later", "older",
    "younger", "more", "less", "both", "among", "however", "although", "though", "while", "after", "before", "during", "without", "within", "through",
    "between", "under", "over", "into", "onto", "whether", "either", "neither", "unless", "until", "according", "based", "together", "using", "given",
    "across", "only", "provided", "supporting", "indicates", "implies", "shows", "connects", "establishes", "mentions", "refers", "it", "its",
    "another", "other", "others", "also", "they", "them", "their", "theirs", "such",
)
FUNCTION = (*GLUE, "one", "two", "three", "four", "five", "each", "every", "these", "those", "there", "then")
LEADS = (*FUNCTION, "excluding", "including", "republican", "democratic", "for")
MORPHOLOGY = (("award", "awards"), ("america", "american"), ("korea", "korean"))
CALENDAR = ("old style", "new style", "julian", "gregorian")
FAMILIES = (
    ("italy", "italian", "italians"),
    ("argentina", "argentine", "argentinian", "argentineborn"),
    ("brazil", "brasil", "brazilian"),
    ("britain", "british", "uk", "united kingdom", "unitedkingdom", "great britain", "greatbritain"),
    ("scotland", "scottish", "glasgow"),
    ("france", "french"),
    ("spain", "spanish", "balearic"),
    ("germany", "german"),
    ("austria", "austrian"),
    ("ireland", "irish"),
    ("england", "english"),
    ("wales", "welsh"),
    ("canada", "canadian", "vancouver"),
    ("united states", "unitedstates", "usa", "america", "american", "washington"),
    (
        "europe", "european", "france", "french", "italy", "italian", "spain", "spanish", "scotland", "scottish", "glasgow", "britain", "british",
        "england", "english", "germany", "german", "austria", "austrian", "ireland", "irish", "balearic",
    ),
    (
        "north america", "northamerica", "north american", "northamerican", "america", "american", "united states", "unitedstates", "usa", "canada",
        "canadian", "washington", "vancouver", "mexico", "mexican",
    ),
    ("south america", "southamerica", "argentina", "argentine", "brazil", "brasil"),
    ("south korea", "southkorea", "south korean", "southkorean", "korea", "korean"),
    ("nazi", "nazis", "germany", "german"),
    ("unitarian", "unitarians", "universalist", "universalists"),
)
NICKNAMES = {
    "mike": "michael", "michael": "mike", "geoff": "geoffrey", "geoffrey": "geoff", "niki": "nikola", "nikola": "niki", "nick": "nicholas",
    "nicholas": "nick", "jack": "john", "john": "jack", "alex": "alexander", "alexander": "alex", "bob": "robert", "robert": "bob", "bill": "william",
    "william": "bill", "jim": "james", "james": "jim", "tom": "thomas", "thomas": "tom",
}
COUNTRIES = {
    "british": ("british", "britain", "uk", "united kingdom", "great britain"),
    "britain": ("british", "britain", "uk", "united kingdom", "great britain"),
    "uk": ("british", "britain", "uk", "united kingdom"),
    "united kingdom": ("british", "britain", "uk", "united kingdom"),
    "italian": ("italian", "italy"),
    "italy": ("italian", "italy"),
    "american": ("american", "united states", "usa", "us"),
    "argentine": ("argentine", "argentina", "argentineborn"),
    "argentineborn": ("argentine", "argentina", "argentineborn"),
}
META = (
    r"\bas an ai\b", r"\bas a language model\b", r"\bthe user asks\b", r"\bwe need (to )?(answer|ensure|inspect|identify)\b",
    r"\blet's (inspect|check|see|think)\b", r"\btraining (example|data|sample)\b", r"\bgold (answer|evidence|label|labels)\b",
    r"\breference answer\b", r"\bhidden (reasoning|chain|cot)\b", r"\bgrading\b", r"\bi (will|need to|should|must)\b",
    r"\bmy (task|goal|job) is\b", r"\bstep[- ]by[- ]step\b", r"\b<think\b", r"\b</think\b", r"\b<answer\b", r"\b<evidence\b",
)
CONNECTIVE = r"(?=[thbswc])\b(therefore|thus|hence|because|since|so|which means|this (implies|shows|indicates|connects)|comparing|compared|whereas|while|both)\b"
#: One of META; what may begin one is looked at first, and the boundary once.
TALK = r"(?=[atwlgrhims<])\b(?:" + "|".join(x.removeprefix(r"\b") for x in META) + ")"
YES = r"\b(yes|same|both|share[ds]?|match(?:es|ed|ing)?|understand|equivalent|affirmative|one (is )?(natural|man[- ]made))\b"
NO = r"\b(no|not|neither|different|do not|does not|did not)\b"
TAGS = r"(?i)</?(?:search|observation|evidence|think|answer|internal)\b"
PROPER = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
HONOURS = r"(?i)\b(?:better known|born|kbe|omri|grande ufficiale)\b"
NO_NAME = ("a", "an", "the", "born", "kbe", "omri", "grande", "ufficiale", "known", "better")


def _listed(values) -> Column:
    return F.array(*map(F.lit, values))


def _none() -> Column:
    return F.array().cast("array<string>")


def _any(conditions: list[Column]) -> Column:
    """Whether a condition holds; those after the first that does aren't evaluated, null is false."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def squeezed(c: Column) -> Column:
    """A text of ASCII words without blanks and marks."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


# Names -----------------------------------------------------------------------


def _variants() -> Column:
    return F.create_map(*[F.lit(x) for a, b in MORPHOLOGY for x in (a, b, b, a)])


def _keys(*families: tuple[str, ...]) -> list[str]:
    return sorted({x.replace(" ", "") for family in families for x in family})


def _of_family(n: Column, s: Column, family: tuple[str, ...]) -> Column:
    keys = _keys(family)
    member = F.arrays_overlap(n["keys"], _listed(keys))  # a name or content of the family is one of the keys without its blanks
    seen = F.exists(_listed(keys), lambda k: F.contains(s["folded"], k)) | F.arrays_overlap(s["vocabulary"], _listed(family))
    return member & seen


#: What attests a name: n is the name (name, content, words, keys), s the sources (seen, folded, vocabulary) and the names' words that they don't have (strange).
ATTESTS: dict[str, Callable[[Column, Column], Column]] = {
    "verbatim": lambda n, s: F.contains(s["seen"], n["content"]),
    "words": lambda n, s: ~F.exists(n["words"], lambda w: F.array_contains(s["strange"], w)),
    "calendar": lambda n, s: n["name"].isin(*CALENDAR) | n["content"].isin(*CALENDAR),
    "family": lambda n, s: F.exists(n["keys"], lambda k: k.isin(*_keys(*FAMILIES))) & _any([_of_family(n, s, f) for f in FAMILIES]),
}


def _name(found: Column) -> Column:
    """A proper noun of the text without the function words that lead it; content and words have three letters and more.

    A proper noun is of ASCII letters and blanks, so its parts are squeezed.
    """

    def read(name: Column, parts: Column, rest: Column, words: Column) -> Column:
        keys = F.concat(parts, F.array(F.array_join(words, ""), F.array_join(parts, "")))
        telling = (F.size(words) > 0) & ~F.forall(rest, lambda t: t.isin(*FUNCTION))
        return F.struct(found.alias("found"), name.alias("name"), F.array_join(words, " ").alias("content"), words.alias("words"), keys.alias("keys"), telling.alias("telling"))

    def led(name: Column, parts: Column) -> Column:
        first = F.array_min(F.filter(F.transform(parts, lambda t, i: F.when(~t.isin(*LEADS), i)), lambda i: i.isNotNull()))
        rest = let(first, lambda k: F.when(k.isNull(), _none()).otherwise(F.slice(parts, k + 1, F.size(parts))))
        return let(rest, lambda r: let(F.filter(r, lambda t: F.length(t) >= 3), lambda words: read(name, parts, r, words)))

    return let(F.lower(found), lambda name: let(F.split(name, r"\s+"), lambda parts: led(name, parts)))


def _strange(names: Column, known: Column) -> Column:
    """Words of names that are no glue and that a vocabulary has in no form; told by hashing."""
    other = lambda w: F.coalesce(F.array_contains(known, F.try_element_at(_variants(), w)), F.lit(False))
    return F.filter(F.array_except(F.flatten(F.transform(names, lambda n: n["words"])), known), lambda w: ~w.isin(*GLUE) & ~other(w))


def novel_names(rationale: Column, sources: Column, folded: Column) -> Column:
    """Proper nouns of a rationale that no rule attests; ``folded`` are the sources' letters and digits without accents.

    A name is read and judged once, however often it comes; what the rules
    share is worked out once a row, and only where there is a name.
    """
    seen = F.array_join(F.transform(sources, lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))), " ")

    def unattested(names: Column) -> Column:
        own = let(vocabulary(F.array_distinct(sources)), lambda v: F.struct(seen.alias("seen"), folded.alias("folded"), v.alias("vocabulary"), _strange(names, v).alias("strange")))
        missing = let(own, lambda s: F.filter(names, lambda n: ~_any([rule(n, s) for rule in ATTESTS.values()])))
        return F.transform(F.when(F.size(names) > 0, missing).otherwise(names), lambda n: n["found"])

    def judged(found: Column) -> Column:
        names = F.filter(F.transform(F.array_distinct(found), _name), lambda n: n["telling"])
        return let(let(names, unattested), lambda missing: F.filter(found, lambda f: F.array_contains(missing, f)))

    return let(all_matches(rationale, PROPER, 1), judged)


# Answers ---------------------------------------------------------------------


def name_tokens(answer: Column) -> Column:
    """Tokens of the name that an answer begins with, without honours and births after it."""
    head = F.get(F.split(F.regexp_replace(F.get(F.split(answer, ","), 0), r"\([^)]*\)", " "), HONOURS), 0)
    return F.filter(tokens(normalize_answer(head)), lambda t: ~F.array_contains(_listed(NO_NAME), t))


def legal_dates(answer: Column) -> Column:
    """Dates that run into other text, as month day year and day month year."""
    both, join = F.concat_ws(" ", answer, normalize_answer(answer)), lambda *x: normalize_answer(F.concat_ws(" ", *x))
    part = rf"(?i)({MONTHS})(\d{{1,2}}),?\s*(\d{{4}})"
    month, day, year = (F.regexp_extract(both, part, k) for k in (1, 2, 3))
    number = day.try_cast("int").cast("string")
    run = rf"(?i)(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})\d+"
    d, m, y = (F.regexp_extract(normalize_answer(answer), run, k) for k in (1, 2, 3))
    return F.concat(F.when(month != "", F.array(join(month, number, year), join(number, month, year))).otherwise(_none()), F.when(m != "", F.array(join(d, m, y))).otherwise(_none()))


#: Other forms of an answer: arrays of normalized texts from the answer as it is given and its normalized form.
FORMS: dict[str, Callable[[Column, Column], Column]] = {
    "quoted": lambda raw, gold: F.transform(all_matches(raw, '"([^"]+)"', 1), normalize_answer),
    "known as": lambda raw, gold: F.array(normalize_answer(F.regexp_extract(raw, r"(?i)better known as ([^,(]+)", 1))),
    "name": lambda raw, gold: F.array(F.array_join(name_tokens(raw), " ")),
    "country": lambda raw, gold: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in COUNTRIES.items() for x in (F.lit(k), _listed(v))]), gold), _none()),
    "date": lambda raw, gold: legal_dates(raw),
}


def aliases(answer: Column, gold: Column | None = None) -> Column:
    """All other forms of an answer that aren't empty; ``gold`` is its normalized form, if that is at hand."""
    gold = normalize_answer(answer) if gold is None else gold
    return F.filter(F.array_distinct(F.concat(*[form(answer, gold) for form in FORMS.values()])), lambda x: x != "")


def _long(a: Column) -> Column:
    return F.filter(a, lambda t: F.length(t) >= 4)


def _conclusion(said: Column) -> Column:
    """What follows a connective up to the end, if that is near; else the last twelve words."""
    after = r"\b(?:therefore|thus|hence|so|since)\b(.{0,240})$"
    words = F.split(said, " ")
    return F.when(said.rlike(after), F.regexp_extract(said, after, 1)).otherwise(F.array_join(F.slice(words, F.greatest(F.size(words) - 11, F.lit(1)), F.lit(12)), " "))


def _surname(r: dict[str, Column]) -> Column:
    """The last telling token of a name in the conclusion, the first one (or its short form) said, or the name attested elsewhere."""
    telling = F.when(F.size(_long(r["name"])) > 0, _long(r["name"])).otherwise(_long(r["tokens"]))

    def held(t: Column) -> Column:
        first, last = F.get(t, 0), F.element_at(t, -1)
        short = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv]), first), first)
        other = (F.contains(r["asked"], last)) | ((r["gold"] != "") & F.contains(r["evidence"], r["gold"]))
        return F.contains(_conclusion(r["said"]), last) & (F.contains(r["said"], first) | F.contains(r["said"], short) | other)

    able = (F.size(r["name"]) >= 2) | (F.size(r["tokens"]) >= 2)
    return able & let(telling, lambda t: F.when(F.size(t) > 0, held(t)).otherwise(False))


def stated(gold: Column, said: Column) -> Column:
    return (gold != "") & F.contains(said, gold)


#: How else than by stating it a rationale can arrive at an answer: r has answer, gold, said, text, asked, evidence, tokens, name and near.
ARRIVES: dict[str, Callable[[dict[str, Column]], Column]] = {
    "short": lambda r: (r["answer"] != "") & (F.length(r["answer"]) <= 3) & F.contains(r["text"], r["answer"]),
    "form": lambda r: F.exists(aliases(r["answer"], r["gold"]), lambda a: F.contains(r["said"], a)),
    "words": lambda r: (F.size(r["tokens"]) > 0) & F.forall(r["tokens"], lambda t: F.contains(r["said"], t)),
    "surname": _surname,
    "part of a title": lambda r: (F.size(r["tokens"]) >= 6) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(r["tokens"]) - 2, F.lit(1))), lambda k: F.contains(r["said"], F.array_join(F.slice(r["tokens"], k, 3), " "))),
    "yes": lambda r: r["gold"].isin("yes", "same") & (r["said"].rlike(YES) | (r["said"].rlike(r"\bnatural\b") & r["said"].rlike(r"\bman[- ]made\b"))),
    "no": lambda r: r["gold"].isin("no", "different") & r["said"].rlike(NO),
    "spelling": lambda r: F.exists(r["near"], lambda w: F.contains(r["said"], w)),
}


def arrives(rationale: Column, answer: Column, question: Column, evidence: Column, near: Column, gold: Column | None = None, said: Column | None = None) -> Column:
    """Whether a rationale arrives at an answer; ``evidence`` is the normalized text of all sources, ``near`` the question's words that nearly stand in the answer.

    ``gold`` and ``said`` are the normalized answer and rationale, if they are
    at hand.  The normalized question and evidence are worked out only where a
    rule comes to them, and the rest only where the answer isn't stated.
    """
    gold = normalize_answer(answer) if gold is None else gold
    said = normalize_answer(rationale) if said is None else said
    late = {"text": rationale, "asked": normalize_answer(question), "evidence": evidence, "near": near}

    def otherwise(n: Column) -> Column:
        own = {"answer": F.trim(answer), "tokens": tokens(n["gold"]), "name": name_tokens(answer)}
        row = F.struct(n["gold"].alias("gold"), n["said"].alias("said"), *[c.alias(k) for k, c in own.items()])
        rules = lambda r: _any([rule({k: r[k] for k in ("gold", "said", *own)} | late) for rule in ARRIVES.values()])
        return F.when(stated(n["gold"], n["said"]), True).otherwise(let(row, rules))

    return let(F.struct(gold.alias("gold"), said.alias("said")), otherwise)
