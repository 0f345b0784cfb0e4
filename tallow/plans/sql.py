"""Snippets of DuckDB SQL that several statements share."""

from __future__ import annotations

PUNCT = r"[!-/:-@\[-`{-~]"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def norm(x: str) -> str:
    """normalize_answer: punctuation off, articles off, single spaces."""
    bare = rf"regexp_replace(lower({x}), '{PUNCT}', '', 'g')"
    return rf"array_to_string(list_filter(regexp_split_to_array({bare}, '\s+'), lambda nw: nw NOT IN ('', 'a', 'an', 'the')), ' ')"


def key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def toks(x: str) -> str:
    """Tokens of a normalized text."""
    return f"list_filter(string_split({norm(x)}, ' '), lambda tw: tw <> '')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def found(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, '{pattern}')"


def keyset(x: str, pattern: str, stop: list[str] | None = None, least: int = 0) -> str:
    out = f"list_distinct({found(x, pattern)})"
    if stop or least:
        conditions = ([f"sw NOT IN {words(stop)}"] if stop else []) + ([f"length(sw) >= {least}"] if least else [])
        out = f"list_filter({out}, lambda sw: {' AND '.join(conditions)})"
    return out


def bodies(x: str, tag: str, empty: bool = False) -> str:
    name = "(?:reasoning|think)" if tag == "reasoning" else tag
    out = f"list_transform(regexp_extract_all({x}, '(?is)<{name}>(.*?)</{name}>', 1), lambda bb: {strip('bb')})"
    return out if empty else f"list_filter({out}, lambda bc: bc <> '')"


def common(p: str, g: str) -> str:
    """Size of the multiset intersection of two lists."""
    return (
        f"coalesce(list_sum(list_transform(list_distinct({p}), lambda cx: least(len(list_filter({p}, lambda cy: cy = cx)),"
        f" len(list_filter({g}, lambda cz: cz = cx))))), 0)"
    )


def f1(n: str, p: str, g: str) -> str:
    """F1 of counts: n common, p predicted, g gold."""
    return (
        f"CASE WHEN {p} = 0 AND {g} = 0 THEN 1.0::DOUBLE WHEN {p} = 0 OR {g} = 0 OR {n} = 0 THEN 0.0::DOUBLE"
        f" ELSE 2 * ({n}::DOUBLE / {p}) * ({n}::DOUBLE / {g}) / ({n}::DOUBLE / {p} + {n}::DOUBLE / {g}) END"
    )
