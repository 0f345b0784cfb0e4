"""License scans by sentence rules.  DataFrame functions only.

A text is cut into sentences, each normalised and looked up among known
licence sentences: by its words in an exact table, or, for sentences with a
name or a number in them, by a pattern of the whole sentence.  Sentences may
run over the lines of a wrapped or commented text.  The identifiers that are
found, in order, form a sequence, and ordered licence rules are matched
against it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An identifier and a pattern of the whole normalised sentence.
SENTENCES = (
    ("APACHE2", r"(?:this (?:work|file|software) is )?licensed under (?:the )?apache license,? version 2(?:\.0)?"),
    ("GPL3", r"(?:this (?:work|file|software) is )?licensed under (?:the )?gnu general public license,? version 3(?:\.0)?(?: or later)?"),
    ("GPL2", r"(?:this (?:work|file|software) is )?licensed under (?:the )?gnu general public license,? version 2(?:\.0)?(?: or later)?"),
    ("LGPL", r"(?:this (?:work|file|software) is )?licensed under (?:the )?gnu lesser general public license,? version [0-9.]+"),
    ("MIT", r"(?:(?:this (?:work|file|software) is )?(?:released|licensed) under (?:the )?mit license|mit license)"),
    ("BSD3", r"(?:(?:this (?:work|file|software) is )?(?:released|licensed) under (?:the )?(?:3-clause bsd|bsd 3-clause) license)"),
    ("CCBYNC4", r"(?:this (?:work|file|software) is )?licensed under (?:a )?(?:cc by-nc|creative commons attribution-noncommercial) 4\.0"),
    ("CCBY4", r"(?:this (?:work|file|software) is )?licensed under (?:a )?(?:cc by|creative commons attribution) 4\.0"),
    ("CC0", r"(?:this (?:work|file|software) is )?(?:dedicated to the public domain|released under cc0(?: 1\.0)?)"),
    ("COPYRIGHT", r"(?:copyright|\(c\)|©).*"),
    ("PERMISSION", r"permission is hereby granted, free of charge, to any person obtaining a copy.*"),
    ("NOTICE", r"the above copyright notice and this permission notice shall be included in all copies.*"),
    ("ASIS", r"the software is provided \"?as is\"?, without warranty of any kind.*"),
    ("REDIST", r"redistribution and use in source and binary forms, with or without modification, are permitted.*"),
    ("NOENDORSE", r"neither the name of .* may be used to endorse or promote products.*"),
    ("RESERVED", r"all rights reserved"),
)

_GPL = r"you (?:can|may) redistribute it and/or modify it under the terms of (?:version {1} of )?the gnu {0}general public license,?(?: as published by the free software foundation[,;:]?)?(?: (?:either )?version {1}(?![0-9]).*)?"

#: Sentences of the usual headers, which the DuckDB statement doesn't know; the last ones begin anywhere in a line.
HEADERS = (("APACHE2", r"licensed under (?:the )?apache license,? version 2(?:\.0)?,? \(the \"?license\"?\).*"),)
INNER = (
    ("GPL3", _GPL.format("", "3")), ("GPL2", _GPL.format("", "2")), ("LGPL", _GPL.format("(?:lesser|library) ", "[0-9.]+")), ("AGPL3", _GPL.format("affero ", "3")),
    ("SPDX", r"spdx-license-identifier: ?.*"),
)

#: Known sentences in full, by their words; marks between words don't count.  The DuckDB statement doesn't know them either.
EXACT = (
    ("MIT", "the mit license"),
    ("MIT", "the mit license (mit)"),
    ("APACHE2", "apache license version 2.0, january 2004"),
    ("GPL3", "gnu general public license version 3, 29 june 2007"),
    ("GPL2", "gnu general public license version 2, june 1991"),
    ("LGPL", "gnu lesser general public license version 3, 29 june 2007"),
    ("LGPL", "gnu lesser general public license version 2.1, february 1999"),
    ("AGPL3", "gnu affero general public license version 3, 19 november 2007"),
    ("MPL2", "mozilla public license version 2.0"),
    ("MPL2", "this source code form is subject to the terms of the mozilla public license, v"),
    ("MPL2", "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/"),
    ("MPL2", "if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/"),
    ("BSD2", "bsd 2-clause license"),
    ("BSD3", "bsd 3-clause license"),
    ("BSDFORM", "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("ISC", "isc license"),
    ("ISC", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("UNLICENSE", "this is free and unencumbered software released into the public domain"),
    ("CCBY4", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CCBYSA4", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"),
    ("CCBYND4", "this work is licensed under a creative commons attribution-noderivatives 4.0 international license"),
    ("CCBYNC4", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"),
    ("CCBYNCSA4", "this work is licensed under a creative commons attribution-noncommercial-sharealike 4.0 international license"),
    ("CCBYNCND4", "this work is licensed under a creative commons attribution-noncommercial-noderivatives 4.0 international license"),
    ("CC0", "cc0 1.0 universal"),
)

#: Licences that an SPDX line can name, and whether they are free for commercial use.
SPDX = (
    ("MIT", True), ("ISC", True), ("Unlicense", True), ("Apache-2.0", True), ("BSD-2-Clause", True), ("BSD-3-Clause", True), ("MPL-2.0", True),
    ("GPL-2.0", True), ("GPL-3.0", True), ("LGPL-2.1", True), ("LGPL-3.0", True), ("AGPL-3.0", True), ("CC0-1.0", True), ("CC-BY-4.0", True), ("CC-BY-SA-4.0", True),
    ("CC-BY-ND-4.0", True), ("CC-BY-NC-4.0", False), ("CC-BY-NC-SA-4.0", False), ("CC-BY-NC-ND-4.0", False),
)

#: A licence, whether it is free for commercial use, and its sentences in order; the first rule that
#: matches a stretch of the sequence takes it.
RULES = (
    ("MIT", True, ("PERMISSION", "NOTICE", "ASIS")),
    ("BSD-3-Clause", True, ("REDIST", "NOENDORSE")),
    ("BSD-2-Clause", True, ("REDIST",)),
    ("Apache-2.0", True, ("APACHE2",)),
    ("GPL-3.0", True, ("GPL3",)),
    ("GPL-2.0", True, ("GPL2",)),
    ("LGPL", True, ("LGPL",)),
    ("MIT", True, ("MIT",)),
    ("BSD-3-Clause", True, ("BSD3",)),
    ("CC-BY-NC-4.0", False, ("CCBYNC4",)),
    ("CC-BY-4.0", True, ("CCBY4",)),
    ("CC0-1.0", True, ("CC0",)),
    ("Proprietary", False, ("COPYRIGHT", "RESERVED")),
    ("Proprietary", False, ("RESERVED",)),
)
_NAMES = {"LGPL-2.1": "LGPL", "LGPL-3.0": "LGPL"}
#: Rules of the sentences that the DuckDB statement doesn't know.
MORE_RULES = (
    ("AGPL-3.0", True, ("AGPL3",)),
    ("MPL-2.0", True, ("MPL2",)),
    ("BSD-2-Clause", True, ("BSD2",)),
    ("ISC", True, ("ISC",)),
    ("Unlicense", True, ("UNLICENSE",)),
    ("CC-BY-SA-4.0", True, ("CCBYSA4",)),
    ("CC-BY-ND-4.0", True, ("CCBYND4",)),
    ("CC-BY-NC-SA-4.0", False, ("CCBYNCSA4",)),
    ("CC-BY-NC-ND-4.0", False, ("CCBYNCND4",)),
    *((_NAMES.get(name, name), free, (f"SPDX-{name.lower()}",)) for name, free in SPDX),
)

_HINT = r"(?i)licen[sc]e|copyright|\(c\)|©|permission|public domain|cc0|as is|redistribution|endorse|rights reserved"


def normalised(sentence: Column) -> Column:
    """Lower case, white space within lines as one space, marks at both ends of lines off."""
    lines = F.regexp_replace(F.lower(sentence), r"(?<![ \t\x0B\f\x{A0}.;:!?*\"'-])[ \t\x0B\f\x{A0}.;:!?*\"'-]*+\n[\s\x{A0}*#/;:>\"'-]*+", "\n")
    flat = F.regexp_replace(lines, r"[ \t\x0B\f\x{A0}]+", " ")
    return F.regexp_replace(flat, r"^[\s*#/;:>\"'-]+|[\s.;:!?*\"'-]+$", "")


def _wrapped(pattern: str) -> str:
    """A pattern whose words may be on different lines; a tail ends with its line."""
    return pattern.removesuffix(".*").replace(".*", "(?s:.*?)").replace(" ", "[ \n]") + (".*" if pattern.endswith(".*") else "")


def words(sentence: Column) -> Column:
    """The key of the exact table: words with one space between each two."""
    return F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))


def _by_words(sentence: str) -> str:
    """A pattern of a sentence's words with any marks and line ends between them."""
    return "[^a-z0-9]+".join(re.findall("[a-z0-9]+", sentence))


def sentence_ids(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order.

    Pieces end at blank lines and at . ! ? before white space.  In them, known
    sentences begin and end with lines, over as few lines as they can.
    """
    known = F.create_map(*[F.lit(x) for i, s in EXACT for x in (" ".join(re.findall("[a-z0-9]+", s)), i)])
    listed = "|".join(re.escape(n.lower()) for n, _ in sorted(SPDX, key=lambda x: -len(x[0])))

    def names(s: Column) -> Column:
        out = F.try_element_at(known, words(s))
        for identifier, pattern in (*SENTENCES, *HEADERS, *INNER[:-1]):
            out = F.coalesce(out, F.when(s.rlike(f"(?s)^(?:{pattern})$"), F.lit(identifier)))
        tagged = F.transform(F.regexp_extract_all(s, F.lit(rf"(?<![a-z0-9.-])(?:{listed})(?![a-z0-9])"), F.lit(0)), lambda x: F.concat(F.lit("SPDX-"), x))
        return F.when(s.startswith("spdx-license-identifier"), tagged).otherwise(F.array(out))

    lines = "|".join([*(_wrapped(p) for _, p in (*SENTENCES, *HEADERS)), *(_by_words(s) + r"[^a-z0-9\n]*+" for _, s in EXACT)])
    inner = "|".join(_wrapped(p) for _, p in INNER)
    sentence = rf"(?dm)(?:^(?:{lines})|(?<![^\s])(?:{inner}))$"
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    parts = F.filter(F.split(plain, r"(?<=[.!?])\s+|\n[\s*#/;:>\"'-]*\n"), lambda s: s.rlike(_HINT + r"|\bmpl\b"))
    found = F.flatten(F.transform(F.transform(parts, normalised), lambda s: F.regexp_extract_all(s, F.lit(sentence), F.lit(0))))
    found = F.flatten(F.transform(F.transform(found, lambda s: F.replace(s, F.lit("\n"), F.lit(" "))), names))
    return F.filter(found, lambda x: x.isNotNull())


def matched_rules(ids: Column) -> Column:
    """Licences of a sequence of identifiers, by the order of the rules.

    The sequence is read as a text of ``;NAME;`` items.  A rule's sentences
    must follow each other in order, with copyright and rights lines between
    at most; a stretch that one rule has taken is closed to later ones.
    """
    line = F.concat(F.lit(";"), F.array_join(ids, ";;"), F.lit(";"))
    out = []
    for license_, _, items in (*RULES, *MORE_RULES):
        pattern = "".join(f";{i};(?:;(?:COPYRIGHT|RESERVED|BSDFORM);)*?" for i in items[:-1]) + f";{items[-1]};"
        out.append(F.when(line.rlike(pattern), F.lit(license_)))
        line = F.regexp_replace(line, pattern, ";-;")
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``sentence_ids`` and ``licenses`` (arrays), ``n_licenses``, ``commercial`` of every whole text.

    ``licenses`` are different licences by name.  ``commercial`` is false if
    one of them rules commercial use out, true if there are others only, and
    null if there are none.  Null and empty texts have none; very long ones
    are read whole.  Of rules that could take the same sentences the first
    does.  A row in gives a row out, repeated ones too; other columns are not
    read.  Nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = F.when(text.rlike(_HINT), sentence_ids(text)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).alias("id"), ids.alias("sentence_ids"))
    bound = sorted({name for name, free, _ in (*RULES, *MORE_RULES) if not free})
    licenses = F.when(F.size("sentence_ids") > 0, F.array_sort(F.array_distinct(matched_rules(F.col("sentence_ids"))))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("id", "sentence_ids", licenses.alias("licenses"))
    free = F.when(F.size("licenses") == 0, F.lit(None).cast("boolean")).otherwise(~F.arrays_overlap("licenses", F.array(*map(F.lit, bound))))
    return rows.select(F.col("id").alias(id_col), "sentence_ids", "licenses", F.size("licenses").cast("long").alias("n_licenses"), free.alias("commercial"))


def scan_sql() -> str:
    """DuckDB SQL for the rows of op3_license_scan: the same steps over the same fixed values."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    space = r"[ \t\n\x0B\f\r]+"
    cut = f"string_split_regex(regexp_replace(coalesce(text, ''), '([.!?]){space}', '\\1' || chr(10), 'g'), '[\\r\\n]+')"
    flat = r"regexp_replace(lower(s), '[ \t\n\x0B\f\r\x{A0}]+', ' ', 'g')"
    clean = rf"""regexp_replace({flat}, '^[ *#/;:>"''-]+|[ .;:!?*"''-]+$', '', 'g')"""
    named = "CASE " + " ".join(f"WHEN regexp_full_match(s, {quote(p)}) THEN '{i}'" for i, p in SENTENCES) + " END"
    steps, line = [], "line0"
    for k, (_, _, items) in enumerate(RULES):
        pattern = quote("".join(f";{i};(?:;(?:COPYRIGHT|RESERVED);)*?" for i in items[:-1]) + f";{items[-1]};")
        steps.append(f"r{k + 1} AS (SELECT *, regexp_matches({line}, {pattern}) AS m{k}, regexp_replace({line}, {pattern}, ';-;', 'g') AS line{k + 1} FROM r{k})")
        line = f"line{k + 1}"
    hits = ", ".join(f"CASE WHEN m{k} THEN '{name}' END" for k, (name, _, _) in enumerate(RULES))
    bound = ", ".join(quote(name) for name in sorted({name for name, free, _ in RULES if not free}))
    return f"""
WITH parts AS (
  SELECT doc_id, list_transform(list_filter({cut}, lambda s: regexp_matches(s, {quote(_HINT)})), lambda s: {clean}) AS parts FROM documents
), named AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda s: {named}), lambda x: x IS NOT NULL) AS ids FROM parts
), r0 AS (
  SELECT doc_id, ids, ';' || array_to_string(ids, ';;') || ';' AS line0 FROM named
), {", ".join(steps)}, found AS (
  SELECT doc_id, ids, list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))) AS licenses FROM r{len(RULES)}
)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(licenses, ',') AS licenses, CAST(len(licenses) AS BIGINT) AS n_licenses,
  CASE WHEN len(licenses) > 0 THEN NOT list_has_any(licenses, [{bound}]) END AS commercial
FROM found"""
