import collections
import math
import random
import textwrap

import duckdb
import numpy as np

from tallow.llm import licenses, queries, urls


def test_license_scan(spark, table):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of it.\n"
        "The above copyright notice and this permission notice shall be included in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND'
    )
    rows = [
        (1, "x. Licensed under the Apache  License, Version 2.0.\nLicensed under CC BY-NC 4.0."),
        (2, None),
        (3, ""),
        (4, mit),
        (5, "\n".join(reversed(mit.split("\n")))),
        (6, "we talked about the MIT License at length"),
        (7, "Copyright 2020 X.\nAll rights reserved."),
        (8, "Released under the MIT License.\n" * 3 + "y " * 100_000),
        (None, "Released under the MIT License."),
    ]
    got = {r.doc_id: r for r in licenses.scan(table(rows)).collect()}
    assert got[1].licenses == ["Apache-2.0", "CC-BY-NC-4.0"] and got[1].commercial is False
    assert got[2].licenses == got[3].licenses == got[6].licenses == [] and got[2].commercial is None
    assert got[4].licenses == ["MIT"] and got[4].sentence_ids == ["PERMISSION", "NOTICE", "ASIS"] and got[4].commercial
    assert got[5].licenses == []
    assert got[7].licenses == ["Proprietary"] and got[8].licenses == ["MIT"] and got[8].n_licenses == 1
    assert got[None].licenses == ["MIT"]
    assert licenses.scan(table([])).collect() == []


def test_license_scan_matches_sql(spark, table, tmp_path):
    made = [
        (1, "A. Licensed  under the Apache License, Version 2.0!  Licensed under CC BY-NC 4.0."),
        (2, None),
        (3, ""),
        (4, "Copyright 2020 X.\r\nAll rights reserved.\n\n* Released under the MIT License.\u00a0"),
        (5, "Redistribution and use in source and binary forms, with or without modification, are permitted.\nCopyright Y\nNeither the name of Y may be used to endorse or promote products"),
        (6, "Redistribution and use in source and binary forms, with or without modification, are permitted.\nx\tlicense"),
        (7, "# Dedicated to the public domain;\v\"MIT License\".\u00a9 2021"),
        (7, "# Dedicated to the public domain;\v\"MIT License\".\u00a9 2021"),
    ]
    table(made).write.parquet(f"{tmp_path}/documents.parquet")
    for folder, name in ((tmp_path, "documents.parquet/*.parquet"), ("/root/testdata/sf0.01", "documents.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/{name}'")
        want = con.execute(queries.ORACLES["op3_license_scan"])
        columns = [d[0] for d in want.description]
        got = queries.op3_license_scan(spark, str(folder)).select(columns).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest, k = url[at + 3 :], 0
    while k < len(rest) and rest[k] not in "/?#":
        k += 1
    host, path = rest[:k], rest[k:]
    for mark in "?#":
        path = path.split(mark)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fit = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fit, key=lambda r: len(r[0]) + len(r[1]), default=None)


def test_hosts_paths_and_rules_match_brute_force(spark):
    given = [None, "", "nothing", "http://", "HTTP://A.Example.COM", "x://b.net/es/1?q#f", "http://net/fr/", "http://example.com/en/a", "http://www.example.com/en/a", "http://m.www.example.com/en/?x", "http://notexample.com/en/1", "http://ÄB.org?x=/es/", "http://a.net/de/1#/fr/", "http://a.com:80/x", "a://b://c.com/en/", "http://q.net/es", "http://h.org/a\nb?c", "http://a.com", "http://a.com?x"]
    pages = spark.createDataFrame([(k, u, "h", "h", "r", 1.0) for k, u in enumerate(given)], "page_id long, url string, host string, path string, rule string, score double")
    got = urls.judge(pages).collect()
    assert len(got) == len(given)
    for r in got:
        host, path = parts(given[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path) == (host, path), given[r.page_id]
        assert r.rule == (rule[0] + rule[1] if rule else None)
        assert r.verdict == rule[2] if rule else r.verdict in ("allow", "block")


def test_models_tell_rejected_from_accepted(spark):
    rows = [(k, f"http://site{k % 7}.com/news/{k}") for k in range(300)] + [(1000 + k, f"http://spam{k % 5}.net/es/{k}") for k in range(300)]
    rows += [(5000, "http://site3.org/news/77"), (5001, "http://spam2.org/es/77"), (5002, None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[5000].verdict == "allow" and got[5001].verdict == "block" and got[5000].score > got[5001].score
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_scores_are_length_normalised_means():
    tables = np.zeros((2, 2, urls.ORDERS * urls.SLOTS))
    assert np.allclose(urls.scores(["abc", "", "x" * 1000], tables), 0)
    assert urls.threshold({(10, "allow"): 5}) == 0.0


def test_models_are_exact_however_many_urls(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(12))
    given = [f"http://{'x.com' if k % 2 else 'y.net/es'}/{word()}" for k in range(4000)] + [f"http://z.org/{word()}" for _ in range(50)] + ["http://é.org/\x02\x03", None]
    got = urls.judge(spark.createDataFrame(list(enumerate(given)), "page_id long, url string").repartition(3)).collect()
    held = {r[0] for r in spark.createDataFrame([(h + p,) for h, p in map(parts, given)], "t string").distinct().filter("pmod(xxhash64(t), 4) = 0").collect()}
    counts = [collections.Counter(), collections.Counter()]
    symbols = lambda t: [256] * (urls.ORDERS - 1) + list(t.encode()) + [257]
    for url in given:
        host, path = parts(url)
        rule = rule_of(host, path)
        x = symbols(host + path)
        if rule and host + path not in held:
            for k in range(urls.ORDERS - 1, len(x)):
                for o in range(urls.ORDERS):
                    counts[rule[2] == "block"][tuple(x[k - o : k + 1])] += 1
                    counts[rule[2] == "block"]["before", tuple(x[k - o : k])] += 1
    assert len({g for c in counts for g in c if len(g) == 5}) > urls.SLOTS
    for r in got:
        x, total = symbols("".join(parts(given[r.page_id]))), 0
        for k in range(urls.ORDERS - 1, len(x)):
            p = [1 / 256, 1 / 256]
            for o in range(urls.ORDERS):
                p = [(c[tuple(x[k - o : k + 1])] + urls.STRENGTH * q) / (c["before", tuple(x[k - o : k])] + urls.STRENGTH) for c, q in zip(counts, p, strict=True)]
            total += math.log(p[0]) - math.log(p[1])
        assert abs(r.score - total / (len(x) - urls.ORDERS + 1)) < 1e-9
    assert len(got) == len(given)


def test_wrapped_license_texts(spark, table):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
    bsd2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above notice."""
    bsd3 = bsd2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    lgpl = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
    want = [(mit, "MIT"), (bsd2, "BSD-2-Clause"), (bsd3, "BSD-3-Clause"), (apache, "Apache-2.0"), (gpl, "GPL-3.0"), (gpl.replace("version 3", "version 2"), "GPL-2.0"), (lgpl, "LGPL"), ("Licensed under the Apache\r\nLicense, Version 2.0", "Apache-2.0")]
    rows = [(f"{lead}{t}".replace("\n", f"\n{lead}"), name) for t, name in want for lead in ("", " * ", "# ", "// ")]
    got = {r.doc_id: r.licenses for r in licenses.scan(table([(k, t) for k, (t, _) in enumerate(rows)])).collect()}
    assert [got[k] for k in range(len(rows))] == [[name] for _, name in rows]
    apart = "Licensed under the Apache\n\nLicense, Version 2.0"
    assert licenses.scan(table([(1, apart)])).collect()[0].licenses == []


PUBLISHED = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MIT": "The MIT License (MIT)\n\nCopyright (c) 2020 Some Body\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-3-Clause": "Copyright 2020 Some Body\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL": "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999",
}


def test_published_texts_wrapped_and_in_comments(spark, table):
    def wrapped(text, lead, width=76):
        return "\n".join(lead + line for part in text.split("\n") for line in textwrap.wrap(part, width - len(lead)) or [""])

    rows = [(wrapped(t, lead), name) for name, t in PUBLISHED.items() for lead in ("", " * ", "# ", "// ", "    ")]
    rows += [(f"{lead}SPDX-License-Identifier: {name}", name) for name, _ in licenses.SPDX if "LGPL" not in name for lead in ("", "// ", "# ", "/* ")]
    got = {r.doc_id: r for r in licenses.scan(table([(k, t) for k, (t, _) in enumerate(rows)])).collect()}
    assert [got[k].licenses for k in range(len(rows))] == [[name] for _, name in rows]
    assert all(got[k].commercial == ("NC" not in name) for k, (_, name) in enumerate(rows))


def test_spdx_expressions_and_prose(spark):
    schema = "doc_id long, text string, ids string, licenses string, sentence_ids int"
    rows = [(1, "SPDX-License-Identifier: (MIT OR Apache-2.0)", "", "", 0), (2, "the GNU General Public License and the ISC license were compared", "", "", 0), (3, "SPDX-License-Identifier: GPL-2.0-or-later", "", "", 0), (1, "SPDX-License-Identifier: (MIT OR Apache-2.0)", "", "", 0)]
    got = sorted((r.doc_id, tuple(r.licenses)) for r in licenses.scan(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, ("Apache-2.0", "MIT")), (1, ("Apache-2.0", "MIT")), (2, ()), (3, ("GPL-2.0",))]


def test_urls_that_are_long_repeated_or_without_an_id(spark):
    long = "https://long.org/" + "a/" * 100_000
    rows = [(1, long, "h", 1), (1, long, "h", 1), (None, "http://x.com/a", "h", 1), (2, "http://x.com/a", "h", 1), (3, None, "h", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, text string, chunk int")
    got = sorted((r.page_id or 0, len(r.path), r.rule or "", r.verdict) for r in urls.judge(pages).collect())
    assert [g[:3] for g in got] == [(0, 2, "com/"), (1, 200_001, ""), (1, 200_001, ""), (2, 2, "com/"), (3, 0, "")] and got[1] == got[2]
    assert urls.judge(spark.createDataFrame([], pages.schema)).collect() == []
