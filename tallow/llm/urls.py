"""URL filters: rules first, then a ratio of two character language models.

URLs that an allow or a block rule decides are the labelled data.  Two
variable-order Markov models (orders 0 to 4, each smoothed by the next lower
one) are counted over all of them, and a URL that no rule decides is judged by
the difference of its mean log-likelihoods, against a threshold calibrated on
the labelled URLs that were left out of the counts.

The counts are exact: an n-gram is a number of its symbols, not a hash, and
the tables of n-grams are distributed and grow with the URLs.  A symbol's
probabilities follow from the n-gram of the highest order that ends in it, so
each different one is valued once, and URLs look up values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise

#: Host, path and verdict of each rule.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: SLOTS: at most so many URLs, neighbours in a partition, share a list of their n-grams.
ORDERS, SLOTS, STRENGTH = 5, 1 << 15, 4.0
#: Symbols are bytes, the start and the end.
_BASE, _START, _END = 258, 256, 257
_BINS, _SPAN = 801, 8.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, low).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (host and path together) that fits; null for none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of every symbol: its text, and the n-gram of the highest order as a number, the last symbol as its last digit."""
    raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64) for t in texts]
    ends = [np.full(ORDERS - 1, _START), np.array([_END])]
    x = np.concatenate([part for r in raw for part in (ends[0], r, ends[1])])
    size = np.array([len(r) + ORDERS for r in raw])
    at = np.flatnonzero(np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) >= ORDERS - 1)
    gram = np.zeros(len(at), np.int64)
    for o in range(ORDERS - 1, -1, -1):
        gram = gram * _BASE + x[at - o]
    return np.repeat(np.arange(len(raw)), size)[at], gram


def scores(texts: list[str], tables: np.ndarray) -> np.ndarray:
    """Mean over a text's symbols of their values; ``tables`` are sorted n-grams and the value of each, 0 for others."""
    grams, values = (np.ravel(t) for t in tables)
    out = [np.empty(0)]
    for low in range(0, len(texts), 4096):
        some = texts[low : low + 4096]
        text, gram = ngrams(some)
        value = np.zeros(len(gram))
        if len(grams):
            place = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            value = np.where(grams[place] == gram, values[place], 0.0)
        out.append(np.bincount(text, value, len(some)) / np.bincount(text, minlength=len(some)))
    return np.concatenate(out)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different n-grams of a chunk's rows in a batch, with their numbers in allowed and in blocked URLs that count."""
    for batch in batches:
        chunks, texts, verdicts = (batch.column(k).to_pylist() for k in range(3))
        for low in range(0, len(texts), 4096):
            text, gram = ngrams(texts[low : low + 4096])
            chunk = np.array(chunks[low : low + 4096], np.int64)[text]
            kind = np.array([{"allow": 1, "block": 2}.get(v, 0) for v in verdicts[low : low + 4096]])[text]
            order = np.lexsort((gram, chunk))
            chunk, gram, kind = chunk[order], gram[order], kind[order]
            first = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (gram[1:] != gram[:-1])])
            n = [np.add.reduceat((kind == k).astype(np.int64), first) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[first]), pa.array(gram[first]), *map(pa.array, n)], ["chunk", "gram", "allow", "block"])


def values(grams: DataFrame) -> DataFrame:
    """``gram``, ``value``: log-probability of its last symbol under the accepted model less that under the rejected one.

    ``grams`` has each n-gram of the highest order once, with its numbers
    ``allow`` and ``block``, which may be 0.  No n-gram of an order ends more
    than _BASE longer ones and no context has more than _BASE symbols, so no
    key of these joins is large.
    """
    levels = [grams]
    for o in range(ORDERS - 1, 0, -1):
        shorter = (F.col("gram") % F.lit(_BASE**o)).alias("gram")
        levels.append(levels[-1].groupBy(shorter).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    known = None
    for o, level in enumerate(reversed(levels)):
        level = level.withColumn("context", F.floor(F.col("gram") / F.lit(_BASE)))
        total = level.groupBy("context").agg(F.sum("allow").alias("in_allow"), F.sum("block").alias("in_block"))
        level = level.join(total, "context")
        if o == 0:
            level = level.withColumns({"p": F.lit(1 / 256), "q": F.lit(1 / 256)})
        else:
            level = level.withColumn("shorter", F.col("gram") % F.lit(_BASE**o)).join(known, "shorter")
        p, q = ((F.col(n) + STRENGTH * F.col(before)) / (F.col(f"in_{n}") + STRENGTH) for n, before in (("allow", "p"), ("block", "q")))
        known = level.select(F.col("gram").alias("shorter"), p.alias("p"), q.alias("q"))
    return known.select(F.col("shorter").alias("gram"), (F.log("p") - F.log("q")).alias("value"))


def _scored(columns: list[str]):
    def run(rows: pa.Table, listed: pa.Table) -> pa.Table:
        gram, at = np.unique(listed.column("gram").to_numpy(), return_index=True)
        got = scores(rows.column("text").to_pylist(), (gram, listed.column("value").to_numpy()[at]))
        return rows.append_column("score", pa.array(got, pa.float64())).select(columns)

    return run


def threshold(counts: dict[tuple[int, str], int]) -> float:
    """The score with the best balanced accuracy over binned scores; the nearest to 0 of equal ones."""
    allow, block = np.zeros(_BINS), np.zeros(_BINS)
    for (b, verdict), n in counts.items():
        (allow if verdict == "allow" else block)[b] += n
    if not allow.sum() or not block.sum():
        return 0.0
    edges = (np.arange(_BINS) / (_BINS - 1) - 0.5) * 2 * _SPAN
    below_allow, below_block = np.r_[0, np.cumsum(allow)[:-1]], np.r_[0, np.cumsum(block)[:-1]]
    good = (1 - below_allow / allow.sum()) + below_block / block.sum()
    best = np.flatnonzero(good == good.max())
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` for every row.

    A null URL or one without :// has an empty host and path.  The models see
    host and path.  Without labelled URLs of both kinds the score is about 0
    and the threshold 0, and URLs are allowed from it on.  Repeated rows give
    a row each and count each.  Only two columns are read.
    """
    url = F.col("u")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("u"))
    rows = rows.select("id", host_of(url).alias("host"), path_of(url).alias("path"))
    name, ruled = matched(F.col("host"), F.col("path"), rules)
    # the number has the partition above bit 33 and the row below
    chunk = F.shiftright(F.monotonically_increasing_id(), SLOTS.bit_length() - 1).alias("chunk")
    rows = materialise(rows.select("id", "host", "path", name.alias("rule"), ruled.alias("ruled"), F.concat("host", "path").alias("text"), chunk), "urls")
    held = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    listed = rows.select("chunk", "text", F.when(~held, F.col("ruled")).alias("ruled")).mapInArrow(_listed, "chunk long, gram long, allow long, block long")
    listed = materialise(listed, "listed")
    grams = listed.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    valued = listed.select("chunk", "gram").join(values(materialise(grams, "grams")), "gram")
    columns = ["id", "host", "path", "rule", "ruled", "text", "score"]
    scored = rows.groupBy("chunk").cogroup(valued.groupBy("chunk")).applyInArrow(
        _scored(columns), f"id {dict(pages.dtypes)[id_col]}, host string, path string, rule string, ruled string, text string, score double"
    )
    scored = materialise(scored, "scored")
    place = F.greatest(F.lit(0), F.least(F.lit(_BINS - 1), F.floor((F.col("score") / (2 * _SPAN) + 0.5) * (_BINS - 1)).cast("int")))
    tried = scored.filter(held & F.col("ruled").isNotNull()).groupBy(place.alias("b"), "ruled").count()
    bar = threshold({(r.b, r.ruled): r["count"] for r in tried.collect()})
    verdict = F.coalesce("ruled", F.when(F.col("score") < bar, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
