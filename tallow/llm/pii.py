"""Personal data: base patterns, extended by bootstrapped contexts.  DataFrame functions only.

Base spans come from four regular expressions with checks.  They are the seeds
of a bootstrap over the whole corpus.  Its instances are runs of
identifier-like tokens (with a digit, an at sign or a bracketed "at"), spaces
included, so a phone number or a card in groups is one instance; tokens with
an at sign stand alone and a plus begins a new one.  The words on
both sides of an instance, or the end of the text, make a lexical pattern; on
the graph of patterns and instances confidence is passed back and forth; and
the patterns that end above the bar add the instances they stand around.  An
instance of a shape that no seed of the kind has needs more: its confidence is
the square of its pattern's.

Positions are code points, ends exclusive.  They follow from the pieces
between matches: split() and regexp_extract_all() walk over the same
leftmost, non-overlapping matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise

#: In the order of the digest.  Possessive groups and the look-behinds (a match begins a run, or where the last one
#: ended) leave the matches as they are and keep the time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "\\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_BLOCK = 1024
_SPAN = "array<struct<start:int,end:int,text:string>>"


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    parts = F.transform(
        F.filter(each, lambda d: d.isNotNull()),
        lambda d, k: F.when(k % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2)),
    )
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": F.when(n.between(16, 19), luhn(digits)).otherwise(F.lit(False)),
        "phone": n.between(8, 15),
    }[kind]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine) -> Column:
    """``combine`` of each place and all before it, in log2(n) passes over the array: nothing grows from place to place."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(state: Column, k: Column) -> Column:
        shift = F.pow(F.lit(2), k).cast("int")
        return F.transform(state, lambda x, at: F.when(at >= shift, combine(x, F.get(state, at - shift))).otherwise(x))

    return F.aggregate(passes, F.transform(values, lambda x: F.when(x.isNotNull(), x)), step)


def _starts(found: Column, gaps: Column) -> Column:
    """Where each match begins, from the matches and the lengths of the pieces around them."""
    steps = F.zip_with(gaps, F.concat(F.array(F.lit(0)), F.transform(found, F.length)), lambda gap, n: gap + n)
    return F.slice(running(steps, lambda x, y: x + y), F.lit(1), F.size(found))


def matches(text: Column, kind: str) -> Column:
    """Spans of a kind's valid matches in a non-null text."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(both: Column) -> Column:
        pairs = F.arrays_zip(both["found"].alias("text"), _starts(both["found"], both["gaps"]).alias("start"))
        good = F.filter(pairs, lambda m: valid(kind, m["text"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end"), m["text"].alias("text")))

    spans = _let(F.struct(found.alias("found"), gaps.alias("gaps")), placed)
    return F.when(text.rlike(_NEEDS[kind]), spans).otherwise(F.array().cast(_SPAN))


#: Identifier-like tokens with one blank between each two.  A token with an at sign stands alone, one that begins with a
#: plus begins an instance, so that identifiers in a row are instances of their own.  Possessive: the time is linear.
_MARK = r"(?=[^\s]*?(?:[0-9@]|[\[({]at[\])}]))"
_ALONE = r"[^\s@]*+@\S*+"
_RUN = rf"(?<!\S)(?:{_ALONE}|{_MARK}\S++(?:[ \t](?![(]?\+|{_ALONE}){_MARK}\S++)*+)"
_LEAD, _TAIL = r"^[^\p{L}\p{N}+(]+", r"[^\p{L}\p{N}]+$"
_BLANKS = " \t\n\x0b\x0c\r"
_ITEM = "array<struct<start:int,end:int,core:string,left:string,right:string>>"


def _word(gap: Column, last: bool) -> Column:
    """The last or first word of the piece between two instances, in lower case; empty if it is blank."""
    flat = F.translate(gap, _BLANKS, " " * len(_BLANKS))
    return F.lower(F.substring_index(F.rtrim(flat), " ", -1) if last else F.substring_index(F.ltrim(flat), " ", 1))


def _contexts(text: Column) -> Column:
    """Instances of a text with the word before and after: array of (start, end, core, left, right).

    Start, end and core leave out marks at the edges.  Without a word between
    it and the end of the text or another instance, an instance has ^ or $ there.
    """
    found = F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))

    def placed(both: Column) -> Column:
        gaps, n = both["gaps"], F.size(both["found"])
        each = F.arrays_zip(
            both["found"].alias("one"),
            _starts(both["found"], F.transform(gaps, F.length)).alias("low"),
            F.slice(gaps, F.lit(1), n).alias("before"),
            F.slice(gaps, F.lit(2), n).alias("after"),
        )

        def item(e: Column) -> Column:
            low = e["low"] + F.length(F.regexp_extract(e["one"], _LEAD, 0))
            core = F.regexp_replace(F.regexp_replace(e["one"], _LEAD, ""), _TAIL, "")
            left, right = F.coalesce(F.nullif(_word(e["before"], True), F.lit("")), F.lit("^")), F.coalesce(F.nullif(_word(e["after"], False), F.lit("")), F.lit("$"))
            return F.struct(low.alias("start"), (low + F.length(core)).alias("end"), core.alias("core"), left.alias("left"), right.alias("right"))

        return F.transform(each, item)

    items = _let(F.struct(found.alias("found"), F.split(text, _RUN, -1).alias("gaps")), placed)
    return F.when(text.rlike(r"[0-9@]|[\[({]at[\])}]"), items).otherwise(F.array().cast(_ITEM))


def shape(token: Column) -> Column:
    """A token with runs of digits as 9, of letters as a."""
    return F.regexp_replace(F.regexp_replace(token, r"\p{L}+", "a"), r"[0-9]+", "9")


def bootstrap(instances: DataFrame, rounds: int = 3, support: int = 5, bar: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Confident patterns (``left``, ``right``, ``kind``, ``confidence``) and the seeds' shapes (``kind``, ``shape``).

    ``instances`` has ``token``, ``shape``, ``left``, ``right`` and ``kind``,
    which is null for tokens that no base span is in.  In each round a
    pattern's confidence in a kind is the mean of its instances' (1 for seeds,
    0 for other kinds' seeds), with one failure added; an unseen instance's is
    the best of its patterns', squared if no seed of the kind has its shape.
    A pattern counts from ``support`` different instances with a confidence on.
    """
    # different instances of a pattern are all that the rounds read; a token has one shape and one kind
    edges = materialise(instances.select("left", "right", "token", "shape", "kind").distinct(), "edges")
    shapes = edges.filter("kind is not null").select("kind", "shape").distinct()
    seeds = edges.filter("kind is not null").select("left", "right", "kind", F.lit(1.0).alias("confidence"))
    unseen = edges.filter("kind is null").drop("kind")
    total = edges.groupBy("left", "right").agg(F.count("*").alias("n"))
    patterns, known = None, seeds
    for step in range(rounds):
        if patterns is not None:
            hits = believed(unseen.join(patterns, ["left", "right"]), shapes)
            best = hits.groupBy("token", "kind").agg(F.max("confidence").alias("confidence"))
            known = seeds.unionByName(unseen.join(best, "token").select("left", "right", "kind", "confidence"))
        patterns = (
            known.groupBy("left", "right", "kind")
            .agg(F.sum("confidence").alias("sum"), F.count("*").alias("n_known"))
            .join(total, ["left", "right"])
            .withColumn("confidence", F.col("sum") / (F.col("n") + 1))
            .filter((F.col("n_known") >= support) & (F.col("confidence") >= bar / 2))
            .select("left", "right", "kind", "confidence")
        )
        patterns = materialise(patterns, f"patterns{step}")
    return patterns.filter(F.col("confidence") >= bar), shapes


def believed(hits: DataFrame, shapes: DataFrame) -> DataFrame:
    """Unseen instances in patterns with their own confidence: the pattern's, squared for a shape that the kind's seeds lack."""
    seen = shapes.withColumn("seen", F.lit(True))
    own = F.when(F.col("seen"), F.col("confidence")).otherwise(F.col("confidence") * F.col("confidence"))
    return hits.join(seen, ["kind", "shape"], "left").withColumn("confidence", own).drop("seen")


def _tag(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """Base spans (kind, start, end) of a non-null text, by kind and start."""
    return F.concat(*[F.transform(matches(text, k), _tag(k)) for k in KINDS])


def _kind_in(core: Column) -> Column:
    """The first kind with a base span in an instance; null for none."""

    def held(kind: str) -> Column:
        found = F.regexp_extract_all(core, F.lit(PATTERNS[kind]), F.lit(0))
        return core.rlike(_NEEDS[kind]) & F.exists(found, lambda x: valid(kind, x))

    return F.coalesce(*[F.when(held(k), F.lit(k)) for k in KINDS])


def _added(docs: DataFrame, id_col: str, text_col: str, rounds: int, support: int, bar: float) -> DataFrame:
    """Spans that the bootstrap adds: one row for an id and text hash, with ``added``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.explode(_contexts(text)).alias("c")).select("id", "hash", "c.*")
    rows = rows.filter(F.col("core") != "")
    rows = rows.select("id", "hash", "start", "end", "left", "right", F.xxhash64("core").alias("token"), F.xxhash64(shape(F.col("core"))).alias("shape"), _kind_in(F.col("core")).alias("kind"))
    instances = materialise(rows, "instances")
    patterns, shapes = bootstrap(instances, rounds, support, bar)
    hits = believed(instances.filter("kind is null").drop("kind").join(patterns, ["left", "right"]), shapes).filter(F.col("confidence") >= bar)
    best = hits.groupBy("id", "hash", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    spans = best.groupBy("id", "hash").agg(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "end")).alias("added"))
    return materialise(spans, "added")


def _with_added(rows: DataFrame, added: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``rows`` with ``added`` (null for none) by id and text hash; broadcast only if its counted size is at most ``most`` bytes."""
    right = added.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "added")
    size = added.agg(F.sum(F.size("added") * 64 + 128)).first()[0] or 0
    if size <= most:
        right = F.broadcast(right)
    return rows.join(right, rows["hash"].eqNullSafe(right["_hash"]) & rows["id"].eqNullSafe(right["_id"]), "left").drop("_id", "_hash")


def _merged(base: Column, added: Column) -> Column:
    """All spans in the order of kinds, then starts; added ones that overlap a base span go.

    An added span overlaps one if the base spans that start before its end
    reach beyond its start: a running maximum over all spans in order.
    """
    order = F.array(*[F.lit(k) for k in KINDS])

    def event(is_base: bool):
        at = (lambda s: s["start"]) if is_base else (lambda s: s["end"])
        reach = (lambda s: s["end"]) if is_base else (lambda s: F.lit(0))
        return lambda s: F.struct(at(s).alias("at"), F.lit(is_base).alias("base"), reach(s).alias("reach"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))

    def kept(events: Column) -> Column:
        reached = F.zip_with(events, running(F.transform(events, lambda e: e["reach"]), F.greatest), lambda e, r: F.struct(e.alias("e"), r.alias("r")))
        fresh = F.filter(reached, lambda x: x["e"]["base"] | (x["r"] <= x["e"]["start"]))
        ranked = F.array_sort(F.transform(fresh, lambda x: F.struct(F.array_position(order, x["e"]["kind"]).alias("rank"), x["e"]["start"].alias("start"), x["e"]["end"].alias("end"), x["e"]["kind"].alias("kind"))))
        return F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    both = F.array_sort(F.concat(F.transform(base, event(True)), F.transform(added, event(False))))
    return F.when(F.size(F.coalesce(added, F.array())) > 0, _let(both, kept)).otherwise(base)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 5, bar: float = 0.9) -> DataFrame:
    """Per row: ``id_col``, ``base`` and ``spans``, arrays of (kind, start, end) in the order of kinds, then starts.

    ``base`` has the spans of the base patterns; ``spans`` has them and those
    that the bootstrap adds: instances that overlap no base span, in a
    confident pattern.  Null and empty texts have no spans; very long ones are
    read whole, with tokens and words of any length.  A row in gives a row
    out; rows that share an id, or have none, get the spans of their own text.
    Of patterns with the same confidence in two kinds the later name wins.
    Other columns are not read.  No rows give no rows.
    """
    added = _added(docs, id_col, text_col, rounds, support, bar)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _with_added(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), base_spans(text).alias("base")), added)
    return rows.select(F.col("id").alias(id_col), "base", _merged(F.col("base"), F.col("added")).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what find() returns; counts are of the base spans."""
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 5, bar: float = 0.9) -> DataFrame:
    """``docs`` with every span of find() replaced by its kind in brackets, as in ``[EMAIL]``.

    Overlapping spans are replaced together, under the kind of the one that
    starts first.  All rows and columns stay, whatever their names; null texts
    stay null.
    """
    added = _added(docs, id_col, text_col, rounds, support, bar)
    text = F.col("row").getField(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumns({"id": F.col("row").getField(id_col), "hash": F.xxhash64(F.coalesce(text, F.lit("")))})
    rows = _with_added(rows.withColumn("base", base_spans(F.coalesce(text, F.lit("")))), added).withColumn("spans", _merged(F.col("base"), F.col("added")))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(piece: Column, low: Column, n: Column) -> Column:
        """A substring; from blocks of the text, as substr() walks from the beginning each time."""
        first = F.floor(low / _BLOCK).cast("int")
        near = F.array_join(F.slice(piece, first + 1, F.floor((low + n) / _BLOCK).cast("int") - first + 1), "")
        return F.substr(near, low - first * _BLOCK + 1, n)

    def replaced(x: Column) -> Column:
        # a span goes under its own mark if it starts where all before it have ended
        ends = F.concat(F.array(F.lit(0)), running(F.transform(x["spans"], lambda s: s["end"]), F.greatest))
        pairs = F.filter(F.arrays_zip(x["spans"].alias("s"), F.slice(ends, F.lit(1), F.size(x["spans"])).alias("at")), lambda p: p["s"]["start"] >= p["at"])
        parts = F.transform(pairs, lambda p: F.concat(cut(x["blocks"], p["at"], p["s"]["start"] - p["at"]), F.lit("["), F.upper(p["s"]["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), F.substr(text, F.element_at(ends, -1) + 1))

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    changed = _let(F.struct(ordered.alias("spans"), blocks.alias("blocks")), replaced)
    whole = F.when(F.size("spans") > 0, changed).otherwise(text)
    return rows.select(*[(whole if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
