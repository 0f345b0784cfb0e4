"""BM25 over candidates of a group, and chunk ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import benchmark_url, public_http
from ..functions.text import bm25_terms, content_id, sentences, web_tokens
from .index import Index, idf, impact


def bm25(candidates: DataFrame, queries: DataFrame, group: str, candidate: str, terms: str = "terms", k1: float = 1.2, b: float = 0.75, length: str | None = None) -> DataFrame:
    """``group``, ``candidate``, ``score`` of the candidates that share a term with their group's query.

    ``candidates`` has (group, candidate, terms), ``queries`` (group, terms).
    Frequencies and lengths are of the group; a term that a query repeats
    counts each time.  Of the candidates' terms only those that the query has
    are counted and shuffled; texts and other terms never are.  with_zeros()
    adds candidates without a common term where a ranking needs them.
    ``length`` names the number of a candidate's terms where those that no
    query has are left out.
    """
    dl = F.col(length) if length else F.size(terms)
    asked = queries.select(group, F.explode(terms).alias("term")).groupBy(group, "term").agg(F.count("*").alias("qf"))
    stats = candidates.groupBy(group).agg(F.count("*").alias("n"), F.avg(dl).alias("avgdl"))
    each = candidates.select(group, candidate, dl.alias("dl"), F.explode(terms).alias("term")).join(asked, [group, "term"])
    tf = each.groupBy(group, "term", candidate, "dl", "qf").agg(F.count("*").alias("tf"))
    df = tf.groupBy(group, "term").agg(F.count("*").alias("df"))
    rated = tf.join(df, [group, "term"]).join(stats, group)
    part = F.col("qf") * idf(F.col("n"), F.col("df")) * impact(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return rated.groupBy(group, candidate).agg(F.sum(part).alias("score"))


def with_zeros(ranked: DataFrame, candidates: DataFrame, group: str, candidate: str, k: int, order: list) -> DataFrame:
    """The ranked rows (``rank`` from 1) with candidates that share no term after them, up to ``k`` a group.

    Only groups with fewer than ``k`` are read again; ``order`` is that of
    candidates with one score.
    """
    short = candidates.select(group).distinct().join(ranked.groupBy(group).agg(F.count("*").alias("have")), group, "left").fillna(0, ["have"]).filter(F.col("have") < k)
    rest = candidates.select(group, candidate).join(short, group).join(ranked.select(group, candidate), [group, candidate], "left_anti")
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    rest = rest.withColumn("place", place).filter(F.col("place") <= k - F.col("have"))  # the limit of a row number is taken before the shuffle
    return ranked.select(group, candidate, "score", "rank").unionByName(rest.select(group, candidate, F.lit(0.0).alias("score"), (F.col("have") + F.col("place")).cast("int").alias("rank")))


def top(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def sentence_terms(df: DataFrame, group: str, source: str, text: str) -> DataFrame:
    """Sentences of each source with their place and terms."""
    rows = df.select(group, source, F.posexplode(sentences(text)).alias("position", "sentence"))
    return rows.withColumn("terms", bm25_terms("sentence"))


def chunks(pages: DataFrame, query: Column, id_col: str, text: str, least: int = 40, most: int = 1400) -> DataFrame:
    """Paragraphs of at least ``least`` characters with the number of query tokens in each; equal paragraphs once."""
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    rows = pages.select(id_col, query.alias("query"), F.posexplode(blocks).alias("position", "block"))
    score = F.size(F.array_intersect(web_tokens("query"), web_tokens("block"))).cast("long")
    key = F.regexp_replace(F.lower(F.substring("block", 1, most)), r"\s+", " ")
    rows = rows.select(id_col, "position", F.substring("block", 1, most).alias("text"), score.alias("score"), content_id(key, "web_", 12).alias("document_id"))
    first = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), id_col, "position"))
    return rows.withColumn("n", first).filter("n = 1").drop("n")


def context_documents(responses: DataFrame, id_col: str, query: str, items: str, most: int = 1400) -> DataFrame:
    """Documents of a context provider, in its order: (``id_col``, rank, document_id, title, url, text, score).

    ``items`` has (url, title, snippets).  Leaks of benchmarks go before ranks
    are given; snippets are joined and cut, and the score is the number of
    the query's tokens in the text.
    """
    kept = F.filter(items, lambda x: ~F.coalesce(benchmark_url(x["url"]), F.lit(False)))
    rows = responses.select(id_col, F.col(query).alias("query"), F.posexplode(kept).alias("place", "x"))
    rows = rows.select(id_col, "query", (F.col("place") + 1).alias("rank"), F.col("x.title").alias("title"), F.col("x.url").alias("url"), F.substring(F.array_join("x.snippets", "\n\n"), 1, most).alias("text"))
    score = F.size(F.array_intersect(web_tokens("query"), web_tokens("text"))).cast("double")
    return rows.select(id_col, "rank", content_id(F.concat_ws("\n", "url", "text"), "web_", 12).alias("document_id"), "title", "url", "text", score.alias("score"))


def checked(asked: DataFrame, known: DataFrame, request: str, topk: int = 5) -> DataFrame:
    """Retrieval requests (``request``, sample_id, query, topk), trimmed, with their ``error`` (null for none).

    ``known`` has the sample ids that can be asked, each once.  An id or a
    query that is blank is an error before an id that isn't known; ``topk`` of
    null or 0 is the default.
    """
    sample, query = F.trim(F.coalesce("sample_id", F.lit(""))), F.trim(F.coalesce("query", F.lit("")))
    rows = asked.select(request, sample.alias("sample_id"), query.alias("query"), F.coalesce(F.nullif("topk", F.lit(0)), F.lit(topk)).alias("topk"))
    rows = rows.join(known.select("sample_id", F.lit(True).alias("known")), "sample_id", "left")
    blank = (F.col("sample_id") == "") | (F.col("query") == "")
    error = F.when(blank, "sample_id and query required").when(F.col("known").isNull(), F.concat(F.lit("unknown sample_id: "), "sample_id"))
    return rows.withColumn("error", error)


def requests(asked: DataFrame, index: Index, request: str, topk: int = 5) -> tuple[DataFrame, DataFrame]:
    """Retrieval requests against an index whose groups are sample ids, by the rules of checked().

    Gives the errors, a row a request (null for none), and the ranked hits of
    requests without one.  Errors alone need no index: checked() does with the ids.
    """
    rows = checked(asked, index.groups.select(F.col("group").alias("sample_id")), request, topk)
    terms = F.transform(F.regexp_extract_all("query", F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    good = rows.filter("error is null").select(F.col(request).alias("query"), F.col("sample_id").alias("group"), terms.alias("terms"), F.col("topk").alias("k"))
    hits = index.top(good).select(F.col("query").alias(request), "rank", "candidate", "score")
    return rows.select(request, "error"), hits


def cached_pages(pages: DataFrame, cache: DataFrame, url: str) -> tuple[DataFrame, DataFrame]:
    """Pages whose text a cache (key, text) holds by the SHA-256 of the URL, and the public ones that must be fetched.

    URLs that aren't public HTTP are in neither; each URL is fetched once.
    """
    keyed = pages.filter(public_http(url)).withColumn("key", F.sha2(url, 256))
    return keyed.join(cache.select("key", "text"), "key"), keyed.join(cache.select("key"), "key", "left_anti").select("key", url).distinct()
