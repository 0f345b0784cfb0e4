"""A persisted inverted index for BM25: postings in blocks with the largest impact of each, and a top-k by shards.

The index is three Parquet tables in a folder: ``candidates``, with each
candidate's terms and their counts; ``groups`` (n, avgdl, shards); and
``postings``, a row for each block of up to ``block`` candidates of a term of a
shard of a group, best ones first, in folders by a hash of the group.

A group's candidates are dealt into shards of about SHARD by a hash, so that no
list, task or accumulator grows with the group.  Building shuffles candidates
once, with their terms as arrays; a shard's postings are made where they lie.

A search reads the blocks of the queries' terms (candidates without a common
term are never met), brings them to the queries of their group shard by shard,
adds up scores in an array of the shard's candidates, and passes on each
query's k best of the shard; no pair of query and candidate is shuffled.
blocks() and needed() tell which blocks those are and which of them can hold
one of the k best.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import let

#: About so many candidates of a group, and queries to it, meet in one task.
SHARD, CHUNK = 16384, 4096


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def impact(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """A term's part of a candidate's score but for the query's and the term's weights."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.greatest(F.lit(1.0), avgdl)))


@dataclass(frozen=True)
class Index:
    """A stored index; the tables as they are read."""

    postings: DataFrame
    groups: DataFrame
    candidates: DataFrame
    folders: int
    k1: float
    b: float

    @staticmethod
    def build(candidates: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, block: int = 128, folders: int = 64) -> Index:
        """Write the index of (group, candidate, terms) to a new folder and open it."""
        spark = candidates.sparkSession
        candidates.select("group", "candidate", F.size("terms").alias("dl"), counted(F.col("terms")).alias("counts")).write.parquet(f"{path}/candidates")
        each = spark.read.parquet(f"{path}/candidates")
        shards = F.ceil(F.count("*") / SHARD).cast("int")
        each.groupBy("group").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), shards.alias("shards")).write.parquet(f"{path}/groups")
        groups = spark.read.parquet(f"{path}/groups")
        dealt = each.join(groups.select("group", "avgdl", "shards"), "group").withColumn("shard", F.pmod(F.xxhash64("candidate"), F.col("shards")).cast("int"))
        folder = F.pmod(F.xxhash64("group"), F.lit(folders)).cast("int")
        # dealt by group and shard, so that grouping by these and the term needs no other shuffle
        dealt = dealt.select("group", "shard", "candidate", "dl", "avgdl", "counts").repartition("group", "shard")
        each = dealt.select("group", "shard", "candidate", "dl", "avgdl", F.explode("counts").alias("c"))
        rated = each.select("group", "shard", F.col("c.term").alias("term"), F.struct((-impact(F.col("c.tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("less"), "candidate").alias("e"))
        lists = rated.groupBy("group", "shard", "term").agg(F.sort_array(F.collect_list("e")).alias("es"))
        places = F.sequence(F.lit(0), F.floor((F.size("es") - 1) / block).cast("int"))
        rows = lists.select("group", "shard", "term", F.size("es").alias("held"), "es", F.explode(places).alias("block"))
        entries = F.transform(F.slice("es", F.col("block") * block + 1, F.lit(block)), lambda e: F.struct(e["candidate"].alias("candidate"), (-e["less"]).alias("impact")))
        rows = rows.select("group", "shard", "term", "block", "held", entries.alias("entries"))
        rows = rows.select("group", "shard", "term", "block", "held", F.get("entries", 0)["impact"].alias("most"), "entries", folder.alias("folder"))
        # a file's rows are sorted, so the groups and terms that it lacks are seen from its statistics
        rows.sortWithinPartitions("folder", "group", "term", "shard", "block").write.partitionBy("folder").parquet(f"{path}/postings")
        spark.createDataFrame([(folders, k1, b)], "folders int, k1 double, b double").coalesce(1).write.json(f"{path}/about")
        return Index.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        about = spark.read.schema("folders int, k1 double, b double").json(f"{path}/about").first()
        tables = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "groups", "candidates"))
        return Index(*tables, about.folders, about.k1, about.b)

    def weights(self, asked: DataFrame) -> DataFrame:
        """The terms of (query, group, terms, k) that the index has, with their weight in a score: (query, group, k, term, weight)."""
        terms = asked.select("query", "group", "k", F.explode("terms").alias("term")).groupBy("query", "group", "k", "term").agg(F.count("*").alias("qf"))
        first = self.postings.filter("block = 0").select("folder", "group", "term", "held")
        wanted = terms.select(*self._keys(), "term").distinct()
        df = first.join(wanted, ["folder", "group", "term"], "left_semi").groupBy("group", "term").agg(F.sum("held").alias("df"))
        terms = terms.join(df, ["group", "term"]).join(self.groups.select("group", "n"), "group")
        return terms.select("query", "group", "k", "term", (F.col("qf") * idf(F.col("n"), F.col("df"))).alias("weight"))

    def _keys(self) -> list[Column]:
        return [F.pmod(F.xxhash64("group"), F.lit(self.folders)).cast("int").alias("folder"), F.col("group")]

    def blocks(self, asked: DataFrame) -> DataFrame:
        """The blocks of the terms of (query, group, terms, k), with what each can add to a score at most, ``bound``, and all of a query's other terms, ``others``."""
        found = self.weights(asked).select("query", *self._keys(), "k", "term", "weight").join(self.postings, ["folder", "group", "term"])
        found = found.select("query", "group", "k", "term", "shard", "block", "weight", (F.col("weight") * F.col("most")).alias("bound"), "entries")
        own = found.filter("block = 0").groupBy("query", "term").agg(F.max("bound").alias("first"))
        best = own.groupBy("query").agg(F.sum("first").alias("all"))
        return found.join(best, "query").join(own, ["query", "term"]).withColumn("others", F.col("all") - F.col("first")).drop("all", "first")

    def needed(self, asked: DataFrame) -> DataFrame:
        """The blocks that may hold one of a query's ``k`` best candidates."""
        rows = self.blocks(asked)
        part = _scored(rows.filter("block = 0"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        least = part.withColumn("rank", rank).filter(F.col("rank") == F.col("k")).select("query", F.col("score").alias("least"))
        # rounding may take a little off a sum
        return rows.join(least, "query", "left").filter(F.col("least").isNull() | (F.col("bound") + F.col("others") >= F.col("least") * (1 - 1e-9) - 1e-7)).drop("least")

    def top(self, asked: DataFrame, digits: int = 8) -> DataFrame:
        """``query``, ``rank``, ``candidate``, ``score`` (rounded) of each query's ``k`` best candidates, ties to the smaller one.

        Candidates without a common term come last, with 0, if there are
        fewer than ``k`` others.
        """
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate"))
        scored = self._by_shard(asked, digits).withColumn("score", F.round("score", digits))
        best = scored.withColumn("rank", rank).filter(F.col("rank") <= F.col("k"))
        have = best.groupBy("query").agg(F.count("*").alias("have"))
        short = asked.select("query", "group", "k").join(have, "query", "left").fillna(0, ["have"]).filter(F.col("have") < F.col("k"))
        # of a group's k smallest candidates no more than those found aren't left
        most = asked.agg(F.max("k")).first()[0] or 0
        place = F.row_number().over(Window.partitionBy("group").orderBy("candidate"))
        small = self.candidates.select("group", "candidate").withColumn("place", place).filter(F.col("place") <= most).drop("place")
        rest = short.join(small, "group").join(best.select("query", "candidate"), ["query", "candidate"], "left_anti")
        place = F.row_number().over(Window.partitionBy("query").orderBy("candidate"))
        rest = rest.withColumn("place", place).filter(F.col("place") <= F.col("k") - F.col("have"))
        zeros = rest.select("query", (F.col("have") + F.col("place")).cast("int").alias("rank"), "candidate", F.lit(0.0).alias("score"))
        return best.select("query", "rank", "candidate", "score").unionByName(zeros)

    def _by_shard(self, asked: DataFrame, digits: int) -> DataFrame:
        """(query, k, candidate, score) of each query's ``k`` best candidates of each shard of its group."""
        weights = self.weights(asked)
        # a group's queries are dealt into chunks, which meet each shard on their own
        parts = asked.groupBy("group").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).join(self.groups.select("group", "shards"), "group")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = weights.join(parts, "group").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int"))
        left = left.select("group", "chunk", each("shards").alias("shard"), "query", "k", "term", "weight")
        wanted = asked.select(*self._keys(), F.explode("terms").alias("term")).distinct()
        right = self.postings.join(wanted, ["folder", "group", "term"], "left_semi").join(parts.select("group", "chunks"), "group")
        right = right.select("group", "shard", each("chunks").alias("chunk"), "term", F.col("entries.candidate").alias("candidates"), F.col("entries.impact").alias("impacts"))
        keys, kind = ["group", "shard", "chunk"], dict(left.dtypes) | dict(self.candidates.dtypes)
        best = lambda a, b: _best(a, b, digits)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"query {kind['query']}, k int, candidate {kind['candidate']}, score double")


def counted(terms: Column) -> Column:
    """A bag of terms as an array of (term, tf): runs of the sorted bag."""
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    runs = lambda s, at: F.transform(at, lambda b, j: F.struct(F.get(s, b).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - b).alias("tf")))
    return let(F.sort_array(terms), lambda s: let(begins(s), lambda at: runs(s, at)))


def _best(asked: pd.DataFrame, blocks: pd.DataFrame, digits: int) -> pd.DataFrame:
    """The best candidates of a shard for some queries of its group: sums in an array of the shard's candidates."""
    names = ["query", "k", "candidate", "score"]
    if asked.empty or blocks.empty:
        return pd.DataFrame(columns=names)
    lengths = blocks["candidates"].map(len).to_numpy()
    ids, places = np.unique(np.concatenate(blocks["candidates"].to_numpy()), return_inverse=True)
    impacts, ends = np.concatenate(blocks["impacts"].to_numpy()), np.cumsum(lengths)
    held: dict = {}
    for term, begin, end in zip(blocks["term"], ends - lengths, ends, strict=True):
        held.setdefault(term, []).append(slice(begin, end))
    found: list = [[], [], []]
    asked = asked.sort_values("query", kind="stable")
    queries, terms, weights, ks = (asked[c].to_numpy() for c in ("query", "term", "weight", "k"))
    starts = np.flatnonzero(np.append(True, queries[1:] != queries[:-1]))
    for begin, end in zip(starts, np.append(starts[1:], len(queries)), strict=True):
        sums, met = np.zeros(len(ids)), np.zeros(len(ids), bool)
        for term, weight in zip(terms[begin:end], weights[begin:end], strict=True):
            for part in held.get(term, ()):  # a candidate is in one block of a term
                sums[places[part]] += weight * impacts[part]
                met[places[part]] = True
        at, k = np.flatnonzero(met), int(ks[begin])
        rated = np.floor(sums[at] * 10.0**digits + 0.5)  # ranked as they are rounded
        if len(at) > k:
            enough = rated >= np.partition(rated, len(at) - k)[len(at) - k]
            at, rated = at[enough], rated[enough]
        at = at[np.lexsort((at, -rated))[:k]]
        for column, values in zip(found, (np.full(len(at), begin), ids[at], sums[at]), strict=True):
            column.append(values)
    row, candidates, scores = map(np.concatenate, found)
    return pd.DataFrame({"query": queries[row], "k": ks[row], "candidate": candidates, "score": scores}, columns=names)


def _scored(blocks: DataFrame) -> DataFrame:
    """Sums over the entries of blocks: (query, k, candidate, score)."""
    each = blocks.select("query", "k", "weight", F.explode("entries").alias("e"))
    return each.groupBy("query", "k", F.col("e.candidate").alias("candidate")).agg(F.sum(F.col("weight") * F.col("e.impact")).alias("score"))
