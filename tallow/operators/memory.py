"""Bounded research memory of an episode: novelty, ranking and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add_evidence(documents: DataFrame, episode: str = "episode") -> DataFrame:
    """First appearances of snippets in an episode, in order of (turn, position).

    ``documents`` has episode, turn, position, url, title, text, score.  Out
    come evidence_id, source_id (both by first appearance), snippet and the
    rest; empty and repeated snippets go.
    """
    rows = documents.withColumn("snippet", F.trim(F.regexp_replace("text", r"\s+", " "))).withColumn("source", F.coalesce(F.nullif("url", F.lit("")), "title"))
    place = Window.partitionBy(episode).orderBy("first_turn", "first_position")
    sources = rows.groupBy(episode, "source").agg(F.min(F.struct(F.col("turn").alias("first_turn"), F.col("position").alias("first_position"))).alias("f")).select(episode, "source", "f.*")
    sources = sources.select(episode, "source", F.concat(F.lit("S"), F.row_number().over(place).cast("string")).alias("source_id"))
    rows = rows.withColumn("digest", F.sha2(F.lower("snippet"), 256)).filter("snippet <> ''")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(episode, "digest").orderBy("turn", "position"))).filter("n = 1")
    number = F.row_number().over(Window.partitionBy(episode).orderBy("turn", "position"))
    rows = rows.withColumn("evidence_id", F.concat(F.lit("E"), number.cast("string")))
    return rows.join(sources, [episode, "source"]).select(episode, "evidence_id", "source_id", "title", "url", F.substring("snippet", 1, 700).alias("snippet"), "score", "turn")


def render(evidence: DataFrame, budget: int, limit: int = 8, reserve: int = 200, episode: str = "episode") -> DataFrame:
    """Ranked evidence lines up to the first that overflows a budget of characters."""
    w = Window.partitionBy(episode).orderBy(F.desc("score"), "turn", "evidence_id")
    rows = evidence.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    rows = rows.withColumn("line", F.concat(F.lit("- ["), "source_id", F.lit("] "), F.substring("snippet", 1, 400)))
    used = F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(len("<research_state>\nKnown:")) + reserve
    rows = rows.withColumn("over", (used > budget).cast("int")).withColumn("over", F.max("over").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.groupBy(episode).agg(F.array_sort(F.collect_list(F.when(F.col("over") == 0, F.struct("rank", "line")))).alias("lines"))
    shown = F.when(F.size("lines") == 0, F.array(F.lit("- None"))).otherwise(F.transform("lines", lambda x: x["line"]))
    return kept.select(episode, F.concat(F.lit("<research_state>\nKnown:\n"), F.array_join(shown, "\n")).alias("rendered"), F.size("lines").cast("long").alias("n_lines"))


def summary(documents: DataFrame, cap: int, episode: str = "episode") -> DataFrame:
    """Per episode: searches left, repeated queries, repeated URLs."""
    first = F.row_number().over(Window.partitionBy(episode, "url").orderBy("turn", "position")) == 1
    rows = documents.withColumn("new", first.cast("long"))
    turns = rows.groupBy(episode, "turn").agg(F.count("*").alias("returned"), F.sum("new").alias("new"), F.min("query").alias("query"))
    return turns.groupBy(episode).agg(
        F.greatest(F.lit(0), F.lit(cap) - F.count("*")).alias("remaining"),
        (F.count("*") - F.countDistinct("query")).alias("duplicate_queries"),
        F.sum(F.greatest(F.lit(0), F.col("returned") - F.col("new"))).alias("duplicate_urls"),
        F.round(F.sum("new") / F.count("*"), 4).alias("new_per_search"),
    )
