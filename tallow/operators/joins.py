"""Joins with a rule: nested lookups, overlaps, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fact_sentence(contexts: Column, fact: Column) -> Column:
    """The sentence a fact names; of contexts with one title the last counts; null if there is none."""
    hits = F.filter(contexts, lambda c: c["title"] == fact["title"])
    return F.get(F.get(hits, F.size(hits) - 1)["sentences"], fact["sentence_id"])


def fact_sentences(df: DataFrame, contexts: str = "contexts", fact: str = "fact") -> DataFrame:
    return df.withColumn("sentence", fact_sentence(F.col(contexts), F.col(fact)))


def overlaps(df: DataFrame, split: str = "split", id_: str = "id") -> DataFrame:
    """Shared ids of each pair of splits: ids gather their few splits, which pair up in place of a self join."""
    sets = df.groupBy(id_).agg(F.sort_array(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("l"), b.alias("r")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.l", "p.r").agg(F.count("*").alias("n"))


def fill_placeholder(df: DataFrame, fills: DataFrame, key: str, column: str, placeholder: str) -> DataFrame:
    rows = df.join(fills, key, "left")
    filled = F.when(F.col("fill").isNull(), F.col(column)).otherwise(F.replace(F.col(column), F.lit(placeholder), F.col("fill")))
    return rows.withColumn(column, filled).drop("fill")
