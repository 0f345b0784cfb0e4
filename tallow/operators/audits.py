"""Aggregates of evaluation runs: means, deltas, ranking and threshold metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ordered_places, running_sums
from .quantiles import linear_quantiles, nearest_ranks  # noqa: F401


def share(condition: Column) -> Column:
    """Mean of a condition, null counted as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def ratio(a: Column, b: Column) -> Column:
    """Sum over sum, with 1 for a sum of 0."""
    return F.sum(a) / F.greatest(F.lit(1), F.sum(b))


def placed(df: DataFrame, score: str, order: list, descending: bool = False) -> DataFrame:
    """``place`` (from 0) of each row by score, then by ``order``."""
    return ordered_places(df, [F.desc(score) if descending else F.asc(score), *order]).drop("total")


def cumulative_precision(df: DataFrame, label: str, score: str, id_col: str) -> DataFrame:
    """``id_col`` and ``precision`` at each row of label 1, by descending score, label 0 first among ties."""
    rows = df.select(id_col, label, score, F.lit(1).alias("row"), (F.col(label) == 1).cast("int").alias("hit"))
    rows = running_sums(rows, [F.desc(score), F.col(label), F.col(id_col)], ["row", "hit"])
    return rows.filter("hit = 1").select(id_col, (F.col("upto_hit") / F.col("upto_row")).alias("precision"))


def midranks(df: DataFrame, score: str) -> DataFrame:
    """``midrank``: the mean place of a row among those of its score."""
    counts = running_sums(df.groupBy(score).agg(F.count("*").alias("n")), [score], ["n"])
    ranks = counts.select(score, (F.col("upto_n") - F.col("n") + (F.col("n") + 1) / 2).alias("midrank"))
    return df.join(ranks, score)


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: AUROC by mid-ranks; null without both labels."""
    sums = midranks(df, score).agg(F.sum(F.when(F.col(label) == 1, F.col("midrank"))).alias("r1"), F.sum((F.col(label) == 1).cast("long")).alias("n1"), F.count("*").alias("n"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return sums.select(F.when((n1 > 0) & (n0 > 0), (F.col("r1") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auroc"))


def confusion(df: DataFrame, gold: str, predicted: str, positive) -> DataFrame:
    g, p = F.col(gold) == positive, F.col(predicted) == positive
    n = {k: F.sum(c.cast("long")) for k, c in {"tp": g & p, "fn": g & ~p, "fp": ~g & p, "tn": ~g & ~p}.items()}
    rows = df.agg(*[v.alias(k) for k, v in n.items()])
    rows = rows.withColumn("recall_pos", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")))
    rows = rows.withColumn("recall_neg", F.col("tn") / F.greatest(F.lit(1), F.col("tn") + F.col("fp")))
    return rows.withColumn("balanced", (F.col("recall_pos") + F.col("recall_neg")) / 2)


def threshold_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Recalls and balanced accuracy at each different score as threshold (positive: at or above).

    Running counts over one row a score replace the thresholds x rows product.
    """
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    per = running_sums(per, [F.desc("threshold")], ["pos", "neg"])
    recall_pos = F.col("upto_pos") / F.col("total_pos")
    recall_neg = 1 - F.col("upto_neg") / F.col("total_neg")
    return per.select("threshold", recall_pos.alias("recall_pos"), recall_neg.alias("recall_neg"), ((recall_pos + recall_neg) / 2).alias("balanced"))


def advantages(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Reward less the group's mean, over its population deviation if that is above 1e-8."""
    w = Window.partitionBy(group)
    std = F.stddev_pop(reward).over(w)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / F.when(std > 1e-8, std).otherwise(1.0))


def paired(df: DataFrame, key: str, arm: str, arms: list[str], columns: list[str]) -> DataFrame:
    """Rows of several arms side by side, for keys that all of them have."""
    out = None
    for a in arms:
        part = df.filter(F.col(arm) == a).select(key, *[F.col(c).alias(f"{c}_{a}") for c in columns])
        out = part if out is None else out.join(part, key)
    return out
