"""Deterministic order, samples, splits, quotas and balancing.

Order comes from SHA-256 of a prefix and the id, which is the same on every
engine and needs no seed state.  "Take n" is sort-and-limit (kept to n rows a
partition before the exchange) or a ranked window with a bound, which Spark
limits in each partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audits import placed


def hash_key(id_: Column, prefix: str = "42:") -> Column:
    return F.sha2(F.concat(F.lit(prefix), id_.cast("string")), 256)


def hash_sample(df: DataFrame, n: int, id_col: str, prefix: str = "42:") -> DataFrame:
    """The first n rows by hash of the id."""
    return df.orderBy(hash_key(F.col(id_col), prefix), id_col).limit(n)


def per_group(df: DataFrame, group: list[str], n: int | Column, id_col: str, prefix: str = "42:") -> DataFrame:
    """The first n rows of each group by hash of the id."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(hash_key(F.col(id_col), prefix), id_col))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def ratio_split(total: Column, ratio: float) -> Column:
    """Rows for the second side: rounded half to even, at least 1, at most a tenth."""
    return F.least(F.greatest(F.lit(1), F.bround(total * ratio).cast("int")), F.greatest(F.lit(1), F.floor(total / 10).cast("int")))


def hamilton(counts: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """Quotas of n over strata by largest remainder; ties go to the larger key.

    One row a stratum, so the windows over all rows are small.
    """
    everything = Window.partitionBy()
    raw = F.lit(n) * F.col(count) / F.sum(count).over(everything)
    rows = counts.withColumn("raw", raw).withColumn("base", F.floor("raw").cast("long"))
    rest = F.lit(n) - F.sum("base").over(everything)
    place = F.row_number().over(Window.orderBy((F.col("raw") - F.col("base")).desc(), F.col(key).desc()))
    return rows.withColumn("quota", F.col("base") + (place <= rest).cast("long")).select(key, count, "quota")


def stratified(df: DataFrame, key: str, n: int, id_col: str, prefix: str = "42:") -> DataFrame:
    """A proportional sample of n over strata."""
    quotas = hamilton(df.groupBy(key).agg(F.count("*").alias("total")), key, "total", n).select(key, "quota")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(hash_key(F.col(id_col), prefix), id_col))
    return df.withColumn("rank", rank).join(quotas, key).filter("rank <= quota").drop("rank", "quota")


def balanced(df: DataFrame, label: str, id_col: str, prefix: str = "42:") -> DataFrame:
    """As many rows of each label as the rarest one has."""
    least = df.groupBy(label).count().agg(F.min("count").alias("least"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(hash_key(F.col(id_col), prefix), id_col))
    return df.withColumn("rank", rank).crossJoin(F.broadcast(least)).filter("rank <= least").drop("rank", "least")  # least is one row


def tertiles(df: DataFrame, score: str, id_col: str) -> DataFrame:
    """Bands cut at n // 3 and 2n // 3 by ascending score and id."""
    total = df.agg(F.count("*").alias("total"))
    rows = placed(df, score, [id_col]).withColumnRenamed("place", "at").crossJoin(F.broadcast(total))  # total is one row
    band = F.when(F.col("at") < F.floor(F.col("total") / 3), "genuine_hard").when(F.col("at") < F.floor(2 * F.col("total") / 3), "medium").otherwise("near_solved")
    return rows.withColumn("band", band).drop("at", "total")


def sequential_fill(df: DataFrame, id_col: str, wanted: list[tuple[str, Column, int]], prefix: str = "42:") -> DataFrame:
    """Fill categories one after the other; an id serves the first that takes it.

    ``wanted`` has (category, eligibility, quota) in order: a chain of anti
    joins against small tables of ids, not a loop over rows.
    """
    out = None
    for name, able, n in wanted:
        rest = df.filter(able)
        if out is not None:
            rest = rest.join(out.select(id_col), id_col, "left_anti")
        part = hash_sample(rest, n, id_col, prefix).select(id_col, F.lit(name).alias("category"))
        out = part if out is None else out.unionByName(part)
    return out


def repeat(df: DataFrame, times: Column) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
