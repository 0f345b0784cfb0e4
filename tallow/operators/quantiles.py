"""Exact order statistics without a sort: iterated refinement of histograms.

Each pass cuts the range that a wanted place lies in into buckets between its
least and largest value and counts them; the bucket that holds the place is the
next range.  A pass shuffles the counts of buckets, at most ``buckets`` numbers
a range and task, and no values.  It ends when a range holds one value, however
often, or so few rows that they are sorted in one cell.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import scratch


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "ranges")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_places(df: DataFrame, group: str, value: str, places, buckets: int = 4096, few: int = 4096) -> DataFrame:
    """``group``, ``name``, ``value`` at places from 0 in the order of each group's values; nulls are left out.

    ``places`` takes the column of a group's number of rows and gives a dict of
    names and places.  ``df`` is read once a pass and twice more.
    """
    x = df.filter(F.col(value).isNotNull()).select(F.struct(F.col(group).alias("g")).alias("g"), F.col(value).alias("x"))  # structs with a null are equal
    names = places(F.col("n"))
    rows = x.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("long").alias("place")) for k, v in names.items()]))
    targets = _written(rows.select("g", "n", "low", "high", each.alias("t")).select("g", "t.name", "t.place", "low", "high", "n"))
    wide = (F.col("low") < F.col("high")) & (F.col("n") > few)
    key = ["g", "low", "high"]
    scales = itertools.cycle([_linear, _signed_log]) if dict(x.dtypes)["x"] in ("double", "float") else itertools.repeat(_linear)
    while not targets.filter(wide).isEmpty():
        open_, scale = targets.filter(wide), next(scales)
        counts = _inside(x, open_.select(*key).distinct()).withColumn("bucket", _bucket(buckets, scale)).groupBy(*key, "bucket").agg(F.count("*").alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
        counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*key).orderBy("bucket")))
        before = F.col("upto") - F.col("c")
        found = open_.join(counts, key).filter((F.col("place") >= before) & (F.col("place") < F.col("upto")))
        found = found.select("g", "name", (F.col("place") - before).alias("place"), F.col("a").alias("low"), F.col("b").alias("high"), F.col("c").alias("n"))
        targets = _written(targets.filter(~wide).unionByName(found))
    left = targets.filter("low < high")
    lists = _inside(x, left.select(*key).distinct()).groupBy(*key).agg(F.sort_array(F.collect_list("x")).alias("xs"))  # of at most ``few`` rows
    own = left.join(lists, key).select("g", "name", F.get("xs", F.col("place").cast("int")).alias("value"))
    return own.unionByName(targets.filter("low >= high").select("g", "name", F.col("low").alias("value"))).select(F.col("g.g").alias(group), "name", "value")


def _inside(x: DataFrame, ranges: DataFrame) -> DataFrame:
    return x.join(ranges, "g").filter((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))


def _linear(x: Column) -> Column:
    return x


def _signed_log(x: Column) -> Column:
    """Grows with x, evenly over the magnitudes that doubles have."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))


def _bucket(n: int, scale) -> Column:
    """A number that grows with x; the ends have buckets of their own, so every pass leaves them behind.

    Passes take turns in a linear scale and, for doubles, one of magnitudes:
    neither evenly spread values nor ones that crowd around 0 need many.
    """
    x, low, high = F.col("x"), F.col("low"), F.col("high")
    part = (scale(x) - scale(low)).cast("double") / F.nullif((scale(high) - scale(low)).cast("double"), F.lit(0.0))
    inner = F.coalesce(F.nanvl(F.least(F.greatest(part * n, F.lit(1.0)), F.lit(n - 2.0)), F.lit(1.0)), F.lit(1.0)).cast("int")
    return F.when(x == low, 0).when(x == high, n - 1).otherwise(inner)


def _wide(found: DataFrame, group: str, names: list[str]) -> DataFrame:
    return found.groupBy(group).agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in names])


def nearest_ranks(df: DataFrame, group: str, value: str, quantiles: dict[str, float], **options) -> DataFrame:
    """Percentiles by sorted[round((n - 1) * q)], rounding half to even: ``group`` and a column for each name."""
    found = at_places(df, group, value, lambda n: {k: F.bround((n - 1) * F.lit(float(q))) for k, q in quantiles.items()}, **options)
    return _wide(found, group, list(quantiles))


def linear_quantiles(df: DataFrame, group: str, value: str, quantiles: dict[str, float], **options) -> DataFrame:
    """Percentiles between the two nearest ranks in proportion."""
    ends = lambda n: {f"{k}_{e}": f((n - 1) * F.lit(float(q))) for k, q in quantiles.items() for e, f in (("low", F.floor), ("high", F.ceil))}
    found = _wide(at_places(df, group, value, ends, **options), group, [f"{k}_{e}" for k in quantiles for e in ("low", "high")])
    n = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    out = []
    for k, q in quantiles.items():
        place = (F.col("_n") - 1) * F.lit(float(q))
        out.append((F.col(f"{k}_low") + (place - F.floor(place)) * (F.col(f"{k}_high") - F.col(f"{k}_low"))).alias(k))
    return found.join(n, F.col(group).eqNullSafe(F.col("_g"))).select(group, *out)
