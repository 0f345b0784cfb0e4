"""An order-free digest of a table's rows that can be brought up to date.

A row's SHA-256 is cut into eight numbers of 32 bits; the digest is their sums,
modulo 2^64 each, with the number of rows.  Rows that are added or removed add
or take away their numbers, so the digest of two tables together is that of
their digests, whatever the order and the partitions.  It is a checksum that
tells stored tables apart, with one combinable aggregate and no list of hashes;
it doesn't withstand someone who chooses rows to collide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 8
_MODULUS = 1 << 64


def row_digest(df: DataFrame, row: Column) -> DataFrame:
    """One row: ``n``, the sums ``s0`` to ``s7``, and ``digest``, all of them in hexadecimal."""
    h = df.select(F.sha2(row, 256).alias("h"))
    part = lambda k: F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(part(k)), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}") for k in range(PARTS)]
    return _finished(h.agg(F.count("*").alias("n"), *sums))


def _finished(sums: DataFrame) -> DataFrame:
    wrapped = {f"s{k}": F.pmod(F.col(f"s{k}"), F.lit(str(_MODULUS)).cast("decimal(38,0)")).cast("decimal(38,0)") for k in range(PARTS)}
    shown = [F.lpad(F.lower(F.conv(F.col(f"s{k}").cast("string"), 10, 16)), 16, "0") for k in range(PARTS)]
    return sums.withColumns(wrapped).withColumn("digest", F.concat(F.col("n").cast("string"), F.lit("-"), *shown))


def combined(added: DataFrame, *others: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The digest of tables together, less that of rows that are ``removed``; from their digests alone."""
    signed = [d.withColumn("sign", F.lit(1)) for d in (added, *others)] + ([removed.withColumn("sign", F.lit(-1))] if removed is not None else [])
    rows = reduce(DataFrame.unionByName, signed)
    sums = [F.sum(F.col(f"s{k}") * F.col("sign")).cast("decimal(38,0)").alias(f"s{k}") for k in range(PARTS)]
    return _finished(rows.agg(F.sum(F.col("n") * F.col("sign")).cast("long").alias("n"), *sums))
