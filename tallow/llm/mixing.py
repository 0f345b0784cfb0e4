"""Mixing sources to target weights.

Sizes are word counts.  The sources share a budget by weight; no source goes
beyond ``cap`` times its own size, and what is cut off goes to the others by
weight.  A document is emitted floor(rate) times, plus one hash-seeded
Bernoulli copy with the fraction of the rate as its probability: it gets the
copy if its uniform number u, a hash of the seed and its id, is below the
source's threshold.

A source of few documents, or with a few long ones, would miss its target by
chance if the threshold were the fraction itself.  So the threshold is
calibrated: of the ``STEPS`` bounds of u it is the one below which the sizes
come nearest to fraction * source size.  It tends to the fraction as a source
grows.  A document's u depends on nothing but itself, so another document
changes draws only between the old threshold and the new.

Copies follow from source and id alone, so texts are never shuffled: what is
aggregated is a row for each source and step of u.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

WORD = r"[^\x20\x09-\x0D]+"
STEPS = 4096


def words_in(text: Column) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def hash32(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text, as a bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source``, ``rows``, ``source_size``, ``target`` for every source of a table of (source, size).

    Sources take the weights in turn, by code point, null last.  With
    caps sorted by cap / weight, those that bind are a prefix, so one pass of
    running sums over the sources gives the fixed point.  The windows are over
    one row a source.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("most").over(rising), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0)))
        .withColumn("full", F.col("most") * F.col("left") <= F.col("weight") * (F.col("budget") - F.col("before")))
        .withColumn("spent", F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything))
        .withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    )
    shared = F.col("weight") * ((F.col("budget") - F.col("spent")) / F.col("open"))
    return per.select("source", "rows", "source_size", F.when(F.col("full"), F.col("most")).otherwise(shared).alias("target"))


def draw(id_: Column, text: Column, seed: str) -> Column:
    """The step of u, 0 to STEPS - 1: the first bits of a hash of the seed and the id; rows without an id draw by text."""
    named = F.concat(F.lit(seed + "/"), id_.cast("string"))
    return F.floor(hash32(F.coalesce(named, F.concat(F.lit(seed + "//"), F.md5(F.coalesce(text, F.lit("")))))) / (2**32 // STEPS))


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``whole`` and ``threshold`` for every source of a table of (source, size, step).

    A document has ``whole`` copies, and one more if its step is below
    ``threshold``.  At most STEPS rows a source meet in a window.
    """
    targets = source_targets(sizes, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select("source", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("fraction"))
    steps = sizes.groupBy("source", "step").agg(F.sum("size").alias("size"))
    below = F.sum("size").over(Window.partitionBy("source").orderBy("step"))
    steps = steps.select("source", (F.col("step") + 1).alias("bound"), below.alias("below"))
    aimed = steps.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("t.*", "s.bound", "s.below")
    miss = F.abs(F.col("below") - F.col("fraction") * F.col("source_size"))
    best = aimed.groupBy("source", "source_size", "target", "whole", "fraction").agg(F.min(F.struct(miss.alias("miss"), "bound")).alias("best"))
    # without any extra copy the miss is the fraction of the size
    none = F.col("fraction") * F.col("source_size") <= F.col("best.miss")
    return best.select("source", "source_size", "target", "whole", F.when(none, F.lit(0)).otherwise(F.col("best.bound")).cast("long").alias("threshold"))


def _copies(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows with a ``source`` and a ``step`` joined with their source's rates; Spark broadcasts the rates only below its size threshold."""
    rows = docs.alias("d").join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
    copies = F.col("r.whole") + F.when(F.col("d.step") < F.col("r.threshold"), 1).otherwise(0)
    return rows.select("d.*", "r.source_size", "r.target", copies.cast("long").alias("copies"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``: one row per document, those with no copy included.

    A null text has size 0; a null source is a source of its own; a null id
    draws by the text.  Repeated rows are rows of their own that draw alike,
    as do rows that share an id.  Very long texts count whole.  Other columns
    are not read, so none can clash.  No rows give no rows.

    The extra copy is drawn at a threshold that is the nearest of 4096 to the
    target for the draws at hand, so its probability is the rate's fraction but
    for what the draws of the source's n documents miss it by, in the order of
    1 / sqrt(n).

    Texts are read once, to write sizes and draws.
    """
    sizes = materialise(_sized(docs, seed, id_col, text_col, source_col), "sizes")
    out = _copies(sizes, source_rates(sizes.select("source", "size", "step"), weights, share, cap))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _sized(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    i, t = F.col(id_col), F.col(text_col)
    return docs.select(i.alias("id"), F.col(source_col).alias("source"), words_in(t).alias("size"), draw(i, t, seed).alias("step"))


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as mix() takes it, with all their columns, whatever their names."""
    sizes = materialise(_sized(docs, seed, id_col, text_col, source_col).drop("id"), "sizes")
    rates = materialise(source_rates(sizes, weights, share, cap), "rates")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    field = lambda c: F.col("row").getField(c)
    drawn = _copies(whole.select("row", field(source_col).alias("source"), draw(field(id_col), field(text_col), seed).alias("step")), rates)
    taken = drawn.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*[field(c).alias(c) for c in docs.columns])


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INT) + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM per
), running AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
    coalesce(sum(most) OVER w, 0) AS before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_before
  FROM weighed WINDOW w AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, most * open_before::DOUBLE <= weight * (budget - before) AS is_full FROM running
), solved AS (
  SELECT *, sum(CASE WHEN is_full THEN most ELSE 0 END) OVER () AS spent, (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::DOUBLE AS open_weight FROM capped
), targets AS (
  SELECT source, n, source_size, CASE WHEN is_full THEN most ELSE weight * ((budget - spent) / open_weight) END AS target FROM solved
), steps AS (
  SELECT source, CAST('0x' || substr(md5(coalesce('mix/' || doc_id, 'mix//' || md5(coalesce(text, '')))), 1, 8) AS BIGINT) // 1048576 AS step, sum(size) AS size
  FROM sized GROUP BY ALL
), bounds AS (
  SELECT source, 0 AS bound, 0 AS below FROM targets
  UNION ALL SELECT source, step + 1, sum(size) OVER (PARTITION BY source ORDER BY step) FROM steps
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate FROM targets
), aimed AS (
  SELECT r.*, bound FROM rated r JOIN bounds b ON r.source IS NOT DISTINCT FROM b.source
  QUALIFY row_number() OVER (PARTITION BY r.source ORDER BY abs(below - (rate - floor(rate)) * source_size), bound) = 1
)
SELECT doc_id, size, a.source_size, target,
  size * CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5(coalesce('mix/' || doc_id, 'mix//' || md5(coalesce(text, '')))), 1, 8) AS BIGINT) // 1048576 < bound THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source
"""
