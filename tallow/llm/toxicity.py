"""Toxicity: a counterfactually regularised classifier.

A logistic regression on the presence of words, of word beginnings and of
several different words with one beginning.  In every labelled sentence that
holds an identity term the term is swapped for each other term of its group,
and the squared change of the sentence's logit is a penalty of the loss, so
that a neutral mention of a group can't raise the score.  Terms that no
labelled sentence holds are swapped as sentences of one word.

The fit uses a bounded sample of the labelled rows (``max_rows``, by hash);
scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise, released

#: Groups of interchangeable identity terms.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-cased word: itself and its beginnings of 4 to 7 characters."""
    names = [f"w{word}", *(f"{n}{word[:n]}" for n in (4, 5, 6, 7) if len(word) >= n)]
    return tuple(xxhash.xxh32_intdigest(n) for n in names)


def often(feature: int, times: int) -> int:
    """The feature that ``times`` different words of a text share ``feature``."""
    return (feature * 2654435761 + times * 40503) >> 7 & 0xFFFFFFFF


def expanded(counts: Counter) -> set[int]:
    """A text's features from the number of its different words with each."""
    return {*counts, *(often(f, k) for f, n in counts.items() if n > 1 for k in (2, 3, 5) if n >= k)}


def featured(words: set[str]) -> set[int]:
    """The features of a text or a sentence from its different words."""
    return expanded(Counter(f for w in words for f in features(w)))


def swaps(text: str, groups) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Of every sentence with a term and every other term of its group: the features that the swap adds, and those it takes away."""
    out = []
    for sentence in _SENTENCE.split(text):
        words = set(_WORD.findall(sentence))
        for group in groups:
            for term in words.intersection(group):
                own = featured(words)
                for other in group:
                    if other != term:
                        new = featured((words - {term}) | {other})
                        out.append((tuple(sorted(new - own)), tuple(sorted(own - new))))
    return out


def _featured_rows(groups):
    """(row, toxic, features, swaps) of the sampled texts."""
    terms = {t for g in groups for t in g}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("plus", pa.list_(pa.int64())), ("minus", pa.list_(pa.int64())), ("times", pa.int64())]))
        for batch in batches:
            for k in range(batch.num_rows):  # a text may have any number of features
                text = batch.column(2)[k].as_py().lower()
                words = set(_WORD.findall(text))
                changed = [{"plus": p, "minus": m, "times": n} for (p, m), n in Counter(swaps(text, groups)).items()] if words & terms else []
                columns = [*(c.slice(k, 1) for c in batch.columns[:2]), pa.array([sorted(featured(words))], pa.list_(pa.int64())), pa.array([changed], kind)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "toxic", "features", "swaps"])

    return run


def wilson(one: Column, all_: Column) -> Column:
    """The lower end of the 95 % Wilson interval of one / all."""
    z2 = 1.96 * 1.96
    share = one / all_
    spread = 1.96 * F.sqrt(share * (1 - share) / all_ + z2 / (4 * all_ * all_))
    return (share + z2 / (2 * all_) - spread) / (1 + z2 / all_)


def covering(low: np.ndarray, held: list[np.ndarray], positive: int, most: int, cover: int = 12, bars: tuple[float, ...] = (0.55, 0.45, 0.35)) -> list[int]:
    """Places of the features that speak for label 1, taken best-supported first until they cover every such row ``cover`` times.

    ``low`` has the lower ends of their precision and ``held`` the rows of
    label 1 that have them, best-supported first.  A feature counts from the
    first bar on; as long as a fifth of the rows are without one, the next bar
    does.  Words that only copies of a few rows share come last and add no
    cover.
    """
    covered, chosen, taken = np.zeros(positive, int), [], set()
    for bar in bars:
        for f in np.flatnonzero(low >= bar).tolist():
            if f not in taken and len(chosen) < most and (covered[held[f]] < cover).sum() >= min(len(held[f]), max(3, positive // 100)):
                chosen.append(f)
                taken.add(f)
                covered[held[f]] += 1
        if (covered > 0).mean() >= 0.8:
            break
    return sorted(chosen)


def _changes(place: dict[int, int]):
    """Sums of products of the signs with which swaps change the chosen features: (i, j, value), and the number of swaps at (-1, -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for held in batch.column(0).to_pylist():
                for x in held:
                    total.update(products(place, x["plus"], x["minus"], x["times"]))
        rows = [(i, j, n) for (i, j), n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "value"])

    return run


def products(place: dict[int, int], plus: Iterable[int], minus: Iterable[int], times: int) -> Counter:
    """What a swap that happens ``times`` times adds to the sums of _changes()."""
    signs = [(place[f], sign) for fs, sign in ((plus, 1), (minus, -1)) for f in fs if f in place]
    out = Counter({(-1, -1): times})
    for i, a in signs:
        for j, b in signs:
            out[i, j] += a * b * times
    return out


@dataclass(frozen=True)
class Problem:
    """What the descent works on: the chosen features of the rows, the labels, and the penalty as a sparse matrix."""

    row: np.ndarray
    column: np.ndarray
    y: np.ndarray
    size: int
    i: np.ndarray
    j: np.ndarray
    value: np.ndarray  # of the mean over the swaps of the outer product of a swap's signs

    def gradient(self, w: np.ndarray, b: float, l2: float, fairness: float) -> tuple[np.ndarray, float]:
        """Of mean log loss + l2 / 2 * |w|^2 + fairness * mean squared change of the logit by a swap."""
        n = len(self.y)
        z = np.bincount(self.row, w[self.column], n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.y) / n
        penalty = 2 * fairness * np.bincount(self.i, self.value * w[self.j], self.size)
        return np.bincount(self.column, error[self.row], self.size) + l2 * w + penalty, float(error.sum())


def descend(problem: Problem, l2: float, fairness: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``steps`` steps of Adam."""
    k, share = problem.size, problem.y.mean()
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        g = np.append(*problem.gradient(w, b, l2, fairness))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 6000,
    groups=IDENTITY_GROUPS,
    fairness: float = 1.0,
    selected: int = 4096,
    candidates: int = 1 << 14,
    l2: float = 1e-4,
    steps: int = 400,
) -> tuple[dict[int, float], float]:
    """Weights of features and the intercept, fitted on at most ``max_rows`` of the labelled rows whose crc32(doc_id as text) mod 4 isn't 2.

    Rows with a null id or label are left out; an id with several labels has
    the largest, one with several texts the least.  The sample is the first
    rows by a hash of the id.  Without rows of both labels, or without a
    feature that tells them apart, the score is the (smoothed) share of label 1.

    Features are counted, and the ``candidates`` with the most rows of label 1
    are picked, in Spark.  The driver holds those with the rows they are in as
    bits, at most ``max_rows * selected`` pairs of a row and a chosen feature,
    and sums for at most ``selected ** 2`` pairs of features that one swap
    changes: none of it grows with the texts.
    """
    spark = docs.sparkSession
    usable = labels.filter("doc_id is not null and toxic is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    # rows of label 1 have the first numbers
    named = [(k, r.doc_id, int(r.toxic > 0)) for k, r in enumerate(sorted(sample, key=lambda r: r.toxic <= 0))]
    table = spark.createDataFrame(named, "row int, doc_id long, toxic int")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(table), "doc_id").groupBy("row", "toxic").agg(F.min("text").alias("text"))
    schema = "row int, toxic int, features array<long>, swaps array<struct<plus:array<long>,minus:array<long>,times:long>>"
    seen = materialise(texts.mapInArrow(released(_featured_rows(groups)), schema), "features")
    there = dict(seen.select("row", "toxic").collect())
    n, positive = len(there), sum(there.values())
    if not 0 < positive < n:
        share = (positive + 0.5) / (n + 1) if n else 0.05
        discard(seen)
        return {}, float(np.log(share / (1 - share)))
    each = seen.select("row", "toxic", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("one")).withColumn("low", wilson(F.col("one"), F.col("n")))
    best = counts.filter("low >= 0.35").orderBy(F.desc("one"), "feature").limit(candidates).select("feature", "low").collect()
    wanted = F.broadcast(spark.createDataFrame([(r.feature, k) for k, r in enumerate(best)], "feature long, k int"))
    marks = each.filter("toxic = 1").join(wanted, "feature").groupBy("k", F.bitmap_bucket_number(F.col("row") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("row") + 1)).alias("rows"))
    held: list[np.ndarray] = [np.empty(0, np.int64)] * len(best)
    for r in marks.orderBy("k", "bucket").collect():
        bits = np.unpackbits(np.frombuffer(bytes(r["rows"]), np.uint8), bitorder="little")
        held[r.k] = np.append(held[r.k], np.flatnonzero(bits) + (r.bucket - 1) * len(bits))
    size = 1 + max((k for k, y in there.items() if y), default=0)
    chosen = covering(np.array([r.low for r in best]), held, size, selected)
    if not chosen:
        discard(seen)
        return {}, float(np.log(positive / (n - positive)))
    place = {best[k].feature: at for at, k in enumerate(chosen)}
    kept = F.broadcast(spark.createDataFrame(list(place.items()), "feature long, at int"))
    cells = each.join(kept, "feature").select("row", "at").toArrow()
    total: Counter = Counter()
    for r in seen.filter("size(swaps) > 0").select("swaps").mapInArrow(released(_changes(place)), "i int, j int, value long").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        total[r.i, r.j] += r["value"]
    for g in groups:  # terms that no sentence holds are sentences of one word
        for t in g:
            for plus, minus in swaps(t, (g,)):
                total.update(products(place, plus, minus, 1))
    discard(seen)
    every = max(1, total.pop((-1, -1), 0))
    numbers = {row: k for k, row in enumerate(sorted(there))}
    rows = np.array([numbers[k] for k in cells.column(0).to_pylist()], np.int64)
    y = np.array([there[k] for k in sorted(there)], float)
    pairs = np.array([(i, j, v / every) for (i, j), v in sorted(total.items()) if v] or np.empty((0, 3)))
    problem = Problem(rows, cells.column(1).to_numpy().astype(np.int64), y, len(chosen), pairs[:, 0].astype(int), pairs[:, 1].astype(int), pairs[:, 2])
    w, b = descend(problem, l2, fairness, steps)
    return {f: float(w[at]) for f, at in place.items() if abs(w[at]) > 1e-4}, b


class Scorer:
    """Scores whole texts; remembers a bounded number of words."""

    def __init__(self, weights: dict[int, float], bias: float, remembered: int = 200_000) -> None:
        self.weights, self.bias, self.remembered, self.known = weights, bias, remembered, {}

    def __call__(self, text: str | None) -> float:
        known, weights = self.known, self.weights
        hits: list[int] = []
        for word in set(_WORD.findall((text or "").lower())):
            at = known.get(word)
            if at is None:
                if len(known) > self.remembered:
                    known.clear()
                at = known[word] = tuple(f for f in features(word) if f in weights or any(often(f, k) in weights for k in (2, 3, 5)))
            if at:
                hits += at
        z = self.bias + sum([weights[f] for f in sorted(expanded(Counter(hits)) & weights.keys())])
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def _scored(weights: dict[int, float], bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, bias)
        for batch in batches:
            out = [scorer(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["id", "score"])

    return run


def score(docs: DataFrame, model: tuple[dict[int, float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) for every row; null and empty texts get the score of a text without words.

    The model has at most as many weights as features were selected.  Repeated
    rows give a row each; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(released(_scored(*model)), "id long, score double").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every document; ``held_out`` is null for a null id.

    Null and empty texts score alike, very long ones are read whole, a score
    at the threshold itself counts as 1, repeated rows give a row each, and
    other columns are not read.
    """
    scored = score(docs, train(docs, labels, max_rows))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 6000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    model = train(docs, labels, max_rows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for batch in batches:
            yield batch.filter(pa.array([scorer(text.as_py()) < threshold for text in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
