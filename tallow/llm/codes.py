"""Product codes of vectors: Lloyd's algorithm on integers, maintained by deltas.

A vector's components become whole numbers and are cut into equal parts; each
part position has a codebook of its own.  A round

1. assigns every part to its nearest entry and writes the table with the
   previous assignment beside the new one;
2. of the rows where they differ, each changed part takes its components from
   the sums of its old entry and adds them to those of the new one.  A task
   sums these contributions by (part, entry) before they are shuffled, so at
   most parts * entries * width numbers leave it, and none in a round in which
   nothing changes;
3. the driver adds them to the running sums and divides.  It holds the
   codebooks, sums and counts: parts * entries * (2 * width + 1) numbers.

All sums are exact, so neither the order of rows nor a repeated task shows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise, released
from .vectors import matrix, whole, width_of

_LONG = 2**63 - 1


def _packed(scale: float, width: int):
    """Ids, labels and vectors as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix(batch.column(2), width)
            ids, labels = (batch.column(k).take(pa.array(at)) for k in (0, 1))
            packed = pa.array([row.tobytes() for row in whole(scale * x)], pa.binary())
            none = pa.nulls(len(at), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, labels, packed, none], ["id", "label", "x", "code"])

    return run


def _unpacked(column: pa.Array, parts: int) -> np.ndarray:
    """Rows x parts x components."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.int32)
    return flat.reshape(len(column), parts, -1).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the first of equal ones, and the squared distance; exact.

    ``x`` is rows x width, ``entries`` is entries x width.  Distances come from
    products of doubles where these hold all sums, else from Python's integers.
    """
    most = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if most * most * max(1, x.shape[1]) < 2**51:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        d = (b * b).sum(1) - 2 * (a @ b.T)
        best = d.argmin(1)
        own = x - entries[best]
        return best, (own * own).sum(1)
    d = ((x.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(2)
    best = np.array([min(range(len(row)), key=row.__getitem__) for row in d.tolist()], np.int64)
    return best, d[np.arange(len(d)), best]


def _assigned(books: np.ndarray):
    """The code of each row, one byte or two a part, beside the previous one."""
    parts, entries = books.shape[:2]
    kind = np.uint8 if entries <= 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                piece = batch.slice(low, 4096)
                x = _unpacked(piece.column(2), parts)
                code = np.column_stack([nearest(x[:, p], books[p])[0] for p in range(parts)]).astype(kind)
                packed = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], piece.column(3), packed], ["id", "label", "x", "previous", "code"])

    return run


def _deltas(parts: int, entries: int, width: int):
    """What a task's rows change: (part, entry, position, value); position -1 holds the count."""
    kind = np.uint8 if entries <= 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            x = _unpacked(batch.column(0), parts)
            x = np.concatenate([x, np.ones((len(x), parts, 1), np.int64)], 2)
            new = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(len(x), parts)
            had = np.flatnonzero(~batch.column(1).is_null().to_numpy(zero_copy_only=False))
            old = np.full(new.shape, -1)
            if len(had):
                old[had] = np.frombuffer(b"".join(batch.column(1).take(pa.array(had)).to_pylist()), kind).reshape(len(had), parts)
            for p in range(parts):
                moved = old[:, p] != new[:, p]
                gone = moved & (old[:, p] >= 0)
                for j in range(width + 1):  # sums of a batch of 32-bit numbers are exact in doubles
                    total[p, :, j] += np.bincount(new[moved, p], x[moved, p, j], entries).astype(np.int64)
                    total[p, :, j] -= np.bincount(old[gone, p], x[gone, p, j], entries).astype(np.int64)
        part, entry, position = np.nonzero(total)
        value = total[part, entry, position]
        position = np.where(position == width, -1, position)
        columns = [pa.array(c.astype(np.int32)) for c in (part, entry, position)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], ["part", "entry", "position", "value"])

    return run


def _coded(books: np.ndarray):
    """Codes in hexadecimal and the squared distances."""
    parts, entries = books.shape[:2]
    digits = [f"{k:0{2 if entries <= 256 else 4}x}" for k in range(entries)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                piece = batch.slice(low, 4096)
                x = _unpacked(piece.column(2), parts)
                found = [nearest(x[:, p], books[p]) for p in range(parts)]
                code = ["".join([digits[k] for k in row]) for row in np.column_stack([f[0] for f in found]).tolist()]
                error = [min(sum(row), _LONG) for row in zip(*[f[1].tolist() for f in found], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return run


def fit(packed: DataFrame, parts: int, entries: int, width: int, rounds: int) -> np.ndarray:
    """Codebooks, parts x entries x width, of the table of packed vectors.

    They start as the parts of the ``entries`` smallest ids (of equal ids, the
    least bytes first); fewer rows give fewer entries.
    """
    first = packed.select("id", "x").orderBy("id", "x").limit(entries).collect()
    books = np.stack([np.frombuffer(bytes(r.x), np.int32).reshape(parts, width) for r in first], 1).astype(np.int64)
    n = books.shape[1]
    sums = np.zeros((parts, n, width + 1), object)  # the last place counts
    table = packed
    for step in range(rounds):
        assigned = table.mapInArrow(released(_assigned(books)), "id long, label long, x binary, previous binary, code binary")
        assigned = materialise(assigned, f"assigned{step}")
        if step:
            discard(before)
        moved = assigned.filter("previous is null or previous <> code").select("x", "previous", "code")
        deltas = moved.mapInArrow(released(_deltas(parts, n, width)), "part int, entry int, position int, value long")
        deltas = deltas.groupBy("part", "entry", "position").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        for r in deltas.collect():  # a row for each number of the codebooks at most
            sums[r.part, r.entry, r.position] += int(r.value)
        used = sums[:, :, -1] > 0
        books[used] = (sums[:, :, :-1][used] // sums[:, :, -1:][used]).astype(np.int64)
        table, before = assigned.select("id", "label", "x", "code"), assigned
    if rounds:
        discard(before)
    return books


def compress(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    most: int = 1 << 17,
) -> DataFrame:
    """``id_col``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every usable row.

    Rows whose vector is null or holds null or non-finite components are
    dropped.  Components become floor(scale * x), held in 32 bits (larger ones
    count as the ends of that range); vectors end in zeros up to a multiple of
    ``parts``.  Repeated rows, and rows that share an id or have none, give a
    row each and all weigh in; null ids come first in the order of ids.  Null
    labels are one label.  Sums of errors that no bigint holds come out as the
    largest one.  Other columns are not read.  No usable rows give no rows.

    Sums by label meet the rows in a broadcast only if there are at most
    ``most`` labels (16 bytes each), else in a join that Spark may split.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    width = -(-max(1, width_of(base, "v")) // parts)
    packed = materialise(base.mapInArrow(released(_packed(scale, parts * width)), "id long, label long, x binary, code binary"), "packed")
    if packed.isEmpty():
        kind = dict(vectors.select(id_col).dtypes)[id_col]
        return spark.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    books = fit(packed, parts, entries, width, rounds)
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    coded = materialise(packed.mapInArrow(released(_coded(books)), "id long, label long, code string, error long"), "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG)).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label")
    if coded.select("label").distinct().count() <= most:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """DuckDB SQL for compress() over ``embeddings``: every round assigns all parts and sums all of them anew."""
    steps = []
    for k in range(rounds + 1):
        # the lower index wins a tie: arg_min over (distance, index)
        steps.append(
            f"""a{k} AS MATERIALIZED (
  SELECT x.vec_id, x.label, x.p, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, b.v), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))), e := b.e)) AS best, any_value(x.v) AS v
  FROM part x JOIN b{k} b ON x.p = b.p GROUP BY x.vec_id, x.label, x.p
)"""
        )
        if k < rounds:
            steps.append(
                f"""m{k} AS (
  SELECT p, e, list(m ORDER BY j) AS v FROM (
    SELECT p, best.e AS e, j, CAST(floor(CAST(sum(v[j]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{k}, unnest(generate_series(1, len(v))) t(j) GROUP BY p, best.e, j
  ) GROUP BY p, e
), b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)"""
            )
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, unnest(generate_series(0, {parts - 1})) t(p)
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}
), b0 AS MATERIALIZED (SELECT p, e, v FROM part JOIN first USING (vec_id)
), {", ".join(steps)}, book AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}
), done AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM done, book
"""
