"""Exact top-k inner products: a Voronoi kNN join.

With data vectors v lifted to (v, sqrt(M^2 - |v|^2)), M the largest length,
and queries to (q, 0), the nearest data vectors are those with the largest
inner product.

1. Pivots, about 2 * sqrt(n) data vectors, make cells; data and queries each
   go to the cell of their nearest pivot.  They are chosen from a sample by
   hash, each the farthest from those before it, so that clusters have their
   own; the result doesn't depend on the choice.
2. Summaries of the cells (number of rows, least and largest distance to the
   pivot, the k + 1 smallest ones; radius of the queries) give for every query
   cell i a bound B_i within which all its queries have their k nearest: the
   radius plus the distance of the pivots plus the k + 1 smallest distances.
3. Pairs of a query cell and a data cell are pruned by the summaries; of the
   data cells that are left, a row goes on if its ring around its own pivot
   and its distance to the query cell's pivot allow it to be within B_i.
4. Query cells make groups; a group's queries and the data it needs are cut
   into blocks of bounded rows, and pairs of blocks are solved by matrix
   products in exact arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

_TYPES = {b"1": np.int8, b"2": np.int16, b"4": np.int32, b"8": np.float64}


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of four types, named by the first byte; doubles hold whatever floor(scale * x) gives."""
    most = np.abs(x).max(initial=0)
    name = b"1" if most < 2**7 else b"2" if most < 2**15 else b"4" if most < 2**31 else b"8"
    return name + x.astype(_TYPES[name]).tobytes()


def _packed(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, squares, widths = [], [], [], []
            for one, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if one is None or not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                ids.append(one)
                out.append(_pack(x))
                squares.append(float(x @ x))
                widths.append(len(x))
            columns = [pa.array(c, t) for c, t in ((ids, pa.int64()), (out, pa.binary()), (squares, pa.float64()), (widths, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "square", "width"])

    return run


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Rows as doubles; shorter vectors end in zeros."""
    if vectors and len({(v[:1], len(v)) for v in vectors}) == 1:
        kind = _TYPES[vectors[0][:1]]
        rows = np.frombuffer(b"".join([v[1:] for v in vectors]), kind).reshape(len(vectors), -1).astype(np.float64)
        return rows if rows.shape[1] == width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        x = np.frombuffer(v, _TYPES[v[:1]], offset=1) if v[:1] != b"8" else np.frombuffer(v[1:], np.float64)
        out[k, : len(x)] = x
    return out


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0, most - (x**2).sum(1)))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots.T)))


def spread(x: np.ndarray, wanted: int) -> np.ndarray:
    """Up to ``wanted`` different rows, each the farthest from those before it."""
    chosen, left = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < wanted and left.max() > 0:
        chosen.append(int(left.argmax()))
        left = np.minimum(left, ((x - x[chosen[-1]]) ** 2).sum(1) ** 0.5)
    return x[chosen]


def _points(vectors: list[bytes], width: int, most: float, lift: bool) -> np.ndarray:
    x = _matrix(vectors, width)
    return _lifted(x, most) if lift else np.column_stack([x, np.zeros(len(x))])


def _assigned(pivots: np.ndarray, most: float, lift: bool):
    """The cell of each vector and its distance to the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                piece = batch.slice(low, 2048)
                d = _distances(_points(piece.column(1).to_pylist(), pivots.shape[1] - 1, most, lift), pivots)
                cell = d.argmin(1)
                columns = [*piece.columns[:3], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "row", "cell", "d"])

    return run


class Plan:
    """What the driver works out of the summaries: which data rows go to which groups of query cells."""

    def __init__(self, pivots: np.ndarray, most: float, k: int, cells: dict, smallest: dict, queries: dict, groups: int) -> None:
        self.pivots, self.most, n = pivots, most, len(pivots)
        slack = 1e-6 * (1 + np.sqrt(most))  # room for rounding
        between = _distances(pivots, pivots)
        low, high, rows = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
        for cell, (count, least, largest) in cells.items():
            rows[cell], low[cell], high[cell] = count, least, largest
        near = np.full((n, k + 1), np.inf)
        for cell, ds in smallest.items():
            near[cell, : len(ds)] = ds
        self.active = sorted(queries)
        self.radius = np.array([queries[i][1] for i in self.active])
        reach = [np.sort((between[i][:, None] + near).ravel())[k] for i in self.active]
        self.bound = self.radius + np.array(reach) + slack
        wide = (self.radius + self.bound + slack)[:, None]
        ring_low, ring_high = between[self.active] - wide, between[self.active] + wide
        wanted = (ring_low <= high[None, :]) & (ring_high >= low[None, :])
        # neighbouring query cells make a group: in the order of their pivots along the longest axis, of about equal numbers of queries
        centred = pivots[self.active] - pivots[self.active].mean(0)
        axis = np.linalg.svd(centred, full_matrices=False)[2][0] if len(centred) > 1 else np.zeros(pivots.shape[1])
        order = np.argsort(centred @ axis, kind="stable")
        asked = np.array([queries[i][0] for i in self.active], np.int64)
        done = np.cumsum(asked[order]) - asked[order]
        group = np.empty(len(self.active), int)
        group[order] = done * min(groups, len(self.active)) // max(1, asked.sum())
        self.group = dict(zip(self.active, group.tolist(), strict=True))
        self.members = {g: np.flatnonzero(group == g) for g in np.unique(group).tolist()}
        self.ring = {g: (np.where(wanted[m], ring_low[m], np.inf).min(0), np.where(wanted[m], ring_high[m], -np.inf).max(0)) for g, m in self.members.items()}
        self.asked = {g: int(asked[m].sum()) for g, m in self.members.items()}
        self.rows = {g: int(rows[wanted[m].any(0)].sum()) for g, m in self.members.items()}


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sent(plan: Plan, blocks: dict[int, tuple[int, int]]):
    """Each data row to the blocks of the groups that may need it: (block of queries, block of data, id, vector, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "q", "s", "id", "v", "row"]
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                piece = batch.slice(low, 4096)
                rows, vectors = piece.column(2).to_numpy(), piece.column(1).to_pylist()
                cell, d = piece.column(3).to_numpy(), piece.column(4).to_numpy()
                points = _points(vectors, plan.pivots.shape[1] - 1, plan.most, True)
                for g, members in plan.members.items():
                    least, largest = plan.ring[g]
                    at = np.flatnonzero((d >= least[cell]) & (d <= largest[cell]))
                    if len(at):
                        far = _distances(points[at], plan.pivots[np.array(plan.active)[members]])
                        at = at[(far <= plan.radius[members] + plan.bound[members]).any(1)]
                    if len(at):
                        block = (_mixed(rows[at]) % np.uint64(blocks[g][1])).astype(np.int32)
                        taken = piece.select([0, 1, 2]).take(pa.array(at))
                        for q in range(blocks[g][0]):
                            same = [pa.array(np.full(len(at), x, np.int32)) for x in (g, q)]
                            yield pa.RecordBatch.from_arrays([*same, pa.array(block), *taken.columns], names)

    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: in single or double precision where sums stay exact, else as Python integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return whole(a) @ whole(b).T


def _solved(k: int, width: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        d_ids = held.column("id").to_numpy()
        q_rows, d_rows = (t.column("row").to_numpy() for t in (asked, held))
        a, b = (_matrix(t.column("v").to_pylist(), width) for t in (asked, held))
        out: list[list] = [[], [], [], [], []]
        for low in range(0, len(a), 128):
            scores = _products(a[low : low + 128], b)
            for one, row, score in zip(asked.column("id").slice(low, 128).to_pylist(), q_rows[low : low + 128], scores, strict=True):
                other = np.flatnonzero(d_rows != row)
                score = score[other]
                if len(other) > k:
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    other, score = other[score >= least], score[score >= least]
                best = sorted(zip((-score).tolist(), d_ids[other].tolist(), strict=True))[:k]
                out[4] += [row] * len(best)
                out[0] += [one] * len(best)
                out[1] += [i for _, i in best]
                out[2] += [min(max(-s, -(2**63)), 2**63 - 1) for s, _ in best]
                out[3] += [float(-s) for s, _ in best]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["query_id", "vec_id", "score", "size", "row"])

    return run


def top_k(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    scale: float = 64.0,
    pivots: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_rows: int = 1 << 14,
    data_rows: int = 1 << 17,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's ``k`` largest integer inner products.

    Vectors become floor(scale * x).  Queries are the rows whose id is
    divisible by ``every``; candidates are all other rows; ties go to the
    smaller id.  Null ids, null vectors and vectors with null or non-finite
    components take no part; shorter vectors count as ending in zeros.  Rows
    that share an id are rows of their own: each is a candidate, of the other
    ones too, and each query among them has its ``k`` rows.  Scores that no bigint holds come out as the nearest
    one, in the order of the exact products (of their doubles across blocks).
    Other columns are not read.  No rows, or no queries, give no rows.

    The driver holds a sample of 8 rows a pivot, of which there are by default
    2 * sqrt(n), 16 to 1024, and k + 4 numbers of each cell, at any size.  On vectors without clusters
    nothing can be pruned: each row then goes to every block of queries.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    packed = base.mapInArrow(_packed(scale), "id long, v binary, square double, width int")
    data = materialise(packed.withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbered once, as it is written
    n, most, width = data.agg(F.count("*"), F.max("square"), F.max("width")).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return none
    wanted = pivots or int(min(1024, max(16, 2 * np.ceil(np.sqrt(n)))))
    picked = data.orderBy(F.xxhash64("id"), "id", "v").limit(8 * wanted).select("v").collect()
    p = spread(_lifted(_matrix([bytes(r.v) for r in picked], width), most), wanted)
    cells = "id long, v binary, row long, cell int, d double"
    placed = materialise(data.select("id", "v", "row").mapInArrow(_assigned(p, most, True), cells), "placed")
    queries = materialise(data.filter(F.col("id") % every == 0).select("id", "v", "row").mapInArrow(_assigned(p, most, False), cells), "queries")
    summary = {r.cell: (r.n, r.low, r.high) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()}
    first = F.row_number().over(Window.partitionBy("cell").orderBy("d"))
    smallest: dict[int, list[float]] = {}
    for r in placed.select("cell", "d", first.alias("place")).filter(F.col("place") <= k + 1).orderBy("cell", "d").collect():
        smallest.setdefault(r.cell, []).append(r.d)
    asked = {r.cell: (r.n, r.u) for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("u")).collect()}
    if not asked:
        return none
    plan = Plan(p, most, k, summary, smallest, asked, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = {g: (-(-plan.asked[g] // query_rows), max(1, -(-plan.rows[g] // data_rows))) for g in plan.members}
    table = spark.createDataFrame([(c, g, *blocks[g]) for c, g in plan.group.items()], "cell int, g int, qs int, ss int")  # a row a cell
    rows = queries.join(F.broadcast(table), "cell")
    rows = rows.select("g", F.pmod(F.xxhash64("row"), F.col("qs")).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("ss") - 1)).alias("s"), "id", "v", "row")
    sent = placed.mapInArrow(_sent(plan, blocks), "g int, q int, s int, id long, v binary, row long")
    keys = ["g", "q", "s"]
    scored = rows.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_solved(k, width), "query_id long, vec_id long, score long, size double, row long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.desc("size"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
