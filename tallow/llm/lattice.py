"""Near-duplicate embeddings: E8 lattice hashing in several tables.

1. Equal vectors of a label are one class, so a group of copies costs a row.
2. Every table projects unit vectors on ``8 * blocks`` random directions and
   decodes each block of 8 numbers to the nearest point of the lattice E8.
   The points of all blocks, with the label, name the vector's cell.  It also
   probes the ``probes`` neighbouring cells that are nearest to it: one or two
   blocks moved to a lattice point beside the own one.
3. Balls: vectors within half the threshold's angle of a cell's leader are all
   linked with each other.  They become one ball, whose links inside need no
   comparison; a dense group of any size so costs a few balls.  Other vectors
   are balls of their own.
4. Two balls are candidates if one probes a cell that the other lives in.
   Cells that one ball alone meets go before any vector is sent; the rest are
   dealt into pairs of blocks of bounded size.  By the triangle inequality on
   angles, two balls are linked throughout, not at all, or in part.
5. Of balls linked in part, each member meets the other leader first, by the
   same inequality; only members still open meet the other members.
6. Links that were found are all confirmed by the cosine in double precision
   or proven by the inequality with room for rounding.  Linked balls make
   components.

Public method: Jegou et al., "Query adaptative locality sensitive hashing"
(2008); decoding as in Conway and Sloane (1982).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialise, released
from .vectors import matrix, width_of

_ROOM = 1e-6  # of an angle, for rounding
#: The 240 shortest vectors of E8: the neighbours of a lattice point.
_ROOTS = np.array(
    [
        [s if k == i else t if k == j else 0 for k in range(8)]
        for i, j in itertools.combinations(range(8), 2)
        for s in (1, -1)
        for t in (1, -1)
    ]
    + [x for x in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum: a point with an odd one moves where it costs least."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) < 0, -1.0, 1.0)
    other = near.copy()
    np.put_along_axis(other, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return np.where((near.sum(-1) % 2 != 0)[..., None], other, near)


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is the even points and those shifted by a half everywhere."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[..., None], a, b)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Lattice:
    """Cells of unit vectors; the same for the same arguments, wherever it is built."""

    def __init__(self, width: int, angle: float, blocks: int, tables: int, probes: int, coarse: float = 2.5, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.blocks, self.tables, self.probes = blocks, tables, probes
        # ``coarse`` is for vectors at distance 0.374, a cosine of 0.93; other thresholds scale it
        scale = coarse * 2 * np.sin(angle / 2) / 0.374
        self.axes = rng.normal(size=(tables, width, 8 * blocks)) / scale
        self.shift = rng.uniform(0, 2, (tables, 8 * blocks))
        self.factors = rng.integers(1 << 62, size=(tables, blocks, 8), dtype=np.int64) * 2 + 1
        self.seeds = rng.integers(1 << 62, size=tables, dtype=np.int64)
        per = min(6, max(1, probes))
        places = [(b, k) for b in range(blocks) for k in range(per)]
        pairs = [(p, q) for p, q in itertools.combinations(places, 2) if p[0] != q[0]]
        self.per, self.moves = per, [[b * per + k for b, k in m] for m in [*((p,) for p in places), *pairs]]

    def cells(self, x: np.ndarray, labels: np.ndarray, table: int, probing: bool = True) -> np.ndarray:
        """Rows x (1 + probes): the own cell, then its neighbours, nearest first."""
        y = (x @ self.axes[table] + self.shift[table]).reshape(len(x), self.blocks, 8)
        point = nearest_point(y)
        factors = self.factors[table]
        with np.errstate(over="ignore"):
            own = ((2 * point).astype(np.int64) * factors).sum((1, 2)) + self.seeds[table] + labels.astype(np.int64) * np.int64(-7046029254386353131)
            if not probing or not self.probes:
                return _mixed(own)[:, None].astype(np.int64)
            cost = 2 - 2 * ((y - point) @ _ROOTS.T)  # what a move to a neighbour adds to the squared distance
            best = np.argpartition(cost, self.per - 1, 2)[:, :, : self.per]
            cost = np.take_along_axis(cost, best, 2).reshape(len(x), -1)
            shifts = np.take_along_axis(np.broadcast_to((factors @ (2 * _ROOTS).astype(np.int64).T)[None], (len(x), self.blocks, 240)), best, 2).reshape(len(x), -1)
            costs = np.stack([cost[:, m].sum(1) for m in self.moves], 1)
            moved = np.stack([shifts[:, m].sum(1) for m in self.moves], 1)
            taken = np.argsort(costs, 1, kind="stable")[:, : self.probes]
            around = own[:, None] + np.take_along_axis(moved, taken, 1)
        return _mixed(np.column_stack([own, around])).astype(np.int64)


#: (classes of the largest label, blocks, coarseness, tables).  Measured at a cosine of 0.93 with 8 probes: a table finds
#: 0.57, 0.45 and 0.28 of the pairs, all tables together 0.99 or more; unrelated vectors meet in a table with
#: probabilities of 2e-4, 1e-5 and less.
SIZES = ((20_000, 2, 2.0, 7), (2_000_000, 3, 2.5, 10), (None, 4, 2.5, 16))


def _packed(width: int, kind: type):
    """(id, label, v) of every row: vectors padded to the width as bytes of ``kind``; null for rows that are linked with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix(batch.column(2), width)
            named = ~(batch.column(0).is_null().to_numpy(zero_copy_only=False) | batch.column(1).is_null().to_numpy(zero_copy_only=False))
            packed: list[bytes | None] = [None] * batch.num_rows
            for k, some, row in zip(at.tolist(), named[at] & (x != 0).any(1), x.astype(kind) + kind(0), strict=True):  # one zero
                packed[k] = row.tobytes() if some else None
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], ["id", "label", "v"])

    return run


def _units(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Unit vectors in double precision, whatever the size of the components."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(1, initial=np.finfo(float).tiny, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows at the same place; the sum's order doesn't depend on what else is in the batch."""
    return np.clip((a * b).sum(1), -1, 1)


def _homes(lattice: Lattice, table: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                piece = batch.slice(low, 2048)
                own = lattice.cells(_units(piece.column(2), kind), piece.column(1).to_numpy(), table, False)[:, 0]
                order = _mixed(piece.column(0).to_numpy().astype(np.uint64) + np.uint64(table)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(order), *piece.columns], ["key", "order", "c", "label", "v"])

    return run


def _captured(half: float, kind: type):
    """Rows beside their cell's leader: those within half the threshold's angle, with their angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                piece = batch.slice(low, 2048)
                angle = np.arccos(_cosines(_units(piece.column(1), kind), _units(piece.column(3), kind)))
                at = pa.array(np.flatnonzero(angle <= half - _ROOM))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(at), piece.column(2).take(at), pa.array(angle).take(at)], ["c", "ball", "angle"])

    return run


def balls(classes: DataFrame, lattice: Lattice, half: float, kind: type, rounds: int = 2) -> DataFrame:
    """(c, ball, angle) of the classes in balls of more than one; a ball is named by its leader, at angle 0.

    A round deals the classes that are left into the cells of another table.
    A cell's leader is its first class by a hash; it travels in a partial
    aggregate, and the join with it may be split, so a cell with a third of
    all classes is no task of its own.
    """
    rest, found = classes.select("c", "label", "v"), []
    for table in range(min(rounds, lattice.tables)):
        keyed = rest.mapInArrow(released(_homes(lattice, table, kind)), "key long, order long, c long, label long, v binary")
        leaders = keyed.groupBy("key").agg(F.min(F.struct("order", "c", "v")).alias("l"), F.count("*").alias("n")).filter("n > 1")
        leaders = leaders.select("key", F.col("l.c").alias("leader"), F.col("l.v").alias("lv"))
        beside = keyed.join(leaders, "key").filter("c <> leader").select("c", "v", "leader", "lv")
        got = materialise(beside.mapInArrow(released(_captured(half, kind)), "c long, ball long, angle double"), f"balls{table}")
        own = got.select("ball").distinct().select(F.col("ball").alias("c"), "ball", F.lit(0.0).alias("angle"))
        found.append(got.unionByName(own))
        if table + 1 < rounds:
            rest = materialise(rest.join(found[-1].select("c"), "c", "left_anti"), f"rest{table}")
    return reduce(DataFrame.unionByName, found)


def _keys(lattice: Lattice, kind: type):
    """(key, ball, home) for every cell that a class lives in or probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                piece = batch.slice(low, 512)
                x, labels, ball = _units(piece.column(2), kind), piece.column(1).to_numpy(), piece.column(0).to_numpy()
                for table in range(lattice.tables):
                    cells = lattice.cells(x, labels, table)
                    home = np.zeros(cells.shape, bool)
                    home[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(ball, cells.shape[1])), pa.array(home.ravel())], ["key", "ball", "home"])

    return run


def _grouped(keys: list[str], solve: Callable[[pa.Table, list[int]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow() over rows sorted by ``keys``: ``solve`` gets whole groups and their bounds.

    Groups are of bounded size, so what is held from one batch to the next is too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                table = new if held is None else pa.concat_tables([held, new])
            else:
                table = held
            if table is None or not table.num_rows:
                continue
            columns = [table[k].to_numpy() for k in keys]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            bounds = [0, *change.tolist()]
            if batch is None:
                bounds.append(table.num_rows)
            held = table.slice(bounds[-1]).combine_chunks() if batch is not None else None
            if len(bounds) > 1:
                yield from solve(table.slice(0, bounds[-1]).combine_chunks(), bounds)

    return run


def _pieces(i: np.ndarray, j: np.ndarray, size: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for low in range(0, len(i), size):
        yield i[low : low + size], j[low : low + size]


def _spanned(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (i, j) beside the least node of their component, for all but those."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    below = np.flatnonzero(root < np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _first_shared(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Rows x tables x cells of two vectors each: the least cell that both meet and one of them lives in."""
    shared = np.concatenate([np.where(own == other[:, :, :1], own, np.iinfo(np.int64).max), np.where(other == own[:, :, :1], other, np.iinfo(np.int64).max)], 2)
    return shared.min((1, 2))


def _met(lattice: Lattice, limit: float, kind: type):
    """What the balls of a cell, or of two of its blocks, are to each other: rows (a, b, state, n).

    0: ``a`` is linked with ``n`` rows here; 1: ``a`` and ``b`` are linked, as part of a spanning forest; 2: balls
    linked throughout; 3: balls to be compared by members.  Two single vectors are counted in the least cell that
    they share, and nowhere else, so no pair of a group has to be emitted.
    """
    angle = math.acos(limit)

    def solve(table: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
        key, ball, label, home, side, radius, size, total = (table[c].to_numpy() for c in ("key", "ball", "label", "home", "side", "radius", "size", "total"))
        unit = _units(table["v"], kind)
        out: list[list[np.ndarray]] = [[], [], [], []]

        def emit(a: np.ndarray, b: np.ndarray, state: int, n: np.ndarray | None = None) -> None:
            for column, values in zip(out, (a, b, np.full(len(a), state, np.int32), np.zeros(len(a), np.int64) if n is None else n), strict=True):
                column.append(values)

        for low, high in itertools.pairwise(bounds):
            b, h, s, r = ball[low:high], home[low:high], side[low:high], radius[low:high]
            near = unit[low:high] @ unit[low:high].T >= np.cos(np.minimum(np.pi, angle + r[:, None] + r + _ROOM)) - 1e-9
            near &= (h[:, None] | h) & (b[:, None] < b)
            if s.any():
                near &= s[:, None] != s
            linked: tuple[list, list] = [], []
            for i, j in _pieces(*(x + low for x in np.nonzero(near))):
                cosine = _cosines(unit[i], unit[j])
                single = (size[i] == 1) & (size[j] == 1)
                for k, x in zip(linked, (i, j), strict=True):
                    k.append(x[single & (cosine >= limit)])
                between, reach = np.arccos(cosine), radius[i] + radius[j]
                whole, part = ~single & (between + reach <= angle - _ROOM), ~single & (between - reach <= angle + _ROOM)
                emit(ball[i[whole]], ball[j[whole]], 2)
                part &= ~whole
                emit(ball[i[part]], ball[j[part]], 3)
            i, j = (np.concatenate(k) if k else np.empty(0, np.int64) for k in linked)
            if not len(i):
                continue
            rows = np.unique(np.concatenate([i, j]))
            cells = np.stack([lattice.cells(unit[rows], label[rows], t) for t in range(lattice.tables)], 1)
            first = np.concatenate([_first_shared(cells[np.searchsorted(rows, x)], cells[np.searchsorted(rows, y)]) for x, y in _pieces(i, j)]) == key[low]
            i, j = i[first], j[first]
            if len(i):
                n = np.bincount(i - low, total[j], high - low) + np.bincount(j - low, total[i], high - low)
                some = np.flatnonzero(n)
                emit(b[some], b[some], 0, n[some].astype(np.int64))
                below, least = _spanned(i, j)
                emit(ball[below], ball[least], 1)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["a", "b", "state", "n"])

    return _grouped(["key", "i", "j"], solve)


def _beside_leaders(limit: float, kind: type):
    """Members beside the leader of a ball that theirs may be linked with: the number of links where the angle tells it, else null."""
    angle = math.acos(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            between = np.arccos(_cosines(_units(column["v"], kind), _units(column["lv"], kind)))
            radius, total = column["radius"].to_numpy(), column["total"].to_numpy()
            whole, none = between + radius <= angle - _ROOM, between - radius > angle + _ROOM
            n = pa.array(np.where(whole, total, 0), mask=~whole & ~none)
            keep = pa.array(np.flatnonzero(~none))
            yield pa.RecordBatch.from_arrays([x.take(keep) for x in (column["c"], column["ball"], column["other"], column["v"], n)], ["c", "ball", "other", "v", "n"])

    return run


def _by_members(limit: float, kind: type):
    """Links of the open members (side 0) of a unit with the members of the other ball (side 1)."""

    def solve(table: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
        ball, other, c, side, n = (table[x].to_numpy() for x in ("ball", "other", "c", "side", "n"))
        unit = _units(table["v"], kind)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for low, high in itertools.pairwise(bounds):
            x, y = (np.flatnonzero(side[low:high] == k) + low for k in (0, 1))
            i, j = np.nonzero(unit[x] @ unit[y].T >= limit - 1e-9)
            count = np.zeros(len(x), np.int64)
            for k, m in _pieces(i, j):
                sure = _cosines(unit[x[k]], unit[y[m]]) >= limit
                count += np.bincount(k[sure], n[y[m[sure]]], len(x)).astype(np.int64)
            some = np.flatnonzero(count)
            for column, values in zip(out, (c[x[some]], ball[x[some]], other[x[some]], count[some]), strict=True):
                column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["c", "ball", "other", "n"])

    return _grouped(["ball", "other", "i", "j"], solve)


def _dealt(name: str, blocks: str):
    """The block of a row, of as many as its group has."""
    return F.pmod(F.xxhash64(name), F.col(blocks)).cast("int")


def _open_links(pairs: DataFrame, members: DataFrame, info: DataFrame, limit: float, kind: type, block: int) -> DataFrame:
    """(c, ball, other, n): links of members with other balls, for the pairs (a, b) of balls that are linked in part."""
    both = pairs.select(F.col("a").alias("ball"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("ball"), F.col("a").alias("other")))
    leaders = info.select(F.col("ball").alias("other"), F.col("v").alias("lv"), "radius", "total")
    beside = members.select("c", "ball", "v").join(both, "ball").join(leaders, "other").select("c", "ball", "other", "v", "lv", "radius", "total")
    beside = materialise(beside.mapInArrow(released(_beside_leaders(limit, kind)), "c long, ball long, other long, v binary, n long"), "beside")
    count = lambda name, out: info.select(F.col("ball").alias(name), F.ceil(F.col("size") / block).cast("int").alias(out))
    asked = beside.filter("n is null").drop("n").join(count("ball", "x"), "ball").join(count("other", "y"), "other").withColumn("i", _dealt("c", "x"))
    left = asked.select("ball", "other", "i", F.explode(F.sequence(F.lit(0), F.col("y") - 1)).alias("j"), F.lit(0).alias("side"), "c", "v", F.lit(0).cast("long").alias("n"))
    groups = asked.select("ball", "other", "i", "y").distinct()
    held = members.select(F.col("ball").alias("other"), "c", "v", "n").join(groups, "other").withColumn("j", _dealt("c", "y"))
    right = held.select("ball", "other", "i", "j", F.lit(1).alias("side"), "c", "v", "n")
    keys = ["ball", "other", "i", "j"]
    units = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys)
    found = units.mapInArrow(released(_by_members(limit, kind)), "c long, ball long, other long, n long")
    return materialise(beside.filter("n > 0").select("c", "ball", "other", "n").unionByName(found), "open")


def _links(classes: DataFrame, lattice: Lattice, limit: float, kind: type, block: int) -> tuple[DataFrame, DataFrame]:
    """(c, ball, n_links) of all classes, and the links (u, v) between balls."""
    captured = balls(classes, lattice, math.acos(limit) / 2, kind)
    members = classes.join(captured, "c", "left").select("c", "label", "v", "n", F.coalesce("ball", "c").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle"), F.col("ball").isNotNull().alias("many"))
    members = materialise(members, "members")
    info = members.groupBy("ball").agg(
        F.max("angle").alias("radius"), F.sum("n").alias("total"), F.count("*").alias("size"), F.max("label").alias("label"), F.max(F.when(F.col("c") == F.col("ball"), F.col("v"))).alias("v")
    )
    info = materialise(info, "info")
    keys = lambda some: some.select("ball", "label", "v").mapInArrow(released(_keys(lattice, kind)), "key long, ball long, home boolean")
    # a class has no cell twice, the members of a ball share most of theirs
    cells = keys(members.filter("not many")).unionByName(keys(members.filter("many")).groupBy("key", "ball").agg(F.max("home").alias("home")))
    cell = Window.partitionBy("key")
    live = cells.withColumns({"n": F.count("*").over(cell), "lived": F.max("home").over(cell)}).filter("n > 1 and lived")
    rows = live.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).join(info, "ball").withColumn("own", _dealt("ball", "blocks"))
    # block b meets the pairs (i, j), i <= j, that hold it
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))))
    rows = rows.withColumn("unit", pair).select("key", "unit.i", "unit.j", "ball", "label", "home", ((F.col("unit.i") < F.col("unit.j")) & (F.col("own") == F.col("unit.j"))).alias("side"), "radius", "size", "total", "v")
    units = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    met = materialise(units.mapInArrow(released(_met(lattice, limit, kind)), "a long, b long, state int, n long"), "met")
    whole, part = (materialise(met.filter(F.col("state") == k).select("a", "b").distinct(), name) for k, name in ((2, "whole"), (3, "part")))
    opened = _open_links(part, members, info, limit, kind, block) if not part.isEmpty() else members.select("c", "ball", F.col("ball").alias("other"), "n").limit(0)
    total = info.select("ball", "total")
    added = [met.filter("state = 0").select(F.col("a").alias("ball"), "n")]
    for one, two in (("a", "b"), ("b", "a")):
        added.append(whole.select(F.col(one).alias("to"), F.col(two).alias("ball")).join(total, "ball").select(F.col("to").alias("ball"), F.col("total").alias("n")))
    by_ball = reduce(DataFrame.unionByName, added).groupBy("ball").agg(F.sum("n").alias("x"))
    by_class = opened.groupBy("c").agg(F.sum("n").alias("y"))
    out = members.select("c", "ball").join(total, "ball").join(by_ball, "ball", "left").join(by_class, "c", "left")
    out = out.select("c", "ball", (F.col("total") - 1 + F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("n_links"))
    edges = met.filter("state in (1, 2)").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(opened.select(F.col("ball").alias("u"), F.col("other").alias("v")))
    return out, edges


def near_vectors(
    vectors: DataFrame,
    limit: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    blocks: int | None = None,
    tables: int | None = None,
    probes: int = 8,
    block: int = 512,
) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Vectors with one label are linked if they were found and their cosine in
    double precision is ``limit`` or more.  ``n_links`` counts other rows,
    copies and rows of the same id included; ``component_id`` is the smallest
    id reachable, ``kept`` says that it is the own one.  Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without a label
    or an id, are linked with nothing; without an id, ``component_id`` and
    ``kept`` are null.  Shorter vectors count as ending in zeros.  A row in
    gives a row out; other columns are not read; no rows give no rows.

    Blocks, tables and the coarseness of cells follow the number of different
    vectors of the largest label (SIZES), so that the recall stays and cells
    don't fill up; all may be given.  Nothing is dropped from a full cell: its
    balls are dealt into blocks, and n unlike balls in one cell cost n^2 / 2
    products spread over pairs of blocks.
    """
    kind, element = np.float32, dict(vectors.select(F.col(vector_col).alias("v")).dtypes)["v"]
    if element != "array<float>":
        kind = np.float64
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    width = width_of(base, "v")
    rows = base.mapInArrow(released(_packed(width, kind)), "id long, label long, v binary")
    named = F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(b":"), F.col("v"))).alias("h")
    usable = rows.filter("v is not null").select("id", "label", "v", named)
    classes = usable.groupBy("h", "label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = materialise(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # numbered once, as it is written
    alone = rows.filter("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    finish = lambda some: some.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    if classes.isEmpty():
        return finish(alone)
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    size, coarse, many = next((b, w, t) for n, b, w, t in SIZES if n is None or most <= n)
    lattice = Lattice(max(1, width), math.acos(limit), blocks or size, tables or many, probes, coarse)
    links, edges = _links(classes.select("c", "label", "v", "n"), lattice, limit, kind, block)
    roots = connected_components(edges).select(F.col("id").alias("ball"), "root")
    joined = classes.select("c", "h", "id").join(links, "c").join(roots, "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    joined = materialise(joined.select("h", "id", "root", "n_links"), "linked")
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = joined.join(least, "root").select("h", "n_links", "component_id")
    out = usable.select("id", "h").join(by_class, "h").select("id", "n_links", "component_id")
    return finish(out.unionByName(alone))


#: DuckDB SQL for near_vectors() over ``embeddings``: all pairs of a label.
SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), roots AS (SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a
), counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a
), done AS (SELECT vec_id, coalesce(n, 0) AS n_links, component_id FROM v JOIN roots USING (r) LEFT JOIN counts USING (r)
)
SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM done
UNION ALL
SELECT vec_id, 0, vec_id, true FROM embeddings
WHERE embedding IS NULL OR label IS NULL OR len(embedding) = 0 OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
  OR len(list_filter(embedding, lambda x: x <> 0)) = 0
"""
