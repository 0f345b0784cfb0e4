"""Near-duplicate detection: MinHash signatures and a multi-index Hamming join.

1. Every text becomes its set of word shingles (64-bit hashes) and a signature
   of ``chunks * width`` MinHash values of 16 bits.
2. Documents with equal sets are one class, named by 64 bits of a digest of
   the set (two of n different sets share a name with probability n^2 / 2^65).
3. Two signatures that differ in at most ``chunks * (errors + 1) - 1`` places
   have, by the pigeonhole principle, a chunk with at most ``errors``
   differing places.  The allowed errors are enumerated as masks: each chunk
   gives one key for every choice of ``errors`` places left out.  All pairs
   under that signature distance thus share a key, and so do most pairs a
   little beyond it; pairs that differ in more than ``distance`` places are
   dropped.
4. Each class is paired with the smallest class of each of its keys.  Pairs
   within the distance are confirmed exactly on the full sets, and confirmed
   links make components.
5. Keys whose classes are still in several components go on: their classes
   are dealt into blocks of bounded size, a component of many blocks by
   itself, and pairs of blocks (not two blocks of one component) compare
   signatures.  Only classes within the distance of one in another component
   send their sets, which are confirmed exactly; a spanning forest of the
   links leaves the task.  So a group of n near copies that hang together
   costs n rows, and nowhere are all pairs of a group emitted.
6. Components of all confirmed links, carried back to all documents.

With the defaults (40 places, 8 chunks of 5, 1 error) all pairs within a
distance of 15 share a key.  A pair at similarity exactly 0.8 differs in 8 of
40 places on average; it shares no key with a probability of
(1 - 0.737) ** 8 = 2e-5, and is beyond ``distance`` (20) with less than 1e-5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import discard, materialise, released

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct word-shingle hashes of whole texts.

    A-Z are lower-cased and words are runs of bytes other than 0x20 and
    0x09-0x0D, which is what bytes.lower() and bytes.split() do.
    """

    def __init__(self, words: int, remembered: int = 1 << 18) -> None:
        self.words, self.remembered, self.known = words, remembered, {}

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= self.remembered:
            self.known.clear()
        h = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; empty for null and for texts without words."""
        if not text:
            return np.empty(0, np.uint64)
        known, make = self.known, self._hash
        got = [known.get(w) or make(w) for w in text.encode("utf-8", "surrogatepass").lower().split()]
        h = np.array(got, np.uint64)
        n = min(self.words, len(h))
        if not n:
            return h
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = mix64(out * _GOLD + h[k : len(h) - n + 1 + k])
        return np.unique(mix64(out + np.uint64(n)))


class MinHash:
    """Signatures, and the keys of the multi-index join."""

    def __init__(self, chunks: int, width: int, errors: int) -> None:
        places = chunks * width
        seeds = mix64(np.arange(1, 2 * places + 1, dtype=np.uint64) * _GOLD)
        self.a, self.b = seeds[:places] | np.uint64(1), seeds[places:]
        masks = [
            [c * width + k for k in range(width) if k not in out]
            for c in range(chunks)
            for out in combinations(range(width), errors)
        ]
        self.kept = np.array(masks)
        self.names = mix64(np.arange(len(masks), dtype=np.uint64) + np.uint64(77))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """One 16-bit value a place; the set is taken in pieces to bound memory."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(hashes), 8192):
            piece = hashes[k : k + 8192, None] * self.a
            piece += self.b
            piece ^= piece >> np.uint64(32)
            piece *= self.a
            np.minimum(low, piece.min(0), out=low)
        return (mix64(low) >> np.uint64(48)).astype(np.uint16)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """The keys of rows of signatures, one column a mask."""
        out = np.tile(self.names, (len(signatures), 1))
        for k in range(self.kept.shape[1]):
            out = mix64(out * _GOLD + signatures[:, self.kept[:, k]].astype(np.uint64))
        return out.view(np.int64)


def farthest(places: int, percent: int, missed: float = 1e-5) -> int:
    """The least distance that a pair at the similarity is beyond with a probability under ``missed``."""
    p, left = 1 - percent / 100, 1.0
    for d in range(places):
        left -= math.comb(places, d) * p**d * (1 - p) ** (places - d)
        if left < missed:
            return d
    return places


def _signed(words: int, chunks: int, width: int, errors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, minhash = Shingler(words), MinHash(chunks, width, errors)
        for batch in batches:
            nodes, counts, signatures = [], [], []
            for text in batch.column(2):
                hashes = shingle(text.as_py())
                counts.append(len(hashes))
                nodes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else None)
                signatures.append(minhash.signature(hashes).tobytes() if len(hashes) else None)
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "n", "node", "signature"])

    return run


def _matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint16).reshape(len(signatures), -1)


def _keyed(chunks: int, width: int, errors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(chunks, width, errors)
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                piece = batch.slice(low, 2048)
                keys = minhash.keys(_matrix(piece.column(1)))
                nodes = np.repeat(piece.column(0).to_numpy(), keys.shape[1])
                masks = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(masks), pa.array(keys.ravel())], ["node", "mask", "key"])

    return run


def _within(distance: int):
    """Pairs whose signatures differ in at most ``distance`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(1) <= distance
                yield batch.select([0, 1]).filter(pa.array(near))

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sets = [shingle(text.as_py()).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    pieces = (batch.slice(low, 128) for batch in batches for low in range(0, batch.num_rows, 128))
    rows = (row for piece in pieces for row in zip(*(c.to_pylist() for c in piece.columns), strict=True))
    return groupby(rows, lambda r: r[:keys])


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["u", "v"])


def _star(percent: int):
    """Of rows (hub, salt, role, node, hashes), the hub's own set first: the nodes that are linked with the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hub, _), rows in _grouped(batches, 2):
            centre, out = np.empty(0, np.uint64), []
            for _, _, role, node, hashes in rows:
                own = np.frombuffer(hashes, np.uint64)
                if not role:
                    centre = own
                    continue
                both = int((centre[np.minimum(np.searchsorted(centre, own), len(centre) - 1)] == own).sum())
                if 100 * both >= percent * (len(centre) + len(own) - both):
                    out.append((node, hub))
            yield _edges(out)

    return run


def _apart(distance: int, chunks: int, width: int, errors: int):
    """Of rows (a, b, mask, node, component, signature) of a pair of blocks of a key: the nodes within the distance of one of another component.

    A pair that shares several keys counts in that of the first mask only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = MinHash(chunks, width, errors).kept
        for (a, b, mask), rows in _grouped(batches, 3):
            _, _, _, nodes, components, signatures = zip(*rows, strict=True)
            x, c, place = np.frombuffer(b"".join(signatures), np.uint16).reshape(len(nodes), -1), np.array(components), np.arange(len(nodes))
            hit = np.zeros(len(nodes), bool)
            for low in range(0, len(nodes), 128):
                differing = np.zeros((len(x[low : low + 128]), len(x)), np.uint8)
                for k in range(x.shape[1]):
                    differing += x[low : low + 128, None, k] != x[None, :, k]
                near = (differing <= distance) & (c[low : low + 128, None] != c[None, :]) & (place[low : low + 128, None] < place[None, :])
                i, j = np.nonzero(near)
                first = (x[low + i] == x[j])[:, kept].all(2).argmax(1) == mask
                hit[low + i[first]] = True
                hit[j[first]] = True
            out = np.array(nodes)[hit]
            names = (pa.array(np.full(len(out), n), pa.int64()) for n in (a, b))
            yield pa.RecordBatch.from_arrays([*names, pa.array(out, pa.int64())], ["a", "b", "node"])

    return run


def links(sets: list[np.ndarray], percent: int, cells: int = 1 << 22) -> np.ndarray:
    """Exact matrix of 100 * |A and B| >= percent * |A or B|.

    Hashes of one set alone can't be shared and are dropped; the rest make
    the columns of a 0/1 matrix that is multiplied piece by piece.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    column = np.cumsum(np.r_[0, column[1:] != column[:-1]]) if len(column) else column
    both = np.zeros((n, n), np.int32)
    step = max(1, cells // max(1, n))  # counts of a piece are far below 2 ** 24, where single precision is exact
    total = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, total, step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((n, min(step, total - low)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += (part @ part.T).astype(np.int32)
    linked = np.empty((n, n), bool)
    for low in range(0, n, 256):
        some = both[low : low + 256].astype(np.int64)
        linked[low : low + 256] = 100 * some >= percent * (size[low : low + 256, None] + size[None, :] - some)
    return linked


def forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """(id, smallest id) for the members of each component of a link matrix."""
    left, out = np.ones(len(ids), bool), []
    for start in np.argsort(ids, kind="stable"):
        if not left[start]:
            continue
        seen = np.zeros(len(ids), bool)
        seen[start], front = True, np.array([start])
        while len(front):
            new = linked[front].any(0) & ~seen
            seen |= new
            front = np.flatnonzero(new)
        left &= ~seen
        out += [(int(ids[k]), int(ids[start])) for k in np.flatnonzero(seen) if k != start]
    return out


def _confirm(percent: int):
    """Of rows (a, b, node, hashes) of a pair of blocks: a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 2):
            sets = {node: np.frombuffer(hashes, np.uint64) for _, _, node, hashes in rows}
            yield _edges(forest(np.array(list(sets)), links(list(sets.values()), percent)))

    return run


def _texts(base: DataFrame, reps: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node``, ``hashes`` of one text of each node."""
    wanted = reps.join(nodes, "node", "left_semi").select("node", F.col("rep.id").alias("_id"), F.col("rep.hash").alias("_hash"))
    # repeated rows of one id and text meet again in dropDuplicates, which combines before the shuffle
    # a merge join at every size: what it shuffles grows with the texts, not by steps
    rows = base.join(wanted.hint("merge"), (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id"))).select("node", "text")
    return rows.mapInArrow(released(_sets(words)), "node long, hashes binary").dropDuplicates(["node"])


def _star_links(near: DataFrame, sets: DataFrame, percent: int, members: int) -> DataFrame:
    """The pairs (u, hub v) of ``near`` that hold on full sets; a hub of many is salted, and its set sent to each salt."""
    salts = near.groupBy("v").agg(F.ceil(F.count("*") / members).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt")
    around = near.join(salts, "v").select("v", salt, F.lit(1).alias("role"), F.col("u").alias("node"))
    hubs = salts.select("v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("v").alias("node"))
    rows = around.unionByName(hubs).join(sets, "node").select("v", "salt", "role", "node", "hashes")
    return rows.repartition("v", "salt").sortWithinPartitions("v", "salt", "role").mapInArrow(released(_star(percent)), "u long, v long")


def _rest_links(tied: DataFrame, reps: DataFrame, sets: DataFrame, first: DataFrame, percent: int, apart, block_bytes: int, block_rows: int) -> DataFrame | None:
    """Links between different components of ``first`` that share a key; None if no key has two."""
    labels = first.select(F.col("id").alias("node"), "root")
    rows = tied.join(labels, "node", "left").select("key", "mask", "node", F.coalesce("root", "node").alias("component"))
    many = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"), F.count("*").alias("n"), F.first("mask").alias("mask"))
    # keys with the same classes do the same work: that of the first mask stays
    keys = materialise(many.filter("low < high").groupBy("mark", "n").agg(F.min(F.struct("mask", "key")).alias("k")).select("k.key"), "keys")
    if keys.isEmpty():
        return None
    rows = materialise(rows.join(keys, "key", "left_semi").join(reps.select("node", "n", "signature"), "node"), "open")
    blocks = lambda c, b: F.ceil(F.greatest(c / block_rows, b * 8 / block_bytes)).cast("long")
    own = rows.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("b")).withColumn("own", blocks(F.col("c"), F.col("b")))
    small = own.groupBy("key").agg(*[F.sum(F.when(F.col("own") <= 1, F.col(x)).otherwise(0)).alias(x) for x in ("c", "b")])
    own = own.select("key", "component", "own").join(small.select("key", F.greatest(F.lit(1), blocks(F.col("c"), F.col("b"))).alias("others")), "key")
    large = F.col("own") > 1
    alone = F.when(large, F.col("component"))  # the component that a block is of, null for mixed blocks
    dealt = rows.join(own, ["key", "component"]).select(
        "key", "mask", "node", "component", "signature", alone.alias("alone"),
        F.when(large, F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.pmod(F.xxhash64("component"), F.col("others"))).alias("place"),
    )
    dealt = dealt.select("key", "mask", F.xxhash64("key", "alone", "place").alias("block"), "alone", "node", "component", "signature")
    block = dealt.select("key", "block", "alone").distinct()
    x, y = block.alias("x"), block.alias("y")
    two = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")) & F.coalesce(F.col("x.alone") != F.col("y.alone"), F.lit(True))
    two = two & ~((F.col("x.block") == F.col("y.block")) & F.col("x.alone").isNotNull())
    pairs = x.join(y, two).select(F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    sides = pairs.select(F.col("a").alias("block"), "a", "b").unionByName(pairs.filter("a <> b").select(F.col("b").alias("block"), "a", "b"))
    met = dealt.join(sides, "block").select("a", "b", "mask", "node", "component", "signature")
    met = met.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(released(apart), "a long, b long, node long")
    sent = met.join(sets, "node").select("a", "b", "node", "hashes")
    return sent.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(released(_confirm(percent)), "u long, v long")


def _classified(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, chunks: int, width: int, errors: int, distance: int | None, block_bytes: int, block_rows: int) -> DataFrame:
    """Per row: ``id``, ``hash`` of the text, ``n``, and the ``keeper`` of its component, (no_id, id, hash); null without shingles."""
    if distance is None:
        distance = farthest(chunks * width, percent)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    signed = base.mapInArrow(released(_signed(words, chunks, width, errors)), "id long, hash long, n long, node long, signature binary")
    signed = materialise(signed, "signatures")
    named = F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")
    reps = signed.filter("node is not null").groupBy("node").agg(F.min(named).alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.count("*").alias("rows"))
    reps = materialise(reps, "classes")
    keyed = reps.select("node", "signature").mapInArrow(released(_keyed(chunks, width, errors)), "node long, mask int, key long")
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "low")
    tied = materialise(keyed.join(shared, "key"), "tied")
    pairs = tied.filter("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct()
    signature = lambda n: reps.select(F.col("node").alias(n), F.col("signature").alias(f"s{n}"))
    near = pairs.join(signature("u"), "u").join(signature("v"), "v").select("u", "v", "su", "sv")
    near = materialise(near.mapInArrow(released(_within(distance)), "u long, v long"), "near")
    # texts are read again, and sets are sent, for classes that share a key with another one only
    sets = materialise(_texts(base, reps, tied.select("node").distinct(), words), "sets")
    first = connected_components(_star_links(near, sets, percent, block_rows))
    rest = _rest_links(tied, reps, sets, first, percent, _apart(distance, chunks, width, errors), block_bytes, block_rows)
    found = first if rest is None else connected_components(rest.unionByName(first.select(F.col("id").alias("u"), F.col("root").alias("v"))))
    discard(tied, near, sets)
    members = found.select(F.col("id").alias("node"), "root").unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    keepers = members.join(reps.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("keeper"))
    linked = members.join(keepers, "root").select("node", "keeper")
    classes = reps.select("node", "rep", "rows").join(linked, "node", "left").select("node", "rows", F.coalesce("keeper", "rep").alias("keeper"))
    classes = materialise(classes, "keepers")
    # classes of more than a thousandth of all rows are at most a thousand: they are broadcast, so no task gets one whole
    many = F.col("rows") > max(1000, signed.count() // 1000)
    large = F.broadcast(classes.filter(many).select("node", "keeper"))
    rows = signed.select("id", "hash", "n", "node")
    rest = rows.join(large, "node", "left_anti").join(classes.filter(~many).select("node", "keeper"), "node", "left")
    return rows.join(large, "node").unionByName(rest).select("id", "hash", "n", "keeper")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    chunks: int = 8,
    width: int = 5,
    errors: int = 1,
    distance: int | None = None,
    block_bytes: int = 1 << 21,
    block_rows: int = 1000,
) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked at a Jaccard similarity of ``percent`` / 100 of their
    sets of ``words``-word shingles; ``component_id`` is the smallest id that
    is reachable.  Null texts and texts without words have no shingles, link
    with nothing and are their own component.  Repeated rows yield a row each;
    rows that give one id several texts are judged text by text.  Rows with a
    null id take part: they are kept only if no row of their component has an
    id, then by the smallest hash of a text; ``component_id`` is then null.
    Very long texts are read whole, in pieces of bounded memory.  Other columns
    of ``docs`` are not read, so none can clash.  An empty table gives an
    empty result.  ``distance`` is by default the least one that a pair at the
    similarity is beyond with a probability under 1e-5.
    """
    rows = _classified(docs, id_col, text_col, words, percent, chunks, width, errors, distance, block_bytes, block_rows)
    component = F.when(F.col("keeper").isNull(), F.col("id")).otherwise(F.col("keeper.id"))
    alone = F.col("keeper").isNull() | (F.col("keeper.no_id") & (F.col("keeper.hash") == F.col("hash")))
    kept = F.when(F.col("id").isNull(), alone).otherwise(F.col("id") == component)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, chunks: int = 8, width: int = 5, errors: int = 1, distance: int | None = None, block_bytes: int = 1 << 21, block_rows: int = 1000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each component.

    It is the one with the smallest id; rows without an id come after all
    others, and among rows of one id the smallest hash of a text goes first.
    Repeated rows of one id and text are copies of each other, of which one
    stays.  Rows without shingles (null texts, texts without words) all stay.
    """
    rows = _classified(docs, id_col, text_col, words, percent, chunks, width, errors, distance, block_bytes, block_rows).filter("keeper is not null")
    mine = (F.col("keeper.hash") == F.col("hash")) & F.col("keeper.id").eqNullSafe(F.col("id"))
    # a row for each id and text that goes (0) or is there more than once (its number of rows)
    marks = rows.groupBy("id", "hash", mine.alias("mine")).agg(F.count("*").alias("times"))
    marks = materialise(marks.filter("not mine or times > 1").select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "mine"), "marks")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = whole.select("row", F.col("row").getField(id_col).cast("long").alias("id"), F.xxhash64(F.col("row").getField(text_col)).alias("hash"))
    same = (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id"))
    # merge joins at every size, as are those that read texts again; both use one shuffle of the rows
    once = whole.join(marks.hint("merge"), same, "left_anti").select("row")
    one = whole.join(marks.filter("mine").hint("merge"), same, "left_semi").groupBy("id", "hash").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(one).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
