"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols.  At each level runs of one symbol become one
symbol; deterministic coin tossing (four times the lowest bit in which a
symbol differs from its left neighbour) shrinks the alphabet to six labels;
local maxima of the labels begin the phrases; and a phrase's name, a hash of
its symbols, is a symbol of the next level.  Whether a symbol begins a phrase
depends on a few symbols around it only, so equal substrings get equal
interior names wherever they stand.  The fingerprint is the bottom-k sketch
of the names of the highest level, followed by those of the levels below as
long as a level has few names (short texts); the likeness of two is the
estimated Jaccard similarity of the name sets of the lowest level that both
hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import mix64
from .store import released

LEVELS, KEPT, FEW, _STEP = 3, 64, 16, np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(x & -x).bit_length() - 1 if x else 0 for x in range(256)], np.uint8)


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 2 * (lowest differing bit) + that bit; the symbol before the first of a text is 0."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = 0
    if x.dtype == np.uint8:
        k = _LOW[x ^ before]
        return 2 * k + ((x >> k) & np.uint8(1))
    d = x ^ before
    k = np.bitwise_count((d & (~d + x.dtype.type(1))) - x.dtype.type(1))
    k[d == 0] = 0
    return (2 * k + ((x >> k.astype(x.dtype)) & x.dtype.type(1))).astype(np.uint8)


def parse(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: symbols of texts end to end and where each text begins (no empty texts) to phrase names and beginnings."""
    starts = np.zeros(len(x), bool)
    starts[first] = True
    new = starts.copy()
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(x)))
    starts, y = starts[at], x[at]
    first = np.flatnonzero(starts)
    label = y
    for _ in range(4):
        label = _toss(label, first)
    y = mix64(y.astype(np.uint64) + length.astype(np.uint64) * _STEP)
    peak = np.zeros(len(y), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    peak[first[1:] - 1] = False  # the last symbol of a text has no right neighbour
    peak[first] = True
    begin = np.flatnonzero(peak)
    place = np.arange(len(y)) - np.repeat(begin, np.diff(np.append(begin, len(y))))
    names = mix64(np.add.reduceat(mix64(y + place.astype(np.uint64) * _STEP), begin))
    return names, np.flatnonzero(starts[begin])


def sketches(texts: list[str], levels: int = LEVELS, kept: int = KEPT, piece: int = 1 << 19, few: int = FEW) -> list[list[np.ndarray]]:
    """Of every text the ``kept`` smallest distinct 32-bit names of each level, ascending, from the highest level down to one with ``few``.

    An empty text has no levels.  Texts are taken together up to ``piece``
    characters, to bound memory.
    """
    out: list[list[np.ndarray]] = [[] for _ in texts]
    low = 0
    while low < len(texts):
        high, total = low, 0
        while high < len(texts) and (high == low or total + len(texts[high]) <= piece):
            total += len(texts[high])
            high += 1
        some = [k for k in range(low, high) if texts[k]]
        low = high
        if not some:
            continue
        x = np.frombuffer("".join([texts[k] for k in some]).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0, *(len(texts[k]) for k in some[:-1])])
        parsed = []
        for _ in range(levels):
            x, first = parse(x, first)
            parsed.append(((x >> np.uint64(32)).astype(np.uint32), np.append(first, len(x))))
        for n, k in enumerate(some):
            for names, at in reversed(parsed):
                out[k].append(np.unique(names[at[n] : at[n + 1]])[:kept])
                if len(out[k][-1]) >= few:
                    break
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], kept: int = KEPT) -> float:
    """Estimated Jaccard similarity of two sketches, at the lowest level that both hold; 1 for two empty ones."""
    if not a or not b:
        return float(len(a) == len(b))
    x, y = (s[min(len(a), len(b)) - 1] for s in (a, b))
    both = np.union1d(x, y)[:kept]
    return float((np.isin(both, x) & np.isin(both, y)).sum() / len(both))


def text_of(sketch: list[np.ndarray]) -> str:
    return ".".join(["".join([f"{v:08x}" for v in level.tolist()]) for level in sketch])


_NULL = -(1 << 63)


def _place(ids: np.ndarray, ties: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """The last of the sorted (id, tie) bounds that isn't above each row."""
    firsts = np.array([b[0] for b in bounds])
    low, high = np.searchsorted(firsts, ids, "left"), np.searchsorted(firsts, ids, "right")
    out = high - 1
    for k in np.flatnonzero(low < high):  # an id that is a bound: its ties decide
        while out[k] >= 0 and bounds[out[k]] > (ids[k], ties[k]):
            out[k] -= 1
    return out


def _dealt(bounds: list[tuple[int, int]]):
    """Rows to ranges, the first row of a range to the range before it as well; texts are compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            ids, ties = batch.column(0).fill_null(_NULL).to_numpy(), batch.column(1).to_numpy()
            rows: list[tuple] = []
            for one, tie, p, text in zip(ids.tolist(), ties.tolist(), _place(ids, ties, bounds).tolist(), batch.column(2), strict=True):
                packed = pack((text.as_py() or "").encode("utf-8", "surrogatepass"))
                rows.append((p, 0, one, tie, packed))
                if bounds[p] == (one, tie):
                    rows.append(((p - 1) % len(bounds), 1, one, tie, packed))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                ["part", "ahead", "id", "tie", "packed"],
            )

    return run


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest (id, tie) of a partition."""
    least: tuple[int, int] | None = None
    for batch in batches:
        if batch.num_rows:
            ids, ties = batch.column(0).fill_null(_NULL).to_numpy(), batch.column(1).to_numpy()
            at = np.lexsort((ties, ids))[0]
            one = (int(ids[at]), int(ties[at]))
            least = one if least is None else min(least, one)
    if least is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in least], ["id", "tie"])


def _fingerprinted(quarter: int, levels: int, kept: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        block: list[tuple[int, str]] = []
        part, chars = None, 0

        def done() -> pa.RecordBatch:
            texts = [t for _, t in block]
            edited = [t[: len(t) - len(t) // quarter] + n[: len(t) // quarter] for t, n in zip(texts, texts[1:], strict=False)]
            own, new = sketches(texts, levels, kept, piece), sketches(edited, levels, kept, piece)
            n = len(edited)
            columns = [
                pa.array([i if i != _NULL else None for i, _ in block[:n]], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                pa.array([text_of(s) for s in own[:n]]),
                pa.array([text_of(s) for s in new]),
                pa.array([likeness(a, b, kept) for a, b in zip(own, new, strict=False)], pa.float64()),
                pa.array([likeness(a, b, kept) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        ended = False
        for batch in batches:
            for p, ahead, one, packed in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if p != part:
                    if len(block) > 1:
                        yield done()
                    part, block, chars, ended = p, [], 0, False
                if ended:
                    continue  # of several rows ahead only the first is next
                text = unpack(packed).decode("utf-8", "surrogatepass")
                block.append((one, text))
                chars += len(text)
                ended = bool(ahead)
                if ended or chars >= piece:
                    if len(block) > 1:
                        yield done()
                        block = block[-1:]
                        chars = len(text)
        if len(block) > 1:
            yield done()

    return run


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", quarter: int = 4, levels: int = LEVELS, kept: int = KEPT, piece: int = 1 << 19, range_bytes: int = 1 << 24
) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that to the next document.

    Columns: ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.  The edited text
    has its last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next document by ascending id; after the last comes the
    first, so a lone document is its own next.  Null texts are empty.  Null
    ids come before all others; rows of one id are ordered by a hash of their
    texts, and rows that repeat both are neighbours.  Very long texts are read
    whole.  Other columns are not read; no rows give no rows.

    Texts cross the network once, compressed, to ranges of (id, hash) of about
    ``range_bytes`` of text, at least as many as the session has shuffle
    partitions; a range is a partition, so no two share a task.  The driver
    sees the first row of each range, two numbers.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"))
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    bounds = sorted((r.id, r.tie) for r in keys.repartitionByRange(ranges, F.asc_nulls_first("id"), "tie").mapInArrow(released(_first), "id long, tie long").collect())
    out = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not bounds:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    return (
        docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
        .mapInArrow(released(_dealt(bounds)), "part int, ahead int, id long, tie long, packed binary")
        .repartitionById(len(bounds), "part")
        .sortWithinPartitions("part", "ahead", "id", "tie")
        .mapInArrow(released(_fingerprinted(quarter, levels, kept, piece)), out)
        .withColumnRenamed("id", id_col)
    )
