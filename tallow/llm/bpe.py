"""Byte-level BPE encoding and decoding with the tokenizers library.

A text is cut by the tokenizer's pattern; every piece is encoded on its own by
a tokenizers BPE model over the printable alphabet in which each of the 256
bytes has one character.  Pieces repeat a lot, so a worker remembers a bounded
number of them.  Ids decode to bytes through the reversed table; as bytes
concatenate, a text decodes piece by piece, and characters that are split
between tokens come out whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import released

#: Unicode's White_Space, which the pattern's \s means.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_characters() -> list[str]:
    """The character of each byte: itself if it is printable Latin-1, else the next free one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(free)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 of a token's bytes, a space and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def model_json(ranks: dict[bytes, int]) -> str:
    """The tokenizers model: all splits of a token into two tokens are merges, of the token's rank.

    Leftmost pairs of one rank go first, as long as splits with a short left part precede.
    """
    show = byte_characters()
    text = {t: "".join(show[b] for b in t) for t in ranks}
    merges = [
        [text[t[:k]], text[t[k:]]]
        for t in sorted(ranks, key=ranks.__getitem__)
        for k in range(1, len(t))
        if t[:k] in ranks and t[k:] in ranks
    ]
    model = {"type": "BPE", "vocab": {text[t]: r for t, r in ranks.items()}, "merges": merges, "ignore_merges": True}
    return json.dumps({"version": "1.0", "added_tokens": [], "model": model})


class Memo(dict):
    """Remembers a function's results; of two generations of ``size`` the older one goes."""

    def __init__(self, function, size: int) -> None:
        self.function, self.size, self.old = function, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key) or self.function(key)
        if len(key) <= 64:
            self[key] = value
        return value


class Codec:
    """Encodes and decodes texts in one Python worker."""

    def __init__(self, model: str, pattern: str, remembered: int = 100_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        # in [^\s...] the class stands for itself, elsewhere it needs brackets
        pattern = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
        self.split = regex.compile(pattern).findall
        show = byte_characters()
        self.show = {b: c for b, c in enumerate(show)}
        byte = {c: b for b, c in enumerate(show)}
        self.tokens = {i: bytes(byte[c] for c in t) for t, i in self.tokenizer.get_vocab().items()}
        self.known = Memo(self.piece, remembered)

    def encode_piece(self, piece: str) -> list[int]:
        shown = piece.encode("utf-8").decode("latin-1").translate(self.show)
        return [t.id for t in self.tokenizer.model.tokenize(shown)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def piece(self, piece: str) -> tuple[str, bytes]:
        ids = self.encode_piece(piece)
        return "".join([f" {i}" for i in ids]), self.decode(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded bytes."""
        ids, raw, n = hashlib.sha256(), hashlib.sha256(), 0
        pieces = self.split(text)
        for k in range(0, len(pieces), 1 << 16):
            got = list(map(self.known.__getitem__, pieces[k : k + (1 << 16)]))
            shown = "".join([g[0] for g in got])
            n += shown.count(" ")
            ids.update((shown if k else shown[1:]).encode())
            raw.update(b"".join([g[1] for g in got]))
        return n, ids.hexdigest(), raw.hexdigest()

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids with the first and one past the last character of each; tokens within a character share it."""
        ids, starts, ends, at = [], [], [], 0
        pieces = self.split(text)
        for piece in pieces:
            got = self.encode_piece(piece)
            inside = [k for k, c in enumerate(piece) for _ in range(len(c.encode("utf-8")))]
            low = 0
            for i in got:
                high = low + len(self.tokens[i])
                ids.append(i)
                starts.append(at + inside[low])
                ends.append(at + inside[high - 1] + 1)
                low = high
            at += len(piece)
        return ids, starts, ends


def _payload(docs: DataFrame, path: str, pattern: str):
    """The model goes out once to each executor; its size is that of the vocabulary file, whatever the input."""
    return docs.sparkSession.sparkContext.broadcast((model_json(load_ranks(path)), pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids``, ``starts``, ``ends`` (arrays of int) of every whole text.

    Null and empty texts have no ids.  A row in gives a row out, repeated and
    null ids included; other columns are not read.
    """
    sent = _payload(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*sent.value)
        for batch in batches:
            got = [codec.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in range(3))],
                ["id", "ids", "starts", "ends"],
            )

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(released(run), "id long, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of id arrays; null arrays are empty.

    Ids that end or begin inside a character leave U+FFFD in its place, as the
    bytes alone are no text.
    """
    sent = _payload(encoded, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*sent.value)
        for batch in batches:
            texts = [codec.decode(i.as_py() or []).decode("utf-8", "replace") for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    out = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return out.mapInArrow(released(run), "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every whole text, encoded and decoded again.

    Null texts count as empty; very long ones are encoded whole, in stretches
    of pieces.  A row in gives a row out, repeated and null ids included;
    pairs of one rank merge from the left.  Other columns are not read, so
    none can clash.  No rows give no rows.
    """
    sent = _payload(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*sent.value)
        for batch in batches:
            got = [codec.digest(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[k] for g in got], pa.string()) for k in (1, 2))],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(released(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
