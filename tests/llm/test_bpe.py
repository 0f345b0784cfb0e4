import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tallow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def texts():
    rnd = random.Random(1)
    out = ["", None, "<|endoftext|> don't", "a  b\n\n c\t\u3000\x85x", "𝄞é漢字" * 50, "=" * 5000, " " * 3000, "word " * 50_000]
    for _ in range(300):
        alphabet = rnd.choice(["a", "ab", " a", "aA-=", "\n \t", "é漢a ", "0123 ", "their'sll've ", "\x00\x1c\u200b\u0301x"])
        out.append("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))))
    return out


def test_round_trip_matches_the_library(spark, table, reference):
    given = texts()
    got = {r.doc_id: r for r in bpe.round_trip(table(list(enumerate(given))), PATH, public_tokenizers.PATTERN).collect()}
    for k, t in enumerate(given):
        ids = reference.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids), repr(t)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_offsets_cover_the_text_and_ids_decode(spark, table, reference):
    given = ["𝄞é漢字 don't", "plain words here", None, ""]
    encoded = bpe.encode(table(list(enumerate(given))), PATH, public_tokenizers.PATTERN)
    for r in encoded.collect():
        t = given[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(t)
        at = 0
        for a, b in zip(r.starts, r.ends, strict=True):
            assert at - 1 <= a <= at and a < b <= len(t)
            at = b
        assert at == len(t)
    back = {r.doc_id: r.text for r in bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()}
    assert back == {k: t or "" for k, t in enumerate(given)}


def test_split_characters_and_odd_rows(spark, table, reference):
    half = reference.encode_ordinary("𝄞")[:1]
    df = spark.createDataFrame([(1, half, "x"), (None, None, "y"), (1, [], "z")], "doc_id long, ids array<int>, text string")
    assert sorted(r.text for r in bpe.decode(df, PATH, public_tokenizers.PATTERN).collect()) == ["", "", "\ufffd"]
    clash = spark.createDataFrame([(None, "a", 1), (2, "a", 1), (2, "a", 1)], "doc_id long, text string, n_tokens long")
    assert [r.n_tokens for r in bpe.round_trip(clash, PATH, public_tokenizers.PATTERN).collect()] == [1, 1, 1]
    assert bpe.round_trip(table([]), PATH, public_tokenizers.PATTERN).collect() == []


def test_bounded_memory_of_pieces():
    memo = bpe.Memo(len, 10)
    assert [memo[str(k)] for k in range(100)] == [len(str(k)) for k in range(100)] and len(memo) <= 10 and len(memo.old) <= 10
    assert memo["x" * 100] == 100 and "x" * 100 not in memo
