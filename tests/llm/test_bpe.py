"""Round trips, and that pieces of long texts encode as the whole does."""

import hashlib
import random
import struct

import public_tokenizers

from quillspark.llm import bpe
from quillspark.llm.common import prepared

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_pieces_encode_as_the_whole():
    enc, r = bpe.encoding(RANKS, PATTERN), random.Random(3)
    for _ in range(300):
        text = "".join(r.choices([" ", "  ", "\n", "a", "Be", "é", "9", "'s", "!", " ", "漢", "\t"], k=r.randint(0, 200)))
        parts = bpe.pieces(text, 7)
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_round_trip(spark):
    texts = [None, "", "Some words.", "naïve 漢字 ‍👩‍🚀", "word " * 60_000, "x" * 5_000, "Some words."]
    df = prepared(spark).createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")
    enc = bpe.encoding(RANKS, PATTERN)
    got = {r.doc_id: r for r in bpe.round_trip(df, RANKS, PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(df, RANKS, PATTERN, check=True).columns == ["doc_id", "text", "decoded", "n_tokens", "token_ids"]
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN).count() == 0


def test_pieces_end_where_matches_end():
    enc, r = bpe.encoding(RANKS, PATTERN), random.Random(5)
    signs = ["'", "''", "'s", "'re", "a", "bc", "1", "23", ".", "!?", " ", "  ", "\n", "\t ", "　", "漢字", "かな", "。", "\x1c", "é", "Я", "½", "́", "\U000105c0"]
    for _ in range(2_000):
        text = "".join(r.choices(signs, k=r.randint(0, 40)))
        parts = bpe.pieces(text, r.choice((1, 3)))
        assert "".join(parts) == text
        assert [i for p in parts for i in bpe.ids_of(enc, p)] == enc.encode_ordinary(text)


def test_long_runs_of_white_space_are_single_matches(monkeypatch):
    enc, r = bpe.encoding(RANKS, PATTERN), random.Random(6)
    for _ in range(100):
        runs = ["".join(r.choices(" \n\t　", k=r.randint(bpe.LONG_RUN - 3, bpe.LONG_RUN + 3))) for _ in range(3)]
        text = r.choice(["", "a", "!"]) + runs[0] + r.choice(["b c", "'s", "1"]) + runs[1] + "x" + r.choice(["", runs[2]])
        parts = bpe.pieces(text)
        assert "".join(parts) == text
        assert [i for p in parts for i in bpe.ids_of(enc, p)] == enc.encode_ordinary(text)


def test_five_million_of_each(spark):
    n = 5_000_000
    texts = [" " * n, "\n" * n, "a" + " " * n + "b", " \n" * (n // 2) + "x", "漢字仮名" * (n // 4), "x1" * (n // 2), "?" * n, "word " * (n // 5)]
    enc = bpe.encoding(RANKS, PATTERN)
    df = prepared(spark).createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in bpe.round_trip(df, RANKS, PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    for i in (4, 5, 6):  # the library does these by itself
        assert got[i].n_tokens == len(enc.encode_ordinary(texts[i]))
    assert got[2].n_tokens == len(enc._encode_single_piece("a")) + len(enc._encode_single_piece(" " * (n - 1))) + len(enc._encode_single_piece(" b"))
