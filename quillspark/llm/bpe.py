"""Byte-level BPE encoding and decoding with a local rank file.

``encode`` appends the ids of each whole text, ``decode`` the raw bytes that ids stand for.
Ids travel as binary: little-endian unsigned 32-bit integers, four bytes a token.

Defined results: a null text counts as empty and has no ids; null ids decode to no bytes;
a text of any length is encoded whole; repeated rows each get their own result; an empty
table gives an empty table; an input column with the name of an output is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import map_columns, prepared

#: Characters of a piece of a long text. A cut falls only where no match of the pattern can span.
PIECE_CHARS = 1 << 16
#: White space that is matched here and not by the library, whose stack a million characters of it overflow.
LONG_RUN = 10_000
# White space, and letters, digits and other signs whose categories no version of Unicode has changed.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_SIGN = r"!-&(-/:-@\[-`{-~\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20"
_BOUNDARY = re.compile(
    rf"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=[{_LETTER}])(?=[0-9{_SIGN}])|(?<=[0-9])(?=[{_LETTER}{_SIGN}])|(?<=[{_SIGN}])(?=[0-9{_LETTER}])"
)
_RUN, _RUN_ONLY = re.compile(rf"[{_WHITE}]{{{LONG_RUN},}}"), re.compile(rf"[{_WHITE}]+")

_loaded: dict = {}


def encoding(rank_path: str, pattern: str):
    """The tiktoken encoding of a rank file; one a process."""
    if (rank_path, pattern) not in _loaded:
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[rank_path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[rank_path, pattern]


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` cut where no match of the pattern can span, into pieces of little more than ``size`` characters if it has such places.

    A match is a run of letters, of numbers or of other visible characters with a blank before it
    at most, an apostrophe with letters, or white space. So one always ends before white space
    behind a visible character, and between runs of two kinds, unless an apostrophe stands there.
    White space is a match up to its last character, or up to the end of the text: of a run of
    LONG_RUN or more, that match is a piece (``is_run``), which the pattern need not be tried on.
    """
    out, at = [], 0
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += _cut(text, at, m.start(), size)
        out.append(text[m.start() : end])
        at = end
    out += _cut(text, at, len(text), size)
    return out or [""]


def _cut(text: str, at: int, end: int, size: int) -> Iterator[str]:
    while end - at > size:
        m = _BOUNDARY.search(text, at + size, end)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    if at < end:
        yield text[at:end]


def is_run(piece: str) -> bool:
    """Whether a piece is a long run of white space: one match."""
    return len(piece) >= LONG_RUN - 1 and _RUN_ONLY.fullmatch(piece) is not None


def ids_of(enc, piece: str) -> list[int]:
    return enc._encode_single_piece(piece) if is_run(piece) else enc.encode_ordinary(piece)


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", size: int = PIECE_CHARS, check: bool = False) -> DataFrame:
    """Append ``n_tokens`` (long) and ``token_ids`` (binary, see above) to each row.

    With ``check``, ids are decoded as well, and a text that does not come back fails the job.
    """

    def make() -> Callable:
        enc = encoding(rank_path, pattern)

        def work(texts: list) -> list:
            counts, packed = [], []
            for t in texts:
                n, parts = 0, []
                for p in pieces(t or "", size):
                    ids = ids_of(enc, p)
                    if check and enc.decode_bytes(ids) != p.encode():
                        raise ValueError("token ids do not decode to the text they come from")
                    n += len(ids)
                    parts.append(np.asarray(ids, dtype="<u4").tobytes())
                counts.append(n)
                packed.append(b"".join(parts))
            return [counts, packed]

        return work

    return map_columns(df, [text], [("n_tokens", T.LongType()), ("token_ids", T.BinaryType())], make)


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """Append ``decoded`` (binary): the bytes of the tokens, joined; they need not be valid text."""

    def make() -> Callable:
        enc = encoding(rank_path, pattern)

        def work(packed: list) -> list:
            return [[enc.decode_bytes(np.frombuffer(b or b"", dtype="<u4").tolist()) for b in packed]]

        return work

    return map_columns(df, [ids], [("decoded", T.BinaryType())], make)


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, per document."""
    own = docs.select("doc_id", "text")
    both = decode(encode(own, rank_path, pattern), rank_path, pattern)
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

