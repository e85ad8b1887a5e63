"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds one frame a document: its ids as little-endian unsigned 32-bit integers, with the
frame's own content checksum. Then follows a skippable frame with the documents' keys, and at
the end the seek table of the zstd seekable format: compressed size, decompressed size and low
32 bits of XXH64 of each frame, the number of frames, and a magic number. A reader takes the
end of the file, finds a document's frame, and decompresses nothing else.

Files follow one another in ascending doc_id; documents lie in ascending doc_id within a file.

Defined results: a null or empty text has the end id alone; null doc_ids come first; equal
doc_ids stand side by side, in one file unless they are more than a file holds; a text of any
length is one frame; an empty table makes no files and reads back as an empty table. Strings of
special tokens are those tokens if ``special`` is set, as the query does, else ordinary text.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import map_columns, new_folder, open_input, open_output, prepared, staged

SEEK_FRAME, KEYS_FRAME, SEEK_END = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Documents of a file on average, compression level, words and parts of words that a worker remembers.
FILE_DOCS, LEVEL, KNOWN, KNOWN_PARTS = 16_384, 1, 250_000, 400_000
#: Rows or bytes of ids that a batch of the reader holds, but for one document.
READ_ROWS, READ_BYTES = 512, 8 << 20
#: Key of a null doc_id; nulls come first, and how many there are stands after a file's keys.
_NULL = -(2**63)
#: Files whose tokens are summed in one window.
SUM_FILES = 4_096

_loaded: dict = {}


def tokenizer(path: str, special: bool):
    """The tokenizer of a file, the same without normalizing and splitting (None if the file's steps are others than
    those that ``encoder`` knows), what words and matches it has encoded, and the strings of special tokens; one a process.

    With ``special``, the strings of special tokens in a text are those tokens, as in the library's plain call; else they are text.
    """
    if (path, special) not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        t, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        t.encode_special_tokens = not special
        bare.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            has = json.load(f)
        names = tuple(x["content"] for x in has["added_tokens"])
        known = [has.get(k) for k in ("normalizer", "pre_tokenizer", "truncation", "padding")] == [_NORMALIZER, _SPLITTER, None, None]
        known &= all(x["special"] and not x["normalized"] and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in has["added_tokens"])
        if known:
            bare.normalizer = normalizers.Sequence([])
            bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        _loaded[path, special] = t, bare if known else None, {}, {}, names if special else ()
    return _loaded[path, special]


# The steps before merging that the fast path below repeats.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# The pre-tokenizer's pattern and a line end, in terms of characters below, for which case and
# categories are the same in all Unicode versions and no digit is other than decimal.
_MATCH = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_PLAIN = re.compile("[\n!-~\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u0148\u014a-\u017f]*+")
#: Stands between words; no id.
_GAP = b"\xff\xff\xff\xff"


def encoder(path: str, end_id: int | None, special: bool = False) -> Callable[[list], list[bytes]]:
    """A function from texts to packed ids.

    The tokenizer drops white space and encodes each match of its pattern by itself, so texts
    are cut at blanks and line ends, words of plain characters into lower-case matches, and
    each distinct match goes through the library once. Words with any other character go
    through it whole, and so do texts with a special token's string, if that is a token, and
    all texts if the file's normalizer or pre-tokenizer are not those this rests on.
    """
    t, bare, words, pieces, names = tokenizer(path, special)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def whole(text: str) -> bytes:
        return np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learned(by, new: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            got = by.encode(part, is_pretokenized=True, add_special_tokens=False)
            own = np.array(got.word_ids, dtype=np.int64)
            raw, cut = np.array(got.ids, dtype="<u4").tobytes(), (np.searchsorted(own, np.arange(len(part) + 1)) * 4).tolist()
            out.update(zip(part, [raw[x:y] for x, y in zip(cut, cut[1:])]))  # noqa: B905
        return out

    def keep(known: dict[str, bytes], new: dict[str, bytes], most: int) -> None:
        """The first to come stay: frequent ones are among them, and most of the others never come again."""
        if len(known) < most:
            known.update(new)

    def learned_plain(new: list[str]) -> dict[str, bytes]:
        flat = _MATCH.findall(unicodedata.normalize("NFC", "\n".join(new)).lower())
        ids = list(map(pieces.get, flat))
        unseen = [k for k, x in enumerate(ids) if x is None]
        if unseen:
            own = learned(bare, list({flat[k] for k in unseen}))
            for k in unseen:
                ids[k] = own[flat[k]]
            keep(pieces, own, KNOWN_PARTS)
        raw = b"".join(ids)
        gaps = np.flatnonzero(np.frombuffer(raw, dtype="<u4") == 0xFFFFFFFF) * 4
        first, last = [0, *(gaps + 4).tolist()], [*gaps.tolist(), len(raw)]
        return dict(zip(new, [raw[x:y] for x, y in zip(first, last, strict=True)], strict=True))

    def work(texts: list) -> list[bytes]:
        if bare is None:
            return [whole(x or "") + end for x in texts]
        pieces["\n"] = _GAP
        rows, new = [], set()
        for x in texts:
            if names and x and any(n in x for n in names):
                rows.append(([whole(x)], [], []))
                continue
            ws = (x or "").replace("\n", " ").split(" ")
            ids = list(map(words.get, ws))
            unseen = [k for k, i in enumerate(ids) if i is None]
            missed = [ws[k] for k in unseen]
            new.update(missed)
            rows.append((ids, unseen, missed))
        own: dict[str, bytes] = {}
        if new:
            plain = list(new)
            if not _PLAIN.fullmatch("\n".join(plain)):
                own = learned(t, [w for w in plain if not _PLAIN.fullmatch(w)])
                plain = [w for w in plain if w not in own]
            if plain:
                own.update(learned_plain(plain))
            keep(words, own, KNOWN)
        out = []
        for ids, unseen, missed in rows:
            for k, w in zip(unseen, missed, strict=True):
                ids[k] = own[w]
            out.append(b"".join(ids) + end)
        return out

    return work


def with_frames(docs: DataFrame, path: str, end_id: int | None, special: bool = False) -> DataFrame:
    """Append n_tokens, raw_size, sum32 and frame (the compressed ids) to each row."""

    def make() -> Callable:
        encode, packer = encoder(path, end_id, special), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

        def work(texts: list) -> list:
            packed = encode(texts)
            return [
                [len(p) // 4 for p in packed],
                [xxhash.xxh64_intdigest(p) & 0xFFFFFFFF for p in packed],
                [packer.compress(p) for p in packed],
            ]

        return work

    return map_columns(docs, ["text"], [("n_tokens", T.LongType()), ("sum32", T.LongType()), ("frame", T.BinaryType())], make)


class Writer:
    """One file of frames."""

    def __init__(self, uri: str):
        self.out, self.keys, self.table, self.nulls = open_output(uri), [], [], 0

    def add(self, key: int | None, raw_size: int, sum32: int, frame: bytes) -> None:
        self.out.write(frame)
        if key is None and self.nulls < len(self.keys):
            raise ValueError("null keys come first")
        self.nulls += key is None
        self.keys.append(_NULL if key is None else key)
        self.table.append(struct.pack("<III", len(frame), raw_size, sum32))

    def close(self) -> None:
        keys = zstandard.ZstdCompressor(level=LEVEL).compress(np.array([*self.keys, self.nulls], dtype="<i8").tobytes())
        self.out.write(struct.pack("<II", KEYS_FRAME, len(keys)) + keys)
        self.table.append(struct.pack("<III", 8 + len(keys), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(body)) + body)
        self.out.close()


class Reader:
    """Random access to the documents of a file."""

    def __init__(self, uri: str):
        self.f = open_input(uri)
        size = self.f.size()
        self.f.seek(max(0, size - 9))
        tail = self.f.read(9)
        if len(tail) < 9 or struct.unpack("<I", tail[5:])[0] != SEEK_END:
            raise ValueError(f"{uri}: no seek table")
        n = struct.unpack("<I", tail[:4])[0]
        if not tail[4] & 0x80:
            raise ValueError(f"{uri}: the seek table has no checksums")
        start = size - 9 - 12 * n - 8
        self.f.seek(start)
        magic, length = struct.unpack("<II", self.f.read(8))
        if magic != SEEK_FRAME or length != 12 * n + 9:
            raise ValueError(f"{uri}: the seek table is broken")
        table = np.frombuffer(self.f.read(12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        place = np.concatenate([[0], np.cumsum(table[:, 0])])
        if place[-1] != start:
            raise ValueError(f"{uri}: frames and seek table differ in length")
        self.f.seek(int(place[-2]))
        raw = self.f.read(int(table[-1, 0]))
        keys = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8:], max_output_size=8 * n + 64), dtype="<i8")
        if len(keys) != n:
            raise ValueError(f"{uri}: keys and frames differ in number")
        self.keys, self.nulls = keys[:-1], int(keys[-1])
        self.place, self.table, self.uri = place[:-2], table[:-1], uri
        self.unpack = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def document(self, i: int) -> bytes:
        """The packed ids of the i-th document, checked."""
        packed, raw, sum32 = (int(x) for x in self.table[i])
        self.f.seek(int(self.place[i]))
        ids = self.unpack.decompress(self.f.read(packed), max_output_size=raw)
        if len(ids) != raw or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != sum32:
            raise ValueError(f"{self.uri}: document {i} is damaged")
        return ids

    def key(self, i: int) -> int | None:
        """The doc_id of the i-th document."""
        return None if i < self.nulls else int(self.keys[i])

    def find(self, key: int | None) -> list[int]:
        """Places of the documents with a doc_id."""
        if key is None:
            return list(range(self.nulls))
        own = self.keys[self.nulls :]
        lo, hi = np.searchsorted(own, key, "left"), np.searchsorted(own, key, "right")
        return list(range(self.nulls + int(lo), self.nulls + int(hi)))

    def close(self) -> None:
        self.f.close()


def placed(cuts: list[int], nulls: int) -> tuple[list[int], list[int], list[int]]:
    """(edges, first, many): rows between two edges, those without a doc_id before all, have ``many`` files from ``first`` on."""
    own = {c: n for c, n in Counter(cuts).items() if n > 1}
    edges = sorted({*cuts, *(c + 1 for c in own if c + 1 < 2**63)})
    many = [max(1, nulls), 1, *(own.get(e, 0) + 1 if e in own else 1 for e in edges)]
    return edges, [0, *accumulate(many)][:-1], many


def write(docs: DataFrame, folder: str, path: str, end_id: int | None, file_docs: int = FILE_DOCS, special: bool = False) -> DataFrame:
    """Files of ``docs`` (doc_id, text); returns a staged table (part, path, documents, tokens), parts in doc_id order.

    ``special``: strings of special tokens in a text are those tokens, as in the library's plain call.

    Files are cut at quantiles of doc_id, found from that column alone; compressed frames, not
    texts, are what the one shuffle moves. A doc_id that several quantiles fall on has files of
    its own, over which its rows are dealt, and so have rows without a doc_id.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    count = own.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    n, nulls = max(1, -(-count["known"] // file_docs)), -(-(count["n"] - count["known"]) // file_docs)
    cuts = own.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    edges, first, many = placed([int(c) for c in cuts], nulls)
    framed = with_frames(own, path, end_id, special).select("doc_id", "n_tokens", "sum32", "frame", "salt")

    def dealt() -> Callable:
        at = np.array(edges, np.int64)

        def part(i: int | None, salt: int) -> int:
            k = 0 if i is None else 1 + int(np.searchsorted(at, i, "right"))
            return first[k] + salt % many[k]

        return lambda ids, salts: [[part(*x) for x in zip(ids, salts, strict=True)]]

    framed = map_columns(framed, ["doc_id", "salt"], [("part", T.IntegerType())], dealt).drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, uri, out, tokens = None, "", None, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "path": [uri], "documents": [len(out.keys)], "tokens": [tokens]})

        for batch in batches:
            for doc_id, n_tokens, sum32, frame, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != now:
                    if out is not None:
                        yield done()
                    now, uri, tokens = p, f"{folder}/{p:08d}-{uuid.uuid4().hex}.tok.zst", 0
                    out = Writer(uri)
                out.add(doc_id, 4 * n_tokens, sum32, frame)
                tokens += n_tokens
        if out is not None:
            yield done()

    rows = framed.repartitionById(first[-1] + many[-1], F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "sum32")
    return staged(rows.mapInArrow(run, "part int, path string, documents long, tokens long"), "token-files")


def read(files: DataFrame, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, token_ids of every document of the files."""
    upto = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("run", F.floor(F.col("part") / SUM_FILES))
    runs = files.groupBy("run").agg(F.sum("tokens").alias("tokens")).select("run", upto(Window.orderBy("run")).alias("run base"))
    placed = files.withColumn("base", upto(Window.partitionBy("run").orderBy("part"))).join(runs, "run").withColumn("base", F.col("base") + F.col("run base"))
    n = max(1, min(files.count(), 100_000))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("token_ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(uri)
                for i in range(len(file)):
                    packed = file.document(i)
                    rows.append({"doc_id": file.key(i), "start": base, "n_tokens": len(packed) // 4, "ids_crc32": zlib.crc32(packed), "token_ids": packed if ids else None})
                    base += len(packed) // 4
                    size += len(packed) if ids else 64
                    if len(rows) >= READ_ROWS or size >= READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                file.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return placed.repartition(n).select("path", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, token_ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write(docs, new_folder(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, special=True)
    return read(files, ids=False).drop("token_ids")
