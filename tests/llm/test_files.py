"""Round trips of archives and token files."""

import hashlib
import io
import struct
import zlib
from base64 import b32encode

import pytest
import zstandard

from quillspark.llm import token_files as K
from quillspark.llm import warc as W
from quillspark.llm.common import new_folder, open_input, open_output, prepared

PAGES = [(5, "http://a.example/ü?x=1\r\ny", "<p>one</p>"), (3, "http://b.example/", "<p>one</p>"), (9, None, "<p>one</p>"), (1, "http://c.example/", None), (2, "http://d.example/", ""), (4, "http://e.example/", "long \r\n\r\n" * 50_000), (None, "http://f.example/", "<p>one</p>"), (3, "http://b.example/", "<p>one</p>")]


def test_archives_round_trip(spark):
    df = prepared(spark).createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    folder = new_folder(spark, "warc")
    files = W.write(df, folder)
    rows = W.read(files).collect()
    assert len(rows) == len(PAGES) and not [r.error for r in rows if r.error]
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = min((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        to = None if first == i else first
        want.append((i, "response" if to is None else "revisit", to, len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), raw if to is None else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload) if r.payload is not None else None)) for r in rows)
    assert {r.url for r in rows if r.page_id == 9} == {None}
    assert not any(c in r.url for r in rows if r.page_id == 5 for c in "\r\n")
    assert all(r.record_type == "response" for r in W.read(W.write(df, folder, min_bytes=11)).collect() if r.payload_bytes == 10)
    assert W.read(W.write(df.limit(0), folder)).count() == 0


@pytest.mark.parametrize(
    ("old", "new", "why"),
    [
        (b"WARC/1.1", b"HTTP/1.1", "version"), (b"WARC-Date: ", b"WARC-Time: ", "missing warc-date"), (b"Content-Length: 7", b"Content-Length: 8", "payload is not"),
        (b"WARC-Type: response", b"WARC-Type response", "bad header"), (b"payload", b"Payload", "digest"),
    ],
)
def test_records_are_validated(old, new, why):
    good = W.record(7, "http://a.example/", b"payload", None)
    assert W.parsed(good)["error"] is None and W.parsed(good)["payload"] == b"payload"
    bad = good.replace(old, new)
    if why == "payload is not":
        block = bad.partition(b"\r\n\r\n")[2][:-4]
        bad = bad.replace(W.digest(good.partition(b"\r\n\r\n")[2][:-4]).encode(), W.digest(block).encode())
    assert why in W.parsed(bad)["error"]
    assert "bytes" in W.parsed(good[:-9])["error"]
    assert "followed" in W.parsed(good + b"x")["error"]


def test_reader_takes_compressed_dictionaries_and_other_skippable_frames():
    words = b"some words that recur in all of the records of this archive " * 4
    raw = zstandard.ZstdCompressor().compress(words)
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    body = struct.pack("<II", W.DICTIONARY_FRAME, len(raw)) + raw + packer.compress(words[:60]) + struct.pack("<II", 0x184D2A51, 3) + b"abc" + packer.compress(b"")
    assert [d for _, d in W.frames(io.BytesIO(body))] == [words[:60], b""]
    with pytest.raises(ValueError, match="cut short"):
        list(W.frames(io.BytesIO(body[:-2])))
    assert list(W.frames(io.BytesIO(b""))) == []


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some words, here.", None, "", "été\n\nİstanbul 12 <|endoftext|> x", "word " * 70_000, "a b\tc", "Some words, here."]
    docs = [((i * 7) % 11 if i != 5 else None, t) for i, t in enumerate(texts)] + [(100 + i, f"row {i}") for i in range(200)]
    df = prepared(spark).createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, part int").repartition(4)
    files = K.write(df, new_folder(spark, "tok"), path, 2, file_docs=40)
    assert files.count() > 2
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    at, want = 0, []
    for i, x in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want.append((i, at, len(ids), zlib.crc32(raw), raw))
        at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.token_ids)) for r in K.read(files).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    file = K.Reader(files.where("part = 1").first().path)
    key = int(file.keys[3])
    assert [file.document(i) for i in file.find(key)] == [w[4] for w in want if w[0] == key]
    file.close()
    assert K.read(K.write(df.limit(0), new_folder(spark, "tok"), path, 2)).count() == 0


def test_damage_is_seen(spark):
    uri = new_folder(spark, "tok") + "/one.tok.zst"
    out = K.Writer(uri)
    ids = struct.pack("<3I", 1, 2, 3)
    out.add(4, len(ids), 1, zstandard.ZstdCompressor().compress(ids))
    out.close()
    with pytest.raises(ValueError, match="damaged"):
        K.Reader(uri).document(0)
    with open_input(uri) as f:
        data = f.read()
    with open_output(uri + "x") as f:
        f.write(data[:-3])
    with pytest.raises(ValueError, match="seek table"):
        K.Reader(uri + "x")


def test_tokens_are_those_of_the_plain_call(spark):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    t = Tokenizer.from_file(path)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endofText|>", " ", "\n", "a", "Bé", "é", "12", "'s", "!", "<|", "|>", "İ", "x</w>", "ﬁ", "Å"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(5_000)]
    got = K.encoder(path, None, special=True)(texts)
    assert [struct.unpack(f"<{len(g) // 4}I", g) for g in got] == [tuple(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_other_tokenizer_files_go_through_the_library_whole(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        own = json.load(f)
    own["normalizer"] = {"type": "NFC"}  # keeps case
    path = str(tmp_path / "own.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(own, f)
    texts = ["Some Words, here", "É 12", ""]
    got = K.encoder(path, 7)(texts)
    assert [struct.unpack(f"<{len(g) // 4}I", g) for g in got] == [(*Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids, 7) for x in texts]


def test_a_doc_id_of_many_rows_has_files_of_its_own(spark):
    import public_tokenizers

    path, least = public_tokenizers.path("word_bpe_49k.json"), -(2**63)
    docs = [(5, f"same {i % 3}") for i in range(300)] + [(None, "none") for _ in range(100)] + [(i, f"row {i}") for i in range(100)] + [(least, "least"), (2**63 - 1, "most")]
    df = prepared(spark).createDataFrame(docs, "doc_id long, text string").repartition(5)
    files = K.write(df, new_folder(spark, "tok"), path, 2, file_docs=40)
    assert max(f.documents for f in files.collect()) <= 120 and sum(f.documents for f in files.collect()) == len(docs)
    rows = sorted(K.read(files).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]


def test_null_and_least_doc_id_differ(spark):
    uri = new_folder(spark, "tok") + "/two.tok.zst"
    out = K.Writer(uri)
    packed = zstandard.ZstdCompressor().compress(b"")
    for key in (None, -(2**63), 3):
        out.add(key, 0, 0, packed)
    out.close()
    file = K.Reader(uri)
    assert [file.key(i) for i in range(3)] == [None, -(2**63), 3] and [file.find(k) for k in (None, -(2**63), 3, 4)] == [[0], [1], [2], []]
    file.close()
