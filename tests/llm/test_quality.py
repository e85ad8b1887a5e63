"""Held-out accuracy of the network on texts of two kinds, coverage of whole texts, and odd rows."""

import random

import numpy as np

from quillspark.llm import quality as Q
from quillspark.llm.common import prepared

WORDS = "the and of to in river stone window letter morning carry small yellow under because walked along road bread water".split()


def good(r):
    return ". ".join(" ".join(r.choices(WORDS, k=r.randint(5, 12))).capitalize() for _ in range(r.randint(2, 30))) + "."


def bad(r):
    k = r.randrange(3)
    if k == 0:
        return " ".join(w + r.choice(["$$$", "###", "%%%"]) for w in r.choices(WORDS, k=r.randint(20, 200)))
    if k == 1:
        return "!! ".join(w.upper() for w in r.choices(WORDS, k=r.randint(20, 200)))
    return " ".join(w for w in r.choices(WORDS, k=4) for _ in range(r.randint(30, 60)))


def test_chunks_cover_every_byte():
    for n in (0, 1, Q.STEP, Q.CHUNK - 1, Q.CHUNK, Q.CHUNK + 1, 5_000):
        data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        c = Q.chunks(data)
        back = np.concatenate([c[0], *[x[Q.CHUNK - Q.STEP :] for x in c[1:]]])
        assert back[:n].astype(np.uint8).tobytes() == data and (back[n:] == Q.PAD).all()


def test_held_out_accuracy_and_long_texts(spark, monkeypatch):
    r = random.Random(2)
    docs = [(i, good(r) if i % 3 else bad(r)) for i in range(900)]
    df = prepared(spark).createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(601, None), (None, 1), (5, 1)], "doc_id long, quality int")
    model = Q.taught(df, labels)
    got = {row.doc_id: row.score for row in Q.score(df, model).collect()}
    right = [(got[i] >= Q.THRESHOLD) == bool(i % 3) for i in range(600, 900)]
    assert np.mean(right) >= 0.97
    assert all(0 <= s <= 1 for s in got.values())
    a = good(random.Random(3))
    both = model.scores([a, a + " " + bad(random.Random(4)) * 30, a])  # what is bad stands at the end
    assert both[0] == both[2] and both[1] < both[0]
    kept = Q.kept(df.selectExpr("*", "'x' as score"), model)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {row.doc_id for row in kept.collect()} == {i for i, s in got.items() if s >= Q.THRESHOLD}


def test_odd_tables(spark):
    rows = [(1, None), (None, ""), (2, "x" * 300_000), (2, "x" * 300_000)]
    df = prepared(spark).createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.taught(df, none) == 1.0
    assert [r.score for r in Q.score(df, 1.0).collect()] == [1.0] * 4
    net = Q.Network.fresh()
    s = [r.score for r in Q.score(df, net).collect()]
    assert s[0] == s[1] and s[2] == s[3]
    assert Q.score(df.limit(0), net).count() == 0


def test_a_score_does_not_depend_on_the_batch():
    r = random.Random(9)
    net = Q.Network.fresh().rounded()
    texts = [good(r) * r.choice([1, 1, 20]) if i % 2 else bad(r) for i in range(300)]
    whole = net.scores(texts)
    assert whole == [net.scores([t])[0] for t in texts] and whole == net.scores(texts[::-1])[::-1]
    assert len(set(whole)) > 250


def test_whole_texts_teach_and_repeated_doc_ids_count_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "fitted", lambda samples, share: seen.append(samples) or share)
    docs = [(i, "x" * 20_000 + str(i)) for i in range(40)] + [(1, "again")] * 500
    df = prepared(spark).createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    Q.taught(df, labels)
    taught = sum(__import__("zlib").crc32(str(i).encode()) % 5 != 0 for i in range(40))
    assert len(seen[0]) == taught and sorted({len(c) for c, _ in seen[0]})[-1] == len(Q.chunks(b"x" * 20_002))
    monkeypatch.setattr(Q, "FIT_BYTES", 100_000)
    Q.taught(df, labels)
    assert 4 <= len(seen[1]) <= 6 and {y for _, y in seen[1]} == {0, 1}
