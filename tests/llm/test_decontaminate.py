"""Decontamination against brute force over all stretches, and the recall of its LSH."""

import random

import numpy as np

from quillspark.llm import decontaminate as D
from quillspark.llm.common import prepared


def distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def holds(item: list, doc: list) -> bool:
    k = len(item) * D.PERCENT // 100
    return any(
        distance(item, doc[s : s + n]) <= k for n in range(max(1, len(item) - k), len(item) + k + 1) for s in range(len(doc) - n + 1)
    )


def edited(r: random.Random, words: list, k: int) -> list:
    w = list(words)
    for _ in range(k):
        p = r.randrange(len(w))
        match r.randrange(3):
            case 0:
                w[p] = f"z{r.randrange(10**6)}"
            case 1:
                del w[p]
            case _:
                w.insert(p, f"z{r.randrange(10**6)}")
    return w


def test_like_brute_force(spark):
    r = random.Random(2)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, [r.choice(vocab) for _ in range(r.randint(4, 24))]) for i in range(10)]
    docs = []
    for d in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 40))]
        if d % 2:
            i, it = r.choice(items)
            w[len(w) // 2 : len(w) // 2] = edited(r, it, r.randint(0, len(it) * 30 // 100))
        docs.append((d, " ".join(w).title().replace(" ", r.choice([" ", ", ", "!! "]))))
    want = {(d, i) for d, t in docs for i, it in items if holds(it, [w.lower() for w in D.words(t)])}
    df = prepared(spark).createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = D.matched(df, bench).collect()
    pairs = {(row.doc_id, h.item_id) for row in got for h in row.held}
    assert pairs <= want
    assert len(pairs) >= 0.98 * len(want) > 20
    kept = {row.doc_id for row in D.clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in pairs}


def test_recall_at_the_edge():
    r = random.Random(9)
    hit = total = 0
    for _ in range(150):
        item = [f"w{r.randrange(3000)}" for _ in range(r.randint(10, 60))]
        found = D.Items([(5, " ".join(item))])
        text = " ".join([f"w{r.randrange(3000)}" for _ in range(30)] + edited(r, item, len(item) * D.PERCENT // 100) + ["w1"] * 5)
        hit += bool(found.found(text))
        total += 1
    assert hit >= 0.97 * total


def test_nearest_is_exact():
    r = random.Random(4)
    for _ in range(100):
        item, doc = ([r.randrange(5) for _ in range(r.randint(1, n))] for n in (8, 14))
        d, b, e = D.nearest(np.array(item), np.array(doc))
        assert d == distance(item, doc[b:e]) == min(distance(item, doc[s:t]) for s in range(len(doc) + 1) for t in range(s, len(doc) + 1))


def test_short_items_and_scripts_without_blanks(spark):
    r = random.Random(6)
    han = [chr(0x4E00 + i) for i in range(400)]
    item = "".join(r.choices(han, k=20))
    near = item[:5] + "龥" + item[6:12] + item[13:]
    thai = "ประเทศไทยมีสามฤดู"
    items = [(1, item), (2, thai), (3, "Fermat"), (4, "prime number"), (5, "the prime number"), (6, "東京"), (7, "...")]
    docs = [
        (1, "".join(r.choices(han, k=30)) + "。" + near + "".join(r.choices(han, k=30)), [1]), (2, "x" + thai + "y", [2]), (3, "What did FERMAT prove? Fermat?", [3]),
        (4, "Is a prime, number 5", [4]), (5, "It is the prime number.", [4, 5]), (6, "彼は東京に住む", [6]), (7, "Fermats primes number the 京東 ...", []), (8, "".join(r.choices(han, k=300)), []),
    ]
    df = prepared(spark).createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    got = {row.doc_id: row.held for row in D.matched(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {d: [h.item_id for h in held] for d, held in got.items()} == {d: want for d, _, want in docs}
    assert [docs[2][1][h.begin : h.end] for h in got[3]] == ["FERMAT"]
    assert got[1][0].distance == 2 and got[1][0].words == 20


def test_odd_rows(spark):
    rows = [(1, None, "a"), (None, "", "b"), (3, "one two three four five " * 30_000, "c"), (3, "one two three four five", "c")]
    df = prepared(spark).createDataFrame(rows, "doc_id long, text string, held string")
    bench = spark.createDataFrame([(1, None), (None, "x y z w v"), (2, "the"), (4, "one two three four five"), (5, "one two three four five")], "item_id long, text string")
    got = sorted((str(r.doc_id), [h.item_id for h in r.held]) for r in D.matched(df, bench).collect())
    assert got == [("1", []), ("3", [4, 5]), ("3", [4, 5]), ("None", [])]
    assert D.clean(df, bench).columns == df.columns
    assert D.matched(df.limit(0), bench).count() == 0
    assert D.clean(df, bench.limit(0)).count() == 4


def test_windows_meet_items_by_band_keys():
    r = random.Random(12)
    items = [[f"w{r.randrange(500)}" for _ in range(20)] for _ in range(40)]
    found = D.Items([(i, " ".join(w)) for i, w in enumerate(items)])
    near = [edited(r, w, 2) for w in items]
    near = [(w + ["zz"] * 20)[:20] for w in near]
    rows = np.array([[found.code.get(x, 0) for x in w] for w in near], np.int64)
    met = {p for walk in range(D.WALKS) for p in found.met(rows, walk)}
    assert sum((i, i) in met for i in range(40)) >= 38 and len(met) < 40 * 40 / 4


def test_items_in_several_blocks(spark, monkeypatch):
    r = random.Random(14)
    items = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(12))) for i in range(30)]
    docs = [(d, f"before {items[d % 30][1]} between {items[(d * 7) % 30][1]} after", "x") for d in range(60)] + [(60, None, "x"), (61, "nothing", "x"), (61, "nothing", "x")]
    df = prepared(spark).createDataFrame(docs, "doc_id long, text string, held string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted((r.doc_id, str(r.held)) for r in D.matched(df, bench).collect())
    monkeypatch.setattr(D, "WORDS_AT_ONCE", 100)
    assert len(D.blocks(bench)) > 3
    several = D.matched(df, bench)
    assert several.columns == ["doc_id", "text", "held"] and sorted((r.doc_id, str(r.held)) for r in several.collect()) == one
    assert {r.doc_id for r in D.clean(df, bench).collect()} == {60, 61} and D.clean(df, bench).count() == 3


def test_the_nearest_match_of_a_stretch_is_given():
    r = random.Random(15)
    for _ in range(40):
        item = [f"w{r.randrange(3000)}" for _ in range(20)]
        text = [*edited(r, item, 3), *edited(r, item, 1), *edited(r, item, 4)]
        (one,) = D.Items([(1, " ".join(item))]).found(" ".join(text))
        assert one["distance"] == D.nearest(np.array([hash(w) for w in item]), np.array([hash(w) for w in text]))[0]
