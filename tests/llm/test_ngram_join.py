"""The join against all pairs, with bundles small enough to take every path."""

import random

import pytest

from quillspark.llm import ngram_join as J
from quillspark.llm.common import prepared

WORDS = [f"w{i}" for i in range(4000)]


def corpus(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    docs, n = [], 0

    def add(words: list[str]) -> None:
        nonlocal n
        docs.append((n, " ".join(words)))
        n += 1

    for _ in range(60):
        add(r.choices(WORDS, k=r.randint(1, 80)))
    base = r.choices(WORDS, k=120)
    for _ in range(60):  # a bundle: copies with few or many changes
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        add(w)
    chain = r.choices(WORDS, k=100)
    for i in range(12):  # neighbours link, ends do not
        add(chain)
        chain = list(chain)
        chain[i * 8] = r.choice(WORDS)
    for i in range(30):  # a shared passage that does not suffice
        add(base[:60] + r.choices(WORDS, k=60))
    return docs + [(n, ""), (n + 1, None), (n + 2, "a b"), (n + 3, "A  B\t"), (n + 4, "a b c"), (n + 5, docs[0][1])]


def brute(docs: list[tuple], width: int, percent: int) -> dict:
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent", "few", "block"), [(3, 90, 64, 512), (3, 90, 4, 8), (5, 80, 4, 8)])
def test_like_all_pairs(spark, monkeypatch, width, percent, few, block):
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "BLOCK", block)
    docs = corpus()
    df = prepared(spark).createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_classes(df, width, percent).collect()}
    assert got == brute(docs, width, percent)


def test_one_of_each_keeps_columns_and_the_smallest(spark):
    rows = [(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (7, None, "n"), (7, None, "n"), (8, "other words are here", "o")]
    df = prepared(spark).createDataFrame(rows, "doc_id long, text string, sig string")
    got = J.one_of_each(df)
    assert got.columns == ["doc_id", "text", "sig"]
    assert sorted((r.doc_id, r.sig) for r in got.collect()) == [(1, "y"), (7, "n"), (8, "o")]


def test_empty_table(spark):
    df = prepared(spark).createDataFrame([], "doc_id long, text string")
    assert J.near_classes(df, 3, 90).count() == 0
    assert J.one_of_each(df).count() == 0


def test_bitmap_never_drops_a_link():
    r = random.Random(3)
    import numpy as np

    for _ in range(200):
        n = r.randint(2, 300)
        x = {r.getrandbits(64) for _ in range(n)}
        y = set(r.sample(sorted(x), n - r.randint(0, n // 8))) | {r.getrandbits(64) for _ in range(r.randint(0, n // 10))}
        a, b = (np.array(sorted(v), dtype=np.uint64) for v in (x, y))
        if J.link(a, b, 80):
            assert J.may_link(J.parity(a), J.parity(b), len(a), len(b), 80)


@pytest.mark.parametrize(("width", "percent", "few", "wide"), [(3, 90, 4, 6), (5, 80, 4, 6), (3, 90, 64, 3)])
def test_sets_of_long_prefixes_are_joined_by_parts(spark, monkeypatch, width, percent, few, wide):
    for name, value in (("FEW", few), ("BLOCK", 8), ("WIDE", wide), ("SPLIT", 20), ("FEW_PARTS", 3), ("BLOCKS", 1), ("COUNT_AT_ONCE", 100), ("COUNTS_KEPT", 200), ("FREQUENT", 3)):
        monkeypatch.setattr(J, name, value)
    docs = corpus(2)
    df = prepared(spark).createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_classes(df, width, percent).collect()}
    assert got == brute(docs, width, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_have_a_part_in_common(percent):
    import numpy as np

    r = random.Random(percent)
    of, start = J.size_classes(percent)
    linked = 0
    for _ in range(600):
        n = r.randint(2, 400)
        x = {r.getrandbits(64) for _ in range(n)}
        edits = r.randint(0, max(1, n * (100 - percent) // 100))
        y = set(r.sample(sorted(x), n - r.randint(0, min(edits, n - 1)))) | {r.getrandbits(64) for _ in range(r.randint(0, edits))}
        a, b = (np.array(sorted(v), dtype=np.uint64) for v in (x, y))
        if len(b) < 2 or not J.link(a, b, percent):
            continue
        linked += 1
        common = sorted(x | y)[: r.choice([0, len(x) // 2, len(x) + len(y)])]  # as if these were frequent
        keys = []
        for v in (a, b):
            rare = v[~np.isin(v, np.array(common, dtype=np.uint64))]
            c = of(len(v))
            assert start(c) <= len(v) < start(c + 1)
            keys.append({int(k) for f in (c - 1, c) if f >= 0 for part in J.part_keys(v, rare, f, start(f + 2) - 1, percent) for k in part})
        assert keys[0] & keys[1]
    assert linked > 200


def test_a_very_long_text_and_a_large_bundle(spark):
    r = random.Random(4)
    common = [f"c{i}" for i in range(300)]
    long = r.choices(common, k=200_000)  # all of its shingles are frequent: copies hold them
    near = list(long)
    for i in range(0, len(near), 200):
        near[i] = "x"
    base = r.choices(WORDS, k=150)
    docs = [(i, " ".join(long[:100_000] + [f"q{i}"] + long[100_000:])) for i in range(30)] + [(30, " ".join(near))]
    for i in range(20_000):  # each differs from the base in up to two words, and so in six shingles: all link with it
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        docs.append((100 + i, " ".join(w)))
    docs += [(50_000 + i, " ".join(base[:75] + r.choices(WORDS, k=75))) for i in range(2_000)]  # half of it
    df = prepared(spark).createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = {x.doc_id: x.component_id for x in J.near_classes(df, 3, 90).collect()}
    assert {got[i] for i in range(31)} == {0}
    assert {got[100 + i] for i in range(20_000)} == {100}
    assert all(got[50_000 + i] == 50_000 + i for i in range(2_000))


def test_rows_that_repeat_a_key_become_the_least_of_them(spark):
    rows = [(1, "a b c d e f", "y", {"k": 2}), (1, "a b c d e f", "x", {"k": 1}), (2, None, "n", None), (2, None, "m", None), (3, "", None, None), (3, "", "z", None)]
    df = prepared(spark).createDataFrame(rows, "doc_id long, text string, source string, more map<string,int>")
    for part in (df, df.union(spark.createDataFrame([(9, "one row of its own", "o", None)], df.schema))):
        got = sorted(str((r.doc_id, r.source)) for r in J.one_of_each(part).collect())
        assert got[:3] == ["(1, 'x')", "(2, 'm')", "(3, None)"]


def test_no_table_holds_the_shingles_of_all_sets(spark, monkeypatch):
    import os
    from urllib.parse import urlparse

    size, plain = [], J.staged

    def counted(df, name):
        out = plain(df, name)
        size.append(sum(os.path.getsize(urlparse(f).path) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(J, "staged", counted)
    r = random.Random(6)
    docs = [(i, " ".join(r.choices(WORDS, k=1000))) for i in range(300)]
    docs += [(1000 + i, docs[i][1] + " more") for i in range(5)]  # the only sets that are compared
    df = prepared(spark).createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {x.doc_id: x.component_id for x in J.near_classes(df, 3, 90).collect()}
    assert got == {i: i % 1000 for i, _ in docs}
    assert size and sum(size) < 8 * 998 * 300 / 4  # a shingle takes 8 bytes, and there are 998 a text
