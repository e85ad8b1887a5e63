"""Recall against brute force, exactness of the probing, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann as A
from quillspark.llm.common import prepared


def brute(rows: dict[int, np.ndarray], k: int) -> dict[int, list]:
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    out = {}
    for q in (i for i in ids if i % 50 == 0):
        s = A.cosines(x, rows[q])
        out[q] = [(ids[j], s[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != q][:k]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(A, "SPLIT", 5)
    r = np.random.default_rng(1)
    x = r.standard_normal((3000, 64))
    x[1000:1400] = x[999]  # one very common vector
    rows = {i: v.astype(np.float32).astype(np.float64) for i, v in enumerate(x)}
    df = prepared(spark).createDataFrame([(i, v.tolist(), i) for i, v in rows.items()], "vec_id long, embedding array<float>, score int")
    want, got = brute(rows, 5), {}
    for row in A.nearest(df, F.col("id") % 50 == 0).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    hits = total = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - A.cosines(rows[v][None], rows[q])[0]) < 1e-12 for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        hits += len({v for v, _ in best} & {m[1] for m in mine})
        total += 5
    assert hits >= 0.97 * total


@pytest.mark.parametrize("block", [16_384, 100, 7])
def test_probing_retrieves_every_code_within_the_radius(spark, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK_ROWS", block)
    r = np.random.default_rng(2)
    bits = r.integers(0, 2, (800, A.BITS)).astype(bool)
    bits[400:] = bits[:400] ^ (r.random((400, A.BITS)) < r.random((400, 1)) * 0.3)
    for plan in (A.Plan(16, 4, 0, A.BITS), A.Plan(16, 4, 1, A.BITS), A.Plan(10, 6, 2, A.BITS)):
        rows = [(i, np.packbits(b).tobytes(), v.tolist()) for i, (b, v) in enumerate(zip(bits, A.values(bits, plan.width, plan.count), strict=True))]
        coded = prepared(spark).createDataFrame(rows, "cid long, code binary, subs array<long>")
        got = {(x.query, x.cid) for x in A.retrieved(coded, coded.where("cid < 40"), plan).collect()}
        whole = bits[:, : plan.width * plan.count]
        want = {(i, int(j)) for i in range(40) for j in np.flatnonzero((whole != whole[i]).sum(1) <= plan.radius)}
        assert want <= got and len(got) < 40 * 800 and plan.visited() < 0.7


def test_queries_that_find_too_few_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(A, "planned", lambda classes, queries, k: (np.eye(64).repeat(8, 1), A.Plan(20, 1, 0, 0)))
    monkeypatch.setattr(A, "BLOCK_QUERIES", 3)
    x = np.random.default_rng(3).standard_normal((400, 64))
    df = prepared(spark).createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(dict(enumerate(x)), 5)
    got = {}
    for row in A.nearest(df, F.col("id") % 50 == 0).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    assert {q: [(v, s) for _, v, s in sorted(rows)] for q, rows in got.items()} == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0, 1.0]), (7, [1.0, 1.0]), (0, [1.0, 0.0]), (50, [2.0, 2.0])]
    df = prepared(spark).createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in A.nearest(df, F.col("id") % 50 == 0).collect())
    h = round(0.5**0.5, 6)
    one = [(0, 1, 0, 1.0), (0, 2, 7, h), (0, 3, 50, h)]
    assert got == sorted(one * 2 + [(50, 1, 7, 1.0), (50, 2, 0, h), (50, 3, 0, h)])
    assert A.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0
