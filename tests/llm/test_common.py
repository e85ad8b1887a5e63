"""The staging area, joins that split frequent keys, components."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import common as C
from quillspark.llm.common import prepared


def test_folders_name_their_filesystem(spark):
    a, b = C.new_folder(spark, "x"), C.new_folder(spark, "x")
    assert a != b and a.startswith("file:/") and spark.sparkContext.applicationId in a


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from quillspark import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(Session)


def test_split_join_is_a_join(spark):
    r = random.Random(1)
    rows = prepared(spark).createDataFrame([(r.choice([1, 1, 1, 2, 3, None]), i) for i in range(500)], "k long, v long")
    own = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d"), (None, "n")], "k long, w string")
    want = sorted(map(tuple, rows.join(own, "k").collect()))
    for split in (1_000, 50, 1):
        assert sorted((x.k, x.v, x.w) for x in C.joined_split(rows, own, "k", split).collect()) == want
    assert C.joined_split(rows.limit(0), own, "k", 1).count() == 0


def test_components_like_union_find(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1_000 + i, 1_001 + i) for i in range(60)] + [(5, 5), (None, 3)] + [(2_000, 2_001 + i) for i in range(100)]
    up = {n: n for x in links if None not in x for n in x}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    linked = {n for a, b in links if a is not None and b is not None and a != b for n in (a, b)}
    got = {x.node: x.root for x in C.components(prepared(spark).createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: top(n) for n in linked}
    assert C.components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0
