"""The law, slots, and how few links are cut."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillspark.llm import shards as S
from quillspark.llm.common import prepared


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def holds(rows: list[dict], n: int, shards: int) -> None:
    assert len(rows) == n
    count = Counter(r["shard"] for r in rows)
    assert set(count) <= set(range(shards))
    assert max(count.values()) - min(count.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_groups_stay_together_and_a_hot_one_takes_few_shards(spark):
    docs = [(i, f"single {i}") for i in range(900)] + [(1000 + i, f"group {i % 60}") for i in range(300)] + [(2000 + i, "hot é") for i in range(600)]
    df = prepared(spark).createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = rows_of(S.sharded(df))
    holds(rows, len(docs), 16)
    text = dict(docs)
    where = defaultdict(set)
    for r in rows:
        t = text[r["doc_id"]]
        where[t].add(r["shard"])
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert sum(len(v) > 1 for k, v in where.items() if k.startswith("group")) <= 3
    assert len(where["hot é"]) <= 9  # 600 rows, quotas of 112 or 113


def test_odd_tables(spark):
    odd = [(None, None), (1, None), (1, ""), (1, "a"), (1, "a")]
    df = prepared(spark).createDataFrame([(*r, 5) for r in odd], "doc_id long, text string, slot int")
    rows = rows_of(S.sharded(df))
    holds(rows, 5, 16)
    assert sorted(r["size"] for r in rows) == [1, 1, 1, 2, 2]
    assert S.sharded(df.limit(0)).count() == 0


def test_nodes_of_several_groups(spark):
    links = prepared(spark).range(200).select(F.col("id").alias("node"), F.explode(F.array(F.concat(F.lit("x"), F.col("id") % 10), F.concat(F.lit("y"), F.col("id") % 5))).alias("group"))
    got = {r.node: r.shard for r in S.propagated(links, [120, 120]).collect()}
    assert len(got) == 200 and max(Counter(got.values()).values()) <= 120
    assert sum(len({got[i] for i in range(g, 200, 10)}) > 1 for g in range(10)) <= 4


def test_cut_groups_against_hashing_and_even_slots(spark):
    """Brute force over the links: how many pairs of equal neighbours (in doc_id order) of a group part, by label propagation and by hash."""
    docs = [(i, f"text {i}") for i in range(2_000)] + [(10_000 + i, f"group {i % 400}") for i in range(2_400)]
    df = prepared(spark).createDataFrame(docs, "doc_id long, text string").repartition(6)
    rows = rows_of(S.sharded(df))
    holds(rows, len(docs), 16)
    text, groups = dict(docs), defaultdict(list)
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        groups[text[r["doc_id"]]].append(r)
    pairs = [(a, b) for g in groups.values() for a, b in zip(g, g[1:])]  # noqa: B905
    cut = sum(a["shard"] != b["shard"] for a, b in pairs)
    by_hash = sum(zlib.crc32(str(a["doc_id"]).encode()) % 16 != zlib.crc32(str(b["doc_id"]).encode()) % 16 for a, b in pairs)
    assert cut <= 0.1 * by_hash


def test_ranks_are_dealt_evenly_within_shards(spark):
    df = prepared(spark).range(40_000).withColumnRenamed("id", "node")
    ranks = S.ranked(df, 40_000, "node", "rank").withColumn("shard", (F.col("rank") / 2_500).cast("int"))
    part = F.pmod(F.xxhash64(F.lit("slot"), "node"), F.lit(16))
    sizes = [r["count"] for r in ranks.groupBy("shard", part.alias("p")).count().collect()]
    assert len(sizes) == 256 and max(sizes) < 260
    slots = S.ranked(ranks, 40_000, "node", "slot", "shard").groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert {(r.n, r.d, r.m) for r in slots} == {(2_500, 2_500, 2_499)}
