"""Undirected weighted graphs stored once per edge: degrees, edges of nodes, bounded expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.small import settled, small

HEAVIEST = 50_000


def adjacency(edges: DataFrame) -> DataFrame:
    """node, other, weight: both directions, self-loops once."""
    keep = [c for c in edges.columns if c not in ("src", "dst")]
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *keep)
    back = edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), *keep)
    return there.unionByName(back)


def neighbours(edges: DataFrame, node: str, limit: int) -> DataFrame:
    return adjacency(edges).where(F.col("node") == node).orderBy(F.desc("weight"), "other").limit(limit)


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges, as stored, with an end in ``ids`` (entity_id); each once."""
    want = small(ids.select("entity_id").distinct())
    at_src = edges.join(want.withColumnRenamed("entity_id", "src"), "src", "left_semi").select(*edges.columns)
    at_dst = edges.join(want.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").select(*edges.columns)
    rest = at_dst.join(want.withColumnRenamed("entity_id", "src"), "src", "left_anti").select(*edges.columns)
    return at_src.unionByName(rest)


def degrees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """entity_id, degree of all ``ids``; 0 for nodes without edges."""
    want = ids.select("entity_id").distinct()
    ends = touching(edges, want).select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("entity_id"))
    count = ends.groupBy("entity_id").agg(F.count("*").alias("degree"))
    return want.join(count, "entity_id", "left").select("entity_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def edge_degrees(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, degree of each pair: the sum of its ends' degrees."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    deg = small(degrees(edges, ends))
    out = pairs.select("src", "dst").distinct()
    for side in ("src", "dst"):
        out = out.join(deg.select(F.col("entity_id").alias(side), F.col("degree").alias(f"d_{side}")), side, "left")
    total = F.coalesce("d_src", F.lit(0)) + F.coalesce("d_dst", F.lit(0))
    return out.select("src", "dst", total.alias("degree"))


def edges_of(edges: DataFrame, ids: DataFrame, top: int | None = None) -> DataFrame:
    """Distinct edges of ``ids`` by degree, best first, with their weights."""
    own = touching(edges, ids)
    out = edge_degrees(edges, own).join(own, ["src", "dst"]).orderBy(F.desc("degree"), F.desc("weight"), "src", "dst")
    return out.limit(top) if top else out


def edge_data(edges: DataFrame, pairs: DataFrame, top: int | None = None) -> DataFrame:
    """Properties of pairs in either direction, missing edges dropped, by degree."""
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    have = edges.withColumn("lo", lo).withColumn("hi", hi).drop("src", "dst")
    want = pairs.select("src", "dst").distinct().withColumn("lo", lo).withColumn("hi", hi)
    out = have.join(small(want), ["lo", "hi"]).drop("lo", "hi").join(edge_degrees(edges, pairs), ["src", "dst"])
    out = out.orderBy(F.desc("degree"), F.desc("weight"), "src", "dst")
    return out.limit(top) if top else out


def entities_of(pairs: DataFrame, top: int) -> DataFrame:
    """Distinct ends of pairs, the first ``top`` by id."""
    return pairs.select(F.col("src").alias("entity_id")).union(pairs.select("dst")).distinct().orderBy("entity_id").limit(top)


def node_data(ids: DataFrame, edges: DataFrame, preferred: DataFrame, fallback: DataFrame, top: int) -> DataFrame:
    """entity_id, entity_type, description, degree of the ``top`` ids by degree; metadata row by row from the preferred table, else the other."""
    found = ids.select("entity_id").distinct()
    for i, table in enumerate((preferred, fallback)):
        found = found.join(table.select("entity_id", F.col("entity_type").alias(f"t{i}"), F.col("description").alias(f"d{i}")), "entity_id", "left")
    known = found.select("entity_id", F.coalesce("t0", "t1").alias("entity_type"), F.coalesce("d0", "d1").alias("description")).where("entity_type is not null")
    return known.join(small(degrees(edges, ids)), "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "entity_id").limit(top)


def least_weight(support: float) -> int:
    """A share below 1 counts in ten-thousandths."""
    return max(1, int(support * 10_000)) if support < 1 else int(support)


def in_band(weight: Column, support: float, heaviest: int = HEAVIEST) -> Column:
    return weight.between(least_weight(support), heaviest)


def expand(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 1, support: float = 1000, per_hop: int = 20) -> DataFrame:
    """entity_id, entity_type, description, seeds, weight, hop: new neighbours hop by hop, those of most seeds first.

    A hop joins the frontier, which has at most ``per_hop`` nodes after the first, so each hop reads the edges once.
    """
    adj = adjacency(edges).where(in_band(F.col("weight"), support)).select("node", "other", "weight")
    frontier = known = seeds.select("entity_id").distinct()
    out = None
    for hop in range(1, hops + 1):
        step = adj.join(small(frontier).withColumnRenamed("entity_id", "node"), "node")
        new = step.join(small(known).withColumnRenamed("entity_id", "other"), "other", "left_anti")
        sums = new.groupBy("other").agg(F.countDistinct("node").alias("seeds"), F.max("weight").alias("weight"))
        found = sums.join(nodes.withColumnRenamed("entity_id", "other"), "other").orderBy(F.desc("seeds"), F.desc("weight"), "other").limit(per_hop)
        found = found.select(F.col("other").alias("entity_id"), "entity_type", "description", "seeds", "weight", F.lit(f"neo4j_hop_{hop}").alias("hop"))
        found = settled(found) if hop < hops else found
        out = found if out is None else out.unionByName(found)
        frontier = found.select("entity_id")
        known = known.union(frontier)
    return out
