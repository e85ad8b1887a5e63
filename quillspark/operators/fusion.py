"""Merging ranked lists: reciprocal ranks, first wins, source sets, balanced cuts, round robin."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank(lists: DataFrame, k: int = 60) -> DataFrame:
    """chunk_id, rrf, sources, tag from (list_idx, rank, chunk_id, source); the first list's other columns are kept."""
    rest = [c for c in lists.columns if c not in ("list_idx", "rank", "chunk_id", "source")]
    first = [F.min_by(c, F.struct("list_idx", "rank")).alias(c) for c in rest]
    out = lists.groupBy("chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("source")).alias("sources"), *first)
    return out.withColumn("tag", F.when(F.size("sources") > 1, "hybrid_overlap").when(F.array_contains("sources", "elasticsearch"), "es_only").otherwise("milvus_only"))


def hybrid(keyword: DataFrame, vector: DataFrame, k: int, top: int) -> DataFrame:
    """Both lists (chunk_id, rank, score) by reciprocal rank; if one is empty, the other by its own score."""
    one = keyword.select(F.lit(0).alias("list_idx"), "rank", "chunk_id", F.lit("elasticsearch").alias("source"), "score")
    two = vector.select(F.lit(1).alias("list_idx"), "rank", "chunk_id", F.lit("milvus").alias("source"), "score")
    both = reciprocal_rank(one.unionByName(two), k)
    lists = one.unionByName(two).agg(F.countDistinct("list_idx").alias("lists"))
    out = both.crossJoin(F.broadcast(lists)).withColumn("merged", F.when(F.col("lists") > 1, F.col("rrf")).otherwise(F.col("score")))
    return out.orderBy(F.desc("merged"), "chunk_id").limit(top).select("chunk_id", "merged", "tag")


def first_wins(lists: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row a key from (list_no, pos, ...): that of the earliest list and place."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("list_no", "pos"))
    return lists.withColumn("n", n).where("n = 1").drop("n")


def source_sets(rows: DataFrame) -> DataFrame:
    """chunk_id and the sorted set of its sources."""
    return rows.groupBy("chunk_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def overlap_cube(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Chunks by every combination of source flags, and by every coarser one (null = any)."""
    flags = rows.groupBy("chunk_id").agg(*[F.max(F.when(F.col("source") == n, 1).otherwise(0)).alias(f"in_{n}") for n in names])
    return flags.cube(*[f"in_{n}" for n in names]).agg(F.count("*").alias("n"))


def relabelled(sources: Column) -> Column:
    """Entity and relation passages are one source, kg."""
    own = F.array_except(sources, F.array(F.lit("entity"), F.lit("relation")))
    return F.array_sort(F.when(F.size(own) < F.size(sources), F.array_union(own, F.array(F.lit("kg")))).otherwise(sources))


def source_ranks(rows: DataFrame) -> DataFrame:
    """rows (chunk_id, source, score) with rank in their source by its own score."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "chunk_id")))


ORDER = ("kg", "elasticsearch", "milvus")


def balanced_cut(rows: DataFrame, total: int) -> DataFrame:
    """At most ``total`` chunks of (chunk_id, source, score), those of more sources first.

    Buckets of equally many sources stay whole while they fit, the first one always. The first
    that does not fit is shared: a third of what is left to each source in the order of
    ``ORDER``, each taking its best not yet taken, then the remainder to sources that have
    more. That bucket alone is gathered, cut to ``total`` rows a source, which is all that can matter.
    """
    ranks = source_ranks(rows)
    per = ranks.groupBy("chunk_id").agg(F.avg("rank").alias("avg_rank"), F.array_sort(F.collect_set("source")).alias("sources"), F.map_from_entries(F.collect_list(F.struct("source", "rank"))).alias("ranks"))
    per = per.withColumn("n_sources", F.size("sources"))
    sizes = {r["n_sources"]: r["n"] for r in per.groupBy("n_sources").agg(F.count("*").alias("n")).collect()}
    whole, left, cut = [], total, None
    for n in sorted(sizes, reverse=True):
        if not whole and cut is None or sizes[n] <= left:
            whole.append(n)
            left = max(0, left - sizes[n])
        else:
            cut = n
            break
    out = per.where(F.col("n_sources").isin(*whole) if whole else F.lit(False))
    if cut is not None and left > 0:
        long = per.where(F.col("n_sources") == cut).select("chunk_id", "avg_rank", F.explode("ranks").alias("source", "rank"))
        near = long.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("rank", "chunk_id"))).where(F.col("place") <= total)
        out = out.select("chunk_id", "n_sources", "avg_rank").unionByName(_shared(near, left, cut))
    else:
        out = out.select("chunk_id", "n_sources", "avg_rank")
    pos = F.row_number().over(Window.orderBy(F.desc("n_sources"), "avg_rank", "chunk_id"))
    return out.orderBy(F.desc("n_sources"), "avg_rank", "chunk_id").limit(total).withColumn("pos", pos)


def shared_out(rows: list[tuple[str, str, int, float]], budget: int) -> list[tuple[str, float]]:
    """(chunk_id, avg_rank) taken from (chunk_id, source, rank, avg_rank)."""
    queues = {s: sorted((r[2], r[0], r[3]) for r in rows if r[1] == s) for s in ORDER}
    taken: dict[str, float] = {}

    def take(source: str, n: int) -> int:
        got = 0
        for _, c, avg in queues[source]:
            if got == n:
                break
            if c not in taken:
                taken[c] = avg
                got += 1
        return got

    for s in ORDER:
        take(s, budget // len(ORDER))
    for s in ORDER:
        take(s, budget - len(taken))
    return list(taken.items())


def _shared(near: DataFrame, budget: int, n_sources: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if parts:
            df = pd.concat(parts)
            got = shared_out(list(df[["chunk_id", "source", "rank", "avg_rank"]].itertuples(index=False, name=None)), budget)
            yield pd.DataFrame({"chunk_id": [g[0] for g in got], "n_sources": n_sources, "avg_rank": [g[1] for g in got]})

    return near.select("chunk_id", "source", "rank", "avg_rank").coalesce(1).mapInPandas(run, "chunk_id string, n_sources int, avg_rank double")


def round_robin(lists: DataFrame, key: str = "id") -> DataFrame:
    """Rows of (list_no, pos, id) in turn, each id once, with their place."""
    once = F.row_number().over(Window.partitionBy(key).orderBy("pos", "list_no"))
    rows = lists.withColumn("n", once).where("n = 1").drop("n")
    return rows.withColumn("place", F.row_number().over(Window.orderBy("pos", "list_no")))


def with_content(ids: DataFrame, chunks: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Contents joined last; missing ones are empty, or their rows go."""
    out = ids.join(chunks.select("chunk_id", "content"), "chunk_id", "left" if keep_missing else "inner")
    return out.withColumn("content", F.coalesce("content", F.lit("")))
