"""Which passages of entities to take: by weighted quota, by overlap, by vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.vector import cosine
from quillspark.operators.small import small


def weighted_pick(lists: DataFrame, most: int, least: int) -> DataFrame:
    """(entity_pos, chunk_pos, chunk_id) rows taken: a quota that falls linearly from ``most`` to ``least`` by entity.

    What entities fall short of their quota goes to unused passages of the first entities that have any. A single entity takes ``most``.
    """
    per = Window.partitionBy("entity_pos")
    sizes = lists.groupBy("entity_pos").agg(F.count("*").alias("have"))
    n = F.count("*").over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy("entity_pos")) - 1
    line = F.lit(float(most)) - i / F.greatest(n - 1, F.lit(1)) * (most - least)
    quotas = sizes.withColumn("quota", F.when(n == 1, F.lit(most)).otherwise(F.bround(line, 0).cast("int"))).withColumn("short", F.greatest(F.lit(0), F.col("quota") - F.col("have")))
    spare = quotas.agg(F.sum("short").alias("spare"))
    rows = lists.join(small(quotas), "entity_pos").withColumn("place", F.row_number().over(per.orderBy("chunk_pos")))
    first = rows.where(F.col("place") <= F.col("quota")).withColumn("round", F.lit(1))
    rest = rows.where(F.col("place") > F.col("quota")).withColumn("turn", F.row_number().over(Window.orderBy("entity_pos", "chunk_pos")))
    rest = rest.crossJoin(F.broadcast(spare)).where(F.col("turn") <= F.col("spare")).withColumn("round", F.lit(2))
    cols = ["entity_pos", "chunk_pos", "chunk_id", "round"]
    return first.select(*cols).unionByName(rest.select(*cols))


def overlap_pick(sources: DataFrame, entities: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """chunk_id, overlap, length: passages that most entities share, then the longest."""
    hits = sources.join(small(entities.select("entity_id").distinct()), "entity_id", "left_semi")
    counts = hits.groupBy("chunk_id").agg(F.countDistinct("entity_id").alias("overlap"))
    sized = counts.join(chunks.select("chunk_id", F.length("content").alias("length")), "chunk_id", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    return sized.orderBy(F.desc("overlap"), F.desc("length"), "chunk_id").limit(k)


def vector_pick(
    own: DataFrame, vectors: DataFrame, query: DataFrame, candidates: DataFrame | None, k: int, high: float = 0.7, min_intersection: int = 100
) -> DataFrame:
    """id, score: the best k of the entities' passages ``own`` (id) by exact cosine.

    With candidates (id, score), only those both have are compared, plus candidates of at least
    ``high``; if that leaves fewer than ``min_intersection``, all of the entities' passages are.
    """
    ids = own.select("id").distinct()
    if candidates is not None:
        sure = candidates.where(F.col("score") >= high).select("id")
        both = candidates.where(F.col("score") < high).select("id").join(ids, "id", "left_semi")
        if both.limit(min_intersection).count() >= min_intersection:
            ids = both.union(sure).distinct()
        else:
            ids = ids.union(sure).distinct()
    few = vectors.join(small(ids), "id", "left_semi")
    scored = few.crossJoin(F.broadcast(query.limit(1))).select("id", cosine(F.col("vector"), F.col("query_vector")).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def relation_sources(pairs: DataFrame | None, sources: DataFrame) -> DataFrame:
    """Passages of a relation: those both of its ends have.

    Without ``pairs``, of every two entities that share a passage (src < dst). Sources are then dealt by
    passage once, and rows meet there: nothing larger than ``sources`` is shuffled. Repeated sources count once.
    """
    if pairs is None:
        own = sources.select("chunk_id", "entity_id").where("chunk_id is not null and entity_id is not null").repartition("chunk_id").distinct()
        a, b = own.withColumnRenamed("entity_id", "src"), own.withColumnRenamed("entity_id", "dst")
        return a.join(b, "chunk_id").where("src < dst").select("src", "dst", "chunk_id")
    a = sources.select(F.col("entity_id").alias("src"), "chunk_id")
    b = sources.select(F.col("entity_id").alias("dst"), "chunk_id")
    return pairs.select("src", "dst").distinct().join(a, "src").join(b, ["dst", "chunk_id"]).select("src", "dst", "chunk_id")
