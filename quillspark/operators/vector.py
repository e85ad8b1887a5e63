"""Exact vector search: top-k per query, per collection, over many queries; centroids and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.vector import cosine, normalised
from quillspark.operators.small import small


def scored(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_idx, id, score, and the columns of ``vectors`` but for the vector. Queries (query_idx, query_vector) are few."""
    pairs = vectors.crossJoin(small(queries, 10_000))
    return pairs.select("query_idx", *[c for c in vectors.columns if c != "vector"], cosine(F.col("vector"), F.col("query_vector")).alias("score"))


def best(df: DataFrame, k: int, by: Sequence[str], score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows of each group with their rank from 1; partial limits before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """Top-k of each query, then the threshold: it never lets in rows from beyond k."""
    out = best(scored(vectors, queries), k, ["query_idx"])
    return out if threshold is None else out.where(F.col("score") >= threshold)


def collections(df: DataFrame, include: Sequence | None = None, exclude: Sequence | None = None) -> DataFrame:
    if include:
        df = df.where(F.col("collection").isin(*include))
    return df.where(~F.col("collection").isin(*exclude)) if exclude else df


def top_k_per_collection(vectors: DataFrame, queries: DataFrame, k: int, min_similarity: float = 0.0, include: Sequence | None = None, exclude: Sequence | None = None) -> DataFrame:
    """Top-k of each query in each collection, then the least similarity; pos ranks a query's rows over all collections."""
    hits = best(scored(collections(vectors, include, exclude), queries), k, ["query_idx", "collection"]).where(F.col("score") >= min_similarity)
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_idx").orderBy(F.desc("score"), "id")))


def best_per_id(hits: DataFrame, id_: str = "id") -> DataFrame:
    """Greatest score of each id over all queries, with query and rank of the winner; the first query wins ties."""
    winner = F.max_by(F.struct("query_idx", "rank"), F.struct(F.col("score"), -F.col("query_idx")))
    return hits.groupBy(id_).agg(F.max("score").alias("score"), winner.alias("w")).select(id_, "score", F.col("w.query_idx").alias("query_idx"), F.col("w.rank").alias("query_rank"))


def candidates(vectors: DataFrame, queries: DataFrame, per_query: int, total: int) -> DataFrame:
    """Top ``per_query`` of each query, the best score of each id, the best ``total`` of these."""
    return best_per_id(top_k(vectors, queries, per_query)).orderBy(F.desc("score"), "id").limit(total)


def budgeted(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k shared out over the queries, at least one each; the best k of what they find."""
    n = max(1, queries.count())
    return candidates(vectors, queries, max(1, k // n), k)


def centroids(vectors: DataFrame, by: str = "collection") -> DataFrame:
    """The mean of each group's vectors, normalised."""
    parts = vectors.select(by, F.posexplode("vector").alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("mean"))
    return lists.select(by, normalised(F.col("mean")).alias("centroid"))


def without_outliers(vectors: DataFrame, threshold: float, by: str = "collection", least: int = 3) -> DataFrame:
    """Rows near the centroid of their group; groups of fewer than ``least`` rows stay whole. Adds ``similarity``."""
    sizes = vectors.groupBy(by).agg(F.count("*").alias("members"))
    both = vectors.join(small(centroids(vectors, by).join(sizes, by)), by)
    out = both.withColumn("similarity", cosine(F.col("vector"), F.col("centroid")))
    return out.where((F.col("members") < least) | (F.col("similarity") >= threshold)).drop("centroid", "members")
