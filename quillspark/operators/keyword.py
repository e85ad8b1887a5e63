"""Keyword search: postings and BM25, for one query or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import terms
from quillspark.operators.small import small

K1, B = 1.2, 0.75


def query_terms(queries: DataFrame) -> DataFrame:
    """query_idx, term, n_terms of each query's distinct terms."""
    return queries.select("query_idx", F.array_distinct(terms(F.col("text"))).alias("t")).select("query_idx", F.explode("t").alias("term"), F.size("t").alias("n_terms"))


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf, doc_len: an inverted index to be written bucketed by term."""
    t = chunks.select("chunk_id", terms(F.col("content")).alias("t"))
    return t.select("chunk_id", F.size("t").alias("doc_len"), F.explode("t").alias("term")).groupBy("term", "chunk_id", "doc_len").agg(F.count("*").alias("tf"))


def write_postings(chunks: DataFrame, table: str, buckets: int = 64) -> None:
    postings(chunks).write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def scored(chunks: DataFrame, queries: DataFrame, should_match: float = 0.3) -> DataFrame:
    """query_idx, chunk_id, score, matched of all chunks with enough of the query's terms.

    Texts are split once; only terms that a query has leave the scan, already counted.
    """
    wanted = query_terms(queries)
    asked = small(wanted.select("term").distinct().agg(F.collect_set("term").alias("asked")), 1)
    split = chunks.select("chunk_id", terms(F.col("content")).alias("t"))
    size = split.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_len"))
    kept = split.crossJoin(asked).select("chunk_id", F.size("t").alias("doc_len"), F.explode(F.filter("t", lambda x: F.array_contains("asked", x))).alias("term"))
    tf = kept.groupBy("term", "chunk_id", "doc_len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    length = F.lit(1 - B) + F.lit(B) * F.col("doc_len") / F.col("avg_len")
    weight = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
    rows = tf.join(small(df), "term").crossJoin(F.broadcast(size)).join(small(wanted), "term").withColumn("w", weight)
    sums = rows.groupBy("query_idx", "chunk_id").agg(F.sum("w").alias("score"), F.count("*").alias("matched"), F.max("n_terms").alias("n_terms"))
    return sums.where(F.col("matched") >= F.greatest(F.lit(1), F.floor(F.lit(should_match) * F.col("n_terms")))).drop("n_terms")


def search(chunks: DataFrame, queries: DataFrame, k: int, should_match: float = 0.3) -> DataFrame:
    """The k best chunks of each query, with rank."""
    rank = F.row_number().over(Window.partitionBy("query_idx").orderBy(F.desc("score"), "chunk_id"))
    return scored(chunks, queries, should_match).withColumn("rank", rank).where(F.col("rank") <= k)


def search_many(chunks: DataFrame, queries: DataFrame, per_query: int, k: int, should_match: float = 0.3) -> DataFrame:
    """The greatest score of each chunk over all queries, the best k of these."""
    hits = search(chunks, queries, per_query, should_match)
    return hits.groupBy("chunk_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)
