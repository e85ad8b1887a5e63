"""Canonical tables of the retrieval engine over plain Parquet tables.

Passages are lines of documents; entities are parts, suppliers and nations; edges are how often
two of them occur together. Everything is a lazy projection, so filters and column pruning
reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.small import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paper_key(doc_id: Column) -> Column:
    return F.sha1(doc_id.cast("string").cast("binary"))


def chunk_id(paper_id: Column, number: Column) -> Column:
    """``chunk-`` + 40 hex + ``-`` + six digits."""
    return F.concat_ws("-", F.lit("chunk"), paper_id, F.lpad(number.cast("string"), 6, "0"))


def paper_of(chunk: Column) -> Column:
    """The paper id inside a chunk id, empty if it is none."""
    return F.regexp_extract(chunk, r"^chunk-([a-f0-9]{40})-(\d+)", 1)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, paper_id, chunk_no, content, doc_id; one row a non-empty line."""
    lines = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "content"))
    paper = paper_key(F.col("doc_id"))
    return lines.where("content <> ''").select(
        chunk_id(paper, F.col("chunk_no")).alias("chunk_id"), paper.alias("paper_id"), "chunk_no", "content", "doc_id"
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, title, authors, year, journal of each document."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        paper_key(F.col("doc_id")).alias("paper_id"),
        F.element_at(F.split("text", "\n"), 1).alias("title"),
        F.array(F.concat(F.lit("Author "), F.col("lang"))).alias("authors"),
        (F.lit(2000) + F.col("doc_id") % 25).cast("string").alias("year"),
        F.col("source").alias("journal"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, collection, vector."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("collection"), F.col("embedding").alias("vector"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: parts with suppliers by number of lines, suppliers with nations once each."""
    line = read(spark, sf_dir, "lineitem")
    pairs = line.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("weight"))
    sold = pairs.select(F.concat(F.lit("PART:"), "l_partkey").alias("src"), F.concat(F.lit("SUPP:"), "l_suppkey").alias("dst"), "weight")
    home = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("SUPP:"), "s_suppkey").alias("src"), F.concat(F.lit("NATION:"), "s_nationkey").alias("dst"), F.lit(1).cast("long").alias("weight")
    )
    return sold.unionByName(home)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, entity_type, description."""
    part = read(spark, sf_dir, "part").select(F.concat(F.lit("PART:"), "p_partkey").alias("entity_id"), F.lit("Part").alias("entity_type"), F.col("p_name").alias("description"))
    supp = read(spark, sf_dir, "supplier").select(F.concat(F.lit("SUPP:"), "s_suppkey"), F.lit("Supplier"), F.col("s_name"))
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("NATION:"), "n_nationkey"), F.lit("Nation"), F.col("n_name"))
    return part.union(supp).union(nation)


def entity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, chunk_id: which orders (as passages) a part occurs in."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(F.concat(F.lit("PART:"), "l_partkey").alias("entity_id"), F.concat(F.lit("ORDER:"), "l_orderkey").alias("chunk_id")).distinct()


def entity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_name, pct_paper, pct_chunk, all_extracted_text of each part that was ordered."""
    line = read(spark, sf_dir, "lineitem")
    total = line.agg(F.countDistinct("l_orderkey").alias("orders"), F.count("*").alias("lines"))
    per = line.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("o"), F.count("*").alias("n"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return per.crossJoin(F.broadcast(total)).select(
        F.concat(F.lit("PART:"), "l_partkey").alias("entity_name"),
        (100.0 * F.col("o") / F.col("orders")).alias("pct_paper"),
        (100.0 * F.col("n") / F.col("lines")).alias("pct_chunk"),
        F.concat_ws("|", "flags").alias("all_extracted_text"),
    )


def questions(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """query_idx, text of the first n benchmark items."""
    return read(spark, sf_dir, "benchmark").where(F.col("item_id") < n).select(F.col("item_id").cast("int").alias("query_idx"), "text")
