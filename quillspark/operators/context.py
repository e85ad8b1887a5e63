"""Prompt context and references: what is shown, under which handle, in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import shortened

SYSTEM = ("KEGG_Pathway", "Reactome_Pathway", "MSigDB_GeneSet")
MOLECULAR = ("Gene", "Protein", "Chemical")


def split_and_handles(chunks: DataFrame, min_score: float, maybe: int = 10) -> DataFrame:
    """section (good, maybe, hidden), handle, ... of (chunk_id, rerank_score, ...).

    Good passages come in document order; of the others the ``maybe`` best, also in document
    order, with handles that go on counting; what is not shown has no handle.
    """
    score = F.coalesce("rerank_score", F.lit(0.0))
    good = score >= min_score
    place = F.row_number().over(Window.partitionBy(good).orderBy(F.desc(score), "chunk_id"))
    rows = chunks.withColumn("section", F.when(good, "good").when(place <= maybe, "maybe").otherwise("hidden"))
    n = F.row_number().over(Window.orderBy(F.when(F.col("section") == "good", 0).when(F.col("section") == "maybe", 1).otherwise(2), "chunk_id"))
    return rows.withColumn("handle", F.when(F.col("section") != "hidden", F.concat(F.lit("C"), n.cast("string"))))


def blocks(shown: DataFrame) -> DataFrame:
    """One row a section: its passages as ``[C1]`` blocks with blank lines between."""
    line = F.concat(F.lit("["), F.col("handle"), F.lit("]\n"), F.col("content"))
    n = F.regexp_extract("handle", r"(\d+)", 1).cast("int")
    rows = shown.where(F.col("handle").isNotNull()).select("section", F.struct(n.alias("n"), line.alias("t")).alias("b"))
    return rows.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b.t), "\n\n").alias("text"))


def references(shown: DataFrame) -> DataFrame:
    """id, content, source_id, handle (null if never shown), rerank_score."""
    return shown.select(F.col("chunk_id").alias("id"), "content", F.col("paper_id").alias("source_id"), "handle", "rerank_score")


def tier(type_: Column, id_: Column) -> Column:
    return F.when(type_.isin(*SYSTEM) | id_.startswith("MSigDB:"), "system").when(type_.isin(*MOLECULAR), "molecular").otherwise("other")


def tiers(entities: DataFrame, length: int = 300, system: tuple[str, ...] = (), molecular: tuple[str, ...] = ()) -> DataFrame:
    """label, line of entities with a description, by tier: [S1].., [M1].., [O1]... More types may be given a tier."""
    kind = F.when(F.col("entity_type").isin(*system), "system") if system else F
    kind = kind.when(F.col("entity_type").isin(*molecular), "molecular") if molecular else kind
    kind = tier(F.col("entity_type"), F.col("entity_id")) if kind is F else kind.otherwise(tier(F.col("entity_type"), F.col("entity_id")))
    rows = entities.where(F.trim(F.coalesce("description", F.lit(""))) != "").withColumn("tier", kind)
    n = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("degree"), "entity_id"))
    label = F.concat(F.upper(F.substring("tier", 1, 1)), n.cast("string"))
    return rows.select("entity_id", "tier", label.alias("label"), F.concat(F.lit("["), label, F.lit("] "), F.col("entity_id"), F.lit(": "), shortened(F.col("description"), length)).alias("line"))


def relations(edges: DataFrame) -> DataFrame:
    """pos, line of edges (src, dst, degree, weight, description)."""
    n = F.row_number().over(Window.orderBy(F.desc("degree"), F.desc("weight"), "src", "dst"))
    return edges.select(n.alias("pos"), F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.col("src"), F.lit(" -> "), F.col("dst"), F.lit(": "), F.coalesce("description", F.lit(""))).alias("line"))


def entity_lines(entities: DataFrame) -> DataFrame:
    return entities.select("entity_id", F.format_string("- %s (%s, degree: %d): %s", "entity_id", "entity_type", F.col("degree").cast("long"), F.coalesce("description", F.lit(""))).alias("line"))


def joined(lines: DataFrame, order: str, text: str = "line") -> DataFrame:
    """All lines as one text."""
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x.t), "\n").alias("text"))


def paper_distribution(shown: DataFrame) -> DataFrame:
    return shown.groupBy("paper_id").agg(F.count("*").alias("chunks"))
