"""Scoring passages against questions behind a pluggable scorer, alone or as a cascade."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import terms
from quillspark.functions.vector import sigmoid
from quillspark.operators.small import small

#: A scorer turns the columns of a question and a passage into a score from 0 to 1.
Scorer = Callable[[Column, Column], Column]


def term_share(question: Column, passage: Column) -> Column:
    """Share of the question's distinct terms that the passage has: the cheap default."""
    asked = F.array_distinct(terms(question))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, terms(passage))) / F.size(asked))


def overlap_logit(question: Column, passage: Column) -> Column:
    """Overlap of distinct terms, normalised by both lengths, through a sigmoid: the costly default."""
    a, b = F.array_distinct(terms(question)), F.array_distinct(terms(passage))
    share = F.size(F.array_intersect(a, b)) / F.sqrt(F.greatest(F.size(a) * F.size(b), F.lit(1)).cast("double"))
    return sigmoid(F.lit(8.0) * share - F.lit(2.0))


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Scorer:
    """A scorer from a model that each worker loads once; text goes to it in Arrow batches."""
    held: list = []

    @F.pandas_udf("double")
    def score(question: pd.Series, passage: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        return pd.Series(held[0](question.fillna("").tolist(), passage.fillna("").tolist()), dtype="float64")

    return score


def all_pairs(docs: DataFrame, queries: DataFrame, scorer: Scorer) -> DataFrame:
    """query_idx, chunk_id, score of each document (chunk_id, content) and question (query_idx, text)."""
    return docs.select("chunk_id", "content").crossJoin(small(queries.select("query_idx", "text"), 1_000)).select("query_idx", "chunk_id", scorer(F.col("text"), F.col("content")).alias("score"))


def aggregated(pairs: DataFrame, how: str = "max") -> DataFrame:
    """chunk_id, score (max or mean), best_query (first of ties), query_scores (map)."""
    agg = {"max": F.max, "mean": F.avg}[how]("score")
    winner = F.max_by("query_idx", F.struct(F.col("score"), -F.col("query_idx")))
    scores = F.map_from_entries(F.array_sort(F.collect_list(F.struct("query_idx", "score"))))
    return pairs.groupBy("chunk_id").agg(agg.alias("score"), winner.alias("best_query"), scores.alias("query_scores"))


def rerank(docs: DataFrame, queries: DataFrame, scorer: Scorer = overlap_logit, how: str = "max", top: int | None = None, min_score: float = 0.0) -> DataFrame:
    out = aggregated(all_pairs(docs, queries, scorer), how)
    if min_score > 0:
        out = out.where(F.col("score") >= min_score)
    out = out.orderBy(F.desc("score"), "chunk_id")
    return out.limit(top) if top else out


def cascade(
    docs: DataFrame, queries: DataFrame, first: Scorer = term_share, second: Scorer = overlap_logit, stage1_top: int = 1024, stage1_min: float = 0.5, stage2_min: float = 0.5, how: str = "max"
) -> tuple[DataFrame, DataFrame]:
    """(stage 1, stage 2): the costly scorer sees only what the cheap one leaves. Scores filter first, then the limit."""
    one = aggregated(all_pairs(docs, queries, first), how).where(F.col("score") >= stage1_min).orderBy(F.desc("score"), "chunk_id").limit(stage1_top)
    left = docs.join(small(one.select("chunk_id")), "chunk_id", "left_semi")
    two = aggregated(all_pairs(left, queries, second), how).where(F.col("score") >= stage2_min).orderBy(F.desc("score"), "chunk_id")
    return one, two


def expand_documents(survivors: DataFrame, chunks: DataFrame, queries: DataFrame, scorer: Scorer = overlap_logit, min_score: float = 0.5, limit: int = 10_000, top: int | None = None) -> DataFrame:
    """chunk_id, score, origin: survivors as they are, and new passages of their papers that score enough."""
    papers = chunks.join(small(survivors.select("chunk_id")), "chunk_id", "left_semi").select("paper_id").distinct()
    reach = chunks.join(small(papers), "paper_id", "left_semi").orderBy("chunk_id").limit(limit)
    new = reach.join(small(survivors.select("chunk_id")), "chunk_id", "left_anti")
    scored = aggregated(all_pairs(new, queries, scorer)).where(F.col("score") >= min_score).select("chunk_id", "score", F.lit("expanded").alias("origin"))
    out = survivors.select("chunk_id", "score", F.lit("kept").alias("origin")).unionByName(scored).orderBy(F.desc("score"), "chunk_id")
    return out.limit(top) if top else out


def rerank_entities(entities: DataFrame, scorer: Scorer, threshold: float, most: int = 200, fallback: str = "use_name") -> DataFrame:
    """Entities (entity_id, query, content, votes) that score enough against their own best query.

    Scores are joined by id. At most ``most`` are scored, those of most votes first. Without
    content, the name is scored, or the row is kept unscored, or removed.
    """
    some = entities.orderBy(F.desc("votes"), "entity_id").limit(most)
    text = F.coalesce(F.when(F.trim("content") != "", F.col("content")), F.lit(None))
    if fallback == "use_name":
        text = F.coalesce(text, F.split_part("entity_id", F.lit(":"), F.lit(2)))
    elif fallback == "remove":
        some = some.where(text.isNotNull())
    out = some.withColumn("entity_rerank_score", F.when(text.isNotNull(), scorer(F.col("query"), text)))
    keep = F.col("entity_rerank_score") >= threshold
    return out.where(keep | F.col("entity_rerank_score").isNull() if fallback == "keep" else keep)


def from_positions(docs: DataFrame, results: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Scores that came as (index, score) put on docs (pos, ...); positions that do not exist are dropped."""
    out = docs.join(results.select(F.col("index").alias("pos"), F.col("relevance_score").alias("score")), "pos")
    return out.where(F.col("score") >= min_score) if min_score > 0 else out


def token_budget(rows: DataFrame, limit: int, order: str = "pos", tokens: str = "tokens") -> DataFrame:
    """The longest prefix whose tokens fit; nothing for a limit of 0 or less."""
    if limit <= 0:
        return rows.limit(0)
    used = F.sum(tokens).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used_tokens", used).where(F.col("used_tokens") <= limit)


def distribution(scores: DataFrame, column: str = "score") -> DataFrame:
    """One row: n, mean, population deviation, min, max and percentiles by linear interpolation."""
    points = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    stats = [F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")]
    return scores.agg(*stats, *[F.percentile(column, p).alias(name) for name, p in points.items()])


def at_or_above_percentiles(scores: DataFrame, points: tuple[float, ...], column: str = "score") -> DataFrame:
    """percentile, value, n: how many scores reach each percentile."""
    cuts = scores.agg(F.percentile(column, list(points)).alias("v")).select(F.posexplode("v").alias("i", "value"))
    cuts = cuts.withColumn("percentile", F.element_at(F.array(*[F.lit(p) for p in points]), F.col("i") + 1))
    return scores.crossJoin(F.broadcast(cuts)).where(F.col(column) >= F.col("value")).groupBy("percentile", "value").agg(F.count("*").alias("n"))
