"""From documents to token ids: a pipeline of four stages, each one operator of ``quillspark.llm``.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns the rows
that stay, with the columns of documents; the last returns token ids. ``run`` writes what each
stage returns to the shared folder and reads it again for the next, so a lost executor repeats
no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, decontaminate, ngram_join, quality
from quillspark.llm.common import prepared, staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects. It learns from the labelled rows of ``docs``."""
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs, quality.taught(docs, labels))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 over five-word shingles make: the smallest doc_id."""
    prepared(spark)
    return ngram_join.one_of_each(docs, width=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.clean(docs, prepared(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, checked by decoding them."""
    import public_tokenizers

    prepared(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(docs.select("doc_id", "text", "lang", "source"), ranks, pattern, check=True)
    return ids.select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("byte-level BPE", encode),
]

#: Neither the network, edit distances nor byte pair merges can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs
