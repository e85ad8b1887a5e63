"""Store-like access to tables: keyed lookups, id lists, scans, caches, statistics files, configuration.

Each reader takes a DataFrame and returns a DataFrame; lookups by a list of ids are semi joins
on an id frame, broadcast while it is small, so no list has to fit into an expression.
"""

from __future__ import annotations

import configparser
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.small import small

#: Ids of one frame that are broadcast; longer ones are joined by shuffle.
BROADCAST_IDS = 200_000


def ids_frame(spark: SparkSession, ids: Sequence, kind: str = "string") -> DataFrame:
    """pos, id in the order given."""
    return spark.createDataFrame(list(enumerate(ids)), f"pos int, id {kind}")


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def by_ids(df: DataFrame, key: str, ids: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose key is in ``ids``; order not kept, misses absent."""
    want = ids.select(F.col("id").alias(key)).distinct()
    out = df.join(small(want, BROADCAST_IDS), key, "left_semi")
    return out.select(*columns) if columns else out


def by_ids_in_order(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows in the order of ``ids`` (column pos stays); misses are skipped, repeated ids repeat."""
    return ids.withColumnRenamed("id", key).join(df, key).orderBy("pos")


def scan_of_papers(chunks: DataFrame, papers: DataFrame, limit: int = 10_000) -> DataFrame:
    """All chunks of the given papers, in chunk order, at most ``limit``: the cap is part of the operator."""
    return chunks.join(papers.select("paper_id").distinct(), "paper_id", "left_semi").orderBy("chunk_id").limit(limit)


def value_of(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """JSON values parsed, anything else wrapped as {"value": ...}."""
    parsed = F.try_parse_json(F.col(value))
    wrapped = F.parse_json(F.to_json(F.struct(F.col(value).alias("value"))))
    return df.withColumn(value, F.coalesce(parsed, wrapped))


def set_members(df: DataFrame, key: str, member: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("value"))


def scan_keys(df: DataFrame, pattern: str, count: int, namespace: str, key: str = "key") -> DataFrame:
    """Keys of a namespace that match a glob, without the namespace, at most ``count``."""
    special = "".join(f"\\{c}" if c in r".^$+{}()|\\" else c for c in pattern)
    regex = "^" + f"{namespace}:{special}".replace("*", ".*").replace("?", ".") + "$"
    return df.where(F.col(key).rlike(regex)).orderBy(key).limit(count).select(F.substring(key, len(namespace) + 2, 10_000).alias(key))


def latest_valid(cache: DataFrame, now, key: str = "key", at: str = "created", expires: str = "expires_at") -> DataFrame:
    """The newest entry of each key that has not expired at ``now``; the newest entry decides, expired or not."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(F.xxhash64(*cache.columns))))
    return cache.withColumn("newest", newest).where("newest = 1").drop("newest").where(F.col(expires).isNull() | (F.col(expires) > F.lit(now)))


def load_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Entity statistics from TSV (.tsv, .txt) or CSV; three columns are required.

    num_text_variations counts the non-empty trimmed parts between bars: 0 for null, null if the file has no such column.
    """
    sep = "\t" if path.lower().endswith((".tsv", ".txt")) else ","
    df = spark.read.csv(path, sep=sep, header=True)
    if missing := {"entity_name", "pct_paper", "pct_chunk"} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    df = df.withColumn("pct_paper", F.col("pct_paper").cast("double")).withColumn("pct_chunk", F.col("pct_chunk").cast("double"))
    return with_variations(df)


def with_variations(df: DataFrame) -> DataFrame:
    if "all_extracted_text" not in df.columns:
        return df.withColumn("num_text_variations", F.lit(None).cast("int"))
    parts = F.filter(F.transform(F.split("all_extracted_text", r"[|]"), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn("num_text_variations", F.when(F.col("all_extracted_text").isNull(), 0).otherwise(F.size(parts)))


def load_json(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON table, or None if there is no such file."""
    try:
        return spark.read.json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def load_config(path: str, overrides: Mapping[str, tuple[str, str, type]], env: Mapping[str, str] | None = None) -> dict[str, dict]:
    """INI sections as dicts; ``overrides`` maps a variable to (section, key, type). Empty and ill-typed variables are ignored."""
    parser = configparser.ConfigParser(interpolation=None)
    if not parser.read(path):
        raise FileNotFoundError(path)
    out = {s: dict(parser[s]) for s in parser.sections()}
    env = os.environ if env is None else env
    for name, (section, key, kind) in overrides.items():
        raw = env.get(name, "")
        if raw == "":
            continue
        try:
            out.setdefault(section, {})[key] = kind(raw)
        except ValueError:
            continue
    return out
