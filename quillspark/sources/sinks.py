"""Sinks: cache writes and traces of a query's stages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def cache_rows(df: DataFrame, key: str, value: str, now: Column, ttl_seconds: int | None = None) -> DataFrame:
    """Rows to append to a cache table; readers take the newest of a key."""
    expires = F.lit(None).cast("timestamp") if ttl_seconds is None else now + F.make_dt_interval(secs=F.lit(ttl_seconds))
    return df.select(F.col(key).alias("key"), F.col(value).alias("value"), now.alias("created"), expires.alias("expires_at"))


def new_entries(entries: DataFrame, cache: DataFrame, key: str = "key", content: str = "value") -> DataFrame:
    """Entries worth saving: not empty, and not in the cache with the same content."""
    return entries.where(F.col(content).isNotNull() & (F.col(content) != "")).join(cache.select(key, content), [key, content], "left_anti")


def append_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


class Trace:
    """The named intermediate relations of one query, lazy until they are written."""

    def __init__(self, query_id: str):
        self.query_id, self.frames, self.seen = query_id, {}, {}

    def log(self, stage: str, df: DataFrame) -> DataFrame:
        if not stage.isidentifier():
            raise ValueError(f"a stage's name becomes a folder's: {stage!r}")
        self.frames[stage] = df
        return df

    def observe(self, stage: str, df: DataFrame, *metrics: Column) -> DataFrame:
        """Metrics that come with the query's own run, at no further job."""
        self.seen[stage] = Observation(stage)
        return df.observe(self.seen[stage], *metrics)

    def write(self, path: str) -> None:
        """One JSON-lines folder a stage, overwritten as a whole."""
        for stage, df in self.frames.items():
            df.write.mode("overwrite").json(f"{path}/query_id={self.query_id}/{stage}")

    def summaries(self) -> Mapping[str, dict]:
        return {k: o.get for k, o in self.seen.items()}
