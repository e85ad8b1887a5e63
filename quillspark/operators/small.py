"""The one place where the size of a side decides how it is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import shared_folder

#: Rows up to which a side is broadcast.
SMALL = 200_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows, else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in the shared folder that ``spark.checkpoint.dir`` names.

    Stages of a question feed several later ones; each would otherwise carry its whole past in its plan.
    """
    shared_folder(df.sparkSession, "settled")
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its files make fewer tasks than there are cores; at scale it stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
