"""Session helpers shared by every entry point."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build(app: str = "quillspark", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests, benches and notebooks; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quillspark-ckpt-"))
        .getOrCreate()
    )


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session whose executors are threads of this machine gets one of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name under ``spark.checkpoint.dir``."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
