"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sluicegate", cpus: str | int = "*") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # The JVM leaves methods over 8000 bytes of bytecode uncompiled; beyond that Spark's
        # split projections are faster than one fused loop.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder for written intermediates, on the storage the cluster names.

    ``spark.checkpoint.dir`` is shared by all executors.  Where it is unset, a session of one
    process, as in a local test, uses a temporary folder of this machine; others are refused,
    since executors would not see the driver's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"run-{label}-")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the work folder, so that later steps do not compute them again."""
    path = f"{work_folder(df.sparkSession, label)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
