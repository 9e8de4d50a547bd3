"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}


def local_session(app_name: str, cpus: int | str = "*", **settings: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, visible to every executor.

    It lies under `spark.checkpoint.dir`. Only a local session without that
    setting gets a temporary folder of its own; on a cluster a machine-local
    folder would lose data, so there the setting is required, and a path of the
    local file system, which only a shared mount makes safe, brings a warning.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    on_cluster = not context.master.startswith("local")
    if not base:
        if on_cluster:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if context.applicationId not in _local_scratch:
            _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="termloom-")
        base = _local_scratch[context.applicationId]
    elif on_cluster and base.startswith(("/", "file:")):
        warnings.warn(f"{base} must be a mount that all executors share", stacklevel=2)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the scratch folder and read it back.

    Used where several branches of a plan need the same costly result. A
    written table survives the loss of executors and ends the lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
