"""SparkSession for tests, the bench and local runs.

Library functions never create or configure a session; they take DataFrames. This helper only
fills in settings that the caller (or the cluster) has not set already.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Driver-side only: skips capturing the Python call site on every DataFrame API call.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                app_name: str = "loyalscope") -> SparkSession:
    """Return the active session, or start a local one with test-sized settings."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = builder.config("spark.driver.memory", os.environ.get("LOYALSCOPE_DRIVER_MEMORY", "8g"))
    # Catalog tables of a local session (bucketed layouts in tests) go to a fresh scratch folder.
    builder = builder.config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="loyalscope-wh-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir`` (a shared folder).

    Only a local-mode session (tests, laptops) without one gets a fresh temporary folder; on a
    cluster a missing setting is an error, never a machine-local path.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    local = tempfile.mkdtemp(prefix="loyalscope-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared ``spark.checkpoint.dir``; what is written there goes when the session ends."""
    parent = f"{ensure_checkpoint_dir(spark).rstrip('/')}/loyalscope-{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    file_system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    file_system.mkdirs(jvm_path)
    file_system.deleteOnExit(jvm_path)
    return f"{parent}/data"


def stored(df: DataFrame, name: str, path: str | None = None, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet into a ``new_folder`` (or to ``path``, where it stays) and read it back; ``options`` are the writer's.

    Cuts the lineage: a lost executor never re-runs what came before. Eager.
    """
    target = path or new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**options or {}).parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)
