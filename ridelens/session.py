"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every ridelens job relies on: calendar parts must not depend on the
# machine's zone, ANSI keeps casts and arithmetic strict, AQE re-plans joins and
# partition counts from runtime sizes (its broadcast switch is the size check).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a shuffled join whose other side is filtered to little: its keys go into a Bloom filter
    # that prunes this side's scan before the shuffle (sides above 1 GB; Spark's own
    # limits of 10 GB, and of 10 MB for the filtered side, pass most such joins by)
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1GB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "ridelens",
                conf: dict[str, str] | None = None) -> SparkSession:
    """Return a session with ``SESSION_DEFAULTS`` applied (``conf`` wins)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # Runtime-settable SQL options also apply to an already running session.
    # (static ones, like the warehouse folder, hold from the session's start only).
    for key, value in {**SESSION_DEFAULTS, **(conf or {})}.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate files: the cluster's ``spark.checkpoint.dir``.

    Only when the setting is absent and the session runs in local mode (tests,
    single-machine runs) is a fresh local folder created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) so intermediate files survive executor loss")
    local = tempfile.mkdtemp(prefix="ridelens-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def new_scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under :func:`scratch_dir` for one write."""
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder: partitions keep their rows and
    order, the lineage ends there, and a lost executor costs no more than reading them again."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared scratch folder and read back: unlike a
    checkpoint its size is known to the optimizer and its columns are read one by one. The
    files stay until the folder is cleared."""
    path = new_scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
