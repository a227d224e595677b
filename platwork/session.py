"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Applied only where the caller's own configuration has not already decided.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Methods above this many bytes are never compiled by the JVM; fall back to smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "platwork", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or return) a session with the engine settings; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    The setting names storage every executor can reach. Where it is unset a temporary folder is
    chosen in local mode only, where all tasks run on this machine; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="platwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/platwork/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: its lineage ends here."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession, root: str | None = None) -> None:
    """Delete all tables that :func:`stored` and :func:`shared_dir` have put under ``root``, by default
    ``spark.checkpoint.dir``.

    For the end of a session, or between jobs whose results are written elsewhere: results that are
    still to be computed from such tables fail afterwards.
    """
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/platwork")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
