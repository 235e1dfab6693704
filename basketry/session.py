"""Session construction and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "basketry", checkpoint_dir: str | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster, the platform's own
    session is used as is; nothing here is required there. ``checkpoint_dir``
    is the shared folder of written tables; only a local master may leave it
    out (a private folder is made then)."""
    if checkpoint_dir is None and master.startswith("local") and not master.startswith("local-cluster"):
        checkpoint_dir = tempfile.mkdtemp(prefix="basketry-ckpt-")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if checkpoint_dir is not None:
        builder = builder.config(_CKPT_KEY, checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the platform sets it (a shared file system path) and it is
    only read here. Only when it is unset (local tests) a private folder is
    created and registered with the SparkContext.
    """
    sc = spark.sparkContext
    path = sc.getConf().get(_CKPT_KEY, None)
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="basketry-ckpt-")
    sc.setCheckpointDir(path)
    return path


def materialize(df, name: str):
    """``df`` written once to the shared checkpoint folder and read back: cuts
    the lineage at a table that survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + f"/{name}-{uuid.uuid4().hex}"
