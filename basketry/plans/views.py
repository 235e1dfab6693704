"""Derived tables shared by the registered queries.

``shop`` (reconstructed shopper rows) and ``feat`` (shop + the feature
pipeline) are each built once per dataset and written as parquet under the
shared checkpoint folder; ``feat_split`` (feat + train/test part) and ``seg``
(feat + segment) are projections of it. Later queries scan them
with column pruning and filter pushdown instead of re-deriving the join tree,
and a lost executor costs a re-read, not a re-derivation.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession

from basketry.session import scratch_path

_MEMO: dict = {}
_LOCK = threading.RLock()


def data_stamp(spark: SparkSession, sf_dir: str) -> str:
    """Changes when a table of the folder does: names, sizes and times of its
    entries, from the file system that holds it; the same in every process."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return hashlib.md5(repr(sorted((e.getPath().getName(), e.getLen(), e.getModificationTime()) for e in entries)).encode()).hexdigest()


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return spark.sparkContext.applicationId, sf_dir.rstrip("/"), data_stamp(spark, sf_dir), name


def materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = _key(spark, sf_dir, name)
    with _LOCK:
        path = _MEMO.get(key)
        if path is None:
            path = scratch_path(spark, name)
            build().write.parquet(path)
            _MEMO[key] = path
    return spark.read.parquet(path)


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.sources.tables import shop_frame
    return materialized(spark, sf_dir, "shop", lambda: shop_frame(spark, sf_dir))


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.operators.features import derive_features
    return materialized(spark, sf_dir, "feat", lambda: derive_features(shop(spark, sf_dir)))


def remembered(spark: SparkSession, sf_dir: str, name: str, build):
    """A small fitted value, once per session and dataset."""
    key = _key(spark, sf_dir, name)
    with _LOCK:
        if key not in _MEMO:
            _MEMO[key] = build()
        return _MEMO[key]


def feat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feat`` with its part, a projection at read time over the stored cuts."""
    from basketry.operators.split import add_part, split_cutoffs
    f = feat(spark, sf_dir)
    return add_part(f, remembered(spark, sf_dir, "cuts", lambda: split_cutoffs(f, "SUBSCRIPTION_STATUS")))


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.sources.tables import seg_column
    return feat(spark, sf_dir).withColumn("Cluster", seg_column())


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.sources.tables import scored_frame
    return materialized(spark, sf_dir, "scored", lambda: scored_frame(spark, sf_dir, shop(spark, sf_dir)))
