"""What every set of model fits needs: a store of finished stages, fits that run
side by side, and matrices partitioned by their size."""

from __future__ import annotations

import hashlib
import json
import pathlib
import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark import InheritableThread, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from basketry.session import ensure_checkpoint_dir

#: Fits in flight at once at most (each has a thread of the driver), and matrix bytes of a partition.
MOST_FITS, PARTITION_BYTES = 32, 32 << 20


def code_digest() -> str:
    """Changes when the library does: a stored fit of other code is no hit."""
    root = pathlib.Path(__file__).resolve().parent.parent
    h = hashlib.sha256()
    for p in sorted(root.glob("operators/*.py")) + sorted(root.glob("functions/*.py")) + sorted(root.glob("sources/*.py")):
        h.update(p.read_bytes())
    return h.hexdigest()[:16]


class FitStore:
    """Finished stages of one data set and configuration, in the shared folder.

    A stage is written to a folder of its own and then published by one small
    file that names the folder, so any process sees a whole stage or none; two
    writers at once do the work twice and the first one counts.
    """

    def __init__(self, spark: SparkSession, *key, root: str | None = None):
        self.spark = spark
        name = hashlib.sha256(repr((code_digest(), *key)).encode()).hexdigest()[:24]
        self.root = f"{(root or ensure_checkpoint_dir(spark)).rstrip('/')}/fits/{name}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._locks: dict[str, threading.RLock] = {}
        self._lock = threading.Lock()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def published(self, stage: str) -> str | None:
        """The folder of a finished stage."""
        mark = self._path(f"{stage}.done")
        if not self._fs.exists(mark):
            return None
        stream = self._fs.open(mark)
        try:
            return f"{self.root}/" + self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def stage(self, name: str, write: Callable[[str], None]) -> str:
        """The folder of stage ``name``; ``write(folder)`` makes it if it is not there."""
        with self._lock:
            lock = self._locks.setdefault(name, threading.RLock())
        with lock:
            have = self.published(name)
            if have:
                return have
            folder = f"{name}-{uuid.uuid4().hex}"
            write(f"{self.root}/{folder}")
            try:
                out = self._fs.create(self._path(f"{name}.done"), False)
                out.write(bytearray(folder.encode()))
                out.close()
            except Exception:  # another process was first
                if not self._fs.exists(self._path(f"{name}.done")):
                    raise
            return self.published(name)

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A stage that is one table."""
        return self.spark.read.parquet(self.stage(name, lambda path: build().write.parquet(path)))

    def value(self, name: str, build: Callable[[], object]):
        """A stage that is one small value of JSON types."""
        def write(path):
            self.spark.createDataFrame([(json.dumps(build()),)], "value string").coalesce(1).write.parquet(path)
        return json.loads(self.spark.read.parquet(self.stage(name, write)).first()["value"])

    def model(self, name: str, kind, build: Callable[[], object]):
        """A stage that is one fitted model of class ``kind``."""
        return kind.load(self.stage(name, lambda path: build().write().save(path)))


def side_by_side(spark: SparkSession, tasks: Iterable, run: Callable, at_once: int | None = None) -> list:
    """``run(task)`` of every task, in order; as many at once as the cluster has
    cores, each in a scheduler pool of its own (which a session with the fair
    scheduler shares out evenly). The first failure is raised."""
    tasks = list(tasks)
    at_once = max(1, min(len(tasks), MOST_FITS, at_once or 2 * spark.sparkContext.defaultParallelism))
    results, failed, todo, lock = [None] * len(tasks), [], iter(enumerate(tasks)), threading.Lock()

    def work(pool):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{pool}")
        while not failed:
            with lock:
                i, task = next(todo, (None, None))
            if i is None:
                return
            try:
                results[i] = run(task)
            except Exception as e:
                failed.append(e)

    threads = [InheritableThread(target=work, args=(k,), session=spark) for k in range(at_once)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    return results


def by_size(rows: DataFrame, n_rows: int, width: int, key: str, alone: bool = False) -> DataFrame:
    """``rows`` (of ``width`` doubles) persisted in as many partitions as their
    bytes ask for, ordered by ``key`` so that fits can be repeated. Many fits of
    a small matrix then cost a task a job, not a task a core; a fit that runs
    ``alone`` spreads over the cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n_rows * (width + 4) * 8 // PARTITION_BYTES))
    if alone:
        parts = max(parts, min(cores, n_rows // 1000 + 1))
    return rows.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)
