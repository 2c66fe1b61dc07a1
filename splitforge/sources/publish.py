"""Publication of written folders: readers see all of one or nothing, and of several writers one wins.

A folder is written beside its place under a name that Spark's readers pass over, and moved there under a lock, a file
that only one writer can create. The lock is held for the move alone, not while rows are written.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Seconds after which a lock counts as left behind by a writer that died, and for which a writer waits for another one's move.
STALE, WAIT = 600, 60


class Store:
    """The Hadoop file system of a path, as Spark itself reaches it."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def move(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} could not be moved to {target}")

    def create(self, path: str) -> bool:
        """Whether this call has created the (empty) file; false where it was there."""
        try:
            self._fs.create(self._path(path), False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()) or self.exists(path):
                return False
            raise
        return True

    def age(self, path: str) -> float:
        """Seconds since the file was written; 0 where there is none."""
        try:
            return max(0.0, time.time() - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000)
        except Py4JJavaError:
            return 0.0


def published(spark: SparkSession, write: Callable[[str], None], path: str, replace: bool = False) -> bool:
    """Write a folder by write(place) and move it to `path`; false, with nothing changed, where there is one already.

    replace: what is there goes; readers then see the old folder, for a moment none, and the new one. Of writers that
    publish one path at the same time the first to take the lock wins; a lock older than STALE is taken over.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    store, staged, lock, old = Store(spark, path), f"{parent}/_{name}-{uuid.uuid4().hex}", f"{parent}/_{name}.lock", f"{parent}/_{name}-{uuid.uuid4().hex}"
    if not replace and store.exists(path):
        return False
    try:
        write(staged)
        began = time.time()
        while not store.create(lock):
            if store.age(lock) > STALE:
                store.delete(lock)
            elif time.time() - began > WAIT:
                raise TimeoutError(f"{lock} is held by another writer")
            else:
                time.sleep(0.05)
        try:
            if store.exists(path):
                if not replace:
                    return False
                store.move(path, old)
            store.move(staged, path)
        finally:
            store.delete(lock)
        return True
    finally:
        for left in (staged, old):
            if store.exists(left):
                store.delete(left)


def appended(df: DataFrame, path: str, batch: int | str) -> bool:
    """Add the rows to a log as those of one batch; false, with nothing added, where the log has the batch.

    So a batch that is delivered again, or a write that is tried again, leaves its rows once. Read with log().
    """
    return published(df.sparkSession, lambda place: df.write.parquet(place), f"{path.rstrip('/')}/batch={batch}")


def to_log(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that adds each batch of a stream to a log once."""

    def put(df: DataFrame, batch: int) -> None:
        appended(df, path, batch)

    return put


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches of a log with the number of their batch; no rows before the first one."""
    if not Store(spark, path).exists(path):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(path)
