"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a new temporary one serves, in local mode only: executors
    of a cluster couldn't share it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder as Parquet and read again: it cuts the lineage, and a lost
    executor costs no recomputation of what came before."""
    return _written(df, new_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function like stored() whose tables are removed at the end; what is computed from them must be stored by then."""
    paths: list[str] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        paths.append(new_path(spark, name))
        return _written(df, paths[-1])

    try:
        yield put
    finally:
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Set the session to hand Python workers at most about `most` bytes at once.

    By default a batch is 10,000 rows whatever their size, which for long texts is more than a worker should hold.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
