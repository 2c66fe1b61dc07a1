"""Sinks: manifests, predictions and metrics; logs are in publish."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitforge.functions.columns import rounded
from splitforge.sources.publish import published


def manifest(df: DataFrame, path: str, columns: Sequence[str], force: bool = False, protected: Sequence[str] = (), kind: str = "csv") -> None:
    """Write the columns. What is there is kept unless forced, and never replaced below a protected folder.

    The manifest appears whole or not at all, and of two writers of one path that aren't forced one is refused.
    """
    if any(path.rstrip("/") == p.rstrip("/") or path.startswith(p.rstrip("/") + "/") for p in protected):
        raise PermissionError(f"{path} is protected")
    writer = df.select(*columns).write
    put = writer.option("header", True).csv if kind == "csv" else writer.format(kind).save
    if not published(df.sparkSession, put, path, replace=force):
        raise FileExistsError(f"{path} is there already")


def predictions(df: DataFrame, path: str, key: str = "sample_id") -> None:
    """JSON lines of image_path and pred."""
    df.select(F.col(key).cast("string").alias("image_path"), "pred").write.json(path)


def metrics(df: DataFrame, path: str, columns: Sequence[str], places: int = 6) -> None:
    """A CSV of the columns, numbers rounded, null as an empty field; and beside it the same as JSON."""
    kinds = dict(df.dtypes)
    rows = df.select(*((rounded(c, places) if kinds[c] == "double" else F.col(c)).alias(c) for c in columns))
    rows.coalesce(1).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(f"{path}.csv")
    df.select(F.to_json(F.struct(*columns)).alias("value")).coalesce(1).write.text(f"{path}.json")
