"""A data source that lists files in tasks, and a sink that writes named files from tasks.

A folder of very many files is listed by its sub-folders: each is a partition of the scan, listed where the task runs,
and neither paths nor counts of files pass through the driver. The driver only names the partitions; with the option
`prefixes` it looks at no folder at all.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "prefix string, name string, path string, length long"
#: Rows of a batch.
_ROWS = 10_000


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; a path without a scheme is local."""
    if "://" in folder or folder.startswith("file:/"):
        return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return fs.LocalFileSystem(), folder


@dataclass
class Prefix(InputPartition):
    """A sub-folder to be listed, with all below it or its own files only."""

    prefix: str
    deep: bool

    def __init__(self, prefix: str, deep: bool):
        super().__init__((prefix, deep))
        self.prefix, self.deep = prefix, deep


class Listing(DataSource):
    """(prefix, name, path, length) of the files below a folder, by its sub-folders.

    Options: path; extensions, joined by commas, any if empty; levels, how many levels of sub-folders are partitions (1);
    prefixes, a JSON list of sub-folders to look at instead of those that there are. prefix and name are relative: the
    partition's sub-folder, and the path below it. The rows of a partition are ordered by name. A prefix that isn't
    there gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(dict(self.options))


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.extensions = tuple(f".{e.strip().lower()}" for e in options.get("extensions", "").split(",") if e.strip())
        self.levels = int(options.get("levels", 1))
        self.given = json.loads(options["prefixes"]) if "prefixes" in options else None

    def partitions(self) -> Sequence[Prefix]:
        if self.given is not None:
            return [Prefix(p.strip("/"), True) for p in dict.fromkeys(self.given)]
        store, base = opened(self.root)
        out, level = [], [""]
        for _ in range(self.levels):
            # Files that stand beside the sub-folders are a partition of their own.
            out += [Prefix(p, False) for p in level]
            level = sorted(posixpath.relpath(i.path, base) for p in level for i in store.get_file_info(fs.FileSelector(posixpath.join(base, p))) if i.type == fs.FileType.Directory)
        return out + [Prefix(p, True) for p in level]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        store, base = opened(self.root)
        below = posixpath.join(base, partition.prefix) if partition.prefix else base
        infos = store.get_file_info(fs.FileSelector(below, allow_not_found=True, recursive=partition.deep))
        found = [(posixpath.relpath(i.path, below), i.size) for i in infos if i.type == fs.FileType.File]
        found = sorted(f for f in found if not self.extensions or f[0].lower().endswith(self.extensions))
        for at in range(0, len(found), _ROWS):
            names = [n for n, _ in found[at : at + _ROWS]]
            paths = [posixpath.join(self.root, partition.prefix, n) if partition.prefix else posixpath.join(self.root, n) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([partition.prefix] * len(names)), pa.array(names), pa.array(paths), pa.array([s for _, s in found[at : at + _ROWS]], pa.int64())], ["prefix", "name", "path", "length"])


def listed(spark: SparkSession, folder: str, extensions: Sequence[str] = (), levels: int = 1, prefixes: Sequence[str] | None = None) -> DataFrame:
    """(prefix, name, path, length) of the files below a folder with one of the extensions, whatever their case; see Listing."""
    spark.dataSource.register(Listing)
    reader = spark.read.format("listing").option("extensions", ",".join(extensions)).option("levels", levels)
    if prefixes is not None:
        reader = reader.option("prefixes", json.dumps(list(prefixes)))
    return reader.load(folder)


def write_files(df: DataFrame, folder: str, name: Column, content: Column) -> DataFrame:
    """Write a file a row and give (name, length) of each, in one pass when the result is read.

    name is a path below the folder. A file is written under another name beside its own and then moved, so readers never see a
    part of one, and a task that runs again replaces the file with the same bytes. Null content is an empty file, rows
    without name are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        made: set[str] = set()
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for file, data in zip(names, batch.column("content")):
                target = posixpath.join(base, file)
                parent = posixpath.dirname(target)
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                raw = data.as_py() or b""
                aside = posixpath.join(parent, f".{uuid.uuid4().hex}")
                with store.open_output_stream(aside) as out:
                    out.write(raw)
                store.move(aside, target)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "length"])

    rows = df.select(name.cast("string").alias("name"), content.cast("binary").alias("content")).where(F.col("name").isNotNull())
    return rows.mapInArrow(work, "name string, length long")
