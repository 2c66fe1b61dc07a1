"""Sources: file listings, manifests, columnar datasets and metric tables as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splitforge.sources.listing import listed

#: Extensions of image files, and folder names that stand for a label.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")
MORE_EXTENSIONS = (*EXTENSIONS, "tif", "tiff")
FOLDERS = {"real": 0, "nature": 0, "0_real": 0, "fake": 1, "ai": 1, "generated": 1, "1_fake": 1}
MANIFEST = "image_path string, label int"
WIDE_MANIFEST = {"image_path": None, "label": None, "dataset": "", "generator": "", "source": "", "orig_w": 0, "orig_h": 0}


def files(spark: SparkSession, folder: str, extensions: Sequence[str] = EXTENSIONS, content: bool = False) -> DataFrame:
    """(path, length[, content]) of the files below a folder with one of the extensions, whatever their case.

    Without content the folder is listed in tasks and no file is read. No matching file gives no rows.
    """
    if not content:
        return listed(spark, folder, extensions).select("path", "length")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    return rows.select("path", "length", "content")


def labelled_folders(spark: SparkSession, root: str, folders: dict[str, int] | None = None, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(path, label) by the name of the parent folder; unknown folders are left out; <root>/train is preferred.

    An error when no folder matches.
    """
    rows = files(spark, root, extensions)
    below = F.regexp_replace("path", r"/[^/]*$", "")
    rows = rows.withColumn("folder", F.lower(F.regexp_extract(below, r"([^/]+)$", 1))).withColumn("in_train", F.col("path").contains(root.rstrip("/").rsplit("/", 1)[-1] + "/train/"))
    names = spark.createDataFrame(list((folders or FOLDERS).items()), "folder string, label int")
    named = rows.join(F.broadcast(names), "folder")
    train = named.agg(F.max("in_train")).first()[0]
    if train is None:
        raise ValueError(f"no folder below {root} has a known name")
    return (named.where("in_train") if train else named).select("path", "label")


@dataclass(frozen=True)
class NamedSource:
    """Rows of one origin: which they are, their label (null: not known), whether the origin is held out, and how many are
    taken at most."""

    name: str
    applies: Column
    label: int | None
    held_out: bool
    first: int | None = None


def named_sources(rows: DataFrame, sources: Sequence[NamedSource], dataset: str, order: Sequence[str] = (), check: bool = False) -> DataFrame:
    """The rows of all sources with dataset, source, label, held_out and source_rank, from one scan; at most `first` rows of a
    source, in the given order. A row that several sources apply to stands in each; columns of these names are replaced.

    check: a source without rows is an error (one pass that counts).
    """
    if not sources:
        raise ValueError("no sources")
    if any(s.first is not None for s in sources) and not order:
        raise ValueError("the first rows of a source need an order")
    table = rows.sparkSession.createDataFrame([(i, s.name, s.label, s.held_out, s.first) for i, s in enumerate(sources)], "source_rank int, source string, label int, held_out boolean, __first long")
    hits = F.filter(F.array(*(F.when(s.applies, F.lit(i)) for i, s in enumerate(sources))), lambda i: i.isNotNull())
    added = {"source_rank", "source", "label", "held_out", "dataset"}
    tagged = rows.select(*(c for c in rows.columns if c not in added), F.explode(hits).alias("source_rank")).join(F.broadcast(table), "source_rank")
    if check:
        there = {r[0] for r in tagged.select("source").distinct().collect()}
        if missing := [s.name for s in sources if s.name not in there]:
            raise ValueError(f"no rows of {', '.join(missing)}")
    bounds = [s.first for s in sources if s.first is not None]
    if bounds:
        # A constant bound beside the source's own: each task keeps no more than that of a source before the shuffle.
        limited = tagged.where("__first IS NOT NULL").withColumn("__rank", F.row_number().over(Window.partitionBy("source_rank").orderBy(*order))).where(F.col("__rank") <= max(bounds)).where("__rank <= __first").drop("__rank")
        tagged = limited if len(bounds) == len(sources) else limited.unionByName(tagged.where("__first IS NULL"))
    return tagged.drop("__first").withColumn("dataset", F.lit(dataset))


def strict_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of exactly image_path,label; another header, a label that is no number, or no rows are errors."""
    header = spark.read.text(path).first()
    if header is None or header[0].strip() != "image_path,label":
        raise ValueError(f"{path} has not the header image_path,label")
    rows = spark.read.csv(path, header=True, schema=MANIFEST, enforceSchema=False, mode="FAILFAST")
    if not rows.take(1):
        raise ValueError(f"{path} has no rows")
    return rows


def lenient_manifest(rows: DataFrame) -> DataFrame:
    """The columns of the wide manifest; missing ones and nulls become '' or 0, a label outside 0 and 1 is an error."""
    missing = [c for c, fill in WIDE_MANIFEST.items() if fill is None and c not in rows.columns]
    if missing:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    label = F.col("label").cast("int")
    checked = F.when(label.isin(0, 1), label).otherwise(F.raise_error(F.lit("a label is neither 0 nor 1")).cast("int"))
    shown = {c: F.coalesce(F.col(c), F.lit(fill)) if c in rows.columns else F.lit(fill) for c, fill in WIDE_MANIFEST.items() if fill is not None}
    return rows.select("image_path", checked.alias("label"), *(v.alias(c) for c, v in shown.items()))


def detected(rows: DataFrame, keys: Sequence[str] = ("generator", "model", "label"), payload_types: Sequence[str] = ("binary",), payload_names: Sequence[str] = ("image",)) -> DataFrame:
    """(key, payload): the first candidate key of the schema, and the first column of a payload type (of the names first)."""
    kinds = dict(rows.dtypes)
    key = next((k for k in keys if k in kinds), None)
    named = [c for c in payload_names if kinds.get(c, "").startswith(tuple(payload_types) + ("struct<origin",))]
    payload = next(iter([*named, *(c for c, t in rows.dtypes if t in payload_types and c != key)]), None)
    if key is None or payload is None:
        raise ValueError(f"no key or payload column among {', '.join(rows.columns)}")
    return rows.select(F.col(key).cast("string").alias("key"), F.col(payload).alias("payload"))


def metric_table(spark: SparkSession, path: str, keys: Sequence[str] = ("transformation", "parameter")) -> DataFrame:
    """A CSV of metrics; all columns but the keys are doubles."""
    header = spark.read.text(path).first()[0].strip().split(",")
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` {'string' if c in keys else 'double'}" for c in header))


def metric_json(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """Metrics from JSON: an object on each line, or with `whole` one object or array in each file."""
    return spark.read.json(path, schema=schema, multiLine=whole)


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(path, digest) of all files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.select("path", F.sha2("content", 256).alias("digest"))
