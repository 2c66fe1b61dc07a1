"""The relations that the plans start from, as DataFrames and as the same relations in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitforge.functions import columns as C
from splitforge.operators import sampling

SEED = 42
#: Lengths of the given vectors, for which kernels are built.
LENGTHS = (64,)
HELD_GENERATORS, HELD_SOURCES = ("g8", "g9"), ("s4",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share, spark.checkpoint.dir. Where that is unset a
    temporary folder serves, in local mode only: executors of a cluster couldn't read it."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df written to a new shared path and read again, for a plan that reads them several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of this kind needs this provider; the session's own is set again at the end."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


def names(spark: SparkSession, column: str, values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with features: label 1 has a generator, label 0 a source."""
    rows = table(spark, sf_dir, "embeddings")
    y = F.col("label") >= 5
    return rows.select(
        F.col("vec_id").alias("sample_id"), y.cast("int").alias("label"), F.when(y, F.concat(F.lit("g"), "label")).alias("generator"),
        F.when(~y, F.concat(F.lit("s"), "label")).alias("source"), F.col("embedding").cast("array<double>").alias("features"),
    )


VECTORS = """vectors AS (SELECT vec_id AS sample_id, CAST(label >= 5 AS INT) AS label, CASE WHEN label >= 5 THEN 'g' || label END AS generator,
  CASE WHEN label < 5 THEN 's' || label END AS source, embedding::DOUBLE[] AS features FROM embeddings)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a size and a content hash; label is null where nothing is labelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", C.content_hash("text").alias("content_hash"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("label"), "source", "lang", F.col("n_chars").alias("size"), "content_hash")


TEXTS = """texts AS (SELECT d.doc_id AS sample_id, l.quality AS label, d.source, d.lang, d.n_chars AS size, sha256(d.text) AS content_hash
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors without features, split 80/10/10 by class, with a content hash and a group of a few samples each."""
    rows = vectors(spark, sf_dir).withColumn("content_hash", C.perceptual_key("features")).drop("features")
    rows = rows.withColumn("group", F.concat(F.lit("q"), F.col("sample_id") % 97))
    return sampling.stratified_split(rows, SEED)


def hash_sql(seed, *parts) -> str:
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"sha256(concat_ws('|', '{seed}', {inner}))"


def uniform_sql(*parts) -> str:
    return f"((CAST('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT) + 1) / 1152921504606846977.0)"


_KEY = """array_to_string(list_transform(range(0, CAST(len(features) / 4 AS BIGINT)), lambda i: format('{:x}', CAST(list_sum(list_transform(range(0, 4),
  lambda j: CASE WHEN features[i * 4 + j + 1] > (list_sort(features)[len(features) // 2] + list_sort(features)[len(features) // 2 + 1]) / 2 THEN 8 >> CAST(j AS INT) ELSE 0 END)) AS BIGINT))), '')"""

KEYED = f"""keyed AS (SELECT sample_id, label, generator, source, {_KEY} AS content_hash, 'q' || (sample_id % 97) AS "group" FROM vectors)"""

SPLITS = f"""splits AS (SELECT sample_id, label, generator, source, content_hash, "group",
  CASE WHEN r <= round_even(n * 0.8, 0) THEN 'train' WHEN r <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(SEED, 'label', 'sample_id')}, sample_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM keyed))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two models under three conditions: drawn numbers, pulled towards the label, with many ties."""
    rows = vectors(spark, sf_dir).select("sample_id", "label", "generator", "source", (F.col("sample_id") * 37 % 2048).alias("size"))
    models = names(spark, "model", ("baseline", "robust"))
    conditions = spark.createDataFrame([("clean", "-"), ("blur", "sigma1.0"), ("noise", "sigma0.05")], "name string, param string")
    every = rows.crossJoin(F.broadcast(models)).crossJoin(F.broadcast(conditions))
    p = F.round((C.uniform(SEED, F.col("model"), F.col("name"), F.col("sample_id")) * 2 + F.col("label")) / 3, 3)
    return every.withColumn("p", p).withColumn("pred", C.predict("p"))


SCORED = f"""scored AS (SELECT *, CAST(p >= 0.5 AS INT) AS pred FROM (SELECT v.sample_id, v.label, v.generator, v.source, v.sample_id * 37 % 2048 AS size, m.model, c.name, c.param,
  round(({uniform_sql("'42'", 'm.model', 'c.name', 'CAST(v.sample_id AS VARCHAR)')} * 2 + v.label) / 3, 3) AS p
  FROM vectors v CROSS JOIN (VALUES ('baseline'), ('robust')) m(model) CROSS JOIN (VALUES ('clean', '-'), ('blur', 'sigma1.0'), ('noise', 'sigma0.05')) c(name, param)))"""

_P = "sum(CASE WHEN label = {0} AND pred = {1} THEN 1 ELSE 0 END)"


def metrics_sql(source: str, by: str = "") -> str:
    """Confusion counts and scores of a relation by some keys, as a query."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    inner = f"SELECT {keys}CAST({_P.format(0, 0)} AS BIGINT) AS tn, CAST({_P.format(0, 1)} AS BIGINT) AS fp, CAST({_P.format(1, 0)} AS BIGINT) AS fn, CAST({_P.format(1, 1)} AS BIGINT) AS tp FROM {source}{group}"
    return f"""SELECT *, tn + fp + fn + tp AS n, (tp + tn) / (tn + fp + fn + tp) AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS "precision",
      CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM ({inner})"""


def auc_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, CASE WHEN np > 0 AND nn > 0 THEN (rs - np * (np + 1) / 2) / (np * nn) END AS roc_auc FROM (
      SELECT {by}, sum(CASE WHEN label = 1 THEN mid ELSE 0 END) AS rs, CAST(sum(label) AS DOUBLE) AS np, CAST(sum(1 - label) AS DOUBLE) AS nn FROM (
        SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS mid FROM {source}) GROUP BY {by})"""
