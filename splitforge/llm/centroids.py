"""Centroid clustering of embeddings on bit planes: exact integer distances from AND and popcount.

Components become integers, and those of a vector, less the least of all, are cut into bit planes: plane b holds bit b of
all 64 components in one 64-bit number. The dot product of a vector and a centroid is the sum over pairs of planes of
popcount(plane & plane) * 2**(b + c), so assignment takes no multiplication of components and no rounding. Moving all
components by the same amount changes no distance, so planes are those of numbers from 0 and as few as their range needs.

Planes are written once and every round reads them alone. A task sums the components of each cluster over its whole
partition and hands on a row a cluster; the driver sees the K centroids and their sums, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitforge.llm.shared import stored

#: Components of a vector, one bit of each in a plane; and what a component is multiplied with.
WIDTH, SCALE = 64, 256
#: Integers of a component are below 2**BITS either way, so that a squared distance is a 64-bit number.
BITS = 27
#: Vectors whose popcounts are taken at once.
_CHUNK = 1024


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes) of 64-bit numbers: the bit planes of rows of 64 numbers from 0 to 2**planes - 1."""
    out = np.empty((len(values), planes), np.uint64)
    for b in range(planes):
        bits = ((values >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def unpack(planes: np.ndarray) -> np.ndarray:
    """The rows of 64 numbers that pack() made the planes of."""
    out = np.zeros((len(planes), WIDTH), np.int64)
    for b in range(planes.shape[1]):
        column = np.ascontiguousarray(planes[:, b]).astype("<u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(column, axis=1, bitorder="little").astype(np.int64) << b
    return out


def dot_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows of x, rows of y) of dot products, from bit planes."""
    out = np.zeros((len(x), len(y)), np.int64)
    for s in range(x.shape[1] + y.shape[1] - 1):
        # At most 64 in each of the pairs of planes of one weight.
        count = np.zeros(out.shape, np.uint16)
        for b in range(max(0, s - y.shape[1] + 1), min(s + 1, x.shape[1])):
            count += np.bitwise_count(x[:, b, None] & y[None, :, s - b])
        out += count.astype(np.int64) << s
    return out


def nearest(planes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance to it) of every row; the smaller number of several."""
    own = unpack(centres)
    norms = (own * own).sum(axis=1)
    cluster, distance = np.empty(len(planes), np.int64), np.empty(len(planes), np.int64)
    for at in range(0, len(planes), _CHUNK):
        part = planes[at : at + _CHUNK]
        values = unpack(part)
        apart = (values * values).sum(axis=1)[:, None] - 2 * dot_products(part, centres) + norms[None, :]
        best = apart.argmin(axis=1)
        cluster[at : at + _CHUNK], distance[at : at + _CHUNK] = best, apart[np.arange(len(part)), best]
    return cluster, distance


def _rows(column: pa.Array, planes: int) -> np.ndarray:
    """The planes of a binary column whose values all have the same length."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), planes).astype(np.uint64)


def _kept(vector: Column) -> Column:
    """Whether a vector has 64 components, all of them finite numbers whose integers have no more than BITS bits."""
    fine = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float(1 << BITS) / SCALE), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) == WIDTH) & fine


def _planes(rows: DataFrame, lowest: int, planes: int) -> DataFrame:
    """(id, planes) of rows (id, ints)."""
    kind = dict(rows.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ints = batch.column("id"), batch.column("ints")
            values = np.asarray(ints.flatten(), np.int64).reshape(len(ids), WIDTH) - lowest
            raw = pack(values, planes).astype("<u8").tobytes()
            step = planes * 8
            yield pa.RecordBatch.from_arrays([ids, pa.array([raw[i * step : (i + 1) * step] for i in range(len(ids))], pa.binary())], ["id", "planes"])

    return rows.mapInArrow(work, f"id {kind}, planes binary")


def _sums(rows: DataFrame, centres: np.ndarray, kind: str) -> list:
    """(cluster, n, sums by component) of the clusters that get vectors; sums are of the numbers from 0, of type `kind`."""
    planes, k = centres.shape[1], len(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64)
        for batch in batches:
            part = _rows(batch.column("planes"), planes)
            cluster, _ = nearest(part, centres)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(unpack(part)[order], first, axis=0)
            n += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = rows.select("planes").mapInArrow(work, "cluster int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast(kind)).alias(f"s{i}") for i in range(WIDTH)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()


def clusters(df: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors of exactly 64 components, none null or non-finite; component x becomes floor(256 * x). Centroids 0,
    1, ... start as the k vectors of least sha256 of "<seed>:<id>"; each round assigns every vector to the nearest one
    (squared distance; of several the smaller number) and moves each non-empty centroid to the componentwise floor of its
    vectors' mean; then vectors are assigned once more. cluster_inertia and inertia are distances summed over the
    cluster and over all, centroid_sha256 is of the centroid's decimal components joined by commas.

    Vectors with an integer of 2**27 or more either way are left out too: their squared distance may be no 64-bit
    number. Rows without id are assigned but start no centroid; rows repeated with one id are vectors of their own, the
    starts among them in the order of their components. Fewer than k vectors start fewer centroids; an empty table,
    or one in which no vector with an id is kept, gives no rows. Further columns are ignored.
    """
    ints = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * SCALE).cast("int"))
    rows = df.where(_kept(F.col(vector_col).cast("array<double>"))).select(F.col(id_col).alias("id"), ints.alias("ints"))
    lowest, highest, n = rows.agg(F.min(F.array_min("ints")), F.max(F.array_max("ints")), F.count("*")).first()
    empty = rows.select(F.col("id").alias(id_col), *(F.lit(0).cast(t).alias(c) for c, t in _RESULT.items())).limit(0)
    if lowest is None:
        return empty
    planes = max(1, int(highest - lowest).bit_length())
    packed = stored(_planes(rows, lowest, planes), "planes")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    # The k least of a sort key: each task keeps k rows, so k rows a task reach the driver.
    starts = packed.where("id IS NOT NULL").withColumn("key", key).orderBy("key", "planes").limit(k).select("planes").collect()
    if not starts:
        return empty
    centres = np.concatenate([np.frombuffer(bytes(r[0]), "<u8") for r in starts]).reshape(len(starts), planes).astype(np.uint64)
    kind = "long" if n << planes < 1 << 63 else "decimal(38,0)"
    for _ in range(rounds):
        values = unpack(centres)
        for row in _sums(packed, centres, kind):
            # The floor of the mean moves with the components.
            values[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(WIDTH)]
        centres = pack(values, planes)
    return _assigned(packed, centres, lowest, id_col)


_RESULT = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}


def _assigned(packed: DataFrame, centres: np.ndarray, lowest: int, id_col: str) -> DataFrame:
    planes, kind = centres.shape[1], dict(packed.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_rows(batch.column("planes"), planes), centres)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    found = stored(packed.mapInArrow(work, f"id {kind}, cluster int, distance long"), "assigned")
    inertia = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}
    shown = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in (unpack(centres) + lowest).tolist()]
    # One row a centroid.
    table = [(c, total, sum(inertia.values()), shown[c]) for c, total in inertia.items()]
    names = packed.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.withColumnRenamed("id", id_col).join(F.broadcast(names), "cluster").select(id_col, *_RESULT)
