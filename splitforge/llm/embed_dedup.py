"""Near-duplicate embeddings by tile products of int8 vectors with rigorous error bounds.

Equal vectors are collapsed first, by two 64-bit hashes, so vectors are shuffled to be collapsed and into tiles, and
what is found goes back to the rows by hash. The vectors of a label are dealt into tiles of bounded size, and each pair of
tiles of a label meets in one task: the unit vectors are quantised to int8 with the exact norm of each vector's
quantisation error, the integer products of the tiles are taken at once, and by the bound on the error only pairs that
could reach the threshold are computed again in double precision. A task gives sums of links and a spanning forest of
its links, not pairs, so a group of near copies of any size gives as many rows as vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitforge.llm.components import components
from splitforge.llm.near_dedup import roots
from splitforge.llm.shared import stored

#: Vectors of a tile, about.
TILE = 2048
#: Pairs computed in double precision at once.
_CHUNK = 50_000


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values as floats, scales, norms of the quantised vectors, norms of the errors) of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def similar_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows of x, rows of y, pairs computed again) of all pairs whose cosine reaches the threshold in doubles."""
    ux, uy = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    qx, sx, nx, ex = quantise(ux)
    qy, sy, ny, ey = quantise(uy)
    # Sums of up to 1040 products of int8 are exact in single precision.
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    about = (qx.astype(kind) @ qy.astype(kind).T).astype(np.float64) * sx[:, None] * sy[None, :]
    bound = about + nx[:, None] * ey[None, :] + ex[:, None] * (ny + ey)[None, :]
    a, b = np.nonzero(bound >= threshold - 1e-9)
    keep = np.zeros(len(a), bool)
    for i in range(0, len(a), _CHUNK):
        part = slice(i, i + _CHUNK)
        keep[part] = np.einsum("ij,ij->i", ux[a[part]], uy[b[part]]) >= threshold
    return a[keep], b[keep], len(a)


def _valid(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers, and isn't zero."""
    fine = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0)


def groups(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every vector: links are cosines >= threshold within a label.

    n_links counts the other vectors linked directly, component_id is the least id that links lead to, kept marks the
    row with that id; ids may be of any type with an order. Vectors that are null, empty, zero or hold null or non-finite components, and rows without label
    or id, link with nothing; vectors of different lengths don't either. Repeated rows are vectors of their own with
    one id. An empty table gives no rows; further columns are ignored.
    """
    usable = _valid(F.col(vector_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    kind, label_kind, key = dict(df.dtypes)[id_col], dict(df.dtypes)[label_col], ["label", "hash_a", "hash_b"]
    base = df.select(F.col(id_col).alias("id"), F.when(usable, F.col(label_col)).alias("label"), F.when(usable, F.col(vector_col).cast("array<double>")).alias("vec"))
    base = base.withColumns({"hash_a": F.when(F.col("vec").isNotNull(), F.xxhash64("vec")), "hash_b": F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit("b"), "vec"))})
    reps = stored(base.where("vec IS NOT NULL").groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "vectors")
    cells = reps.select(*key, F.size("vec").alias("dim"), "rep", "copies", "vec")
    tiles = cells.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = cells.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    dealt = dealt.select(*key, "dim", "rep", "copies", "vec", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select(*key, "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "rep", "copies", "vec")

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("rep").combine_chunks()
        copies, tile, first, last = (np.asarray(table.column(c), np.int64) for c in ("copies", "tile", "i", "j"))
        vectors = np.asarray(table.column("vec").chunk(0).flatten(), np.float64).reshape(len(ids), -1)
        left, right = np.flatnonzero(tile == first), np.flatnonzero(tile == last)
        links, froms, tos = np.zeros(len(ids), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(left) and len(right):
            a, b, _ = similar_pairs(vectors[left], vectors[right], threshold)
            a, b = left[a], right[b]
            if first[0] == last[0]:
                a, b = a[a < b], b[a < b]
            links += np.bincount(a, copies[b], len(ids)).astype(np.int64) + np.bincount(b, copies[a], len(ids)).astype(np.int64)
            root = roots(len(ids), a, b)
            froms = np.flatnonzero(root != np.arange(len(ids)))
            tos = root[froms]
        some = np.flatnonzero(links)
        to = pa.concat_arrays([pa.nulls(len(some), ids.type), ids.take(pa.array(tos))])
        own = pa.array(np.concatenate([some, froms]))
        return pa.table({**{c: table.column(c).take(own) for c in key}, "id": ids.take(own), "links": np.concatenate([links[some], np.zeros(len(froms), np.int64)]), "to": to})

    found = stored(dealt.groupBy("label", "dim", "i", "j").applyInArrow(work, f"label {label_kind}, hash_a long, hash_b long, id {kind}, links long, to {kind}"), "tiles")
    linked = found.where("to IS NULL").groupBy(*key).agg(F.sum("links").alias("links"))
    placed = components(found.where("to IS NOT NULL").select(F.col("id").alias("a"), F.col("to").alias("b")))
    named = reps.select(*key, "rep", "copies").join(linked, key, "left").join(placed, F.col("rep") == F.col("id"), "left")
    named = named.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = base.drop("vec").join(named, key, "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
