"""Token-id files of patched frame-of-reference blocks.

A file section holds the ids of consecutive documents. Its ids are cut into blocks of BLOCK ids; each block stores
its minimum, a bit width that a percentile of its offsets from the minimum fits, the offsets packed at that width,
and the offsets that don't fit in an exception list. A table of block starts lets a reader unpack any range of ids
without the blocks before it, and a table of document sizes finds each document.

Layout of a section (little-endian): magic, documents, ids, blocks, exceptions (5 x u4) | ids of each document
(u4) | minimum of each block (u4) | width (u1) | exceptions (u2) | start of the packed words (u4, in 8-byte words)
| exception positions in their block (u2) | exception offsets (u4) | packed words (u8).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitforge.llm import bpe
from splitforge.llm.shared import new_path

MAGIC, BLOCK = 0x31464F50, 256
#: Offsets up to this percentile of a block decide its width.
PERCENTILE = 0.95
#: Ids of a section at most, but for one longer document.
SECTION = 1_000_000


def pack(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """A section of the ids of len(sizes) documents."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    table = np.full(blocks * BLOCK, 0, np.uint64)
    table[:n] = ids
    if n < len(table):
        table[n:] = ids[-1]
    table = table.reshape(blocks, BLOCK)
    low = table.min(axis=1) if blocks else np.empty(0, np.uint64)
    table = table - low[:, None]
    at = min(BLOCK - 1, int(PERCENTILE * BLOCK))
    bound = np.partition(table, at, axis=1)[:, at] if blocks else low
    width = np.ceil(np.log2(bound.astype(np.float64) + 1)).astype(np.uint8)
    over = (table >> width[:, None].astype(np.uint64)) > 0
    row, place = np.nonzero(over)
    exceptions = table[row, place].astype("<u4")
    words = width.astype(np.int64) * (BLOCK // 64)
    starts = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    packed = np.zeros(starts[-1], np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        values = np.ascontiguousarray((table[own] & np.uint64((1 << w) - 1)).T)
        out = np.zeros((w * (BLOCK // 64), len(own)), np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            out[word] |= values[j] << np.uint64(shift)
            if shift + w > 64:
                out[word + 1] |= values[j] >> np.uint64(64 - shift)
        packed[(starts[own][:, None] + np.arange(out.shape[0])).ravel()] = out.T.ravel()
    head = np.array([MAGIC, len(sizes), n, blocks, len(row)], "<u4")
    parts = [head, sizes.astype("<u4"), low.astype("<u4"), width, np.bincount(row, minlength=blocks).astype("<u2"), starts[:-1].astype("<u4"), place.astype("<u2"), exceptions, packed.astype("<u8")]
    return b"".join(p.tobytes() for p in parts)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document) of a section; ValueError if it isn't one."""
    head = np.frombuffer(data, "<u4", 5)
    if head[0] != MAGIC:
        raise ValueError("not a section of a token file")
    docs, n, blocks, over = (int(x) for x in head[1:])
    at = 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    sizes, low, width, many, starts = take("<u4", docs), take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u4", blocks)
    place, exceptions = take("<u2", over), take("<u4", over)
    packed = np.frombuffer(data, "<u8", (len(data) - at) // 8, at)
    table = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        words = np.ascontiguousarray(packed[starts[own].astype(np.int64)[:, None] + np.arange(w * (BLOCK // 64))].T)
        values, mask = np.empty((BLOCK, len(own)), np.uint32), np.uint64((1 << w) - 1)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            value = words[word] >> np.uint64(shift)
            if shift + w > 64:
                value = value | (words[word + 1] << np.uint64(64 - shift))
            values[j] = value & mask
        table[own] = values.T
    table[np.repeat(np.arange(blocks), many), place] = exceptions
    return (table + low[:, None]).ravel()[:n], sizes


def write(df: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts, append end_id to each, and write the ids in ascending id order below `path`.

    Rows are dealt by ranges of id_col and sorted within them, so the files follow one another in id order; each file
    is a Parquet container of sections (first_id, before: ids of the file before it, doc_ids, tokens, data). Null texts count as empty, rows
    with one id stay apart and are ordered by text, a null id comes first, an empty table gives no section.
    """
    name = bpe.share(df, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load_shared(name)
        keys, ids, sizes, total, before = [], [], [], 0, 0

        def section() -> pa.RecordBatch:
            data = pack(np.concatenate(ids), np.concatenate(sizes))
            own = pa.chunked_array(keys).combine_chunks()
            columns = [own.slice(0, 1), pa.array([before], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([total], pa.int64()), pa.array([data], pa.binary())]
            return pa.record_batch(columns, names=["first_id", "before", "doc_ids", "tokens", "data"])

        for batch in batches:
            for part, texts in bpe.texts_of(batch, "__text"):
                found, at = coder.encode(texts)
                found = np.insert(found, at[1:], np.uint32(end_id))
                keys.append(part.column(0))
                ids.append(found)
                sizes.append(np.diff(at) + 1)
                total += len(found)
                if total >= SECTION:
                    yield section()
                    keys, ids, sizes, total, before = [], [], [], 0, before + total
        if keys:
            yield section()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    kind = dict(rows.dtypes)["id"]
    parted = rows.repartitionByRange(F.col("id")).sortWithinPartitions("id", "__text")
    packed = parted.mapInArrow(work, f"first_id {kind}, before long, doc_ids array<{kind}>, tokens long, data binary")
    # The sections are packed bits already.
    packed.withColumn("file", F.spark_partition_id()).write.option("compression", "uncompressed").parquet(path)


def offsets(sections: DataFrame) -> DataFrame:
    """(file, start): how many ids the files before each one hold. One row a file, however many documents."""
    totals = sections.groupBy("file").agg(F.min("first_id").alias("first_id"), F.sum("tokens").alias("tokens"))
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))


def read(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document (id_col, start, n_tokens, ids_crc32) from the sections of a token-file table.

    start counts the ids of all documents before it. Sections are unpacked where they are read; only small rows of
    documents and one total a file are shuffled.
    """
    kind = dict(df.dtypes)["first_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                file, before, docs, data = (batch.column(i)[row] for i in range(4))
                ids, sizes = unpack(data.as_py())
                at = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                data = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(data[a:b]) for a, b in zip((at[:-1] * 4).tolist(), (at[1:] * 4).tolist())]
                columns = [docs.values, pa.array([file.as_py()] * len(sizes), pa.int32()), pa.array(at[:-1] + before.as_py()), pa.array(sizes.astype(np.int64)), pa.array(sums, pa.int64())]
                yield pa.record_batch(columns, names=["id", "file", "inside", "n_tokens", "ids_crc32"])

    docs = df.select("file", "before", "doc_ids", "data").mapInArrow(work, f"id {kind}, file int, inside long, n_tokens long, ids_crc32 long")
    return docs.join(offsets(df), "file").select(F.col("id").alias(id_col), (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(df: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write() to a new path in the shared folder, then read()."""
    spark = df.sparkSession
    path = new_path(spark, "tokens")
    write(df, path, vocabulary, end_id, id_col, text_col)
    return read(spark.read.parquet(path), id_col)
