"""Structured Streaming forms of quota collection, de-duplication and record unnesting."""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Groups of hashes that the seen-set is dealt into, by their first hexadecimal digits.
HASH_DIGITS = 3


class _Quota(StatefulProcessor):
    """Lets pass the records of each key as long as the key's quota lasts. The state is what is left of it, which begins
    with the table of caps; a key without one lets nothing pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", StructType([StructField("n", LongType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.left.update((int(initialState["cap"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        left = self.left.get()[0] if self.left.exists() else 0
        for part in rows:
            taken = part.iloc[:left]
            left -= len(taken)
            if len(taken):
                yield taken
        self.left.update((left,))

    def close(self) -> None:
        pass


def caps_by_kind(keys: DataFrame, held: DataFrame, cap: Column, held_cap: Column, key: str = "key") -> DataFrame:
    """(key, cap): the cap of each key, another one for the keys that are held out."""
    marked = keys.join(held.select(key).distinct().withColumn("__held", F.lit(True)), key, "left")
    return marked.select(key, F.when(F.col("__held"), held_cap).otherwise(cap).cast("long").alias("cap"))


def stream_quota(rows: DataFrame, caps: DataFrame, key: str = "key") -> DataFrame:
    """The rows of a stream that arrive while their key is below its cap; which ones depends on their arrival.

    caps: a table of (key, cap), each key once; keys without a cap are left out. It is the initial state, so nothing of it is
    broadcast, and only a number a key is kept. The state store must be RocksDB.
    """
    start = caps.select(key, F.col("cap").cast("long")).groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=_Quota(), outputStructType=rows.schema, outputMode="Append", timeMode="None", initialState=start)


@dataclass(frozen=True)
class Ended:
    """How a collection ended: whether all quotas are full, how many records it took, and in how many batches."""

    full: bool
    taken: int
    batches: int


class _Full(StreamingQueryListener):
    """Sums the records that the batches of one query took, and says when they are enough."""

    def __init__(self, name: str, wanted: int):
        self.name, self.wanted, self.taken, self.batches = name, wanted, 0, 0
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        self.taken += row["taken"] or 0
        self.batches += event.progress.numInputRows > 0
        if self.taken >= self.wanted:
            self.ended.set()

    def onQueryTerminated(self, event) -> None:
        pass


def collect_until_full(rows: DataFrame, caps: DataFrame, path: str, checkpoint: str, timeout: float, key: str = "key") -> Ended:
    """Collect a stream into `path` as Parquet until every key of `caps` has as many records as its cap, or for `timeout` seconds.

    The stream needs no end: a listener sums what each batch took, and the query is stopped once all quotas are full;
    batches that had begun by then take nothing. After a stop the same call goes on from the checkpoint.
    """
    spark = rows.sparkSession
    wanted = caps.agg(F.coalesce(F.sum("cap"), F.lit(0))).first()[0]
    name = f"quota-{threading.get_ident()}-{id(caps)}"
    schema = rows.schema
    try:
        before = spark.read.schema(schema).parquet(path).count()
    except Exception as e:  # the folder isn't there before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = 0
    listener = _Full(name, wanted - before)
    if before >= wanted:
        return Ended(True, before, 0)
    spark.streams.addListener(listener)
    try:
        kept = stream_quota(rows, caps, key).observe(name, F.count(F.lit(1)).alias("taken"))
        query = kept.writeStream.format("parquet").option("checkpointLocation", checkpoint).start(path)
        waited = 0.0
        while query.isActive and not listener.ended.wait(0.05) and waited < timeout:
            waited += 0.05
        query.stop()
        if query.exception() is not None:
            raise query.exception()
    finally:
        spark.streams.removeListener(listener)
    return Ended(listener.ended.is_set(), before + listener.taken, listener.batches)


def shortfall(caps: DataFrame, collected: DataFrame, key: str = "key") -> DataFrame:
    """(key, cap, taken, missing) of every key with a cap."""
    taken = collected.groupBy(key).agg(F.count("*").alias("__taken"))
    n = F.coalesce("__taken", F.lit(0))
    return caps.join(taken, key, "left").select(key, "cap", n.cast("long").alias("taken"), F.greatest(F.col("cap") - n, F.lit(0)).cast("long").alias("missing"))


def batch_quota(rows: DataFrame, cap: int, order: Sequence[str], key: str = "key") -> DataFrame:
    """The same on a table: the first `cap` rows of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= cap).drop("__rank")


class _Seen(StatefulProcessor):
    """The hashes that a group has seen, each with the time after which it may be forgotten."""

    def __init__(self, order: str, keep: int | None):
        self.order, self.keep = order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = StructType([StructField("hash", StringType())])
        self.seen = handle.getMapState("seen", text, StructType([StructField("n", LongType())]), self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The first row of each hash in the whole batch: parts of it come in any order.
        firsts: pd.DataFrame | None = None
        for part in rows:
            both = part if firsts is None else pd.concat([firsts, part])
            firsts = both.sort_values(self.order, kind="stable").drop_duplicates("seen_hash")
        if firsts is None:
            return
        fresh = [not self.seen.containsKey((h,)) for h in firsts["seen_hash"]]
        for h in firsts["seen_hash"][fresh]:
            self.seen.updateValue((h,), (1,))
        if any(fresh):
            yield firsts[fresh].drop(columns=["seen_group", "seen_hash"])

    def close(self) -> None:
        pass


def stream_dedup(rows: DataFrame, key: Column, order: str, keep_ms: int | None = None) -> DataFrame:
    """A stream without rows whose key was seen before; of equal keys in one batch the row first in `order` stays.

    key: a hexadecimal hash of the content. The seen-set holds full hashes in groups of their first digits, so no time
    column is needed and no key forgotten; keep_ms bounds it to keys seen within so many milliseconds. A task holds the
    distinct rows of a group in one batch. The state store must be RocksDB.
    """
    keyed = rows.withColumn("seen_hash", key).withColumn("seen_group", F.substring("seen_hash", 1, HASH_DIGITS))
    return keyed.groupBy("seen_group").transformWithStateInPandas(statefulProcessor=_Seen(order, keep_ms), outputStructType=rows.schema, outputMode="Append", timeMode="None" if keep_ms is None else "ProcessingTime")


def unnested(rows: DataFrame, group: str = "group", real: str = "image", generated: Sequence[str] = ("image_gen0", "image_gen1", "image_gen2", "image_gen3")) -> DataFrame:
    """(group, origin, payload): of each record the real and the generated payloads that aren't null; batch or stream."""
    parts = [F.struct(F.lit("real").alias("origin"), F.col(real).alias("payload")), *(F.struct(F.lit(f"gen{i}").alias("origin"), F.col(c).alias("payload")) for i, c in enumerate(generated))]
    return rows.select(group, F.explode(F.array(*parts)).alias("r")).select(group, "r.origin", "r.payload").where("payload IS NOT NULL")
