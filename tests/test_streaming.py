import time

import pytest
from pyspark.sql import functions as F

from splitforge.streaming import streams


def collected(df, name, spark, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("key"), F.col("event_id").alias("record"))


def arriving(spark, rows, path, files):
    rows.repartition(files, "record").write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_quota_stops_at_the_cap_and_passes_over_keys_without_one(spark, tmp_path):
    rows = events(spark)
    there = {r.key: r["count"] for r in rows.groupBy("key").count().collect()}
    caps = spark.createDataFrame([(k, 30 if k == "click" else 7) for k in there if k != "view"], "key string, cap int")
    stream = arriving(spark, rows, str(tmp_path / "in"), 3)
    found = collected(streams.stream_quota(stream, caps), "quota", spark).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in found} == {k: min(n, 30 if k == "click" else 7) for k, n in there.items() if k != "view"}


def test_a_stream_without_end_ends_when_all_quotas_are_full_and_goes_on_after_a_stop(spark, tmp_path):
    rows, path, state = events(spark), str(tmp_path / "out"), str(tmp_path / "state")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    caps = streams.caps_by_kind(counts, spark.createDataFrame([("click",)], "key string"), F.floor(F.col("n") / 3), F.lit(1))
    stream = arriving(spark, rows.where("record % 5 = 0"), str(tmp_path / "in"), 2)
    first = streams.collect_until_full(stream, caps, path, state, timeout=12)
    assert not first.full and first.batches == 2
    missing = {r.key: r.missing for r in streams.shortfall(caps, spark.read.parquet(path)).collect()}
    assert sum(missing.values()) > 0 and missing["click"] == 0
    arriving(spark, rows.where("record % 5 != 0"), str(tmp_path / "in"), 8)
    second = streams.collect_until_full(stream, caps, path, state, timeout=120)
    assert second.full and second.batches < 8
    report = streams.shortfall(caps, spark.read.parquet(path)).collect()
    assert all(r.taken == r.cap and r.missing == 0 for r in report) and {r.key: r.cap for r in report}["click"] == 1
    assert streams.collect_until_full(stream, caps, path, state, timeout=1).batches == 0


def test_a_failing_stream_is_no_silent_end(spark, tmp_path):
    stream = arriving(spark, events(spark), str(tmp_path / "in"), 1).withColumn("record", F.raise_error(F.lit("broken")).cast("long"))
    caps = spark.createDataFrame([("click", 5)], "key string, cap long")
    with pytest.raises(Exception, match="broken"):
        streams.collect_until_full(stream, caps, str(tmp_path / "out"), str(tmp_path / "state"), timeout=60)


def texts(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(path)


def test_seen_set_keeps_the_first_of_equal_texts_over_batches_and_restarts(spark, tmp_path):
    path, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for rows in ([(4, "a"), (2, "b"), (1, "a")], [(5, "b"), (6, "c"), (7, "c"), (8, None)], [(9, "a"), (10, "d")]):
        stream = streams.stream_dedup(texts(spark, rows, path), F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id")
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()
        time.sleep(0.01)
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2, 6, 8, 10]
    assert sum(s.numRowsTotal for s in query.lastProgress.stateOperators) == 5


def test_seen_set_forgets_after_its_time(spark, tmp_path):
    path, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for n, rows in enumerate(([(1, "a")], [(2, "a")]), 1):
        stream = streams.stream_dedup(texts(spark, rows, path), F.sha2("text", 256), "doc_id", keep_ms=1)
        # With a time to live there are always batches to come, so such a stream has no end of its own.
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).start(out)
        for _ in range(300):
            time.sleep(0.1)
            if query.lastProgress and spark.read.schema("doc_id long").parquet(out).count() == n:
                break
        query.stop()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_unnesting_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "y", None, None, "z"), ("b", None, None, None, None, None)], "group string, image string, image_gen0 string, image_gen1 string, image_gen2 string, image_gen3 string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert sorted(collected(streams.unnested(stream), "unnested", spark).collect()) == [("a", "gen0", "y"), ("a", "gen3", "z"), ("a", "real", "x")]
