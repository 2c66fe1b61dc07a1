"""Plans of dataset assembly: de-duplication, balancing, splits, quotas, set operations, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitforge.functions import columns as C
from splitforge.operators import dedup, joins, sampling
from splitforge.plans import base as B
from splitforge.streaming import streams

PLANS: dict = {}
SEED = B.SEED


def plan(sql: str | None = None):
    def put(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return put


def _rank(parts: str, order: str, name: str = "r") -> str:
    return f"row_number() OVER ({parts} ORDER BY {order}) AS {name}"


@plan(f"WITH {B.VECTORS}, {B.KEYED}, {B.SPLITS} SELECT sample_id, label, split FROM splits")
def w1_stratified_split(spark, sf_dir):
    return B.splits(spark, sf_dir).select("sample_id", "label", "split")


@plan(f"SELECT doc_id, CASE WHEN r <= floor(n * 0.15) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, {_rank('', B.hash_sql(7, 'doc_id') + ', doc_id')}, count(*) OVER () AS n FROM documents)")
def w2_random_split(spark, sf_dir):
    return sampling.random_split(B.table(spark, sf_dir, "documents").select("doc_id"), 7, 0.15, "doc_id")


@plan(f"WITH {B.TEXTS} SELECT sample_id, label FROM (SELECT *, {_rank('PARTITION BY label', B.hash_sql(7, 'label', 'sample_id') + ', sample_id')}, count(*) OVER () AS n FROM texts WHERE label IS NOT NULL) WHERE n <= 101 OR r <= 50")
def w3_class_balanced_cap(spark, sf_dir):
    rows = B.texts(spark, sf_dir).where("label IS NOT NULL").select("sample_id", "label")
    return sampling.class_balanced_cap(rows, 7, 101)


@plan(f"SELECT event_type, event_id FROM (SELECT event_type, event_id, {_rank('PARTITION BY event_type', 'ts, event_id')}, CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 7 WHEN 'purchase' THEN 20 END AS cap FROM events) WHERE r <= cap")
def w4_per_key_quota(spark, sf_dir):
    caps = {"click": 100, "view": 7, "purchase": 20}
    rows = B.table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return sampling.per_key_quota(rows, caps, "event_type", ["ts", "event_id"]).select("event_type", "event_id")


_FIRST = "SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY source, sample_id) AS r FROM texts) WHERE r = 1"


@plan(f"WITH {B.TEXTS}, firsts AS ({_FIRST}), sizes AS (SELECT source, count(*) AS k FROM firsts GROUP BY source), target AS (SELECT least(min(k), 40, floor(500 / count(*))) AS t FROM sizes) SELECT sample_id, source FROM (SELECT *, {_rank('PARTITION BY source', B.hash_sql(SEED, 'source', 'content_hash') + ', content_hash')} FROM firsts) WHERE r <= (SELECT t FROM target)")
def w5_balanced(spark, sf_dir):
    firsts = dedup.first_wins(B.texts(spark, sf_dir), "content_hash", ["source", "sample_id"])
    n_real = spark.range(1).select(F.lit(500).cast("long").alias("n_real"))
    return sampling.balanced(firsts, SEED, n_real, "source", ["content_hash"], 40).select("sample_id", "source")


_GROUPS = "SELECT conv_id, row_number() OVER (ORDER BY {0}, conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations {1})"


@plan(f"SELECT c.conv_id, c.turn, CASE WHEN g.r <= floor(g.n * 0.2) THEN 'val' ELSE 'train' END AS split FROM conversations c JOIN ({_GROUPS.format(B.hash_sql(SEED, 'conv_id'), '')}) g USING (conv_id)")
def w6_group_split(spark, sf_dir):
    return sampling.group_split(B.table(spark, sf_dir, "conversations").select("conv_id", "turn"), SEED, 0.2, "conv_id")


@plan(f"""WITH {B.VECTORS}, {B.KEYED}, held AS (SELECT "group" FROM (SELECT "group", row_number() OVER (ORDER BY {B.hash_sql(SEED, '"group"')}, "group") AS r, count(*) OVER () AS n FROM (SELECT DISTINCT "group" FROM keyed WHERE label = 0)) WHERE r <= floor(n * 0.25))
SELECT sample_id, label, "group" FROM keyed WHERE NOT (label = 0 AND "group" IN (SELECT "group" FROM held))""")
def w7_held_back_groups(spark, sf_dir):
    rows = B.splits(spark, sf_dir).select("sample_id", "label", "group")
    return joins.without_groups(rows, sampling.held_back_groups(rows, SEED, 0.25), F.col("label") == 0)


@plan(f"WITH {B.TEXTS}, firsts AS ({_FIRST}) SELECT sample_id, source, label FROM firsts")
def w8_first_wins(spark, sf_dir):
    return dedup.first_wins(B.texts(spark, sf_dir), "content_hash", ["source", "sample_id"]).select("sample_id", "source", "label")


@plan("SELECT epoch, n FROM (SELECT l_linenumber AS epoch, count(*) AS n, row_number() OVER (ORDER BY CASE WHEN l_linenumber = 1 THEN -1 ELSE l_linenumber % 3 END DESC, l_linenumber) AS r FROM lineitem GROUP BY l_linenumber) WHERE r = 1")
def w9_best_epoch(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(F.count("*").alias("n"))
    f1 = F.when(F.col("epoch") == 1, F.lit(float("nan"))).otherwise((F.col("epoch") % 3).cast("double"))
    return sampling.best_epoch(rows.withColumn("f1", f1)).select("epoch", "n")


@plan(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, {_rank('PARTITION BY lang', B.hash_sql(5, 'lang', 'doc_id') + ', doc_id')} FROM documents) WHERE r <= 25")
def w10_seeded_sample(spark, sf_dir):
    return sampling.seeded_sample(B.table(spark, sf_dir, "documents").select("doc_id", "lang"), 5, 25, "doc_id", ["lang"])


@plan(f"""WITH {B.VECTORS}, {B.KEYED} SELECT CASE WHEN label = 1 THEN content_hash ELSE "group" END AS "group", count(*) AS n, min(sample_id) AS first FROM keyed GROUP BY ALL""")
def w11_near_groups(spark, sf_dir):
    """Samples by their perceptual key; those of label 0 count as having none and fall back on another key."""
    rows = B.vectors(spark, sf_dir).select("sample_id", "label", C.perceptual_key("features").alias("key"), F.concat(F.lit("q"), F.col("sample_id") % 97).alias("other"))
    return dedup.near_groups(rows, F.when(F.col("label") == 1, F.col("key")), "other").groupBy("group").agg(F.count("*").alias("n"), F.min("sample_id").alias("first"))


@plan("SELECT source AS raw, CASE WHEN lower(trim(source)) IN ('src1', 'src2') THEN 'REAL' ELSE source END AS normalised, count(*) AS n FROM documents GROUP BY ALL")
def a12_availability(spark, sf_dir):
    return dedup.availability(B.table(spark, sf_dir, "documents"), "source", ("SRC1", "src2"))


@plan(f"WITH {B.TEXTS} SELECT source, CASE WHEN r > 1 THEN 'duplicate' WHEN size < 200 THEN 'too small' ELSE 'added' END AS reason, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY source, sample_id) AS r FROM texts) GROUP BY ALL")
def a15_reject_counts(spark, sf_dir):
    rows = dedup.marked_duplicates(B.texts(spark, sf_dir), "content_hash", ["source", "sample_id"])
    return dedup.rejects(rows.withColumn("reason", F.coalesce("reason", F.when(F.col("size") < 200, "too small"))))


@plan("""WITH given AS (SELECT doc_id, coalesce(source, '?') AS source, n_chars, sha256(text) AS hash, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad FROM documents),
  good AS (SELECT doc_id, row_number() OVER (PARTITION BY hash ORDER BY source, doc_id) AS r FROM given WHERE NOT bad AND n_chars >= 400)
SELECT source, CASE WHEN bad THEN 'bad' WHEN n_chars < 400 THEN 'too small' WHEN r > 1 THEN 'duplicate' ELSE 'added' END AS reason, count(*) AS n, CAST(sum(CASE WHEN r = 1 THEN doc_id END) AS BIGINT) AS ids
  FROM given LEFT JOIN good USING (doc_id) GROUP BY ALL""")
def a15_one_pass(spark, sf_dir):
    """The documents with their checksums, those of the toxic ones spoiled: what becomes of each, counted while the good ones are
    written; beside the counts the sum of the ids that the written table has."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("?")).alias("source"), "n_chars", "text", F.crc32(F.encode("text", "UTF-8")).alias("sum"))
    toxic = B.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("spoiled"))
    given = docs.join(toxic, "doc_id", "left").withColumn("text", F.when(F.col("spoiled") == 1, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    broken = F.crc32(F.encode("text", "UTF-8")) != F.col("sum")
    rows = dedup.judged(given.withColumn("hash", C.content_hash("text")), "hash", ["source", "doc_id"], broken, F.col("n_chars") < 400)
    path = B.scratch(spark, "added")
    counts = dedup.write_added(rows.select("doc_id", "source", "reason"), path, [f"src{i}" for i in range(20)])
    table = spark.createDataFrame([(s, r, n) for (s, r), n in counts.items()], "source string, reason string, n long")
    ids = spark.read.parquet(path).groupBy("source").agg(F.sum("doc_id").alias("ids")).withColumn("reason", F.lit("added"))
    return table.join(ids, ["source", "reason"], "left")


def _shares(spark, sf_dir):
    """Texts in three splits by id, so copies of a text stand in several."""
    split = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("sample_id") % 3 + 1).cast("int"))
    return B.texts(spark, sf_dir).withColumn("split", split)


_SHARES = "shares AS (SELECT *, ['train', 'val', 'test'][CAST(sample_id % 3 AS INT) + 1] AS split FROM texts)"


@plan(f"WITH {B.TEXTS}, {_SHARES}, k AS (SELECT DISTINCT source, lang, split FROM shares) SELECT a.split AS left_split, b.split AS right_split, count(DISTINCT a.source) AS n FROM k a JOIN k b ON a.source = b.source AND a.split < b.split GROUP BY ALL")
def s1_key_overlap(spark, sf_dir):
    return dedup.pairwise_overlap(_shares(spark, sf_dir), "source").select("left_split", "right_split", "n")


@plan(f"WITH {B.TEXTS}, {_SHARES}, k AS (SELECT DISTINCT content_hash, split FROM shares) SELECT a.split AS left_split, b.split AS right_split, count(*) AS n, array_to_string(list_sort(list(a.content_hash))[1:3], ',') AS examples FROM k a JOIN k b ON a.content_hash = b.content_hash AND a.split < b.split GROUP BY a.split, b.split")
def s2_content_overlap(spark, sf_dir):
    return dedup.pairwise_overlap(_shares(spark, sf_dir), "content_hash").withColumn("examples", F.array_join("examples", ","))


@plan(f"WITH {B.TEXTS}, {_SHARES} SELECT content_hash FROM shares WHERE split IN ('train', 'val') INTERSECT SELECT content_hash FROM shares WHERE split = 'test'")
def s3_pool_and_final(spark, sf_dir):
    return dedup.merged_overlap(_shares(spark, sf_dir), "content_hash", ("train", "val"), "test")


@plan(f"WITH {B.TEXTS}, {_SHARES} SELECT split, CAST(0 AS INT) AS whole, count(*) - count(DISTINCT content_hash) AS n FROM shares GROUP BY split UNION ALL SELECT NULL, 1, count(*) - count(DISTINCT content_hash) FROM shares")
def s4_duplicates(spark, sf_dir):
    rows = dedup.duplicates_in_splits(_shares(spark, sf_dir), "content_hash")
    return rows.select("split", F.col("whole").cast("int").alias("whole"), "n")


@plan("SELECT count(DISTINCT sha256(text)) AS distinct_keys, count(*) AS n_rows FROM documents")
def s5_union_and_sum(spark, sf_dir):
    return dedup.union_and_sum(B.texts(spark, sf_dir), "content_hash")


@plan("SELECT 'src' || i AS source FROM (SELECT unnest(range(15, 25)) AS i) WHERE 'src' || i NOT IN (SELECT source FROM documents)")
def s6_not_available(spark, sf_dir):
    wanted = spark.range(15, 25).select(F.concat(F.lit("src"), "id").alias("source"))
    return dedup.not_available(wanted, B.table(spark, sf_dir, "documents"), "source")


@plan("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS r FROM documents) WHERE r <= 37")
def o2_first_rows(spark, sf_dir):
    return sampling.first_rows(B.table(spark, sf_dir, "documents").select("doc_id", "source"), 37, ["source", "doc_id"])


@plan(f"WITH {B.VECTORS}, {B.KEYED}, {B.SPLITS} SELECT sample_id, split FROM splits WHERE split = 'val' ORDER BY {B.hash_sql(SEED, 'sample_id')}, sample_id")
def o3_seeded_order(spark, sf_dir):
    return sampling.seeded_order(B.splits(spark, sf_dir).where("split = 'val'").select("sample_id", "split"), SEED)


@plan("SELECT source, array_to_string(list_sort(list(DISTINCT lang))[1:3], ',') AS examples FROM documents GROUP BY source")
def o4_examples(spark, sf_dir):
    return dedup.examples(B.table(spark, sf_dir, "documents"), "source", "lang").withColumn("examples", F.array_join("examples", ","))


@plan("SELECT event_type AS key, least(count(*), 50) AS n FROM events GROUP BY ALL")
def st1_stream_quota(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("record"), "ts")
    quota = streams.batch_quota(rows, 50, ["ts", "record"])
    return quota.groupBy("key").agg(F.count("*").alias("n"))


@plan("""SELECT doc_id AS "group", 'real' AS origin, text AS payload FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, 'gen' || i, CASE WHEN i = 2 AND lang = 'en' THEN NULL ELSE lang || i END FROM documents, (SELECT unnest(range(0, 4)) AS i) WHERE lang IS NOT NULL AND NOT (i = 2 AND lang = 'en')""")
def st3_unnested(spark, sf_dir):
    rows = B.table(spark, sf_dir, "documents")
    wide = rows.select(F.col("doc_id").alias("group"), F.col("text").alias("image"), *(F.when(F.lit(i != 2) | (F.col("lang") != "en"), F.concat("lang", F.lit(i))).alias(f"image_gen{i}") for i in range(4)))
    return streams.unnested(wide)
