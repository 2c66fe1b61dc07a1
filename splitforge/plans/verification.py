"""Plans of verification and counting of splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitforge.operators import joins, metrics, verify
from splitforge.plans import base as B
from splitforge.streaming import streams

PLANS: dict = {}
_WITH = f"WITH {B.VECTORS}, {B.KEYED}, {B.SPLITS}"


def plan(sql: str | None = None):
    def put(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return put


def _held(spark):
    return B.names(spark, "generator", B.HELD_GENERATORS), B.names(spark, "source", B.HELD_SOURCES)


def _flat(findings):
    return findings.withColumn("examples", F.array_join("examples", ","))


@plan(f"{_WITH} SELECT sample_id, split FROM splits WHERE (label = 1 AND generator IN ('g8', 'g9')) OR (label = 0 AND source IN ('s4'))")
def j6_held_out_present(spark, sf_dir):
    return joins.held_out_present(B.splits(spark, sf_dir), *_held(spark)).select("sample_id", "split")


@plan(f"{_WITH} SELECT sample_id, label FROM splits WHERE NOT (label = 0 AND \"group\" IN ('q3', 'q50', 'q77'))")
def j7_without_groups(spark, sf_dir):
    groups = B.names(spark, "group", ("q3", "q50", "q77"))
    return joins.without_groups(B.splits(spark, sf_dir), groups, F.col("label") == 0).select("sample_id", "label")


@plan(f"{_WITH} SELECT e.vec_id AS sample_id FROM embeddings e WHERE e.vec_id NOT IN (SELECT sample_id FROM splits WHERE split = 'train')")
def j8_not_in_manifest(spark, sf_dir):
    scored = B.vectors(spark, sf_dir).select("sample_id")
    return joins.not_in_manifest(scored, B.splits(spark, sf_dir).where("split = 'train'"))


@plan(f"""WITH {B.VECTORS}, {B.KEYED}, {B.SPLITS} SELECT split, array_to_string(list_sort(list(DISTINCT generator) FILTER (generator IS NOT NULL)), ',') AS generators, array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), ',') AS sources FROM splits GROUP BY split""")
def a8_members(spark, sf_dir):
    """The sorted names that stand in each split."""
    names = metrics.members(B.splits(spark, sf_dir))
    return names.select("split", F.array_join("generators", ",").alias("generators"), F.array_join("sources", ",").alias("sources"))


@plan(f"""{_WITH}, x AS (SELECT split, label, coalesce(generator, source) AS origin, CASE WHEN sample_id <= 96 THEN '<=96' WHEN sample_id <= 224 THEN '96-224' WHEN sample_id <= 512 THEN '224-512' WHEN sample_id <= 1024 THEN '512-1024' ELSE '>1024' END AS bucket FROM splits)
SELECT split, 'all' AS kind, '' AS key, count(*) AS n FROM x GROUP BY split UNION ALL SELECT split, 'label', CAST(label AS VARCHAR), count(*) FROM x GROUP BY split, label
UNION ALL SELECT split, 'origin', origin || '/' || label, count(*) FROM x GROUP BY split, origin, label UNION ALL SELECT split, 'bucket', bucket, count(*) FROM x GROUP BY split, bucket""")
def a8_composition(spark, sf_dir):
    return metrics.composition(B.splits(spark, sf_dir), "sample_id")


@plan(f"{_WITH} SELECT split, count(*) AS n, count(*) FILTER (WHERE label = 0) AS n_real, count(*) FILTER (WHERE label = 1) AS n_generated FROM splits GROUP BY split")
def a9_class_counts(spark, sf_dir):
    return metrics.class_counts(B.splits(spark, sf_dir))


def _defects(spark, sf_dir):
    """Splits with planted defects: a sample in two splits, one twice, one blank generator, held-out keys moved about."""
    rows = B.splits(spark, sf_dir).withColumn("generator", F.when(F.col("sample_id") == 30, "").otherwise(F.col("generator")))
    copies = F.when(F.col("sample_id") == 11, F.array(F.lit("val"), F.lit("train"))).when(F.col("sample_id") == 20, F.array("split", "split")).otherwise(F.array("split"))
    return B.stored(rows.withColumn("split", F.explode(copies)), "defects")


_DEFECTS = """defects AS (SELECT sample_id, label, CASE WHEN sample_id = 30 THEN '' ELSE generator END AS generator, source, content_hash, "group", split FROM splits WHERE sample_id <> 11
  UNION ALL SELECT s.sample_id, label, generator, source, content_hash, "group", x.split FROM splits s CROSS JOIN (VALUES ('val'), ('train')) x(split) WHERE sample_id = 11
  UNION ALL SELECT sample_id, label, generator, source, content_hash, "group", split FROM splits WHERE sample_id = 20)"""


def _pairs_sql(relation: str, key: str, check: str) -> str:
    return f"""SELECT '{check}:' || a.split || '-' || b.split AS "check", 'error' AS severity, count(*) AS n, array_to_string(list_sort(list(CAST(a.k AS VARCHAR) ORDER BY a.k)[1:3]), ',') AS examples
  FROM (SELECT DISTINCT {key} AS k, split FROM {relation}) a JOIN (SELECT DISTINCT {key} AS k, split FROM {relation}) b ON a.k = b.k AND a.split < b.split GROUP BY a.split, b.split"""


def _finding_sql(check: str, rows: str, severity: str = "error") -> str:
    """rows: a query with the column e."""
    return f"""SELECT '{check}', '{severity}', count(*), coalesce(array_to_string(list_sort(list(DISTINCT CAST(e AS VARCHAR)) FILTER (WHERE e IS NOT NULL))[1:3], ','), '') FROM ({rows})"""


_DUPLICATES = "SELECT sample_id AS e FROM defects GROUP BY split, sample_id HAVING count(*) > 1"
_BALANCE = "SELECT split AS e FROM defects GROUP BY split HAVING abs(count(*) FILTER (WHERE label = 0) - count(*) FILTER (WHERE label = 1)) / count(*) > 0.02"
_SIZES = "SELECT split AS e FROM (SELECT split, count(*) AS n, sum(count(*)) OVER () AS total FROM defects GROUP BY split) WHERE abs(n - total * CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END) > greatest(4, total * 0.01)"


@plan(f"{_WITH}, {_DEFECTS} {_pairs_sql('defects', 'sample_id', 'overlap')} UNION ALL {_finding_sql('duplicate in split', _DUPLICATES)} UNION ALL {_finding_sql('class balance', _BALANCE, 'warning')} UNION ALL {_finding_sql('split size', _SIZES, 'warning')}")
def v1_split_report(spark, sf_dir):
    return _flat(verify.split_report(_defects(spark, sf_dir), targets={"train": 0.7, "val": 0.15, "test": 0.15}))


_SEEN = "SELECT sample_id AS e FROM defects WHERE split <> 'test' AND ((label = 1 AND generator IN ('g8', 'g9')) OR (label = 0 AND source IN ('s4')))"
_ABSENT = "SELECT g AS e FROM (VALUES ('g8'), ('g9')) x(g) WHERE g NOT IN (SELECT generator FROM defects WHERE split = 'test' AND generator IS NOT NULL)"
_BLANK = "SELECT sample_id AS e FROM defects WHERE label = 1 AND trim(coalesce(generator, '')) = ''"


@plan(f"{_WITH}, {_DEFECTS} {_pairs_sql('defects', 'sample_id', 'overlap')} UNION ALL {_pairs_sql('defects', 'content_hash', 'content overlap')} UNION ALL {_finding_sql('duplicate in split', _DUPLICATES)} UNION ALL {_finding_sql('blank generator', _BLANK)} UNION ALL {_finding_sql('held out in training', _SEEN)} UNION ALL {_finding_sql('held out missing in final', _ABSENT)}")
def v2_independent_report(spark, sf_dir):
    return _flat(verify.independent_report(_defects(spark, sf_dir), *_held(spark)))


_POOL = "pool AS (SELECT * REPLACE (CASE WHEN split = 'test' THEN 'test' ELSE 'pool' END AS split) FROM defects)"
_ONE_CLASS = "SELECT split AS e FROM defects WHERE split = 'test' GROUP BY split HAVING count(DISTINCT label) < 2"
_THIN = "SELECT generator AS e FROM defects WHERE label = 1 AND split IN ('train', 'val') GROUP BY generator HAVING count(*) < 40"
_STRADDLE = "SELECT DISTINCT a.split || '-' || b.split AS e FROM defects a JOIN defects b ON a.\"group\" = b.\"group\" AND a.split < b.split"
_CONFLICT = "SELECT content_hash AS e FROM defects GROUP BY content_hash HAVING count(DISTINCT label) > 1"


@plan(f"{_WITH}, {_DEFECTS}, {_POOL} {_pairs_sql('pool', 'sample_id', 'overlap')} UNION ALL {_pairs_sql('pool', 'content_hash', 'content overlap')} UNION ALL {_finding_sql('held out in training', _SEEN)} UNION ALL {_finding_sql('duplicate in split', _DUPLICATES)} UNION ALL {_finding_sql('final split of one class', _ONE_CLASS)} UNION ALL {_finding_sql('thin generator', _THIN, 'warning')} UNION ALL {_finding_sql('group_overlap', _STRADDLE, 'warning')} UNION ALL {_finding_sql('label_conflict', _CONFLICT, 'warning')}")
def v3_leakage_report(spark, sf_dir):
    return _flat(verify.leakage_report(_defects(spark, sf_dir), *_held(spark), least=40))


@plan(f"{_WITH} SELECT generator, count(*) AS available, CAST(least(count(*), 45, floor(230 / (SELECT count(DISTINCT generator) FROM splits))) AS BIGINT) AS quota, least(count(*), 45, floor(230 / (SELECT count(DISTINCT generator) FROM splits))) < 45 AS short FROM splits WHERE label = 1 GROUP BY generator")
def v4_quota_plan(spark, sf_dir):
    return verify.quota_plan(B.splits(spark, sf_dir).where("label = 1"), 230, 45, 45, strict=False)


@plan(f"""{_WITH}, planned AS (SELECT generator, least(count(*), 45, floor(230 / (SELECT count(DISTINCT generator) FROM splits))) AS quota FROM splits WHERE label = 1 GROUP BY generator)
SELECT generator, CAST(quota AS BIGINT) AS cap, CAST(least(n, quota) AS BIGINT) AS taken, CAST(greatest(quota - n, 0) AS BIGINT) AS missing FROM planned JOIN (SELECT generator, count(*) FILTER (split <> 'test') AS n FROM splits WHERE label = 1 GROUP BY generator) USING (generator)""")
def v4_collected_plan(spark, sf_dir):
    """The second pass after a quota plan: the samples outside test arrive as a stream and are collected by the plan's quotas; what is
    missing of each is reported."""
    rows = B.stored(B.splits(spark, sf_dir).where("label = 1").select("sample_id", "generator", "split"), "samples")
    caps = verify.quota_plan(rows, 230, 45, 45, strict=False).select("generator", F.col("quota").alias("cap"))
    source, path = B.scratch(spark, "arriving"), B.scratch(spark, "collected")
    given = rows.where("split != 'test'").select("generator", "sample_id")
    given.repartition(3, "sample_id").write.parquet(source)
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(source)
    with B.rocksdb(spark):
        kept = streams.stream_quota(stream, caps, "generator")
        kept.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return streams.shortfall(caps, spark.read.schema(given.schema).parquet(path), "generator")


@plan(f"{_WITH} SELECT generator, count(*) AS n FROM splits WHERE label = 1 AND split IN ('train', 'val') GROUP BY generator HAVING count(*) < 45")
def v5_thin_generators(spark, sf_dir):
    return verify.thin_generators(B.splits(spark, sf_dir), 45)


@plan(f"""{_WITH}, {_DEFECTS}, found AS (SELECT 'blank generator' AS c, count(*) AS n FROM ({_BLANK}) UNION ALL SELECT 'duplicate in split', count(*) FROM ({_DUPLICATES}) UNION ALL SELECT 'held out missing in final', count(*) FROM ({_ABSENT}))
SELECT count(*) FILTER (WHERE n > 0) = 0 AS allowed, coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE n > 0), '') AS blocked_by FROM found""")
def v9_gate(spark, sf_dir):
    found = verify.independent_report(_defects(spark, sf_dir), *_held(spark))
    return verify.gate(found, ["blank generator", "duplicate in split", "held out missing in final", "no such check"]).withColumn("blocked_by", F.array_join("blocked_by", ","))
