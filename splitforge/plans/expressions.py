"""Plans over projections, predicates, scalar expressions and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitforge.functions import columns as C
from splitforge.plans import base as B
from splitforge.sources import readers

PLANS: dict = {}


def plan(sql: str | None = None):
    def put(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return put


@plan("""SELECT 'documents' AS dataset, 'src' || i AS source, i >= 16 AS held_out, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
  JOIN (SELECT unnest(range(0, 20)) AS i) ON source = 'src' || i WHERE i >= 4 OR r <= 5 + i GROUP BY ALL""")
def src3_named_sources(spark, sf_dir):
    """Twenty sources from one scan of the documents, a few rows of the first four."""
    parts = [readers.NamedSource(f"src{i}", F.col("source") == f"src{i}", None, i >= 16, 5 + i if i < 4 else None) for i in range(20)]
    rows = readers.named_sources(B.table(spark, sf_dir, "documents").select("doc_id", "source"), parts, "documents", ["doc_id"])
    return rows.groupBy("dataset", "source", "held_out").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@plan("SELECT d.doc_id AS image_path, coalesce(CAST(quality AS INT), -1) AS label, '' AS generator, coalesce(source, '') AS source, 0 AS orig_w, 0 AS orig_h, '' AS dataset FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IN (0, 1)")
def src5_lenient_manifest(spark, sf_dir):
    rows = B.texts(spark, sf_dir).where("label IS NOT NULL").select(F.col("sample_id").alias("image_path"), "label", "source")
    return readers.lenient_manifest(rows)


@plan("SELECT source AS key, count(text) AS n, max(length(text)) AS longest FROM documents GROUP BY source")
def src6_detected_fields(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    found = readers.detected(docs, keys=("generator", "model", "source", "label"), payload_types=("string",), payload_names=("image", "text"))
    return found.groupBy("key").agg(F.count("payload").alias("n"), F.max(F.length("payload")).alias("longest"))


@plan("SELECT lang, CASE WHEN lower(trim(lang)) IN ('en', 'de') THEN 'REAL' ELSE lang END AS key, count(*) AS n FROM documents GROUP BY ALL")
def p1_normalised_keys(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").groupBy("lang", C.normalise_real("lang", ("EN", "De")).alias("key")).agg(F.count("*").alias("n"))


@plan("SELECT p_partkey, p_size, p_size * 3 % 40 AS h FROM part WHERE least(p_size, p_size * 3 % 40) >= 20")
def p2_min_side(spark, sf_dir):
    rows = B.table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") * 3 % 40).alias("h"))
    return rows.where(C.min_side_at_least("p_size", "h", 20))


_BUCKET = "CASE WHEN {0} <= 96 THEN '<=96' WHEN {0} <= 224 THEN '96-224' WHEN {0} <= 512 THEN '224-512' WHEN {0} <= 1024 THEN '512-1024' ELSE '>1024' END"


@plan(f"SELECT {_BUCKET.format('n_chars')} AS with_zero, CASE WHEN n_chars % 97 = 0 THEN NULL ELSE {_BUCKET.format('(n_chars % 97) * 12')} END AS without_zero, count(*) AS n FROM documents GROUP BY ALL")
def p3_size_buckets(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("n_chars")
    return docs.groupBy(C.size_bucket("n_chars").alias("with_zero"), C.size_bucket(F.col("n_chars") % 97 * 12, include_zero=False).alias("without_zero")).agg(F.count("*").alias("n"))


@plan("SELECT CAST(o_totalprice * 0 + (o_orderkey % 11) / 10.0 >= 0.5 AS INT) AS up, CAST((o_orderkey % 11) / 10.0 > 0.5 AS INT) AS down, count(*) AS n FROM orders GROUP BY ALL")
def p4_threshold(spark, sf_dir):
    p = F.col("o_orderkey") % 11 / 10.0
    return B.table(spark, sf_dir, "orders").groupBy(C.predict(p).alias("up"), C.predict(p, tie=0).alias("down")).agg(F.count("*").alias("n"))


@plan("SELECT count(*) AS n, count(p) AS kept, sum(coalesce(p, 0)) AS with_zeros FROM (SELECT CASE WHEN quality = 1 THEN n_chars % 7 / 8.0 END AS p FROM documents LEFT JOIN labels USING (doc_id))")
def p5_unreadable(spark, sf_dir):
    p = F.when(F.col("label") == 1, F.col("size") % 7 / 8.0)
    rows = B.texts(spark, sf_dir).select(p.alias("p"))
    return rows.agg(F.count("*").alias("n"), F.count(C.unreadable("p")).alias("kept"), F.sum(C.unreadable("p", "zero")).alias("with_zeros"))


@plan(f"WITH {B.VECTORS}, {B.SCORED} SELECT CASE WHEN param = '-' THEN name ELSE name || ':' || param END AS tag, count(*) AS n FROM scored GROUP BY ALL")
def p6_condition_tags(spark, sf_dir):
    return B.scored(spark, sf_dir).groupBy(C.condition_tag("name", "param").alias("tag")).agg(F.count("*").alias("n"))


@plan("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7.0 / 1000, 6) AS value FROM lineitem")
def p7_rounded(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", C.rounded(F.col("l_extendedprice").cast("double") / 7.0 / 1000).alias("value"))


@plan("SELECT CASE WHEN g > 0.03 THEN 'gain' WHEN g < -0.005 THEN 'loss' ELSE 'neutral' END AS verdict, count(*) AS n FROM (SELECT (l_orderkey % 13 - 4) / 100.0 AS g FROM lineitem) GROUP BY ALL")
def p8_gap_verdict(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").groupBy(C.gap_verdict((F.col("l_orderkey") % 13 - 4) / 100.0).alias("verdict")).agg(F.count("*").alias("n"))


@plan("SELECT CASE WHEN trim(coalesce(g, '')) = '' THEN 'unknown' ELSE g END AS generator, count(*) AS n FROM (SELECT CASE WHEN label % 3 = 0 THEN NULL WHEN label % 3 = 1 THEN ' ' ELSE 'g' || label END AS g FROM embeddings) GROUP BY ALL")
def p9_blank_keys(spark, sf_dir):
    g = F.when(F.col("label") % 3 == 0, None).when(F.col("label") % 3 == 1, " ").otherwise(F.concat(F.lit("g"), "label"))
    return B.table(spark, sf_dir, "embeddings").groupBy(C.known_key(g).alias("generator")).agg(F.count("*").alias("n"))


@plan("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def sc1_content_hash(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", C.content_hash("text").alias("content_hash"))


@plan("SELECT vec_id, CAST('0x' || substr(sha256(concat_ws('|', '42', 'blur', 'sigma1.0', CAST(vec_id AS VARCHAR))), 1, 15) AS BIGINT) AS prefix, CAST(CAST('0x' || substr(sha256(concat_ws('|', '42', 'blur', CAST(vec_id AS VARCHAR))), 1, 8) AS BIGINT) AS VARCHAR) AS head FROM embeddings")
def sc2_derived_seed(spark, sf_dir):
    rows = B.table(spark, sf_dir, "embeddings")
    full = C.derived_seed(42, "blur", F.col("vec_id"))
    return rows.select("vec_id", C.seed_prefix(42, "blur", "sigma1.0", F.col("vec_id")).alias("prefix"), F.floor(full / F.lit(2**32).cast("decimal(20,0)")).cast("long").cast("string").alias("head"))


_U = B.uniform_sql("'42'", "'x'", "CAST(vec_id AS VARCHAR)")
_A, _B = B.uniform_sql("'42'", "'x'", "CAST(vec_id AS VARCHAR)", "'a'"), B.uniform_sql("'42'", "'x'", "CAST(vec_id AS VARCHAR)", "'b'")


@plan(f"SELECT vec_id, round({_U}, 9) AS u, round(round(sqrt(-2.0 * ln({_A})) * cos(2 * pi() * {_B}), 9), 6) AS z FROM embeddings")
def sc3_draws(spark, sf_dir):
    rows = B.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(C.uniform(42, "x", F.col("vec_id")), 9).alias("u"), F.round(C.normal(42, "x", F.col("vec_id")), 6).alias("z"))


@plan("SELECT o_orderkey, round(b - a, 9) AS gap, CASE WHEN a <> 0 THEN round(b / a, 9) END AS retention, round(a - b, 9) AS drop FROM (SELECT o_orderkey, o_orderkey % 5 / 4.0 AS a, o_orderkey % 7 / 6.0 AS b FROM orders)")
def sc4_gap_retention_drop(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 / 4.0).alias("a"), (F.col("o_orderkey") % 7 / 6.0).alias("b"))
    return rows.select("o_orderkey", F.round(C.gap("b", "a"), 9).alias("gap"), F.round(C.retention("b", "a"), 9).alias("retention"), F.round(C.drop("b", "a"), 9).alias("drop"))


@plan("""SELECT o_orderkey, CAST(tp AS BIGINT) AS tp, CAST(greatest(0, least(5000, round_even(tp - (10000 * a - 5000), 0))) AS BIGINT) AS fp, CAST(5000 - tp AS BIGINT) AS fn FROM (
  SELECT o_orderkey, a, CASE WHEN f >= 1 THEN 5000 ELSE round_even(5000 * f * (1.0 - a) / (1.0 - f), 0) END AS tp FROM (
    SELECT o_orderkey, CAST(0.5 + o_orderkey % 499 / 1000.0 AS DOUBLE) AS a, CAST(0.5 + o_orderkey % 499 / 1000.0 AS DOUBLE) AS f FROM orders))""")
def sc5_reconstructed_counts(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").select("o_orderkey", (0.5 + F.col("o_orderkey") % 499 / 1000.0).alias("a"))
    counts = C.reconstructed_counts("a", "a", 5000, 5000)
    return rows.select("o_orderkey", counts["tp"].alias("tp"), counts["fp"].alias("fp"), counts["fn"].alias("fn"))


@plan("SELECT vec_id, round(1 / (1 + exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE)), 9) AS p FROM embeddings")
def sc6_softmax(spark, sf_dir):
    e = F.col("embedding")
    return B.table(spark, sf_dir, "embeddings").select("vec_id", F.round(C.softmax_of_two(e[0].cast("double"), e[1].cast("double")), 9).alias("p"))


@plan("SELECT vec_id, round(list_sum(list_transform(range(0, 64), lambda i: (i + 1) * (embedding[i + 1]::DOUBLE - [0.1, 0.2, 0.3][i % 3 + 1]) / [0.5, 0.25, 0.125][i % 3 + 1])), 6) AS s FROM embeddings")
def sc7_standardised(spark, sf_dir):
    v = C.standardised(F.transform("embedding", lambda x: x.cast("double")), [0.1, 0.2, 0.3], [0.5, 0.25, 0.125])
    weighted = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return B.table(spark, sf_dir, "embeddings").select("vec_id", F.round(weighted, 6).alias("s"))


@plan(f"WITH {B.VECTORS}, {B.KEYED} SELECT sample_id, content_hash AS key FROM keyed")
def sc8_perceptual_key(spark, sf_dir):
    return B.vectors(spark, sf_dir).select("sample_id", C.perceptual_key("features").alias("key"))


def _names_sql(column: str) -> str:
    return f"""'[' || coalesce('"' || array_to_string(list_sort(list(DISTINCT {column}) FILTER (WHERE {column} IS NOT NULL)), '","') || '"', '') || ']'"""


@plan(f"""WITH {B.VECTORS}, {B.KEYED}, {B.SPLITS} SELECT split, '{{"generators":' || {_names_sql('generator')} || ',"n":' || count(*) || ',"n_real":' || count(*) FILTER (WHERE label = 0) || ',"sources":' || {_names_sql('source')} || '}}' AS report FROM splits GROUP BY split""")
def sc9_report_json(spark, sf_dir):
    from splitforge.operators.metrics import class_counts, members

    rows = class_counts(B.splits(spark, sf_dir)).join(members(B.splits(spark, sf_dir)), "split")
    return rows.select("split", C.report_json(n=F.col("n"), n_real=F.col("n_real"), generators=F.col("generators"), sources=F.col("sources")).alias("report"))
