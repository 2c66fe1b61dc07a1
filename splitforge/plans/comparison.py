"""Plans of metrics, slices and comparison tables over predictions of two models."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitforge.functions import columns as C
from splitforge.operators import compare, joins, metrics
from splitforge.plans import base as B

PLANS: dict = {}
_WITH = f"WITH {B.VECTORS}, {B.SCORED}"
KEYS = ["model", "name", "param"]
_KEYS = "model, name, param"
_M = f"m AS ({B.metrics_sql('scored', _KEYS)}), a AS ({B.auc_sql('scored', _KEYS)}), t AS (SELECT m.*, a.roc_auc FROM m JOIN a USING (model, name, param))"


def plan(sql: str | None = None):
    def put(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return put


def _rounded(df):
    return df.select(*(C.rounded(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _table(spark, sf_dir):
    """Metrics of every (model, name, param)."""
    rows = B.stored(B.scored(spark, sf_dir), "scored")
    return metrics.classification(rows, KEYS).join(metrics.roc_auc(rows, KEYS), KEYS)


@plan(f"{_WITH} SELECT model, CAST(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM scored GROUP BY model")
def a1_confusion(spark, sf_dir):
    return metrics.confusion(B.scored(spark, sf_dir), ["model"])


@plan(f"{_WITH}, m AS ({B.metrics_sql('scored', _KEYS)}) SELECT model, name, param, tn, fp, fn, tp, n, round(accuracy, 6) AS accuracy, round(\"precision\", 6) AS \"precision\", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def a2_classification(spark, sf_dir):
    return _rounded(metrics.classification(B.scored(spark, sf_dir), KEYS))


@plan(f"{_WITH}, a AS ({B.auc_sql('scored', _KEYS)}) SELECT model, name, param, round(roc_auc, 9) AS roc_auc FROM a")
def a3_roc_auc(spark, sf_dir):
    return metrics.roc_auc(B.scored(spark, sf_dir), KEYS).withColumn("roc_auc", F.round("roc_auc", 9))


@plan(f"{_WITH} SELECT model, name, param, round(avg(p), 6) AS mean_p, round(avg(CASE WHEN label = 0 THEN pred END), 6) AS fpr, round(avg(CASE WHEN label = 1 THEN pred END), 6) AS tpr FROM scored GROUP BY ALL")
def a4_rates(spark, sf_dir):
    return _rounded(metrics.rates(B.scored(spark, sf_dir), KEYS))


@plan(f"{_WITH} SELECT generator, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(pred), 6) AS detected_rate FROM scored WHERE label = 1 GROUP BY generator")
def a5_by_generator(spark, sf_dir):
    return _rounded(metrics.by_generator(B.scored(spark, sf_dir)))


@plan(f"{_WITH} SELECT source, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(pred), 6) AS fp_rate FROM scored WHERE label = 0 GROUP BY source")
def a6_by_source(spark, sf_dir):
    return _rounded(metrics.by_source(B.scored(spark, sf_dir)))


_BUCKETED = "bucketed AS (SELECT *, CASE WHEN size <= 96 THEN '<=96' WHEN size <= 224 THEN '96-224' WHEN size <= 512 THEN '224-512' WHEN size <= 1024 THEN '512-1024' ELSE '>1024' END AS bucket FROM scored WHERE size > 0)"


@plan(f"""{_WITH}, {_BUCKETED}, m AS ({B.metrics_sql('bucketed', 'bucket')}), a AS ({B.auc_sql('bucketed', 'bucket')}), r AS (SELECT bucket, avg(p) AS mean_p, avg(CASE WHEN label = 0 THEN pred END) AS fpr, avg(CASE WHEN label = 1 THEN pred END) AS tpr FROM bucketed GROUP BY bucket)
SELECT m.bucket, tn, fp, fn, tp, n, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(mean_p, 6) AS mean_p, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(roc_auc, 6) AS roc_auc FROM m JOIN a USING (bucket) JOIN r USING (bucket)""")
def a7_by_size_bucket(spark, sf_dir):
    return _rounded(metrics.by_bucket(B.stored(B.scored(spark, sf_dir), "scored")))


@plan(f"{_WITH}, {_M} SELECT model, true AS with_clean, count(*) AS n_conditions, round(avg(accuracy), 6) AS mean_accuracy, round(avg(f1), 6) AS mean_f1, round(avg(roc_auc), 6) AS mean_roc_auc FROM t GROUP BY model UNION ALL SELECT model, false, count(*), round(avg(accuracy), 6), round(avg(f1), 6), round(avg(roc_auc), 6) FROM t WHERE name <> 'clean' GROUP BY model")
def a10_macro_means(spark, sf_dir):
    table = B.stored(_table(spark, sf_dir), "metrics")
    both = [_rounded(metrics.macro_mean(table, ["accuracy", "f1", "roc_auc"], with_clean=w).withColumn("with_clean", F.lit(w))) for w in (True, False)]
    return both[0].unionByName(both[1])


@plan(f"{_WITH}, {_M} SELECT model, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM t WHERE name <> 'clean' GROUP BY model")
def a11_summed_errors(spark, sf_dir):
    return metrics.summed_errors(_table(spark, sf_dir))


_TOTALS = "totals AS (SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM vectors)"
_HITS = "CASE WHEN f >= 1 THEN pos ELSE round_even((pos + neg) / 2 * f * (1.0 - a) / (1.0 - f), 0) END"


@plan(f"""{_WITH}, {_M}, {_TOTALS}, published AS (SELECT model, name, round(accuracy, 3)::DOUBLE AS a, round(f1, 3)::DOUBLE AS f FROM t), hits AS (SELECT *, {_HITS} AS tp FROM published CROSS JOIN totals)
SELECT model, CAST(sum(greatest(0, least(neg, round_even(tp - ((pos + neg) * a - neg), 0)))) AS BIGINT) AS fp, CAST(sum(pos - tp) AS BIGINT) AS fn FROM hits WHERE name <> 'clean' GROUP BY model""")
def a11_reconstructed_errors(spark, sf_dir):
    """The errors that follow from accuracy and F1 to three places, as a report publishes them."""
    totals = B.vectors(spark, sf_dir).agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    published = _table(spark, sf_dir).select(*KEYS, F.round("accuracy", 3).alias("accuracy"), F.round("f1", 3).alias("f1"))
    return metrics.reconstructed_errors(published, totals[0], totals[1]).drop("tp_bound")


_CURVES = "curves AS (SELECT model, CASE WHEN label = 1 THEN 'generated' ELSE 'real' END AS cohort, name AS sweep, sample_id % 4 AS step, count(*) AS n, avg(p) AS mean_p FROM scored GROUP BY ALL)"


def _curves(spark, sf_dir):
    cohort = F.when(F.col("label") == 1, "generated").otherwise("real")
    rows = B.scored(spark, sf_dir).select("model", cohort.alias("cohort"), F.col("name").alias("sweep"), (F.col("sample_id") % 4).alias("step"), "p")
    return metrics.sweep_curve(rows)


@plan(f"{_WITH}, {_CURVES} SELECT model, cohort, sweep, round(max(CASE WHEN step = 0 THEN mean_p END), 6) AS first, round(max(CASE WHEN step = 3 THEN mean_p END), 6) AS last, round(max(CASE WHEN step = 0 THEN mean_p END) - max(CASE WHEN step = 3 THEN mean_p END), 6) AS drop, round(max(CASE WHEN step = 3 THEN mean_p END) - max(CASE WHEN step = 0 THEN mean_p END), 6) AS rise FROM curves GROUP BY ALL")
def a13_sweep_ends(spark, sf_dir):
    return _rounded(metrics.sweep_ends(_curves(spark, sf_dir)))


@plan(f"{_WITH} SELECT model, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM (SELECT model, label * 0.9 + 0.05 AS y, greatest(least(p, 1 - 1e-12), 1e-12) AS q FROM scored) GROUP BY model")
def a14_log_loss(spark, sf_dir):
    return _rounded(metrics.log_loss(B.scored(spark, sf_dir), ["model"], smoothing=0.1))


@plan(f"{_WITH}, {_M} SELECT name, param, " + ", ".join(f"round(max(CASE WHEN model = '{m}' THEN {v} END), 6) AS {m}_{a}" for m in ("baseline", "robust") for v, a in (("accuracy", "acc"), ("f1", "f1"), ("roc_auc", "auc"))) + " FROM t GROUP BY name, param")
def a16_wide_table(spark, sf_dir):
    return _rounded(_wide(spark, sf_dir))


def _wide(spark, sf_dir):
    table = _table(spark, sf_dir).select(*KEYS, F.col("accuracy").alias("acc"), "f1", F.col("roc_auc").alias("auc"))
    return metrics.wide(table, ["baseline", "robust"], ["acc", "f1", "auc"])


@plan(f"{_WITH}, {_M} SELECT model, name, param, round(accuracy, 6) AS accuracy, round(ca, 6) AS clean_accuracy FROM t JOIN (SELECT model, accuracy AS ca FROM t WHERE name = 'clean') USING (model)")
def j3_clean_reference(spark, sf_dir):
    return _rounded(joins.with_clean(_table(spark, sf_dir), ["accuracy"]).select(*KEYS, "accuracy", "clean_accuracy"))


_FROZEN = "frozen(ord, name, param, accuracy) AS (VALUES (0, 'clean', '-', 0.9), (1, 'blur', 'sigma1.0', 0.6), (2, 'jpeg', 'q90', 0.8))"


@plan(f"{_WITH}, {_M}, {_FROZEN} SELECT ord, f.name, f.param, CAST(f.accuracy AS DOUBLE) AS accuracy, coalesce(CAST(t.n AS VARCHAR), '-') AS new_n FROM frozen f LEFT JOIN (SELECT * FROM t WHERE model = 'robust') t USING (name, param)")
def j4_frozen_and_new(spark, sf_dir):
    frozen = spark.createDataFrame([(0, "clean", "-", 0.9, 0), (1, "blur", "sigma1.0", 0.6, 0), (2, "jpeg", "q90", 0.8, 0)], "ord int, name string, param string, accuracy double, n long")
    return joins.compared_runs(frozen, _table(spark, sf_dir).where("model = 'robust'"), ["n"]).join(frozen.select("ord", "accuracy"), "ord").select("ord", "name", "param", "accuracy", "new_n")


_EXPECTED = "expected(model) AS (VALUES ('baseline'), ('robust'), ('not there'))"


@plan(f"{_WITH}, {_EXPECTED} SELECT e.model, n, CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status FROM expected e LEFT JOIN (SELECT model, count(*) AS n FROM scored GROUP BY model) USING (model)")
def j5_availability(spark, sf_dir):
    expected = B.names(spark, "model", ("baseline", "robust", "not there"))
    return joins.with_availability(expected, B.scored(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n")))


_WIDE = f"{_M}, w AS (SELECT name, param, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN {v} END) AS {m}_{a}" for m in ("baseline", "robust") for v, a in (("accuracy", "acc"), ("f1", "f1"), ("roc_auc", "auc"))) + " FROM t GROUP BY name, param), c AS (SELECT * FROM w WHERE name = 'clean')"
_TP = "CASE WHEN w.{m}_f1 >= 1 THEN 5000 ELSE round_even(5000 * w.{m}_f1 * (1.0 - w.{m}_acc) / (1.0 - w.{m}_f1), 0) END"


def _errors_sql(m: str) -> str:
    tp = _TP.format(m=m)
    return f"CAST(greatest(0, least(5000, round_even({tp} - (10000 * w.{m}_acc - 5000), 0))) AS BIGINT) AS {m}_fp, CAST(5000 - {tp} AS BIGINT) AS {m}_fn"


@plan(f"{_WITH}, {_WIDE} SELECT w.name, w.param, CASE WHEN w.param = '-' THEN w.name ELSE w.name || ':' || w.param END AS label, " + ", ".join(f"round(w.robust_{v} - w.baseline_{v}, 6) AS {v}_gap" for v in ("acc", "f1", "auc")) + ", " + ", ".join(f"round(w.{m}_{v} / c.{m}_{v}, 6) AS {m}_{v}_retention" for v in ("acc", "f1") for m in ("baseline", "robust")) + f", {_errors_sql('baseline')}, {_errors_sql('robust')} FROM w CROSS JOIN c")
def r1_derived_benchmark(spark, sf_dir):
    table = compare.derived_benchmark(_wide(spark, sf_dir))
    drop = [f"{m}_{v}" for m in ("baseline", "robust") for v in ("acc", "f1", "auc", "bound")]
    return _rounded(table.drop(*drop))


@plan(f"{_WITH}, {_M} " + " UNION ALL ".join(f"SELECT model, '{v}' AS metric, round(max(CASE WHEN name = 'clean' THEN {v} END), 6) AS clean, round(avg(CASE WHEN name <> 'clean' THEN {v} END), 6) AS transformed FROM t GROUP BY model" for v in ("accuracy", "f1", "roc_auc")))
def r2_clean_and_transformed(spark, sf_dir):
    return _rounded(compare.clean_and_transformed(_table(spark, sf_dir)))


@plan(f"{_WITH}, {_WIDE} SELECT w.name, w.param, round(w.baseline_acc / c.baseline_acc, 6) AS baseline, round(w.robust_acc / c.robust_acc, 6) AS robust FROM w CROSS JOIN c")
def r3_retention_matrix(spark, sf_dir):
    return _rounded(compare.retention_matrix(_table(spark, sf_dir), ["baseline", "robust"]))


_R5M = f"m AS ({B.metrics_sql('scored', 'model')}), a AS ({B.auc_sql('scored', 'model')}), r AS (SELECT model, avg(p) AS mean_p, avg(CASE WHEN label = 0 THEN pred END) AS fpr, avg(CASE WHEN label = 1 THEN pred END) AS tpr FROM scored GROUP BY model)"


@plan(f"""{_WITH}, {_EXPECTED}, {_R5M} SELECT e.model, tn, fp, fn, tp, n, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(mean_p, 6) AS mean_p, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(roc_auc, 6) AS roc_auc,
  CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status, round(accuracy - (SELECT accuracy FROM m WHERE model = 'baseline'), 6) AS accuracy_delta FROM expected e LEFT JOIN m USING (model) LEFT JOIN a USING (model) LEFT JOIN r USING (model)""")
def r5_generalisation(spark, sf_dir):
    expected = B.names(spark, "model", ("baseline", "robust", "not there"))
    return _rounded(compare.generalisation(expected, B.stored(B.scored(spark, sf_dir), "scored"), "baseline"))


@plan(f"{_WITH}, {_CURVES} SELECT cohort, sweep, step, round(max(CASE WHEN model = 'baseline' THEN mean_p END), 6) AS baseline, round(max(CASE WHEN model = 'robust' THEN mean_p END), 6) AS robust FROM curves GROUP BY ALL")
def r6_sensitivity(spark, sf_dir):
    return _rounded(compare.sensitivity(_curves(spark, sf_dir), ["baseline", "robust"]))


@plan(f"{_WITH}, {_WIDE} SELECT name, param, round(robust_acc - baseline_acc, 6) AS acc_gap FROM w ORDER BY robust_acc - baseline_acc DESC, name, param LIMIT 2")
def o1_strongest_gains(spark, sf_dir):
    rows = _wide(spark, sf_dir).withColumn("acc_gap", C.gap("robust_acc", "baseline_acc"))
    return _rounded(compare.gap_ranking(rows, n=2, gains=True).select("name", "param", "acc_gap"))
