"""Plans of corruption sweeps, fitting, scoring and their metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from splitforge.functions import columns as C
from splitforge.operators import corrupt, joins, metrics, score, verify
from splitforge.operators.compare import robustness_summary
from splitforge.plans import base as B
from splitforge.sources import publish

PLANS: dict = {}
SEED = B.SEED


def plan(sql: str | None = None):
    def put(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return put


_VALUES = ", ".join(f"({i}, '{n}', '{p}', {v if v is not None else 'NULL'})" for i, (n, p, v) in enumerate(corrupt.SWEEP))
_CATALOGUE = f"catalogue(ord, name, param, value) AS (VALUES {_VALUES})"


@plan(f"WITH {_CATALOGUE} SELECT ord, name, param, CAST(value AS DOUBLE) AS value, (SELECT count(*) FROM embeddings) AS samples FROM catalogue")
def c1_condition_catalogue(spark, sf_dir):
    samples = B.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("samples"))
    return corrupt.catalogue(spark).crossJoin(samples)


@plan(f"WITH {_CATALOGUE} SELECT name, param, count(*) AS n, count(DISTINCT vec_id) AS samples FROM embeddings CROSS JOIN catalogue GROUP BY ALL")
def j1_samples_by_conditions(spark, sf_dir):
    rows = joins.samples_by_conditions(B.vectors(spark, sf_dir).select("sample_id"), corrupt.catalogue(spark))
    return rows.groupBy("name", "param").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("samples"))


_AT = "features[least(greatest(i + {k}, 0), 63) + 1]"


def _blur_sql(sigma: float) -> str:
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    return " + ".join(f"{_AT.format(k=k)} * {w / total!r}" for k, w in zip(range(-reach, reach + 1), weights))


def _noise_sql(name: str, param: str, sigma: float, size: str = "2 * ") -> str:
    parts = [f"'{SEED}'", f"'{name}'", f"'{param}'", "CAST(sample_id AS VARCHAR)", "CAST(i AS VARCHAR)"]
    z = f"round(sqrt(-2.0 * ln({B.uniform_sql(*parts, chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {B.uniform_sql(*parts, chr(39) + 'b' + chr(39))}), 9)"
    return f"greatest(-1.0, least(1.0, features[i + 1] + {size}{sigma!r} * {z}))"


def _down_sql(scale: float) -> str:
    b = max(1, round(1 / scale))
    return f"list_sum(features[(i // {b}) * {b} + 1:(i // {b}) * {b} + {b}]) / {b}"


def _factor_sql(param: str, spread: float, name: str = "color_jitter") -> str:
    u = B.uniform_sql(f"'{SEED}'", f"'{name}'", f"'{param}'", "CAST(sample_id AS VARCHAR)", "'factor'")
    return f"(1 - {spread} + 2 * {spread} * {u})"


_MEAN = "(list_sum(features) / 64)"


def _kernel_sql(name: str, param: str, value) -> str:
    """The value at position i (from 0) of the transformed vector."""
    if name == "jpeg":
        return f"round(features[i + 1] * {value * 0.64!r}) / {value * 0.64!r}"
    if name == "blur":
        return _blur_sql(value)
    if name == "resize":
        return _down_sql(value)
    if name == "noise":
        return _noise_sql(name, param, value)
    if param.startswith("brightness"):
        return f"features[i + 1] * {_factor_sql(param, value)}"
    if param.startswith("contrast"):
        return f"{_MEAN} + (features[i + 1] - {_MEAN}) * {_factor_sql(param, value)}"
    if name == "center_crop":
        inner = math.floor(64 * value)
        return f"features[{(64 - inner) // 2} + CAST(floor((i + 0.5) * {inner} / 64) AS INT) + 1]"
    return "features[i + 1]"


_SWEPT = " ".join(f"WHEN name = '{n}' AND param = '{p}' THEN {_kernel_sql(n, p, v)}" for n, p, v in corrupt.SWEEP)
_SWEEP = f"WITH {B.VECTORS}, {_CATALOGUE}, swept AS (SELECT sample_id, name, param, i, CASE {_SWEPT} END AS v FROM vectors CROSS JOIN catalogue CROSS JOIN (SELECT unnest(range(0, 64)) AS i))"


def _summed(rows, *keys):
    """Sums over positions, weighted by position, so a value in the wrong place shows."""
    weighted = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select(*keys, F.round(weighted, 6).alias("s"))


_LEGACY_NOISE = _noise_sql("noise", "", 15.0 / 255).replace("'noise', '', ", "'noise', ")
_LEGACY_FACTOR = "(1 - 0.3 + 2 * 0.3 * " + B.uniform_sql(f"'{SEED}'", "'color_jitter'", "CAST(sample_id AS VARCHAR)", "'factor'") + ")"
_LEGACY_SQL = [_kernel_sql("jpeg", "", 35.0), _kernel_sql("blur", "", 2.0), _kernel_sql("resize", "", 0.5), _LEGACY_NOISE, f"features[i + 1] * {_LEGACY_FACTOR}", _kernel_sql("center_crop", "", 0.8)]


def _kernel_plan(name: str):
    conditions = tuple(c for c in corrupt.SWEEP if c[0] == name)

    def run(spark, sf_dir):
        return _summed(corrupt.sweep(B.vectors(spark, sf_dir).select("sample_id", "features"), SEED, conditions, lengths=B.LENGTHS), "sample_id", "param")

    return run, f"{_SWEEP} SELECT sample_id, param, round(sum(v * (i + 1)), 6) AS s FROM swept WHERE name = '{name}' GROUP BY ALL"


for _id, _name in (("c3_compress", "jpeg"), ("c4_blur", "blur"), ("c5_down_up", "resize"), ("c6_noise", "noise"), ("c7_jitter", "color_jitter"), ("c8_centre_crop", "center_crop")):
    PLANS[_id] = _kernel_plan(_name)


@plan(f"{_SWEEP} SELECT name, param, count(*) // 64 AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 5) AS spread FROM swept GROUP BY ALL")
def c2_sweep(spark, sf_dir):
    rows = corrupt.sweep(B.vectors(spark, sf_dir).select("sample_id", "features"), SEED, lengths=B.LENGTHS)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    sums = F.aggregate("features", start, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    # Each vector is summed where it is; nothing is exploded.
    rows = rows.select("name", "param", F.size("features").alias("k"), sums.alias("sums"))
    mean, square = F.sum("sums.s") / F.sum("k"), F.sum("sums.q") / F.sum("k")
    return rows.groupBy("name", "param").agg(F.count("*").alias("n"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 5).alias("spread"))


_NAMES = tuple(corrupt.BANKS)
_ORDERED = ", ".join(f"{{'h': sha256(concat_ws('|', '{SEED}', 'order', '{n}', CAST(sample_id AS VARCHAR))), 'n': '{n}'}}" for n in _NAMES)
_GATE = B.uniform_sql(f"'{SEED}'", "'gate'", "CAST(sample_id AS VARCHAR)")


_STEPS = 2


def _drawn_sql(k: int) -> str:
    """The value at position i (from 0) after the kernel that was drawn for step k, with its drawn parameter."""
    cases = []
    for name, bank in corrupt.BANKS.items():
        index = f"floor({B.uniform_sql(f"'{SEED}'", "'parameter'", f"'{name}'", 'CAST(sample_id AS VARCHAR)')} * {len(bank)})"
        for i, value in enumerate(bank):
            if name in ("brightness", "contrast"):
                factor = _factor_sql(str(k), value, name)
                v = f"features[i + 1] * {factor}" if name == "brightness" else f"{_MEAN} + (features[i + 1] - {_MEAN}) * {factor}"
            else:
                v = _kernel_sql(name, str(k), value)
            cases.append(f"WHEN applied[{k + 1}] = '{name}' AND {index} = {i} THEN {v}")
    return f"CASE {' '.join(cases)} ELSE features[i + 1] END"


def _augmented_sql(source: str) -> str:
    """Relations step0, step1 and step2: a relation (sample_id, label, features) and what each drawn kernel makes of it."""
    applied = f"CASE WHEN {_GATE} < 0.5 THEN list_transform(list_sort([{_ORDERED}])[1:{_STEPS}], lambda s: s.n) ELSE [] END"
    parts = [f"step0 AS (SELECT sample_id, label, features, {applied} AS applied FROM {source})"]
    for k in range(_STEPS):
        parts.append(f"""step{k + 1} AS (SELECT sample_id, any_value(label) AS label, list(v ORDER BY i) AS features, any_value(applied) AS applied
  FROM (SELECT sample_id, label, applied, i, {_drawn_sql(k)} AS v FROM step{k} CROSS JOIN (SELECT unnest(range(0, 64)) AS i)) GROUP BY sample_id)""")
    return ", ".join(parts)


@plan(f"WITH {B.VECTORS}, {_augmented_sql('vectors')} SELECT sample_id, array_to_string(applied, ',') AS applied, round(list_sum(list_transform(range(0, 64), lambda j: features[j + 1] * (j + 1))), 6) AS s FROM step{_STEPS}")
def c9_random_augmentation(spark, sf_dir):
    rows = corrupt.augmented(B.vectors(spark, sf_dir).select("sample_id", "features"), SEED, num=_STEPS, lengths=B.LENGTHS)
    return _summed(rows, "sample_id", F.array_join("applied", ",").alias("applied"))


_PICK = B.uniform_sql(f"'{SEED}'", "'pick'", "CAST(sample_id AS VARCHAR)")
_LEGACY = " ".join(f"WHEN k = {i} THEN '{n}:{p}'" for i, (n, p, _) in enumerate(corrupt.LEGACY))


_LEGACY_VALUE = " ".join(f"WHEN k = {i} THEN {v}" for i, v in enumerate(_LEGACY_SQL))


@plan(f"""WITH {B.VECTORS}, picked AS (SELECT sample_id, features, CASE WHEN {_GATE} < 0.5 THEN floor({_PICK} * {len(corrupt.LEGACY)}) END AS k FROM vectors)
SELECT sample_id, applied, round(sum(v * (i + 1)), 6) AS s FROM (SELECT sample_id, i, CASE {_LEGACY} END AS applied, CASE {_LEGACY_VALUE} ELSE features[i + 1] END AS v FROM picked CROSS JOIN (SELECT unnest(range(0, 64)) AS i)) GROUP BY ALL""")
def c11_legacy_corruptions(spark, sf_dir):
    return _summed(corrupt.legacy(B.vectors(spark, sf_dir).select("sample_id", "features"), SEED, lengths=B.LENGTHS), "sample_id", "applied")


def _probe_sql() -> str:
    out = []
    for name, steps in corrupt.PROBES:
        for step, value in enumerate(steps):
            if step == 0:
                v = "features[i + 1]"
            elif name == "grain":
                v = _noise_sql(name, str(step), value / 255)
            else:
                v = _blur_sql(value) if name == "blur" else _down_sql(value / 1024)
            out.append(f"SELECT '{name}' AS sweep, {step} AS step, sample_id, sum(({v}) * (i + 1)) AS s FROM vectors CROSS JOIN (SELECT unnest(range(0, 64)) AS i) GROUP BY sample_id")
    return " UNION ALL ".join(out)


@plan(f"WITH {B.VECTORS} SELECT sweep, step, count(*) AS n, round(avg(s), 5) AS mean FROM ({_probe_sql()}) GROUP BY ALL")
def c12_probe_sweeps(spark, sf_dir):
    rows = corrupt.probe(B.vectors(spark, sf_dir).select("sample_id", "features"), SEED, lengths=B.LENGTHS)
    weighted = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("sweep", "step").agg(F.count("*").alias("n"), F.round(F.avg(weighted), 5).alias("mean"))


@plan("SELECT p_partkey, CAST(greatest(1, round_even(w * s, 0)) AS INT) AS w, CAST(greatest(1, round_even(h * s, 0)) AS INT) AS h FROM (SELECT p_partkey, w, h, CASE WHEN greatest(w, h) > 512 THEN CAST(512 AS DOUBLE) / greatest(w, h) ELSE 1.0 END AS s FROM (SELECT p_partkey, p_size * 37 AS w, CAST(p_partkey * 53 % 900 + 1 AS INT) AS h FROM part))")
def c13_capped_dimensions(spark, sf_dir):
    rows = B.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).alias("orig_w"), (F.col("p_partkey") * 53 % 900 + 1).cast("int").alias("orig_h"))
    return corrupt.capped_dimensions(rows, 512).select("p_partkey", "w", "h")


@plan(f"WITH {_CATALOGUE} SELECT name, param, (SELECT count(*) FROM embeddings) AS n FROM catalogue")
def v7_reproducible_digests(spark, sf_dir):
    """The conditions of the sweep, all of which give the same digests when the samples are dealt otherwise."""
    samples = B.vectors(spark, sf_dir).select("sample_id", "features")
    first = verify.condition_digests(corrupt.sweep(samples, SEED, lengths=B.LENGTHS))
    second = verify.condition_digests(corrupt.sweep(samples.repartition(5), SEED, lengths=B.LENGTHS))
    return first.join(verify.not_reproduced(first, second), ["name", "param"], "left_anti").select("name", "param", "n")


# Models

_MODEL = """{m}_model AS (SELECT i, avg(CASE WHEN label = 1 THEN v END) - avg(CASE WHEN label = 0 THEN v END) AS w, (avg(CASE WHEN label = 1 THEN v END) + avg(CASE WHEN label = 0 THEN v END)) / 2 AS mid
  FROM {rows} GROUP BY i)"""
_TRAIN = f"""{B.KEYED}, {B.SPLITS}, train_rows AS (SELECT v.label, i, v.features[i + 1] AS v FROM vectors v JOIN splits s USING (sample_id) CROSS JOIN (SELECT unnest(range(0, 64)) AS i) WHERE s.split = 'train')"""
_AUGMENTED = _augmented_sql("(SELECT v.sample_id, v.label, v.features FROM vectors v JOIN splits s USING (sample_id) WHERE s.split = 'train')")
_BOTH = f"(SELECT label, i, v FROM train_rows UNION ALL SELECT label, i, features[i + 1] FROM step{_STEPS} CROSS JOIN (SELECT unnest(range(0, 64)) AS i))"
_MODELS = f"{_TRAIN}, {_AUGMENTED}, {_MODEL.format(m='base', rows='train_rows')}, {_MODEL.format(m='robust', rows=_BOTH)}"


def _train(spark, sf_dir):
    split = B.splits(spark, sf_dir).select("sample_id", "split")
    return B.vectors(spark, sf_dir).join(split, "sample_id")


def _models(train):
    """The centroid model of the clean rows, and that of the clean ones and the same randomly augmented."""
    noisy = corrupt.augmented(train, SEED, num=_STEPS, lengths=B.LENGTHS).drop("applied")
    return score.centroid_model(train, "baseline"), score.centroid_model(train.unionByName(noisy), "robust")


@plan(f"WITH {B.VECTORS}, {_MODELS} SELECT 'baseline' AS model, CAST(i AS INT) AS pos, round(w, 8) AS w, round(mid, 8) AS mid FROM base_model")
def m2_centroid_model(spark, sf_dir):
    model = _models(_train(spark, sf_dir).where("split = 'train'"))[0]
    return model.select("model", "pos", F.round("w", 8).alias("w"), F.round("mid", 8).alias("mid"))


@plan(f"WITH {B.VECTORS}, {_MODELS} SELECT 'robust' AS model, CAST(i AS INT) AS pos, round(w, 8) AS w, round(mid, 8) AS mid FROM robust_model")
def m3_robust_model(spark, sf_dir):
    model = _models(_train(spark, sf_dir).where("split = 'train'"))[1]
    return model.select("model", "pos", F.round("w", 8).alias("w"), F.round("mid", 8).alias("mid"))


_TEST = "(SELECT sample_id FROM splits WHERE split = 'test')"
_MARGINS = "SELECT x.sample_id, '{m}' AS model, round(sum((v.features[x.i + 1] - x.mid) * x.w), 6) AS margin FROM (SELECT s.sample_id, m.i, m.w, m.mid FROM " + _TEST + " s CROSS JOIN {m0}_model m) x JOIN vectors v USING (sample_id) GROUP BY x.sample_id"


@plan(f"WITH {B.VECTORS}, {_MODELS} {_MARGINS.format(m='baseline', m0='base')} UNION ALL {_MARGINS.format(m='robust', m0='robust')}")
def m4_batch_scores(spark, sf_dir):
    rows = B.stored(_train(spark, sf_dir), "samples")
    first, second = _models(rows.where("split = 'train'"))
    scored = score.score(rows.where("split = 'test'"), first.unionByName(second))
    return scored.select("sample_id", "model", F.round("margin", 6).alias("margin"))


#: Candidates of the fit by epochs, how many epochs they have, and after how many without a better f1 they stop.
_CANDIDATES = (score.Candidate("slow", 0.5, 0.001), score.Candidate("steady", 4.0, 0.001), score.Candidate("fast", 32.0, 0.0))
_EPOCHS, _PATIENCE = 12, 3


def _fit_sql() -> str:
    """Relations w1, w2, ... of the weights that each epoch begins with (candidate, w), e1, ... of its lines, and log, those up to
    where each candidate stops."""
    given = ", ".join(f"({k}, '{c.name}', {c.rate!r}::DOUBLE, {c.reg!r}::DOUBLE)" for k, c in enumerate(_CANDIDATES))
    parts = [
        f"given(ord, candidate, rate, reg) AS (VALUES {given})",
        "fit_rows AS MATERIALIZED (SELECT v.sample_id, v.label, s.split, list_append(v.features, 1.0) AS x FROM vectors v JOIN splits s USING (sample_id))",
        "w1 AS (SELECT candidate, list_transform(range(0, 65), lambda i: 0.0::DOUBLE) AS w FROM given)",
    ]
    for e in range(1, _EPOCHS + 1):
        parts.append(f"""p{e} AS MATERIALIZED (SELECT split, label, x, candidate, least(greatest(1 / (1 + exp(-list_dot_product(x, w))), 1e-12), 1 - 1e-12) AS p FROM fit_rows CROSS JOIN w{e} WHERE split <> 'test')""")
        parts.append(f"""e{e} AS (SELECT {e} AS epoch, candidate, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) FILTER (split = 'train') AS train_loss, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) FILTER (split = 'val') AS val_loss,
  count(*) FILTER (split = 'val' AND label = 0 AND p < 0.5) AS tn, count(*) FILTER (split = 'val' AND label = 0 AND p >= 0.5) AS fp, count(*) FILTER (split = 'val' AND label = 1 AND p < 0.5) AS fn, count(*) FILTER (split = 'val' AND label = 1 AND p >= 0.5) AS tp FROM p{e} GROUP BY candidate)""")
        parts.append(f"""w{e + 1} AS MATERIALIZED (SELECT candidate, list(w - rate * (g + CASE WHEN i < 65 THEN reg * w ELSE 0 END) ORDER BY i) AS w
  FROM (SELECT candidate, i, avg((p - label) * v) AS g FROM (SELECT candidate, p, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p{e} WHERE split = 'train') GROUP BY candidate, i)
  JOIN (SELECT candidate, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w{e}) USING (candidate, i) JOIN given USING (candidate) GROUP BY candidate)""")
    every = " UNION ALL ".join(f"SELECT * FROM e{e}" for e in range(1, _EPOCHS + 1))
    parts.append(f"""shown AS (SELECT epoch, candidate, train_loss, val_loss, (tp + tn) / (tn + fp + fn + tp) AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS "precision",
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM ({every}))""")
    parts.append("marked AS (SELECT *, f1 > coalesce(max(f1) OVER (PARTITION BY candidate ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS improved FROM shown)")
    parts.append("since AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY candidate ORDER BY epoch) AS waited FROM marked)")
    parts.append(f"log AS (SELECT s.* FROM since s LEFT JOIN (SELECT candidate, min(epoch) AS stop FROM since WHERE waited >= {_PATIENCE} GROUP BY candidate) t USING (candidate) WHERE stop IS NULL OR epoch <= stop)")
    parts.append("best AS (SELECT epoch, candidate FROM log JOIN given USING (candidate) ORDER BY f1 DESC, epoch, ord LIMIT 1)")
    weights = " UNION ALL ".join(f"SELECT {e} AS epoch, candidate, w FROM w{e}" for e in range(1, _EPOCHS + 1))
    parts.append(f"chosen AS (SELECT w FROM ({weights}) JOIN best USING (epoch, candidate))")
    return f"{B.VECTORS}, {B.KEYED}, {B.SPLITS}, {', '.join(parts)}"


_ROUNDED = """epoch, candidate, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, improved"""


def _fit(spark, sf_dir, log_path=None):
    rows = B.stored(_train(spark, sf_dir).select("sample_id", "label", "features", "split"), "samples")
    return score.fit_by_epochs(rows.where("split != 'test'"), _CANDIDATES, _EPOCHS, _PATIENCE, B.LENGTHS[0], log_path), rows


def _rounded_log(log):
    return log.select(*(C.rounded(c).alias(c) if t == "double" else F.col(c) for c, t in log.dtypes))


@plan(f"WITH {_fit_sql()} SELECT {_ROUNDED} FROM log")
def m6_epoch_log(spark, sf_dir):
    """The log of three candidates, appended epoch by epoch and read back."""
    path = B.scratch(spark, "epochs")
    _fit(spark, sf_dir, path)
    return _rounded_log(publish.log(spark, path, score.LOG).drop("batch"))


_EVERY_P = " UNION ALL ".join(f"SELECT {e} AS epoch, candidate, label, p FROM p{e} WHERE split = 'val'" for e in range(1, _EPOCHS + 1))


@plan(f"WITH {_fit_sql()}, every_p AS ({_EVERY_P}), aucs AS ({B.auc_sql('every_p', 'epoch, candidate')}) SELECT epoch, candidate, round(roc_auc, 6) AS roc_auc FROM aucs JOIN log USING (epoch, candidate)")
def m6_epoch_aucs(spark, sf_dir):
    """The area under the curve of every epoch of the log."""
    fit, rows = _fit(spark, sf_dir)
    return score.epoch_aucs(fit, rows.where("split = 'val'")).withColumn("roc_auc", F.round("roc_auc", 6))


@plan(f"WITH {_fit_sql()} SELECT {_ROUNDED} FROM log JOIN best USING (epoch, candidate)")
def m6_best_candidate(spark, sf_dir):
    """The line of the epoch and candidate that win on val."""
    fit, _ = _fit(spark, sf_dir)
    epoch, name = fit.best
    return _rounded_log(fit.log).where((F.col("epoch") == epoch) & (F.col("candidate") == name))


_TESTED = "tested AS (SELECT sample_id, label, list_dot_product(x, w) AS margin FROM fit_rows CROSS JOIN chosen WHERE split = '{split}'), scored AS (SELECT *, 'probe' AS model, CAST(1 / (1 + exp(-margin)) >= 0.5 AS INT) AS pred FROM tested)"


@plan(f"WITH {_fit_sql()}, {_TESTED.format(split='test')}, m AS ({B.metrics_sql('scored', 'model')}) SELECT * FROM m")
def m1_linear_probe(spark, sf_dir):
    """The winner of the epochs on the test rows."""
    fit, rows = _fit(spark, sf_dir)
    return metrics.classification(score.fitted_scores(fit.weights[fit.best], rows.where("split = 'test'"), "probe"), ["model"])


@plan(f"""WITH {_fit_sql()}, {_TESTED.format(split='val')} SELECT sample_id, label, round(-margin, 6) AS logit_0, round(margin, 6) AS logit_1, round(1 - 1 / (1 + exp(-margin)), 6) AS p_0, round(1 / (1 + exp(-margin)), 6) AS p_1, pred FROM scored""")
def m5_diagnostic_scores(spark, sf_dir):
    """Logits and probabilities of both classes of the val rows under the winner."""
    fit, rows = _fit(spark, sf_dir)
    scored = score.fitted_scores(fit.weights[fit.best], rows.where("split = 'val'"), "probe")
    return scored.select("sample_id", "label", *(F.round(c, 6).alias(c) for c in ("logit_0", "logit_1", "p_0", "p_1")), "pred")


# Flagship: how much accuracy the scorers keep under each corruption

def _judged_sql(conditions) -> str:
    """Margins of both models for every sample outside train under every condition."""
    values = ", ".join(f"('{n}', '{p}')" for n, p, _ in conditions)
    swept = " ".join(f"WHEN name = '{n}' AND param = '{p}' THEN {_kernel_sql(n, p, v)}" for n, p, v in conditions)
    return f"""{B.VECTORS}, {_MODELS}, both_models AS (SELECT 'baseline' AS model, * FROM base_model UNION ALL SELECT 'robust', * FROM robust_model),
  swept AS (SELECT v.sample_id, v.label, c.name, c.param, x.i, CASE {swept} END AS v FROM vectors v JOIN splits s USING (sample_id) CROSS JOIN (VALUES {values}) c(name, param) CROSS JOIN (SELECT unnest(range(0, 64)) AS i) x WHERE s.split <> 'train'),
  judged AS (SELECT model, name, param, sample_id, label, round(sum((v - mid) * w), 9) AS margin FROM swept JOIN both_models USING (i) GROUP BY ALL)"""


def _summary_sql(conditions) -> str:
    relations = f"""{_judged_sql(conditions)},
  scored AS (SELECT *, 1 / (1 + exp(-margin)) AS p, CAST(1 / (1 + exp(-margin)) >= 0.5 AS INT) AS pred FROM judged),
  m AS ({B.metrics_sql('scored', 'model, name, param')}), a AS ({B.auc_sql('scored', 'model, name, param')}), r AS (SELECT m.*, a.roc_auc FROM m JOIN a USING (model, name, param)),
  clean AS (SELECT model, accuracy AS ca, f1 AS cf FROM r WHERE name = 'clean')"""
    return f"""WITH {relations} SELECT r.name, r.param, r.model, tn, fp, fn, tp, n, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc,
  CASE WHEN ca <> 0 THEN round(accuracy / ca, 6) END AS accuracy_retention, round(ca - accuracy, 6) AS accuracy_drop, CASE WHEN cf <> 0 THEN round(f1 / cf, 6) END AS f1_retention, round(cf - f1, 6) AS f1_drop,
  round(max(CASE WHEN r.model = 'robust' THEN accuracy END) OVER (PARTITION BY r.name, r.param) - max(CASE WHEN r.model = 'baseline' THEN accuracy END) OVER (PARTITION BY r.name, r.param), 6) AS accuracy_gap
  FROM r JOIN clean USING (model)"""


def _judged(spark, sf_dir, conditions):
    """Split, fit two centroid scorers on train, corrupt the other samples, score each changed row with both."""
    rows = B.stored(_train(spark, sf_dir), "samples")
    first, second = _models(rows.where("split = 'train'"))
    swept = corrupt.sweep(rows.where("split != 'train'").select("sample_id", "label", "features"), SEED, conditions, lengths=B.LENGTHS)
    return B.stored(score.score(swept, first.unionByName(second)).drop("features"), "scored")


@plan(f"""WITH {_judged_sql(corrupt.SWEEP)} SELECT name, param, CAST(sum(n) AS BIGINT) AS pairs, count(*) AS samples, round(avg(gap), 6) AS gap, round(max(abs(gap)), 6) AS largest
  FROM (SELECT name, param, sample_id, count(*) AS n, sum(CASE WHEN model = 'robust' THEN margin ELSE -margin END) AS gap FROM judged GROUP BY ALL) GROUP BY ALL""")
def j2_paired_models(spark, sf_dir):
    """Each transformed row scored by both models, and how far their margins on the same row are apart."""
    gap = F.sum(F.when(F.col("model") == "robust", F.col("margin")).otherwise(-F.col("margin")))
    paired = _judged(spark, sf_dir, corrupt.SWEEP).groupBy("name", "param", "sample_id").agg(F.count("*").alias("n"), gap.alias("gap"))
    return paired.groupBy("name", "param").agg(F.sum("n").alias("pairs"), F.count("*").alias("samples"), F.round(F.avg("gap"), 6).alias("gap"), F.round(F.max(F.abs("gap")), 6).alias("largest"))


def _summary(spark, sf_dir, conditions):
    table = robustness_summary(_judged(spark, sf_dir, conditions))
    return table.select(*(C.rounded(c).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes))


@plan(_summary_sql(corrupt.SWEEP))
def r4_robustness_summary(spark, sf_dir):
    """The summary of all conditions of the sweep."""
    return _summary(spark, sf_dir, corrupt.SWEEP)


@plan(f"""SELECT model, count(*) AS conditions, round(avg(accuracy), 5) AS accuracy, round(avg(f1), 5) AS f1, round(avg(roc_auc), 5) AS roc_auc, round(avg(accuracy_retention), 5) AS accuracy_retention, round(avg(f1_retention), 5) AS f1_retention,
  CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM ({_summary_sql(corrupt.SWEEP)}) GROUP BY model""")
def r4_sweep_means(spark, sf_dir):
    """The means of the summary over all conditions, and the errors summed."""
    means = [F.round(F.avg(c), 5).alias(c) for c in ("accuracy", "f1", "roc_auc", "accuracy_retention", "f1_retention")]
    return _summary(spark, sf_dir, corrupt.SWEEP).groupBy("model").agg(F.count("*").alias("conditions"), *means, F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


@plan(_summary_sql(corrupt.SWEEP))
def r4_whole_sweep(spark, sf_dir):
    """The summary of all conditions under the name that it was first registered with."""
    return _summary(spark, sf_dir, corrupt.SWEEP)
