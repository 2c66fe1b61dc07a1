import hashlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitforge.functions import columns as C
from splitforge.operators import compare, corrupt, dedup, metrics, sampling, score, verify
from splitforge.sources import listing, publish, readers, writers

#: A published benchmark of 17 conditions, and error counts that must follow from its first rows.
BENCHMARK = """clean,-,0.915,0.915,0.969,0.897,0.899,0.957
jpeg,q90,0.912,0.912,0.968,0.896,0.897,0.955
jpeg,q70,0.908,0.911,0.967,0.895,0.897,0.955
jpeg,q50,0.864,0.868,0.936,0.862,0.860,0.929
jpeg,q30,0.862,0.852,0.944,0.857,0.857,0.925
blur,sigma0.5,0.786,0.734,0.943,0.875,0.867,0.946
blur,sigma1.0,0.569,0.259,0.749,0.819,0.815,0.892
blur,sigma2.0,0.531,0.359,0.548,0.728,0.683,0.831
resize,scale0.5,0.554,0.236,0.681,0.803,0.794,0.876
resize,scale0.25,0.524,0.372,0.537,0.721,0.677,0.812
noise,sigma0.02,0.887,0.887,0.956,0.875,0.875,0.946
noise,sigma0.05,0.744,0.736,0.836,0.822,0.827,0.900
noise,sigma0.10,0.533,0.454,0.547,0.660,0.573,0.737
color_jitter,brightness_pm20,0.911,0.911,0.967,0.891,0.893,0.956
color_jitter,contrast_pm20,0.906,0.906,0.966,0.891,0.893,0.952
color_jitter,saturation_pm20,0.914,0.915,0.969,0.895,0.897,0.957
center_crop,keep0.80,0.664,0.506,0.861,0.833,0.827,0.905"""
DERIVED = {"clean": (425, 425, 614, 416, 1.0), "jpeg:q90": (440, 440, 569, 471, 0.998885), "jpeg:q70": (629, 291, 622, 428, 0.99777), "jpeg:q50": (832, 528, 619, 761, 0.960981)}


def test_derived_benchmark(spark):
    rows = [[a, b, *map(float, x)] for a, b, *x in (line.split(",") for line in BENCHMARK.splitlines())]
    wide = spark.createDataFrame(rows, "name string, param string, baseline_acc double, baseline_f1 double, baseline_auc double, robust_acc double, robust_f1 double, robust_auc double")
    table = {r.label: r for r in compare.derived_benchmark(wide).collect()}
    assert len(table) == 17
    for label, (bfp, bfn, rfp, rfn, kept) in DERIVED.items():
        r = table[label]
        assert (r.baseline_fp, r.baseline_fn, r.robust_fp, r.robust_fn, round(r.robust_acc_retention, 6)) == (bfp, bfn, rfp, rfn, kept)
    assert round(table["clean"].acc_gap, 6) == -0.018
    assert 20 < table["clean"].baseline_bound < 40
    means = [sum(r[f"{m}_acc"] for r in table.values()) / 17 for m in ("baseline", "robust")]
    assert [round(m, 3) for m in means] == [0.764, 0.836]


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, p double").withColumn("pred", C.predict("p"))


@pytest.mark.parametrize("rows,auc", [([(1, 0.5), (0, 0.5)], 0.5), ([(1, 0.9), (0, 0.1)], 1.0), ([(1, 0.1), (0, 0.9)], 0.0), ([(1, 0.3), (1, 0.7)], None), ([(1, 0.5), (0, 0.5), (0, 0.2), (1, 0.2)], 0.5)])
def test_auc_with_ties_and_one_class(spark, rows, auc):
    assert metrics.roc_auc(scored(spark, rows)).first()[0] == auc


def test_metrics_of_nothing(spark):
    r = metrics.classification(scored(spark, [])).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.n, r.accuracy, r.f1) == (0, 0, 0, 0, 0, None, None)
    r = metrics.classification(scored(spark, [(0, 0.1)])).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (1.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("n", [1, 5, 15, 25])
def test_split_sizes_round_half_to_even(spark, n):
    rows = spark.range(n).select(F.col("id").alias("sample_id"), F.lit(1).alias("label"))
    counts = {r.split: r["count"] for r in sampling.stratified_split(rows, 1).groupBy("split").count().collect()}
    assert counts.get("train", 0) == round(0.8 * n) and counts.get("val", 0) == round(0.1 * n) and sum(counts.values()) == n


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.range(300).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("label"), F.concat(F.lit("g"), F.col("id") % 40).alias("group"), F.array([F.lit(0.1 * k) for k in range(8)]).alias("features"))
    for f in (lambda d: sampling.stratified_split(d, 3), lambda d: sampling.group_split(d, 3, 0.2), lambda d: corrupt.augmented(d, 3), lambda d: corrupt.legacy(d, 3)):
        first = sorted(map(str, f(rows).collect()))
        assert first == sorted(map(str, f(rows.repartition(7).orderBy(F.desc("sample_id"))).collect()))


def test_groups_do_not_straddle_and_duplicates_do_not_matter(spark):
    rows = spark.range(200).select(F.col("id").alias("sample_id"), (F.col("id") % 30).alias("group"), (F.col("id") % 50).alias("content_hash"))
    split = sampling.group_split(rows, 5, 0.3)
    assert split.groupBy("group").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    once = dedup.first_wins(rows, "content_hash", ["sample_id"])
    assert sorted(once.collect()) == sorted(dedup.first_wins(rows.unionByName(rows), "content_hash", ["sample_id"]).collect())


def test_caps(spark):
    rows = spark.range(20).select(F.col("id").alias("sample_id"), (F.col("id") < 3).cast("int").alias("label"))
    assert sampling.class_balanced_cap(rows, 1, 11).groupBy("label").count().sort("label").collect() == [(0, 5), (1, 3)]
    assert sampling.class_balanced_cap(rows, 1, None).count() == sampling.class_balanced_cap(rows, 1, 20).count() == 20


def test_probe_equals_newton_steps_and_the_best_setting_wins(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 3)) * [1, 2, 0.5] + [0, 1, 2]
    y = (x @ [1.0, -0.7, 0.4] + draw.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], "sample_id long, label int, features array<double>")
    found = {r.sample_id: (r.logit_1, r.p_1) for r in score.probe_scores(score.linear_probe(rows, reg=0.01, iterations=200), rows, "probe").collect()}
    # The penalty is on coefficients of features divided by their deviation.
    z = np.column_stack([x / x.std(axis=0, ddof=1), np.ones(300)])
    w, penalty = np.zeros(4), np.diag([0.01, 0.01, 0.01, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z / 300 + penalty, z.T @ (p - y) / 300 + penalty @ w)
    for i, (logit, p) in found.items():
        assert abs(logit - z[i] @ w) < 1e-3 and abs(p - 1 / (1 + np.exp(-z[i] @ w))) < 1e-4
    log = score.candidate_log(rows.where("sample_id < 200"), rows.where("sample_id >= 200"), (10.0, 0.01)).collect()
    best = score.best_candidate(spark.createDataFrame(log)).first()
    assert best.f1 == max(r.f1 for r in log) and best.epoch == min(r.epoch for r in log if r.f1 == best.f1)


def plain_draw(*parts):
    return (int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16) + 1) / (16**15 + 1)


def test_augmentation_in_plain_python(spark):
    """Which kernels are drawn, with which parameter, and what the vectors become, for kernels without draws of their own."""
    names = ("jpeg", "resize", "center_crop")
    draw = np.random.default_rng(5)
    vectors = {i: draw.uniform(-1, 1, 16) for i in range(60)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "sample_id long, features array<double>")
    found = {r.sample_id: r for r in corrupt.augmented(rows, 9, p=0.7, num=2, names=names).collect()}
    kernels = {
        "jpeg": lambda v, q: np.sign(v) * np.floor(np.abs(v) * q * 0.64 + 0.5) / (q * 0.64), "resize": lambda v, s: np.repeat(v.reshape(-1, round(1 / s)).mean(axis=1), round(1 / s)),
        "center_crop": lambda v, k: v[2 + np.floor((np.arange(16) + 0.5) * 12 / 16).astype(int)],
    }
    for i, v in vectors.items():
        order = sorted(names, key=lambda n: hashlib.sha256(f"9|order|{n}|{i}".encode()).hexdigest())[:2] if plain_draw(9, "gate", i) < 0.7 else []
        for n in order:
            bank = corrupt.BANKS[n]
            v = kernels[n](v, bank[int(plain_draw(9, "parameter", n, i) * len(bank))])
        assert found[i].applied == order and np.allclose(found[i].features, v, atol=1e-9), i


def test_best_epoch_ignores_nan_and_takes_the_earliest(spark):
    log = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, 0.7), (4, 0.7), (5, None)], "epoch int, f1 double")
    assert sampling.best_epoch(log).first().epoch == 3


def clean_splits(spark):
    rows = [(i, i % 2, f"g{i % 4}" if i % 2 else None, None if i % 2 else f"s{i % 3}", f"h{i}", ("train", "val", "test")[i % 3]) for i in range(60)]
    return spark.createDataFrame(rows, "sample_id long, label int, generator string, source string, content_hash string, split string")


@pytest.mark.parametrize(
    "defect,check",
    [
        (lambda d: d.unionByName(d.where("sample_id = 3").withColumn("split", F.lit("val")).withColumn("content_hash", F.lit("new"))), "overlap:train-val"),
        (lambda d: d.withColumn("content_hash", F.when(F.col("sample_id") == 1, "h0").otherwise(F.col("content_hash"))), "content overlap:train-val"),
        (lambda d: d.withColumn("generator", F.when(F.col("sample_id") == 1, "").otherwise(F.col("generator"))), "blank generator"),
        (lambda d: d.unionByName(d.where("sample_id = 3")), "duplicate in split"),
        (lambda d: d.withColumn("generator", F.when(F.col("sample_id") == 3, "held").otherwise(F.col("generator"))), "held out in training"),
    ],
)
def test_planted_defects_are_found_alone(spark, defect, check):
    held = spark.createDataFrame([("held",)], "generator string"), spark.createDataFrame([("nowhere",)], "source string")
    base = clean_splits(spark).withColumn("generator", F.when(F.col("sample_id") == 5, "held").otherwise(F.col("generator")))
    found = {r.check for r in verify.independent_report(base, *held).collect() if r.n}
    assert not found
    assert {r.check for r in verify.independent_report(defect(base), *held).collect() if r.n} == {check}


def test_missing_files_and_report(spark):
    rows = clean_splits(spark)
    listing = rows.where("sample_id != 4").select("sample_id")
    found = {r.check: (r.n, r.examples) for r in verify.split_report(rows, targets={"train": 1 / 3, "val": 1 / 3, "test": 1 / 3}, listing=listing).collect() if r.n}
    assert found == {"missing file": (1, ["4"])}
    assert verify.passed(verify.split_report(rows, listing=listing.where("sample_id < 0"))).first().ok is False


def test_quota_plan_is_strict(spark):
    rows = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2, "generator string")
    assert verify.quota_plan(rows, 10, 4, 2).orderBy("generator").collect() == [("a", 5, 4), ("b", 2, 2)]
    with pytest.raises(Exception, match="too few rows of b"):
        verify.quota_plan(rows, 10, 4, 3).collect()


def test_unknown_transform_and_user_kernels(spark):
    with pytest.raises(ValueError, match="unknown transform"):
        corrupt.named("fog")
    corrupt.add("negative", lambda v, value, *seed: F.transform(v, lambda x: -x))
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "sample_id int, features array<double>")
    assert corrupt.augmented(rows, 1, p=1.1, num=1, names=["negative"]).first().features == [-1.0, -2.0]
    with pytest.raises(ValueError):
        corrupt.add("nothing")
    corrupt.add("mirror", build=lambda value, n: corrupt.Kernel(mix=[[(n - 1 - i, value)] for i in range(n)]), parameter="factor", values=(2.0,))
    assert corrupt.augmented(rows, 1, p=1.1, num=1, names=["mirror"]).first().features == [4.0, 2.0]
    shown = {r.name: tuple(r)[1:] for r in corrupt.described(spark).collect()}
    assert shown["mirror"] == ("factor", [2.0], "kernel") and shown["negative"][2] == "column" and shown["jpeg"][0] == "quality in percent"
    corrupt.remove("negative")
    corrupt.remove("mirror")


def test_lengths_of_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 6.0]), (2, [0.5]), (3, []), (4, None)], "sample_id int, features array<double>")
    swept = corrupt.sweep(rows, 1, (("resize", "scale0.5", 0.5), ("clean", "-", None)))
    got = {(r.sample_id, r.name): r.features for r in swept.collect()}
    assert got[1, "resize"] == [1.5, 1.5, 6.0] and got[2, "resize"] == [0.5] and got[3, "resize"] == [] and got[4, "resize"] is None
    assert got[1, "clean"] == [1.0, 2.0, 6.0] and len(got) == 8
    with pytest.raises(Exception, match="kernels are for others"):
        corrupt.sweep(rows, 1, (("resize", "scale0.5", 0.5),), lengths=(3,)).collect()


def test_policies(spark):
    rows = spark.createDataFrame([(None,), (0.4,)], "p double")
    assert [r[0] for r in rows.select(C.unreadable("p", "zero")).collect()] == [0.0, 0.4]
    with pytest.raises(Exception, match="no prediction"):
        rows.select(C.unreadable("p", "fail")).collect()
    with pytest.raises(ValueError):
        C.unreadable("p", "other")


def test_sources_and_sinks(spark, tmp_path):
    for name in ("train/real/a.JPG", "train/fake/b.png", "train/other/c.png", "train/fake/d.txt", "e.tif"):
        (tmp_path / "set" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / name).write_bytes(name.encode())
    folder = str(tmp_path / "set")
    assert readers.files(spark, folder).count() == 3
    assert readers.files(spark, folder, readers.MORE_EXTENSIONS).count() == 4
    found = {r.path.rsplit("/", 1)[-1]: r.label for r in readers.labelled_folders(spark, folder).collect()}
    assert found == {"a.JPG": 0, "b.png": 1}
    before = spark.createDataFrame(readers.snapshot(spark, folder).collect())
    assert before.count() == 5
    (tmp_path / "set" / "e.tif").write_bytes(b"changed")
    assert [r.change for r in verify.frozen_changes(before, readers.snapshot(spark, folder)).collect()] == ["altered"]

    path = str(tmp_path / "manifest")
    rows = spark.createDataFrame([("a", 1), ("b", 0)], "image_path string, label int")
    writers.manifest(rows.coalesce(1), path, ["image_path", "label"])
    assert sorted(readers.strict_manifest(spark, path).collect()) == [("a", 1), ("b", 0)]
    with pytest.raises(FileExistsError):
        writers.manifest(rows, path, ["image_path", "label"])
    writers.manifest(rows.limit(1), path, ["image_path", "label"], force=True)
    assert readers.strict_manifest(spark, path).count() == 1
    with pytest.raises(PermissionError):
        writers.manifest(rows, path, ["image_path"], force=True, protected=[str(tmp_path)])
    (tmp_path / "wrong.csv").write_text("path,label\na,1\n")
    with pytest.raises(ValueError, match="header"):
        readers.strict_manifest(spark, str(tmp_path / "wrong.csv"))
    with pytest.raises(Exception, match="neither 0 nor 1"):
        readers.lenient_manifest(rows.withColumn("label", F.lit(2))).collect()
    with pytest.raises(ValueError, match="no key"):
        readers.detected(rows)

    table = spark.createDataFrame([("clean", "-", 0.1234567, None)], "transformation string, parameter string, acc double, auc double")
    writers.metrics(table, str(tmp_path / "metrics"), ["transformation", "parameter", "acc", "auc"])
    assert readers.metric_table(spark, str(tmp_path / "metrics.csv")).collect() == [("clean", "-", 0.123457, None)]
    assert readers.metric_json(spark, str(tmp_path / "metrics.json"), "acc double").first().acc == 0.1234567
    line, where = spark.createDataFrame([(1, 0.5)], "epoch int, f1 double"), str(tmp_path / "log")
    assert publish.log(spark, where, "epoch int, f1 double").collect() == []
    assert [publish.appended(line, where, b) for b in (0, 1, 0)] == [True, True, False]
    assert sorted(publish.log(spark, where, "epoch int, f1 double").collect()) == [(1, 0.5, 0), (1, 0.5, 1)]
    writers.predictions(spark.createDataFrame([(7, 1)], "sample_id int, pred int"), str(tmp_path / "pred"))
    assert spark.read.json(str(tmp_path / "pred")).collect() == [("7", 1)]


def test_publication_is_whole_or_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "out"), spark.range(50)

    def breaks(place):
        rows.write.parquet(place)
        raise OSError("the writer died")

    with pytest.raises(OSError):
        publish.published(spark, breaks, path)
    assert not (tmp_path / "out").exists() and list(tmp_path.iterdir()) == []
    with ThreadPoolExecutor(4) as pool:
        wrote = list(pool.map(lambda k: publish.published(spark, lambda place: rows.withColumn("writer", F.lit(k)).write.parquet(place), path), range(4)))
    found = spark.read.parquet(path).groupBy("writer").count().collect()
    assert sum(wrote) == 1 and [tuple(r) for r in found] == [(wrote.index(True), 50)]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    assert publish.published(spark, rows.limit(3).write.parquet, path, replace=True) and spark.read.parquet(path).count() == 3


def test_a_lock_left_behind_is_taken_over(spark, tmp_path, monkeypatch):
    (tmp_path / "_out.lock").touch()
    monkeypatch.setattr(publish, "WAIT", 0.1)
    with pytest.raises(TimeoutError):
        publish.published(spark, spark.range(3).write.parquet, str(tmp_path / "out"))
    monkeypatch.setattr(publish, "STALE", -1)
    assert publish.published(spark, spark.range(3).write.parquet, str(tmp_path / "out"))


def test_listing_by_sub_folders(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{i % 3}/{i % 2}/f{i}.{'txt' if i % 5 else 'bin'}", "x" * i) for i in range(60)] + [(60, "top.TXT", None), (61, None, "y")], "id int, name string, text string")
    made = listing.write_files(docs.repartition(4), str(tmp_path), F.col("name"), F.col("text")).collect()
    assert {r.name: r.length for r in made} == {r.name: len(r.text or "") for r in docs.where("name IS NOT NULL").collect()}
    for levels in (0, 1, 2):
        found = listing.listed(spark, str(tmp_path), ("txt",), levels).collect()
        assert sorted((f"{r.prefix}/{r.name}".lstrip("/"), r.length) for r in found) == sorted((r.name, r.length) for r in made if not r.name.endswith("bin"))
        assert all(r.path == f"{tmp_path}/{r.prefix}/{r.name}".replace("//", "/") for r in found)
    assert listing.listed(spark, f"file://{tmp_path}", prefixes=["1", "not there"]).count() == 20
    assert listing.listed(spark, str(tmp_path), ("png",)).collect() == []


def newton(x, y, reg):
    """Logistic regression with the penalty on coefficients of standardised columns, as MLlib has it; the intercept is free."""
    n, spread = len(y), x.std(axis=0, ddof=1)
    z = np.hstack([x / spread, np.ones((n, 1))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], reg), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / n + np.diag(penalty), z.T @ (p - y) / n + penalty * w)
    return w[:-1] / spread, w[-1]


@pytest.fixture(scope="module")
def fitted_rows(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 5)) * np.array([1, 2, 0.5, 3, 1])
    y = (x @ np.array([1, -0.5, 2, 0, 0.3]) + draw.normal(size=400) > 0.4).astype(int)
    rows = spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "sample_id int, label int, features array<double>").persist()
    return x, y, rows


def test_probe_gives_the_logits_of_a_plain_fit(fitted_rows):
    x, y, rows = fitted_rows
    w, b = newton(x[:300], y[:300], 0.01)
    model = score.linear_probe(rows.where("sample_id < 300"))
    for r in score.probe_scores(model, rows.where("sample_id >= 300"), "probe").collect():
        margin = float(x[r.sample_id] @ w + b)
        assert abs(r.logit_1 - margin) < 1e-3 and r.logit_0 == -r.logit_1
        assert abs(r.p_1 - 1 / (1 + np.exp(-r.logit_1))) < 1e-12 and abs(r.p_0 + r.p_1 - 1) < 1e-12 and r.p == r.p_1 and r.pred == int(r.p_1 >= 0.5)


def test_best_candidate_is_that_of_plain_fits(fitted_rows):
    x, y, rows = fitted_rows
    settings = (0.3, 0.1, 0.01)
    log = score.candidate_log(rows.where("sample_id < 300"), rows.where("sample_id >= 300"), settings)
    table = {r.setting: r for r in log.collect()}
    for reg in settings:
        w, b = newton(x[:300], y[:300], reg)
        p = 1 / (1 + np.exp(-(x[300:] @ w + b)))
        ones, zeros = p[y[300:] == 1], p[y[300:] == 0]
        auc = np.mean((ones[:, None] > zeros) + 0.5 * (ones[:, None] == zeros))
        loss = -np.mean(np.where(y[300:] == 1, np.log(p), np.log(1 - p)))
        assert abs(table[reg].roc_auc - auc) < 2e-3 and abs(table[reg].log_loss - loss) < 1e-3 and abs(table[reg].accuracy - np.mean((p >= 0.5) == y[300:])) < 0.02
    best = score.best_candidate(log).first()
    assert best.epoch in (1, 2, 3) and best.setting == settings[best.epoch - 1]


def test_auc_of_crowded_scores(spark):
    """Scores that crowd at one end, more of them distinct than there are buckets, in two groups."""
    draw = np.random.default_rng(9)
    rows = [(g, int(draw.integers(2)), float(p)) for g in "ab" for p in np.append(1 - draw.random(3000) * 1e-9, [0.0, 0.5, 1.0, 1.0])]
    got = dict(metrics.roc_auc(spark.createDataFrame(rows, "g string, label int, p double"), ["g"]).collect())
    for g in "ab":
        ones, zeros = (np.array([p for h, y, p in rows if h == g and y == label]) for label in (1, 0))
        assert abs(got[g] - np.mean((ones[:, None] > zeros) + 0.5 * (ones[:, None] == zeros))) < 1e-12


def test_epochs_are_those_of_a_plain_loop_and_a_log_is_written_once(spark, tmp_path):
    draw = np.random.default_rng(8)
    x = draw.normal(0, 1, (240, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + draw.normal(0, 1.5, 240) > 0.3).astype(float)
    train = np.arange(240) < 160
    rows = spark.createDataFrame([("train" if t else "val", int(label), v.tolist(), "more") for t, label, v in zip(train, y, x)], "split string, label int, features array<double>, other string")
    candidates = [score.Candidate("a", 0.3, 0.1), score.Candidate("b", 3.0)]
    log = str(tmp_path / "log")
    fit = score.fit_by_epochs(rows.repartition(5), candidates, epochs=9, patience=2, log_path=log)
    got = {(r.epoch, r.candidate): r for r in fit.log.collect()}
    z, want = np.hstack([x, np.ones((240, 1))]), {}
    for c in candidates:
        w, top, since = np.zeros(5), -1.0, 0
        for epoch in range(1, 10):
            p = 1 / (1 + np.exp(-z @ w))
            hit = p >= 0.5
            tp, fp, fn = (np.sum(hit & (y == 1) & ~train), np.sum(hit & (y == 0) & ~train), np.sum(~hit & (y == 1) & ~train))
            f1 = 2 * tp / (2 * tp + fp + fn)
            losses = [-np.mean(np.log(np.where(y == 1, p, 1 - p))[s]) for s in (train, ~train)]
            want[epoch, c.name] = (losses, f1, w.copy())
            top, since = (f1, 0) if f1 > top else (top, since + 1)
            if since >= 2:
                break
            w = w - c.rate * ((p - y)[train] @ z[train] / 160 + np.append(c.reg * w[:-1], 0))
    assert set(got) == set(want) and len(want) < 18
    for k, (losses, f1, w) in want.items():
        assert np.allclose([got[k].train_loss, got[k].val_loss], losses, atol=1e-9) and abs(got[k].f1 - f1) < 1e-12 and np.allclose(fit.weights[k], w, atol=1e-9)
    assert fit.best == min(want, key=lambda k: (-want[k][1], k[0], k[1]))
    score.fit_by_epochs(rows, candidates, epochs=9, patience=2, width=4, log_path=log)
    assert publish.log(spark, log, score.LOG).count() == len(want)
    scored = score.fitted_scores(fit.weights[fit.best], rows.where("split = 'val'"), "m")
    assert metrics.classification(scored).first().f1 == pytest.approx(want[fit.best][1])
    aucs = {(r.epoch, r.candidate): r.roc_auc for r in score.epoch_aucs(fit, rows.where("split = 'val'")).collect()}
    margin = z[~train] @ want[fit.best][2]
    pos, neg = margin[y[~train] == 1], margin[y[~train] == 0]
    assert set(aucs) == set(want) and aucs[fit.best] == pytest.approx(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))
    with pytest.raises(ValueError, match="train and of val"):
        score.fit_by_epochs(rows.where("split = 'train'"), candidates)


def test_rejects_are_judged_in_order_and_counted_in_passing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "a", 9, False), (2, "s", "a", 9, False), (0, "s", "a", 9, True), (3, "t", "b", 1, False), (4, "t", "b", 9, False), (5, "t", None, 9, None), (6, None, None, None, False), (7, "u", "a", 9, False)], "id int, source string, key string, size int, broken boolean")
    found = dedup.judged(rows.repartition(3), "key", ["id"], F.col("broken"), F.col("size") < 5)
    assert {r.id: r.reason for r in found.collect()} == {0: "bad", 1: "added", 2: "duplicate", 3: "too small", 4: "added", 5: "added", 6: "added", 7: "duplicate"}
    counts = dedup.write_added(found, str(tmp_path / "added"), ["s", "t"])
    assert counts == {("s", "bad"): 1, ("s", "added"): 1, ("s", "duplicate"): 1, ("t", "too small"): 1, ("t", "added"): 2, (None, "added"): 1, (None, "duplicate"): 1}
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "added")).collect()) == [1, 4, 5, 6]


def test_named_sources_come_from_one_scan(spark, tmp_path):
    spark.createDataFrame([(i, f"s{i % 3}", "old") for i in range(12)], "id int, origin string, source string").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    some = [readers.NamedSource("zero", F.col("origin") == "s0", 0, False, 2), readers.NamedSource("one", F.col("origin") == "s1", 1, True, 3), readers.NamedSource("low", F.col("id") < 2, None, False, 9)]
    out = readers.named_sources(rows, some, "d", ["id"])
    assert sorted(map(tuple, out.select("source", "id", "label", "held_out", "dataset").collect()), key=str) == sorted([("zero", 0, 0, False, "d"), ("zero", 3, 0, False, "d"), ("one", 1, 1, True, "d"), ("one", 4, 1, True, "d"), ("one", 7, 1, True, "d"), ("low", 0, None, False, "d"), ("low", 1, None, False, "d")], key=str)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert readers.named_sources(rows, [readers.NamedSource("all", F.lit(True), None, False)], "d").count() == 12
    with pytest.raises(ValueError, match="no rows of none"):
        readers.named_sources(rows, [readers.NamedSource("none", F.col("id") < 0, None, False)], "d", check=True)
    with pytest.raises(ValueError, match="order"):
        readers.named_sources(rows, some, "d")


def test_errors_follow_from_published_values(spark):
    table = spark.createDataFrame([("m", "clean", 0.9, 0.9), ("m", "blur", 0.569, 0.259), ("m", "jpeg", 0.5, 0.0)], "model string, name string, accuracy double, f1 double")
    row = metrics.reconstructed_errors(table, 5000, 5000).first()
    # 4310 errors and an F1 of 0.259 are 753 hits; half right and no hits are 5000 misses.
    assert (row.fp, row.fn) == (63, 4247 + 5000) and row.tp_bound > 0
