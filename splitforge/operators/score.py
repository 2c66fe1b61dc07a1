"""Fitting and scoring of models on fixed features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitforge.functions.columns import predict, unreadable
from splitforge.operators.joins import by_models
from splitforge.operators.metrics import classification, log_loss, roc_auc
from splitforge.operators.sampling import best_epoch
from splitforge.sources.publish import appended


def centroid_model(train: DataFrame, name: str = "baseline", vector: str = "features", label: str = "label") -> DataFrame:
    """(model, pos, w, mid): for each position the difference of the class means and their midpoint. One row a
    position, whatever the number of samples."""
    values = train.select(label, F.posexplode(vector).alias("pos", "v"))
    means = values.groupBy("pos").agg(F.avg(F.when(F.col(label) == 1, F.col("v"))).alias("m1"), F.avg(F.when(F.col(label) == 0, F.col("v"))).alias("m0"))
    return means.select(F.lit(name).alias("model"), "pos", (F.col("m1") - F.col("m0")).alias("w"), ((F.col("m1") + F.col("m0")) / 2).alias("mid"))


def as_arrays(model: DataFrame) -> DataFrame:
    """(model, w, mid) with one row a model and arrays by position."""
    return model.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("pos", "w", "mid"))).alias("s")).select("model", F.transform("s", lambda x: x["w"]).alias("w"), F.transform("s", lambda x: x["mid"]).alias("mid"))


def score(rows: DataFrame, models: DataFrame, vector: str = "features", threshold: float = 0.5, policy: str = "exclude") -> DataFrame:
    """rows of every model with margin, p and pred; the models' weights (one short row each) are broadcast.

    Rows without features get a null p and fall under the policy for unreadable rows.
    """
    every = by_models(rows, as_arrays(models))
    products = F.zip_with(F.zip_with(F.col(vector), F.col("mid"), lambda v, m: v - m), F.col("w"), lambda d, w: d * w)
    margin = F.round(F.aggregate(products, F.lit(0.0), lambda a, x: a + x), 9)
    out = every.withColumn("margin", margin).withColumn("p", unreadable(1.0 / (1.0 + F.exp(-F.col("margin"))), policy)).drop("w", "mid")
    out = out.where("p IS NOT NULL") if policy in ("exclude", "skip") else out
    return out.withColumn("pred", predict("p", threshold))


def unreadable_count(rows: DataFrame, p: str = "p") -> DataFrame:
    return rows.agg(F.count_if(F.col(p).isNull() | F.isnan(p)).alias("n_unreadable"), F.count("*").alias("n"))


def linear_probe(train: DataFrame, vector: str = "features", label: str = "label", reg: float = 0.01, iterations: int = 50):
    """A logistic regression on fixed features (MLlib)."""
    data = train.select(F.col(label).cast("double").alias("label"), array_to_vector(vector).alias("features"))
    return LogisticRegression(regParam=reg, maxIter=iterations).fit(data)


def probe_scores(model, rows: DataFrame, name: str, vector: str = "features", threshold: float = 0.5) -> DataFrame:
    """rows with model, the logits and probabilities of both classes, p and pred."""
    shown = model.transform(rows.withColumn("__v", array_to_vector(vector)).drop("features").withColumnRenamed("__v", "features"))
    both, logits = vector_to_array("probability"), vector_to_array("rawPrediction")
    keep = [c for c in rows.columns if c != vector]
    out = shown.select(*keep, F.lit(name).alias("model"), logits[0].alias("logit_0"), logits[1].alias("logit_1"), both[0].alias("p_0"), both[1].alias("p_1"), both[1].alias("p"))
    return out.withColumn("pred", predict("p", threshold))


@dataclass(frozen=True)
class Candidate:
    """Settings of a fit by gradient steps: the rate of a step and the weight of the squared coefficients."""

    name: str
    rate: float
    reg: float = 0.0


_STEP = "split string, candidate int, n long, loss double, gradient array<double>, tn long, fp long, fn long, tp long"


def _one_step(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """(split, candidate, ...): of every candidate the loss and confusion counts of each split under its weights (the
    intercept last), and the gradient of the loss. Each task sums its rows by products of matrices and hands on a row a candidate and split."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            splits, y = np.array(batch.column("split").to_pylist(), object), np.asarray(batch.column("label"), np.float64)
            x = np.asarray(batch.column("features").flatten(), np.float64).reshape(len(y), -1)
            x = np.hstack([x, np.ones((len(y), 1))])
            for split in set(splits):
                mine = splits == split
                margin = x[mine] @ weights.T
                p = np.clip(1 / (1 + np.exp(-margin)), 1e-12, 1 - 1e-12)
                own, hit = y[mine, None], p >= 0.5
                loss = -(own * np.log(p) + (1 - own) * np.log(1 - p)).sum(axis=0)
                counts = np.array([((own == t) & (hit == h)).sum(axis=0) for t, h in ((0, False), (0, True), (1, False), (1, True))])
                parts = [np.full(len(weights), mine.sum()), loss, (p - own).T @ x[mine], counts]
                sums[split] = [a + b for a, b in zip(sums[split], parts)] if split in sums else parts
        rows = [{"split": s, "candidate": c, "n": int(n[c]), "loss": float(loss[c]), "gradient": g[c].tolist()} | dict(zip(("tn", "fp", "fn", "tp"), counts[:, c].tolist())) for s, (n, loss, g, counts) in sums.items() for c in range(len(weights))]
        shape = pa.schema([("split", pa.string()), ("candidate", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()), ("gradient", pa.list_(pa.float64())), *((c, pa.int64()) for c in ("tn", "fp", "fn", "tp"))])
        yield pa.RecordBatch.from_pylist(rows, schema=shape)

    parts = rows.mapInArrow(work, _STEP)
    added = F.aggregate(F.collect_list("gradient"), F.array_repeat(F.lit(0.0), weights.shape[1]), lambda a, g: F.zip_with(a, g, lambda x, y: x + y))
    # Gradients are summed in groups of tasks first, so no row gathers those of all tasks.
    groups = parts.withColumn("part", F.spark_partition_id() % 64).groupBy("split", "candidate", "part").agg(added.alias("gradient"), *(F.sum(c).alias(c) for c in ("n", "loss", "tn", "fp", "fn", "tp")))
    return groups.groupBy("split", "candidate").agg(added.alias("gradient"), *(F.sum(c).alias(c) for c in ("n", "loss", "tn", "fp", "fn", "tp")))


@dataclass(frozen=True)
class Fit:
    """What a fit has tried: the log, the weights of every epoch, and the winner."""

    log: DataFrame
    weights: dict[tuple[int, str], np.ndarray]
    best: tuple[int, str]


#: The columns of a log of epochs.
LOG = "epoch int, candidate string, train_loss double, val_loss double, accuracy double, precision double, recall double, f1 double, improved boolean"


def fit_by_epochs(rows: DataFrame, candidates: Sequence[Candidate], epochs: int = 20, patience: int = 3, width: int | None = None, log_path: str | None = None) -> Fit:
    """Logistic regressions by gradient steps over rows (split, label, features), whose splits are train and val.

    All candidates take a step in one pass over the rows. An epoch's line has the losses and the scores on val of the weights
    that it begins with, which are 0 in the first. A candidate goes on as long as its f1 on val was better than all before within
    the last `patience` epochs; the best epoch is the one of the highest f1, of several the earliest, of these the first
    candidate. With a log path the lines of each epoch are appended there as its batch when it ends, so that a fit that is
    started again adds none twice. The driver holds the weights, which don't grow with the rows.
    """
    spark = rows.sparkSession
    width = len(rows.select("features").first()[0]) if width is None else width
    active, weights = list(range(len(candidates))), np.zeros((len(candidates), width + 1))
    lines, tried = [], {}
    top, since = {c: -1.0 for c in active}, {c: 0 for c in active}
    for epoch in range(1, epochs + 1):
        if not active:
            break
        found = {(r["split"], active[r["candidate"]]): r for r in _one_step(rows, weights[active]).collect()}
        fresh = []
        for c in list(active):
            train, val = found.get(("train", c)), found.get(("val", c))
            if train is None or val is None:
                raise ValueError("a fit needs rows of train and of val")
            tn, fp, fn, tp = (val[k] for k in ("tn", "fp", "fn", "tp"))
            ratio = lambda a, b: a / b if b else 0.0
            f1 = ratio(2 * tp, 2 * tp + fp + fn)
            better = f1 > top[c]
            tried[epoch, candidates[c].name] = weights[c].copy()
            fresh.append((epoch, candidates[c].name, train["loss"] / train["n"], val["loss"] / val["n"], (tp + tn) / val["n"], ratio(tp, tp + fp), ratio(tp, tp + fn), f1, better))
            top[c], since[c] = (f1, 0) if better else (top[c], since[c] + 1)
            penalty = np.append(candidates[c].reg * weights[c][:-1], 0.0)
            weights[c] -= candidates[c].rate * (np.array(train["gradient"]) / train["n"] + penalty)
            if since[c] >= patience:
                active.remove(c)
        lines += fresh
        if log_path:
            appended(spark.createDataFrame(fresh, LOG), log_path, epoch)
    order = {c.name: i for i, c in enumerate(candidates)}
    best = min(lines, key=lambda r: (-r[7], r[0], order[r[1]]))
    return Fit(spark.createDataFrame(lines, LOG), tried, (best[0], best[1]))


def fitted_scores(weights: np.ndarray, rows: DataFrame, name: str, vector: str = "features", threshold: float = 0.5) -> DataFrame:
    """rows with model, the logits and probabilities of both classes, p and pred, by weights with the intercept last."""
    table = F.array(*(F.lit(float(w)) for w in weights[:-1]))
    margin = F.aggregate(F.zip_with(F.col(vector), table, lambda v, w: v * w), F.lit(float(weights[-1])), lambda a, x: a + x)
    p = 1.0 / (1.0 + F.exp(-F.col("logit_1")))
    keep = [c for c in rows.columns if c != vector]
    out = rows.withColumn("logit_1", margin).select(*keep, F.lit(name).alias("model"), (-F.col("logit_1")).alias("logit_0"), "logit_1", (1 - p).alias("p_0"), p.alias("p_1"), p.alias("p"))
    return out.withColumn("pred", predict("p", threshold))


def epoch_aucs(fit: Fit, val: DataFrame) -> DataFrame:
    """(epoch, candidate, roc_auc) on the val rows of the weights of every epoch; one job for all, with a row of weights an epoch."""
    table = val.sparkSession.createDataFrame([(e, c, w.tolist()) for (e, c), w in fit.weights.items()], "epoch int, candidate string, w array<double>")
    margin = F.aggregate(F.zip_with("features", F.slice("w", 1, F.size("features")), lambda v, w: v * w), F.element_at("w", -1), lambda a, x: a + x)
    rows = val.select("label", "features").crossJoin(F.broadcast(table)).select("epoch", "candidate", "label", (1 / (1 + F.exp(-margin))).alias("p"))
    return roc_auc(rows, ["epoch", "candidate"])


def candidate_log(train: DataFrame, val: DataFrame, settings: Sequence[float]) -> DataFrame:
    """(epoch, setting, loss, accuracy, f1, roc_auc) on the validation rows of a fit with each regularisation."""
    logs = []
    for epoch, reg in enumerate(settings, 1):
        scored = probe_scores(linear_probe(train, reg=reg), val, "candidate")
        row = classification(scored).crossJoin(roc_auc(scored)).crossJoin(log_loss(scored))
        logs.append(row.select(F.lit(epoch).alias("epoch"), F.lit(float(reg)).alias("setting"), "log_loss", "accuracy", "precision", "recall", "f1", "roc_auc"))
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more)
    return out


def best_candidate(log: DataFrame) -> DataFrame:
    return best_epoch(log)
