"""Training of the logistic risk model where the cases are: full-batch descent over distinct cases with their counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators.features import RiskModel, normalised, risk_score
from chartloom.operators.lineage import ship

#: Epochs of a whole training.
EPOCHS = 2400
_BLOCK = 8192
#: Distinct cases up to which all epochs run in one task (some 30 MB), since a Spark job an epoch would cost more than its sums.
_ONE_TASK = 200_000


def _blocks(rows: Iterator) -> Iterator[np.ndarray]:
    """Rows of (features, label, count) as matrices, the label and the count last."""
    held: list = []
    for r in rows:
        held.append([*r[0], r[1], r[2]])
        if len(held) == _BLOCK:
            yield np.array(held, dtype=float)
            held = []
    if held:
        yield np.array(held, dtype=float)


def _gradient(block: np.ndarray, weights: np.ndarray, intercept: float) -> np.ndarray:
    """Sums over a block: the weights' gradients, then the intercept's."""
    x, y, count = block[:, :-2], block[:, -2], block[:, -1]
    z = x @ weights + intercept
    small = np.exp(-np.abs(z))
    error = (np.where(z >= 0, 1 / (1 + small), small / (1 + small)) - y) * count
    return np.append(error @ x, error.sum())


def _descent(sums: Callable[[np.ndarray, float], np.ndarray], size: int, n: float, epochs: int, rate: float, ridge: float) -> tuple[np.ndarray, float]:
    """(weights, intercept) after all epochs over n cases, more than none, of so many features; sums: the gradient at a model."""
    weights, intercept = np.zeros(size), 0.0
    for _ in range(epochs):
        total = sums(weights, intercept)
        weights, intercept = weights - rate * (total[:-1] / n + ridge * weights), intercept - rate * float(total[-1]) / n
    return weights, intercept


def train_risk(cases: DataFrame, epochs: int = EPOCHS, rate: float = 0.15, ridge: float = 0.015, model: RiskModel = RiskModel()) -> RiskModel:
    """The model with intercept and weights learned from cases(the features, label); the intercept is not shrunk.

    Cases of the same features and label are one row with their count, so that an epoch costs what the distinct cases cost.  Where
    these are few, all epochs run in one task; else each epoch is a job that sends the weights out and brings one sum of gradients
    back, added up in a tree: what the driver holds does not grow with the cases.  Normalised cases are kept as matrices, in memory
    as far as it goes, and are made again from their source where an executor is lost.  A value that is null, NaN or infinite
    counts as its center; rows without a label are left out; no rows give weights of 0.
    """
    ship(cases.sparkSession)
    parts = [normalised(n, c, s) for n, _, c, s in model.features]
    rows = cases.where("label IS NOT NULL").select(F.array(*parts).alias("x"), F.col("label").cast("double").alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    blocks = rows.rdd.mapPartitions(_blocks).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        distinct, n = blocks.map(lambda b: np.array([len(b), b[:, -1].sum()])).fold(np.zeros(2), np.add)
        size = len(parts)
        if distinct <= _ONE_TASK:

            def trained(held: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, float]]:
                whole = np.concatenate([np.zeros((0, size + 2)), *held])
                yield _descent(lambda w, b: _gradient(whole, w, b), size, n, epochs, rate, ridge)

            weights, intercept = blocks.coalesce(1).mapPartitions(trained).first() if n else (np.zeros(size), 0.0)
        else:
            weights, intercept = _descent(lambda w, b: blocks.map(lambda block: _gradient(block, w, b)).treeReduce(np.add), size, n, epochs, rate, ridge)
    finally:
        blocks.unpersist()
    features = tuple((name, float(w), c, s) for (name, _, c, s), w in zip(model.features, weights, strict=True))
    return RiskModel(float(intercept), features, model.decision, model.low, model.high)


def training_report(cases: DataFrame, model: RiskModel) -> DataFrame:
    """One row: n, accuracy, precision, recall and f1 of a model's decisions (0 where a ratio has no denominator)."""
    rows = risk_score(cases.where("label IS NOT NULL"), model).select((F.col("raw_probability") >= model.decision).alias("said"), (F.col("label") == 1).alias("so"))
    both = lambda said, so: F.count_if((F.col("said") == said) & (F.col("so") == so))
    counts = rows.agg(F.count("*").alias("n"), both(True, True).alias("tp"), both(True, False).alias("fp"), both(False, True).alias("fn"), both(False, False).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("n", ratio(tp + F.col("tn"), F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


