"""A whole training: all epochs, over distinct cases with their counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.functions import lexicon as L
from chartloom.operators import training
from chartloom.operators.features import RiskModel
from chartloom.operators.training import train_risk, training_report
from chartloom.plans import durable
from chartloom.plans.catalog import QUERIES, SQL
from tests.test_durable import FEATURES, plain_descent

SF = "/root/testdata/sf0.001"


def test_the_report_is_of_a_whole_training(spark):
    """the query trained for 12 epochs, where a training has 2400."""
    cases = durable._cases(spark, SF).cache()
    for name, missing, center in (("heart_rate__mean", "heart_rate__missing", 80.0), ("bp_systolic__last", "bp_missing", 120.0), ("bp_diastolic__last", "bp_missing", 75.0)):
        cases = cases.withColumn(name, F.when(F.col(missing) == 1, center).otherwise(F.col(name)))
    b, w = plain_descent([tuple(r) for r in cases.drop("note_id").collect()], 2400)
    model = RiskModel(float(b), tuple((n, float(x), c, s) for (n, _, c, s), x in zip(L.RISK_FEATURES, w, strict=True)))
    report = QUERIES["rsk_training_report"](spark, SF).first()
    assert report == training_report(cases, model).first() and report["recall"] > 0
    assert "epoch < 2400" in SQL["rsk_training_report"]


@pytest.mark.parametrize("one_task", [0, 1000])
def test_repeated_cases_count_as_often_as_they_come(spark, monkeypatch, one_task):
    monkeypatch.setattr(training, "_ONE_TASK", one_task)
    monkeypatch.setattr(training, "_BLOCK", 8)
    rng = np.random.default_rng(2)
    rows = [(*[float(v) for v in rng.integers(0, 2, len(L.RISK_FEATURES))], int(rng.integers(0, 2))) for _ in range(30)]
    missing = [k for k, (n, *_) in enumerate(L.RISK_FEATURES) if n in ("heart_rate__missing", "bp_missing")]
    rows = [tuple(0.0 if k in missing else v for k, v in enumerate(r)) for r in rows]
    rows = [r for k, r in enumerate(rows) for _ in range(1 + k % 5)]
    model = train_risk(spark.createDataFrame(rows, FEATURES).repartition(3), epochs=40)
    b, w = plain_descent(rows, 40)
    assert abs(model.intercept - b) < 1e-9 and max(abs(np.array([x[1] for x in model.features]) - w)) < 1e-9
