import numpy as np
import pytest

from cladeflow.plans import confidence


def test_confidence_of_separable_predictions(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(200):
        right = int(i % 4 == 0)
        top = rng.uniform(0.7, 0.9) if right else rng.uniform(0.4, 0.6)
        rows.append((i, float(rng.integers(100, 200)), [top, 1 - top], right))
    df = spark.createDataFrame(rows, "id long, length double, maxprob array<double>, right int")
    data = confidence.confidence_features(df)
    scored = confidence.apply_confidence(confidence.fit_confidence(data, ["length"], "right"), data)
    row = confidence.confidence_metrics(scored, "right").first()
    assert row["auc"] == pytest.approx(1.0) and row["tp"] + row["fn"] == 50 and row["pos_rate"] == 0.25
