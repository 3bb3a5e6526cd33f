"""How many rated rows the quality classifier learns from."""

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import ordinal


def test_learns_from_8000_rated_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ordinal, "fit_ordinal", lambda x, grades, n_grades: seen.append((x.shape, len(grades))))
    docs = spark.range(8_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("wort "), F.col("id")).alias("text"))
    ordinal.fit_on_labels(docs, docs.select("doc_id", (F.col("doc_id") % 3).alias("grade")), 3)
    assert seen == [((8_000, ordinal.WIDTH), 8_000)]


def test_one_row_of_each_id(spark):
    """Ids rated twice or with two texts: always the same rows, however they are dealt."""
    docs = spark.createDataFrame([(k, f"w{k % 7} x{k % 3}") for k in range(300)] + [(k, "ab other") for k in range(50)], "doc_id long, text string")
    ratings = spark.createDataFrame([(k, k % 3) for k in range(300)] + [(k, 0) for k in range(100)], "doc_id long, grade int")
    got = [ordinal.fit_on_labels(docs.repartition(p), ratings.repartition(p), 3, most_rows=60, rounds=20) for p in (1, 5)]
    assert np.allclose(got[0].weights, got[1].weights, atol=1e-3) and np.allclose(got[0].thresholds, got[1].thresholds, atol=1e-3)


def test_likelihood_by_brute_force():
    """The fit's weights are a minimum of the penalised negative log likelihood, computed row by row."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)).astype(np.float32)
    grades = np.digitize(x @ np.array([1.5, -1, 0, 0.5]) + rng.logistic(size=400), [-0.5, 1.0])
    m = ordinal.fit_ordinal(x, grades, 3)
    scale = 1 / x.std(axis=0)

    def loss(w, t):
        total = 0.0
        for row, g in zip(x.astype(float), grades):
            tail = [1.0, *(1 / (1 + np.exp(-(row @ w - t)))), 0.0]
            total -= np.log(tail[g] - tail[g + 1])
        return total / len(x) + 1e-3 / 2 * float(((w / scale) ** 2).sum())

    best = loss(m.weights, m.thresholds)
    for _ in range(60):
        assert loss(m.weights + rng.normal(size=4) * 0.02, m.thresholds + rng.normal(size=2) * 0.02) > best - 1e-7
