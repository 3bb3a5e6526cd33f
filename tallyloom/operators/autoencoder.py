"""Autoencoders trained by full-batch gradient descent, one for each value of a column."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import ship_package
from tallyloom.store import store


def first_weights(width: int, sizes: tuple[int, ...]) -> list[np.ndarray]:
    rng = np.random.default_rng(0)
    dims = [width, *sizes, width]
    return [rng.normal(0, 1 / np.sqrt(a), (a + 1, b)) for a, b in zip(dims, dims[1:])]


def gradient(x: np.ndarray, weights: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    """Sum of squared errors of rows x, and its gradient; tanh layers, the last one linear."""
    one, acts = np.ones((len(x), 1)), [x]
    for k, w in enumerate(weights):
        z = np.hstack([acts[-1], one]) @ w
        acts.append(np.tanh(z) if k < len(weights) - 1 else z)
    error = acts[-1] - x
    down, out = 2 * error, []
    for k in range(len(weights) - 1, -1, -1):
        if k < len(weights) - 1:
            down = down * (1 - acts[k + 1] ** 2)
        out.append(np.hstack([acts[k], one]).T @ down)
        down = down @ weights[k][:-1].T
    return float((error**2).sum()), out[::-1]


def train(rows: DataFrame, label: str, vector: str, sizes: tuple[int, ...] = (16, 2, 16), epochs: int = 200, rate: float = 0.05) -> dict:
    """label: (weights, mean squared error of each epoch), over all rows.

    Vectors are standardised within their label. Each epoch is a job: tasks sum the
    gradients of their rows, the sums meet by label, and a row per label reaches the
    driver, which moves the weights. Rows without a vector or a label are left out.
    """
    ship_package(rows.sparkSession)
    plain = rows.select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x")).where("label is not null and x is not null")
    held = store(plain, "vectors").df
    stats = held.groupBy("label").agg(Summarizer.metrics("count", "mean", "std").summary(array_to_vector("x")).alias("s")).collect()
    scales = {r.label: (r.s["count"], np.asarray(r.s["mean"]), np.asarray(r.s["std"]) + 1e-9) for r in stats}
    weights = {k: first_weights(len(mean), sizes) for k, (_, mean, _) in scales.items()}
    losses: dict = {k: [] for k in scales}
    kind = dict(held.dtypes)["label"]

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(p) for p in pdf["payload"]], axis=0)
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "payload": [total.tobytes()]})

    for _ in range(epochs):

        def sums(batches, weights=weights):
            found: dict = {}
            for batch in batches:
                labels = np.array(batch.column(0).to_pylist(), dtype=object)
                x = batch.column(1).flatten().to_numpy().reshape(len(labels), -1)
                for k in set(labels):
                    _, mean, std = scales[k]
                    loss, grads = gradient((x[labels == k] - mean) / std, weights[k])
                    found[k] = found.get(k, 0) + np.concatenate([[loss], *(g.ravel() for g in grads)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), batch.schema.field(0).type), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["label", "payload"])

        for r in held.mapInArrow(sums, f"label {kind}, payload binary").groupBy("label").applyInPandas(add, f"label {kind}, payload binary").collect():
            total, n = np.frombuffer(r.payload), scales[r.label][0]
            losses[r.label].append(float(total[0]) / n / len(scales[r.label][1]))
            cuts = np.cumsum([1, *(w.size for w in weights[r.label])])
            weights[r.label] = [w - rate / n * total[a:b].reshape(w.shape) for w, a, b in zip(weights[r.label], cuts, cuts[1:])]
    return {k: (weights[k], losses[k]) for k in scales}
