"""Dense autoencoders, plain and variational, trained by mini-batches with Adam.

Rows are dealt into batches by a hash of their key and stored by batch. A step is a job
over one batch: tasks sum the gradient of their rows, the sums meet in a tree, and a few
rows of the size of the weights reach the driver, which moves the weights. Noise is drawn
by key and epoch, so neither tasks nor partitions change what is learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import ship_package
from tallyloom.store import store

FAN = 16  # sums that meet on the driver


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit counters to well-mixed bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def normal_draws(keys: np.ndarray, epoch: int, width: int, seed: int = 0) -> np.ndarray:
    """(rows, width) standard normal numbers that follow from key, epoch and place alone."""
    with np.errstate(over="ignore"):
        base = mixed(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(1 + epoch + (seed << 20)))
        at = mixed(base[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, 2 * width + 1, dtype=np.uint64))
    u = (at >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.sqrt(-2 * np.log1p(-u[:, :width])) * np.cos(2 * np.pi * u[:, width:])


def layers(dims: list[int], rng: np.random.Generator) -> list[np.ndarray]:
    """Weights with a last row of biases."""
    return [np.vstack([rng.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros((1, b))]) for a, b in zip(dims, dims[1:])]


def forward(x: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """Activations: tanh, the last layer linear."""
    acts = [x]
    for k, w in enumerate(weights):
        z = acts[-1] @ w[:-1] + w[-1]
        acts.append(np.tanh(z) if k < len(weights) - 1 else z)
    return acts


def backward(acts: list[np.ndarray], weights: list[np.ndarray], down: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(gradients, what reaches the input) of what reaches the output."""
    out = []
    for k in range(len(weights) - 1, -1, -1):
        if k < len(weights) - 1:
            down = down * (1 - acts[k + 1] ** 2)
        out.append(np.vstack([acts[k].T @ down, down.sum(0)]))
        down = down @ weights[k][:-1].T
    return out[::-1], down


@dataclass(frozen=True)
class Plain:
    """hidden: sizes from the first hidden layer to the last; squared error, mean over numbers."""

    width: int
    hidden: tuple[int, ...] = (100, 50, 2, 50, 100)

    def first(self, seed: int = 0) -> list[np.ndarray]:
        return layers([self.width, *self.hidden, self.width], np.random.default_rng(seed))

    def gradient(self, x: np.ndarray, keys: np.ndarray, epoch: int, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(reconstruction loss, 0) and the gradient, summed over rows."""
        acts = forward(x, weights)
        error = acts[-1] - x
        return np.array([(error**2).sum() / self.width, 0.0]), backward(acts, weights, 2 * error / self.width)[0]


@dataclass(frozen=True)
class Variational:
    """Encoder and decoder with one hidden layer each, normal latent numbers, logistic outputs for inputs in [0, 1].

    kl: "sum" over dimensions, "mean" over them, as its weight in the loss; beside it
    stands the cross-entropy, summed over numbers.
    """

    width: int
    hidden: int = 32
    latent: int = 2
    kl: str = "sum"

    def first(self, seed: int = 0) -> list[np.ndarray]:
        rng = np.random.default_rng(seed)
        return [*layers([self.width, self.hidden, 2 * self.latent], rng), *layers([self.latent, self.hidden, self.width], rng)]

    def gradient(self, x: np.ndarray, keys: np.ndarray, epoch: int, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(reconstruction loss, divergence) and the gradient, summed over rows."""
        encoder, decoder = weights[:2], weights[2:]
        up = forward(x, encoder)
        mu, log_var = up[-1][:, : self.latent], up[-1][:, self.latent :]
        eps, spread = normal_draws(keys, epoch, self.latent), np.exp(0.5 * log_var)
        out = forward(mu + spread * eps, decoder)
        p = 1 / (1 + np.exp(-out[-1]))
        scale = 1.0 if self.kl == "sum" else 1.0 / self.latent
        recon = float((np.logaddexp(0, out[-1]) - x * out[-1]).sum())
        divergence = float(-0.5 * (1 + log_var - mu**2 - np.exp(log_var)).sum()) * scale
        of_decoder, down = backward(out, decoder, p - x)
        of_mu = down + scale * mu
        of_log_var = down * eps * 0.5 * spread + scale * 0.5 * (np.exp(log_var) - 1)
        return np.array([recon, divergence]), [*backward(up, encoder, np.hstack([of_mu, of_log_var]))[0], *of_decoder]

    def encode(self, x: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        up = forward(x, weights[:2])[-1]
        return up[:, : self.latent], up[:, self.latent :]


class Adam:
    def __init__(self, weights: list[np.ndarray], rate: float, first: float = 0.9, second: float = 0.999):
        self.rate, self.first, self.second, self.n = rate, first, second, 0
        self.m, self.v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def step(self, weights: list[np.ndarray], grads: list[np.ndarray]) -> list[np.ndarray]:
        self.n += 1
        self.m = [self.first * m + (1 - self.first) * g for m, g in zip(self.m, grads)]
        self.v = [self.second * v + (1 - self.second) * g * g for v, g in zip(self.v, grads)]
        a, b = 1 - self.first**self.n, 1 - self.second**self.n
        return [w - self.rate * (m / a) / (np.sqrt(v / b) + 1e-8) for w, m, v in zip(weights, self.m, self.v)]


def summed(rows: DataFrame, model, weights: list[np.ndarray], epoch: int) -> np.ndarray:
    """Rows, the two losses and the gradient, summed over rows key, x; at most FAN sums reach the driver."""
    size = 3 + sum(w.size for w in weights)

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                losses, grads = model.gradient(x, batch.column(0).to_numpy(), epoch, weights)
                total += np.concatenate([[batch.num_rows], losses, *(g.ravel() for g in grads)])
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % FAN], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "payload"])

    def add(batches):
        total = np.zeros(size)
        for pdf in batches:
            for p in pdf["payload"]:
                total += np.frombuffer(p)
        yield pd.DataFrame({"payload": [total.tobytes()]})

    partial = rows.mapInArrow(run, "slot int, payload binary")
    if rows.rdd.getNumPartitions() > FAN:
        partial = partial.repartition(FAN, "slot").select("payload").mapInPandas(add, "payload binary")
    return np.sum([np.zeros(size), *(np.frombuffer(r["payload"]) for r in partial.select("payload").collect())], axis=0)


def train(rows: DataFrame, model, key: str, vector: str, epochs: int = 10, batches: int = 4, rate: float = 0.01, seed: int = 0) -> tuple[list[np.ndarray], list[tuple[float, float]]]:
    """(weights, mean reconstruction loss and divergence of each epoch) over all rows with a vector.

    An epoch takes every batch once. Keys are whole numbers; null ones are 0 for the
    noise. Without rows the first weights come back.
    """
    ship_package(rows.sparkSession)
    plain = rows.where(F.col(vector).isNotNull()).select(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    held = store(plain.withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int")), "batches", partition="batch").df
    weights = model.first(seed)
    adam, history = Adam(weights, rate), []
    for epoch in range(epochs):
        seen = np.zeros(3)
        for b in range(batches):
            total = summed(held.where(F.col("batch") == b).select("key", "x"), model, weights, epoch)
            seen += total[:3]
            if total[0]:
                cuts = np.cumsum([3, *(w.size for w in weights)])
                grads = [total[lo:hi].reshape(w.shape) / total[0] for w, lo, hi in zip(weights, cuts, cuts[1:])]
                weights = adam.step(weights, grads)
        if seen[0]:
            history.append((seen[1] / seen[0], seen[2] / seen[0]))
    return weights, history
