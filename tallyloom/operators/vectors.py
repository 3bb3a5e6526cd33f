"""Arithmetic on vectors, images and latent points, in long form (id, position, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, pos (from 0), x."""
    return df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))


def min_max(values: DataFrame) -> DataFrame:
    """x scaled to [0, 1] within its position; a constant position is 0. One row of bounds per position is broadcast."""
    bounds = values.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return values.join(F.broadcast(bounds), "pos").withColumn("x", scaled).drop("lo", "hi")


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def downsample(values: DataFrame, key: str, side: int) -> DataFrame:
    """Means of 2 x 2 pixels of a square image."""
    row, col = F.floor(F.col("pos") / side / 2), F.floor(F.col("pos") % side / 2)
    return values.groupBy(key, (row * (side // 2) + col).alias("pos")).agg(F.avg("x").alias("x"))


def dense(vector: Column, weights: list[list[float]], bias: list[float], activation=F.tanh) -> Column:
    """activation(v W + b) of an array; weights: one list per output."""
    outputs = []
    for w, b in zip(weights, bias):
        products = F.zip_with(vector, F.array(*[F.lit(x) for x in w]), lambda x, y: x * y)
        outputs.append(activation(F.aggregate(products, F.lit(0.0), lambda s, x: s + x) + b))
    return F.array(*outputs)


#: Stops of the two-sided scale, from orange to violet.
PUOR = ["#b35806", "#f1a340", "#fee0b6", "#f7f7f7", "#d8daeb", "#998ec3", "#542788"]


def rgb(stop: str) -> tuple[int, int, int]:
    return tuple(int(stop[k : k + 2], 16) for k in (1, 3, 5))


def colour(t: Column, stops: list[str] = PUOR) -> Column:
    """rgb(r,g,b) at place t of [0, 1], linear between the stops beside it; halves are rounded up."""
    x = clip(t) * (len(stops) - 1)
    at = F.least(F.floor(x), F.lit(len(stops) - 2)).cast("int")
    parts = []
    for channel in range(3):
        values = F.array(*[F.lit(float(rgb(s)[channel])) for s in stops])
        low, high = F.get(values, at), F.get(values, at + 1)
        parts.append(F.floor(low + (high - low) * (x - at) + 0.5).cast("string"))
    return F.concat(F.lit("rgb("), F.concat_ws(",", *parts), F.lit(")"))


def reparameterise(mu: Column, log_var: Column, eps: Column) -> Column:
    return mu + F.exp(0.5 * log_var) * eps


def kl(mu: Column, log_var: Column) -> Column:
    """Of one latent dimension."""
    return -0.5 * (1 + log_var - mu * mu - F.exp(log_var))


def cross_entropy(x: Column, p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(x * F.log(q) + (1 - x) * F.log(1 - q))


def lcg(seed: int | Column, n: int) -> Column:
    """n draws in [0, 1) of s = (s * 25214903917 + 11) mod 65536, as an array."""
    step = lambda s: (s * (25214903917 % 65536) + 11) % 65536
    first = F.array(step((seed if isinstance(seed, Column) else F.lit(seed)).cast("long")))
    states = F.aggregate(F.sequence(F.lit(2), F.lit(n)), first, lambda a, _: F.concat(a, F.array(step(F.element_at(a, -1))))) if n > 1 else first
    return F.transform(states, lambda s: s / 65536.0)
