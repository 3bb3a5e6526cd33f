import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import random as R
from tallyloom.functions.text import in_order
from tallyloom.operators.components2d import principal_components
from tallyloom.operators.resample import FILTERS, resampled
from tallyloom.operators.word2vec import Network, small_networks


def test_draws_do_not_follow_the_partitions(spark):
    rows = spark.range(20_000)
    draws = rows.select("id", R.uniform(5, F.col("id"), F.lit("x")).alias("u"), R.normal(5, F.col("id"), F.lit("x")).alias("z"))
    got = [sorted(map(tuple, draws.repartition(n).collect())) if n else sorted(map(tuple, draws.collect())) for n in (0, 1, 7)]
    assert got[0] == got[1] == got[2]
    u, z = np.array([r[1] for r in got[0]]), np.array([r[2] for r in got[0]])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.002
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs((z**3).mean()) < 0.08 and abs((z**4).mean() - 3) < 0.2
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.02 and len(set(u)) == 20_000
    assert [r[0] for r in spark.range(3).select(R.uniform(6, F.col("id"))).collect()] != [r[0] for r in spark.range(3).select(R.uniform(7, F.col("id"))).collect()]


def pixel(image, to, i, j, name):
    """One pixel of the result, from all of the image."""
    f, support = FILTERS[name]
    total = whole = 0.0
    for a in range(image.shape[0]):
        for b in range(image.shape[1]):
            w = 1.0
            for at, before, after, k in ((a, image.shape[0], to[0], i), (b, image.shape[1], to[1], j)):
                scale = before / after
                w *= f((at + 0.5 - (k + 0.5) * scale) / max(1.0, scale))
            total += w * image[a, b]
            whole += w
    return total / whole


@pytest.mark.parametrize("name", sorted(FILTERS))
@pytest.mark.parametrize("to", [(14, 14), (3, 5), (1, 1), (40, 7)])
def test_resampling_pixel_by_pixel(spark, name, to):
    image = np.random.default_rng(2).random((28, 20))
    df = spark.createDataFrame([(image.ravel().tolist(),), ([1.0],), (None,)], "x array<double>")
    got = [r[0] for r in df.select(resampled(F.col("x"), (28, 20), to, name)).collect()]
    assert got[1] is None and got[2] is None
    want = [pixel(image, to, i, j, name) for i in range(to[0]) for j in range(to[1])]
    assert np.allclose(got[0], want, atol=1e-12)


@pytest.mark.parametrize("n,d", [(40, 6), (9, 30), (8, 8)])
def test_components_from_either_side(spark, n, d):
    x = np.random.default_rng(n).normal(size=(n, d)) * np.linspace(3, 1, d)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "k long, v array<double>")
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (u * s)[:, :2] * np.where(vt[:2][np.arange(2), np.abs(vt[:2]).argmax(1)] < 0, -1, 1)
    for side in (None, "rows", "columns"):
        got = {r.k: (r.pc1, r.pc2) for r in principal_components(df, "k", "v", side=side).collect()}
        assert len(got) == n and np.allclose([got[k] for k in range(n)], want, atol=1e-8)


def test_components_of_little(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "k long, v array<double>")
    assert [tuple(r) for r in principal_components(df, "k", "v").collect()] == [(1, 0.0, 0.0)]
    assert principal_components(df.limit(0), "k", "v").count() == 0


def test_german_order(spark):
    words = ["zebra", "ärger", "apfel", "Apfel", "öl", "ofen", "straße", "strasse", "über", "unter", "a"]
    df = spark.createDataFrame([(words,)], "w array<string>")
    got = df.select(in_order(F.col("w"), "de")).first()[0]
    assert got == ["a", "apfel", "Apfel", "ärger", "ofen", "öl", "strasse", "straße", "über", "unter", "zebra"]
    assert sorted(words) != got


def test_small_networks_by_hand(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c"]), (2, ["x"]), (3, None)], "k long, w array<string>")
    got = {r.k: r for r in small_networks(df, ["k"], "w").collect()}
    net, losses = Network.create(3, 2, seed=1), []
    for _ in range(2):
        steps = [(1, [0]), (0, [1, 1]), (1, [0, 2]), (2, [1])]
        losses.append(sum(net.step(w, np.bincount(c, minlength=3), 0.1) for w, c in steps) / 4)
    assert math.isclose(got[1].first_loss, losses[0]) and math.isclose(got[1].second_loss, losses[1])
    assert got[2].n_words == 1 and got[2].first_loss is None and got[3].n_words == 0


def test_colours_between_stops(spark):
    from tallyloom.operators import vectors as V

    places = [0.0, 1.0, 0.5, -3.0, 9.0, 1 / 12, 0.99]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in places], "t double").select(V.colour(F.col("t"))).collect()]
    assert got[:5] == ["rgb(179,88,6)", "rgb(84,39,136)", "rgb(247,247,247)", "rgb(179,88,6)", "rgb(84,39,136)"]
    assert got[5] == "rgb(210,126,35)" and got[6] == "rgb(88,45,140)"
