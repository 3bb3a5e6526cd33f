"""Word vectors that no driver holds: the step against pairs one by one, topics, and the queries' settings."""

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from tallyloom.operators import word2vec as W


def test_a_step_is_that_of_all_pairs():
    """At a small rate, the sum over pairs of a word and those near it, told from the words drawn."""
    rng = np.random.default_rng(2)
    tokens, starts = np.array([0, 1, 2, 1, 3, 0, 4, 2], np.int32), np.array([0, 6])
    inner, outer, odds = rng.normal(size=(5, 4)), rng.normal(size=(5, 4)), np.array([3.0, 2, 2, 1, 1])
    moved = inner.copy(), outer.copy()
    rate = 1e-7
    W.skip_gram(tokens, starts, *moved, odds, 2, (rate, rate), np.random.default_rng(9))
    draw, want = np.random.default_rng(9), (np.zeros((5, 4)), np.zeros((5, 4)))
    likely = lambda c, t: 1 / (1 + np.exp(-inner[c] @ outer[t]))
    for lo, hi in ((0, 6), (6, 8)):
        reach = draw.integers(1, 3, hi - lo)
        drawn = np.searchsorted(np.cumsum(odds), draw.random(W.CHUNK) * odds.sum(), side="right")
        for i in range(lo, hi):
            for k in range(max(lo, i - reach[i - lo]), min(hi, i + reach[i - lo] + 1)):
                told = [(tokens[i], 1 - likely(tokens[k], tokens[i]))] if k != i else []
                told += [(t, -W.NEGATIVE / W.CHUNK * likely(tokens[k], t)) for t in drawn if k != i and t != tokens[i]]
                for t, slope in told:
                    want[0][tokens[k]] += slope * outer[t]
                    want[1][t] += slope * inner[tokens[k]]
    for got, before, slope in zip(moved, (inner, outer), want):
        assert np.allclose((got - before) / rate, slope, atol=1e-4)


def test_words_of_a_topic_come_together(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [[f"{'ab'[k % 2]}{w}" for w in rng.integers(0, 12, 30)] + ["z"] for k in range(120)]
    rows = spark.createDataFrame([*[(t,) for t in texts], (["once", None],), ([],), (None,), (["z"],)], "words array<string>")
    sizes, plain = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: sizes.append(len(out := plain(self))) or out)
    vectors = W.train_vectors(rows, size=8, window=10, iterations=6, parts=3)
    monkeypatch.undo()
    assert max(sizes) == 3  # no words or vectors on the driver, only sums and the parts' numbers
    got = {r.word: np.array(r.vector) for r in vectors.collect()}
    assert set(got) == {"z", *(f"{t}{k}" for t in "ab" for k in range(12))}
    unit = {w: v / np.sqrt(v @ v) for w, v in got.items()}
    cos = lambda s, t: np.mean([unit[f"{s}{i}"] @ unit[f"{t}{k}"] for i in range(12) for k in range(12) if (s, i) != (t, k)])
    assert min(cos("a", "a"), cos("b", "b")) > cos("a", "b") + 0.2


def test_no_rows(spark):
    assert W.train_vectors(spark.createDataFrame([], "words array<string>"), iterations=1).count() == 0


@pytest.mark.parametrize("name", ["w2v_train", "words_pca2"])
def test_queries_lower_no_setting(spark, monkeypatch, name):
    from tallyloom import catalog, plans  # noqa: F401
    from tallyloom.plans import text

    seen = []

    def noted(rows, *args, **settings):
        seen.append((args, settings))
        raise InterruptedError

    for module in (W, text):
        monkeypatch.setattr(module, "train_vectors", noted)
    with pytest.raises(InterruptedError):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [((), {})]
