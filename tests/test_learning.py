import random
from collections import Counter

import numpy as np
import pytest

from tallyloom.operators import networks as N
from tallyloom.operators.sentences import abbreviations, sentences, split_sentences
from tallyloom.operators.sequences import cycles
from tallyloom.operators.strong import strong_components


@pytest.mark.parametrize("model", [N.Plain(5, (4, 2, 4)), N.Variational(5, 4, 2, "sum"), N.Variational(5, 3, 2, "mean")])
def test_gradient_by_differences(model):
    rng = np.random.default_rng(1)
    x, keys, weights = rng.random((7, 5)), np.arange(7), model.first(3)
    losses, grads = model.gradient(x, keys, 2, weights)
    for w, g in zip(weights, grads):
        for at in [(0, 0), (w.shape[0] - 1, w.shape[1] - 1), (w.shape[0] // 2, 0)]:
            old, found = w[at], []
            for step in (1e-5, -1e-5):
                w[at] = old + step
                found.append(model.gradient(x, keys, 2, weights)[0].sum())
            w[at] = old
            assert abs((found[0] - found[1]) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at]))
    assert losses[0] > 0 and np.isfinite(losses).all()


def test_draws_by_key():
    z = N.normal_draws(np.arange(20_000), 3, 4)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and (N.normal_draws(np.array([7]), 3, 4) == z[7]).all() and not (N.normal_draws(np.arange(5), 4, 4) == z[:5]).any()


def test_training_does_not_follow_the_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (0.5 + 0.4 * np.sin(np.arange(6) * (k % 5))).tolist()) for k in range(200)] + [(None, rng.random(6).tolist()), (900, None)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    model = N.Variational(6, 8, 2)
    runs = [N.train(df.repartition(n), model, "k", "v", epochs=5, batches=3, rate=0.02) for n in (1, 40)]
    assert np.allclose(runs[0][1], runs[1][1], atol=1e-9) and all(np.allclose(a, b, atol=1e-9) for a, b in zip(runs[0][0], runs[1][0]))
    assert sum(runs[0][1][-1]) < sum(runs[0][1][0])
    assert N.train(df.limit(0), model, "k", "v", epochs=1)[1] == []


def test_the_deep_one_has_the_sizes_of_the_reference_case():
    assert [w.shape for w in N.Plain(196).first()] == [(197, 100), (101, 50), (51, 2), (3, 50), (51, 100), (101, 196)]


def reach(edges, a):
    seen, open_ = set(), [a]
    while open_:
        for x, y in edges:
            if x == open_[-1] and y not in seen:
                seen.add(y)
                open_.append(y)
                break
        else:
            open_.pop()
    return seen


def test_strong_components_by_reach(spark):
    rng, rows, want = random.Random(6), [], set()
    for g in range(14):
        edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(rng.choice([4, 9, 14, 25]))}
        rows += [(g, a, b) for a, b in edges]
        to = {a: reach(edges, a) for a in range(9)}
        for a in range(9):
            if a in to[a]:
                want.add((g, a, min(b for b in range(9) if b in to[a] and a in to[b])))
    df = spark.createDataFrame([*rows, *rows[:5], (1, None, 3)], "g long, source long, target long")
    assert {tuple(r) for r in strong_components(df, "g").collect()} == want
    assert strong_components(df.limit(0), "g").count() == 0


def test_paths_never_leave_their_rings(spark):
    """Two rings and a long bridge between them, which peeling leaves whole."""
    ring = lambda first, n: [(first + k, first + (k + 1) % n) for k in range(n)]
    bridge = [(2, 100), *((100 + k, 101 + k) for k in range(30)), (130, 50)]
    df = spark.createDataFrame([(1, a, b) for a, b in ring(0, 4) + ring(50, 3) + bridge], "g long, source long, target long")
    parts = {r.node: r.component for r in strong_components(df, "g").collect()}
    assert parts == {0: 0, 1: 0, 2: 0, 3: 0, 50: 50, 51: 50, 52: 50}
    assert {r.cycle for r in cycles(df, "g").collect()} == {"0>1>2>3", "50>51>52"}


TEXT = "Das ist z.B. ein Haus. Herr Dr. Meier kam am 3. Oktober. Wirklich? Ja! Er sagte: „Gut.“ Dann ging er usw. und blieb weg. "


def test_sentences_of_a_learned_corpus(spark):
    fill = "Sie sahen z.B. den Hof. Dr. Adam und Dr. Beck gingen. Brot, Milch usw. und Käse waren da. Der Hof war groß. Das Haus war alt. Alle gingen. Wir sahen das Haus. Es ist da so groß und so alt wie der Hof da drüben. "
    docs = spark.createDataFrame([(1, TEXT), (2, fill * 12), (3, None), (4, "... 123 !"), (5, "")], "doc_id long, text string")
    known = abbreviations(docs)
    words = {r.word: r for r in known.collect()}
    assert {"z.b", "dr", "usw"} <= set(words) and not {"haus", "hof", "gingen", "da", "alt"} & set(words)
    tokens = Counter(t for r in docs.collect() for t in (r.text or "").lower().split())
    assert words["dr"].n_stop == tokens["dr."] and words["usw"].n_small == tokens["usw."]
    got = {}
    for r in sentences(docs, known).orderBy("doc_id", "sentence").collect():
        got.setdefault(r.doc_id, []).append(" ".join(r.words))
    assert got[1] == ["das ist z b ein haus", "herr dr meier kam am oktober", "wirklich", "ja", "er sagte gut", "dann ging er usw und blieb weg"]
    assert len(got[2]) == 8 * 12 and set(got) == {1, 2}


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_abbreviations_beyond_those_sent(spark, most):
    """However few go to every task, texts are cut by all of them; repeated texts and ids stay."""
    texts = ["Herr Dr. Meier kam. Ende.", "„Prof. Beck Dr. Adam. Hof.", "Ing. Beck. Da.", None, "", "Herr Dr. Meier kam. Ende."]
    docs = spark.createDataFrame([(k % 5, t) for k, t in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame([("dr", 9.0), ("prof", 8.0), ("ing", 7.0)], "word string, score double")
    got = sorted((r.doc_id, r.sentence, " ".join(r.words)) for r in sentences(docs, known, most=most).collect())
    first = [(0, 0, "herr dr meier kam"), (0, 1, "ende")]
    assert got == sorted([*first, *first, (1, 0, "prof beck dr adam"), (1, 1, "hof"), (2, 0, "ing beck"), (2, 1, "da")])


def test_cuts():
    known = frozenset({"dr"})
    assert split_sentences("Dr. A. Kam er? er ging. Ende", known) == [["Dr.", "A."], ["Kam", "er?"], ["er", "ging."], ["Ende"]]
    assert split_sentences(None, known) == [] == split_sentences("  ", known)
