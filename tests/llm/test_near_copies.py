"""The pipeline's near-copy stage by brute force: five words, 0.8."""

import random
from fractions import Fraction

import corpus_pipeline as P
from tallyloom.llm.signature_tree import jaccard_components, one_of_each
from tests_helpers import LOWER, WORD

SF2 = "/root/testdata/sf0.01"


def sets(texts, n):
    words = {k: WORD.findall((t or "").translate(LOWER)) for k, t in texts.items()}
    return {k: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set() for k, w in words.items()}


def stay(texts, n, least):
    """The smallest id of each group of linked texts, all pairs compared."""
    have, label = sets(texts, n), {k: k for k in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(have)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = have[a], have[b]
            if x and y and min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {k for k in ids if root(k) == k}


def test_near_copies_between_the_bounds(spark):
    draw = random.Random(7)
    texts = {}
    for k, n in enumerate(range(30, 70)):  # one word changed: 5-word similarity (n - 9) / (n + 1)
        words = [f"w{draw.randrange(10**9)}" for _ in range(n)]
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join([*words[: n // 2], "anders", *words[n // 2 + 1 :]])
    want = stay(texts, 5, Fraction(80, 100))
    assert len(want) < len(stay(texts, 4, Fraction(85, 100)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in P.near_duplicates(spark, docs, SF2).collect()} == want


def test_near_copies_of_documents(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in P.near_duplicates(spark, docs, SF2).collect()} == stay(texts, 5, Fraction(80, 100))


def test_sets_without_an_id_are_compared(spark):
    base = [f"w{k}" for k in range(120)]
    near = lambda k: " ".join([*base[:k], "anders", *base[k + 1 :]])
    for third, want in ((7, [1, 1, 1]), (None, [1, 1, 1])):
        docs = spark.createDataFrame([(1, near(0)), (2, near(119)), (third, near(60)), (9, "etwas ganz anderes hier")], "doc_id long, text string")
        got = jaccard_components(docs).collect()
        assert sorted(r.component_id for r in got) == [*want, 9]
    alone = spark.createDataFrame([(None, near(0)), (None, near(119)), (None, near(119)), (3, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_components(alone).collect()) == [("3", "3"), ("None", "None"), ("None", "None"), ("None", "None")]


def test_rows_that_share_an_id_leave_the_least_text(spark):
    rows = [(1, "b one two three four five", {"k": 1}, "z"), (1, "a six seven eight nine ten", {"k": 2}, "y"), (1, "a six seven eight nine ten", {"k": 2}, "x"), (2, "other words are here now", {"k": 3}, "x")]
    for parts in (1, 2, 4):
        for order in (rows, rows[::-1]):
            docs = spark.createDataFrame(order, "doc_id long, text string, extra map<string,int>, source string").repartition(parts)
            kept = {(r.doc_id, r.text, r.source) for r in one_of_each(docs).collect()}
            assert kept == {(1, "a six seven eight nine ten", "x"), (2, "other words are here now", "x")}
