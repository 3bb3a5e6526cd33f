"""Golden values and invariants on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import documents as D
from tallyloom.operators import inventory as I
from tallyloom.operators import profile as P
from tallyloom.operators import retrieval as R
from tallyloom.operators import sequences as S


def outcome(spark, machine, inputs):
    df = spark.createDataFrame([(inputs,)], "x array<string>").select(S.run(machine, F.col("x")).alias("r"), S.accepted(machine, S.run(machine, F.col("x"))).alias("ok"))
    row = df.first()
    return row.ok, row.r.state, list(row.r.outputs)


@pytest.mark.parametrize(
    ("inputs", "ok", "state"),
    [
        (["Event_sub", "voll", "mail", "visa"], True, "q4"),
        (["Event_sub", "voll", "nomail"], False, "q0"),
        (["Event_sub", "voll", "nomail", "Event_sub", "voll", "mail", "visa"], True, "q4"),
        (["Event_sub", "visa"], False, "q1"),
        ([], False, "q0"),
    ],
)
def test_form(spark, inputs, ok, state):
    assert outcome(spark, S.FORM, inputs)[:2] == (ok, state)


def test_machines(spark):
    assert outcome(spark, S.TURNSTILE, ["bezahlen", "durchgehen", "bezahlen", "bezahlen", "durchgehen"])[1] == "Zu"
    assert outcome(spark, S.SHOP, ["checkout", "error", "pay"])[1:] == ("Trap", ["Zahlungsfehler"])
    assert outcome(spark, S.PATTERN_101, list("1011010"))[2] == "nix nix treffer nix nix treffer nix".split()
    assert outcome(spark, S.ADDER, ["3", "3", "0"])[2] == ["0", "1", "1"]
    with pytest.raises(Exception, match="no transition"):
        outcome(spark, S.MEALY_DRINKS, ["warten"])


def test_machine_from_json():
    text = '﻿{"automaton": {"States": [{"ID": 1, "Name": "a", "Start": true, "Final": false, "Transitions": [{"Source": 1, "Target": 2, "Labels": ["x"]}, {"Source": 1, "Target": 1, "Labels": [["y", "0"]]}]}, {"ID": 2, "Name": "b", "Start": false, "Final": true, "Output": "B", "Transitions": []}]}}'
    m = S.from_json(text)
    assert m.transitions == {("a", "x"): ("b", "B"), ("a", "y"): ("a", "0")} and m.final == {"b"}
    with pytest.raises(ValueError, match="two transitions"):
        S.from_json(text.replace('["y", "0"]', '"x"'))


def test_fusion_is_symmetric(spark):
    lists = [spark.createDataFrame(r, "id string, rank long") for r in ([("a", 1), ("b", 2), ("c", 3)], [("c", 1), ("d", 2), ("a", 3)])]
    got = dict(R.fuse([(lists[0], 0.5), (lists[1], 0.5)], "id").collect())
    assert got["a"] == pytest.approx(0.5 / 61 + 0.5 / 63) == pytest.approx(got["c"]) and got["b"] == pytest.approx(got["d"]) == pytest.approx(0.5 / 62)


def test_gate(spark):
    df = spark.createDataFrame([(0.30, 0), (0.29, 2), (0.29, 3), (None, 0)], "s double, n long")
    assert [r[0] for r in df.select(R.gate(F.col("s"), F.col("n"))).collect()] == ["generate", "reformulate", "generate", "reformulate"]


def test_loop_is_bounded():
    assert len(R.retrieval_loop("q", lambda q, k: q + "x", lambda q: None)) == R.MOST_RETRIES + 1


def test_chunks_cover_the_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab \n", k=n)) for n in (1, 511, 512, 513, 896, 897, 2000)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = R.chunk_fixed(docs).orderBy("doc_id", "chunk_no").collect()
    for k, t in enumerate(texts):
        mine = [r.chunk for r in rows if r.doc_id == k]
        assert (mine[0] + "".join(c[128:] for c in mine[1:]) if mine else "") == (t or "")
    for t in texts:
        assert all(0 < len(c) <= 512 for c in R.split_recursive(t or ""))


def test_bm25_negative_idf(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a a"), (4, None)], "doc_id long, text string")
    got = dict(R.bm25(docs, "a").collect())
    assert set(got) == {1, 2, 3} and got[1] == pytest.approx(got[2])


def test_name_flags(spark):
    names = ["Untitled3", "Kopie von x", "bericht(2)", "plan_v2", "plan_FINAL", "plan_Final", "a#b", "a  b", "a..b", "PRÄSENTATION1", "gut"]
    df = spark.createDataFrame([(n,) for n in names], "s string").select("s", *I.name_flags(F.col("s"), F.col("s")))
    got = {r.s: (r.generic, r.versioned, r.bad_chars) for r in df.collect()}
    generic = {"Untitled3", "Kopie von x", "bericht(2)", "PRÄSENTATION1"}
    assert {n for n, f in got.items() if f[0]} == generic
    assert {n for n, f in got.items() if f[1]} == {"plan_v2", "plan_FINAL"}
    assert {n for n, f in got.items() if f[2]} == {"a#b", "a  b", "a..b"}


def test_profile_edges(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0)], "a string, b double")
    assert [tuple(r) for r in P.null_counts(df).collect()] == [("a", 2)]
    assert P.choose_analyses(df, True) == ["numerisch", "kategorisch", "fehlende_werte"]
    empty = df.limit(0)
    assert P.describe_numeric(empty, ["b"]).first()["count"] == 0
    assert P.iqr_outliers(df, "b").count() == 0


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.clean(F.lit("Sil-\n be  und\nmehr"))) == "Silbe und mehr"
    assert one(X.parse_tokens(F.lit("['a', \"b\",,c]"))) == ["a", "b", "c"]
    assert one(X.file_name(F.lit("  Über Größe (2).x "))) == "ueber_groesse_2_x"
    assert one(X.size_text(F.lit(1023))) == "1023.0 B" and one(X.size_text(F.lit(1536))) == "1.5 KB"
    assert one(X.thousands(F.lit(1234567))) == "1.234.567"


def test_cycles(spark):
    edges = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("z", "w")], "source string, target string")
    assert [tuple(r) for r in S.cycles(edges).collect()] == [("x>y>z", 3)]
    ring = [(1, f"n{k:02}", f"n{(k + 1) % 12:02}") for k in range(12)] + [(1, "n03", "tail"), (1, "tail", "end"), (1, "n05", "n05"), (2, "a", "b"), (2, "b", "c"), (None, "a", "b")]
    got = {(r.g, r.cycle, r.n) for r in S.cycles(spark.createDataFrame(ring, "g long, source string, target string"), "g").collect()}
    assert got == {(1, ">".join(f"n{k:02}" for k in range(12)), 12), (1, "n05", 1)}
    rng = random.Random(3)
    many = [(g, str(rng.randrange(6)), str(rng.randrange(6))) for g in range(40) for _ in range(9)]

    def by_hand(edges):
        out, todo = set(), [(a,) for a, _ in edges]
        while todo:
            p = todo.pop()
            for a, b in edges:
                if a == p[-1] and b == p[0]:
                    out.add(p)
                elif a == p[-1] and b > p[0] and b not in p:
                    todo.append((*p, b))
        return out

    want = {(g, ">".join(c), len(c)) for g in range(40) for c in by_hand({e[1:] for e in many if e[0] == g})}
    assert {tuple(r) for r in S.cycles(spark.createDataFrame(many, "g long, source string, target string"), "g").collect()} == want
    assert S.cycles(edges.limit(0)).count() == 0


def test_spec_lint(spark):
    full = "".join(f"## {n}. T\n" + {2: "### Beispiel 1\n### Beispiel 2\n", 3: "|a|b|c|d|\n|--|--|--|--|\n|f|g|h|i|\n", 4: "|k|z|\n|--|--|\n|`x`|1|\n|y|2|\n", 5: "- ja → x → END\n- nein -> y\nProsa → nichts\n", 7: "recursion_limit: 9\n", 8: "```mermaid\nx --> r{wie}\nr -->|gut| y\n```\n", 9: "keine\n"}.get(n, "") for n in range(1, 11))
    docs = spark.createDataFrame([(1, full), (1, full), (2, None), (3, "## 3. S\n|a|\n"), (None, full.replace("r -->|gut| y", "r -->|gut| y\ny --> x"))], "doc_id long, text string")
    got = {}
    for r in D.spec_lint(docs).collect():
        got.setdefault(r.doc_id, []).append((r.status, r.check, r.detail))
    ok = {("OK", c, "2" if c == "A5" else "") for c in ("A1", "A2", "A5", "A6", "A7", "B4", "B6")}
    assert len(got[1]) == 16 and set(got[1]) == ok | {("OK", "D1", "0/0")}
    assert set(got[None]) == ok | {("INFO", "D1", "r>y>x"), ("BEFUND", "D1", "1/0")}
    assert set(got[2]) == {("BEFUND", "A1", "1, 2, 3, 4, 5, 6, 7, 8, 9, 10"), ("WARN", "A2", ""), ("BEFUND", "A5", "0"), ("BEFUND", "A6", ""), ("BEFUND", "A7", ""), ("WARN", "B6", ""), ("WARN", "B4", ""), ("WARN", "D1", "")}
    assert ("BEFUND", "A1", "1, 2, 4, 5, 6, 7, 8, 9, 10") in got[3] and ("WARN", "A2", "") in got[3]
    assert D.spec_lint(docs.limit(0)).count() == 0


def test_sections_and_rows_have_no_limit(spark):
    docs = spark.createDataFrame([("\n".join(f"## {k}. T{k}\ntext" for k in range(12_000)),), ("\n".join(["|a|", "|--|", *["|x|"] * 15_000]),)], "text string").withColumn("doc_id", F.lit(1))
    assert D.md_sections(docs).count() == 12_000
    assert D.md_table_rows(docs, "doc_id", body="text").count() == 15_000


ANSWERS = [
    ("array_first", "x [1] {}", "[1]"),
    ("any", "nichts", None),
    ("widest_array", "[kaputt]", "[]"),
    ("think_and_fence", '{"a":1} rest', '{"a":1}'),
    ("strict", "[1]", "[1]"),
    ("any", None, None),
    ("array_first", '```json\n{"a": [}, "b": {"c": 1}}\n```', None),
    ("array_first", 'so ]{"a": 1}[', '{"a":1}'),
    ("array_first", "[1] [2]", None),
    ("object_or_default", 'x {"depth": {"v": 1}, "a": {}} {"b": 2}', '{"a":{},"depth":{"v":1}}'),
    ("object_or_default", "{" + "{}" * 20_000 + "}", '{"completeness":0.5,"depth":0.5}'),
    ("object_or_default", None, '{"completeness":0.5,"depth":0.5}'),
    ("think_and_fence", '<think>{"x":\n2}</think> gut\n```\n[1, "ä"]\n``` Ende', '[1,"ä"]'),
    ("think_and_fence", "<think>offen", None),
    ("strict", "1] [2", None),
    ("strict", "1} {", None),
    ("strict", "1, 2", None),
    ("strict", "", None),
    ("strict", " \n null ", "null"),
    ("strict", '{"a":1,"a":2}', None),
    ("widest_array", 'a ```json\n[1, [2]]\n``` b ] c', "[]"),
    ("widest_array", "<think>[9]</think>a ```json [1, [2]] ``` b", "[1,[2]]"),
    ("any", "```json\n[1]\n```\nEnde", "[1]"),
    ("any", 'A: {"b": "' + "x" * 200_000 + '"} ok', '{"b":"' + "x" * 200_000 + '"}'),
    ("unbekannt", "so [1]", "[1]"),
    (None, "so [1]", "[1]"),
]


def test_answers(spark):
    rows = spark.createDataFrame([(k, m, t) for k, (m, t, _) in enumerate(ANSWERS)], "k int, mode string, answer string")
    got = dict(D.parse_answers(rows).select("k", "found").collect())
    assert {k: got[k] for k in range(len(ANSWERS))} == {k: w for k, (_, _, w) in enumerate(ANSWERS)}
    assert D.parse_answers(rows.limit(0)).count() == 0


def test_quiz_rounds_end():
    rounds = D.quiz_rounds(lambda k: [], lambda q: ["never good"])
    assert [r["done"] for r in rounds] == [False, False, True]


def test_word2vec_step_golden():
    from tallyloom.operators import word2vec as W

    draws = W.Draws(1)
    assert [draws() for _ in range(3)] == pytest.approx([0.9002685546875, 0.9419403076171875, 0.116973876953125])
    net = W.Network.create(3, 2, seed=1)
    before = net.forward(0)
    loss = net.step(0, [0, 1, 1], 0.1)
    assert loss > 0 and net.forward(0)[1] + net.forward(0)[2] > before[1] + before[2]
    assert sum(net.forward(1)) == pytest.approx(1)


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for values in (rng.normal(size=4001), np.exp(rng.normal(size=3000) * 8), rng.integers(0, 3, 1000).astype(float), np.array([5.0]), np.full(500, 2.0), np.concatenate([np.full(900, 1.0), [1e9]])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
        want = np.quantile(values, shares)
        for keep, bins in ((10, 7), (10_000, 1000)):
            assert np.allclose(P.exact_quantiles(df, {"v": shares}, keep, bins)["v"], want, rtol=1e-12)
    assert P.exact_quantiles(df.limit(0), {"v": [0.5]}) == {"v": [None]}
    # Several columns at once; infinite and very large values.
    inf = float("inf")
    rows = [(float(k), -1e308 if k % 2 else 1e308, [-inf, 1.0 * k, inf][k % 3]) for k in range(999)]
    got = P.exact_quantiles(spark.createDataFrame(rows, "a double, b double, c double"), {"a": [0.5], "b": [0.1, 0.9], "c": [0.1, 0.5, 0.9]}, 10, 7)
    assert got == {"a": [499.0], "b": [-1e308, 1e308], "c": [-inf, 499.0, inf]}


def test_source_excerpt(spark):
    cases = {"# Kopf\nimport os\nfrom a import b\nx = 1": ("Kopf", "import os | from a import b"), "\'\'\'Eins\nzwei\n\'\'\'\n# Titel": ("Titel", "Eins zwei "), "": ("", ""), "import re\n# spät": ("spät", "import re")}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", D.source_excerpt(F.col("t")).alias("e"))
    assert {r.t: (r.e.title, r.e.excerpt.strip()) for r in df.collect()} == {t: (a, b.strip()) for t, (a, b) in cases.items()}


def test_names_are_numbered_across_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), f"p{k:04}") for k in range(700)]
    rng.shuffle(rows)
    want, seen = {}, {}
    for stem, path in sorted(rows, key=lambda r: r[1]):
        seen[stem] = seen.get(stem, 0) + 1
        want[path] = f"{stem}__dup{seen[stem]}" if stem and seen[stem] > 1 else stem
    got = {r.path: r.unique_stem for r in I.deduplicated_names(spark.createDataFrame(rows, "stem string, path string")).collect()}
    assert got == want


def test_machines_in_pieces(spark):
    """The composed pieces give what one fold gives, for every machine and any cut."""
    rng = random.Random(5)
    symbols = {"t": ["bezahlen", "durchgehen", "warten"], "s": ["checkout", "error", "pay", "back", "x"], "p": ["0", "1"], "f": ["Event_sub", "voll", "mail", "visa", "nomail"]}
    for name, machine, hit in (("t", S.TURNSTILE, None), ("s", S.SHOP, "Zahlungsfehler"), ("p", S.PATTERN_101, "treffer"), ("f", S.FORM, None)):
        rows = [(u, k, rng.choice(symbols[name])) for u in range(12) for k in range(rng.randrange(1, 60))]
        events = spark.createDataFrame(rows, "u long, k long, x string")
        whole = {r.u: r.r for r in S.sequences(events, "u", ["k"], F.col("x")).select("u", S.run(machine, F.col("inputs")).alias("r")).collect()}
        for cut in ("k div 7", "0", "k"):
            for r in S.run_in_pieces(events, "u", ["k"], F.col("x"), machine, F.expr(cut), hit).collect():
                w = whole[r.u]
                assert (r.state, r.read, r.rejected, r.hits, r.first, r.last) == (w.state, w.read, w.rejected, w.outputs.count(hit), (w.outputs or [None])[0], (w.outputs or [None])[-1])


def test_stored_bm25(spark, tmp_path):
    """Written, loaded again, replaced; a question reads the folders of its words only."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 17}" for j in range(1, 9))) for k in range(60)] + [(99, None)], "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    built = R.Bm25Index.build(docs, path)
    question = "w3 w5 w5 fehlt"
    want = {r.doc_id: r.score for r in R.bm25(docs, question).collect()}
    found = R.Bm25Index.load(spark, path).search(question)
    assert want and {r.doc_id: r.score for r in found.collect()} == pytest.approx(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("bucket#", "bucket") or "PartitionFilters: [bucket" in plan
    assert built.search("").count() == 0
    R.Bm25Index.build(docs.limit(0), path)
    assert R.Bm25Index.load(spark, path).search(question).count() == 0


def test_log_tail(spark):
    rng = random.Random(1)
    turns = [(c, k, "user", "x" * rng.choice([0, 1, 5, 3000])) for c in range(4) for k in range(rng.choice([1, 30, 600]))]
    got = {r.conv_id: r.log for r in R.log_tail(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 40, 9).collect()}
    for c, log in got.items():
        assert log == "\n".join(f"{r}: {t[:9]}" for x, _, r, t in turns if x == c)[-40:]


SMALL = "/root/testdata/sf0.001"


def embeddings(spark):
    import numpy as np

    rows = sorted(spark.read.parquet(f"{SMALL}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    return [r.vec_id for r in rows], np.array([r.label for r in rows]), np.array([r.embedding for r in rows], dtype=float)


def test_components_by_brute_force(spark):
    import numpy as np

    import tallyloom.plans  # noqa: F401
    from tallyloom import catalog

    ids, _, x = embeddings(spark)
    x = x - x.mean(axis=0)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    v = v[:2] * np.sign([w[np.argmax(np.abs(w))] for w in v[:2]])[:, None]
    got = {r.vec_id: (r.pc1, r.pc2) for r in catalog.QUERIES["vec_pca2"](spark, SMALL).collect()}
    assert np.allclose([got[k] for k in ids], x @ v.T, atol=1e-4)


def test_autoencoder_by_brute_force(spark):
    """Gradients summed over tasks are the gradients of all rows; they agree with differences of the loss."""
    import numpy as np

    from tallyloom.operators import autoencoder as A

    _, labels, x = embeddings(spark)
    got = A.train(spark.read.parquet(f"{SMALL}/embeddings.parquet").where("label in (1, 2)").repartition(3), "label", "embedding", (5, 2, 5), epochs=6)
    for k in (1, 2):
        mine = x[labels == k]
        mine = (mine - mine.mean(0)) / (mine.std(0, ddof=1) + 1e-9)
        weights = A.first_weights(mine.shape[1], (5, 2, 5))
        for loss in got[k][1]:
            total, grads = A.gradient(mine, weights)
            assert loss == pytest.approx(total / mine.size, rel=1e-9)
            weights = [w - 0.05 / len(mine) * g for w, g in zip(weights, grads)]
        assert got[k][1][-1] < got[k][1][0]
    for layer, at in ((0, (3, 2)), (1, (5, 1)), (3, (0, 4))):
        weights = A.first_weights(mine.shape[1], (5, 2, 5))
        _, grads = A.gradient(mine, weights)
        up = [w.copy() for w in weights]
        up[layer][at] += 1e-6
        assert (A.gradient(mine, up)[0] - A.gradient(mine, weights)[0]) / 1e-6 == pytest.approx(grads[layer][at], rel=1e-3, abs=1e-3)


def test_tree_learns(spark):
    import tallyloom.plans  # noqa: F401
    from tallyloom import catalog

    row = catalog.QUERIES["ml_tree_accuracy"](spark, "/root/testdata/sf0.01").first()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("label in (1, 2, 8)")
    most = max(r["count"] for r in rows.groupBy("label").count().collect()) / rows.count()
    assert 0.2 * rows.count() < row.n < 0.4 * rows.count() and row.accuracy > most - 0.1


def test_word_vectors(spark):
    from tallyloom.operators.word2vec import train_vectors

    rows = spark.createDataFrame([(["a", "b", "a", "c"],), (["b", "a", "einmal"],), ([],)], "words array<string>")
    got = {r.word: list(r.vector) for r in train_vectors(rows, size=7, window=3, iterations=2).collect()}
    assert set(got) == {"a", "b"} and all(len(v) == 7 and any(v) for v in got.values())


def test_recursive_chunks_by_hand():
    assert R.split_recursive("eins zwei drei", 9, 0) == ["eins zwei", "drei"]
    assert R.split_recursive("a\n\nb c", 5, 0) == ["a", "b c"] and R.split_recursive("a\n\nb c", 6, 0) == ["a\n\nb c"]
