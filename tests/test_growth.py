"""What must not grow with the tables: rows sent through the driver, and tails cut at a line's end."""

import time

import numpy as np
import pyarrow as pa
import pytest

from tallyloom import catalog, plans  # noqa: F401  registers the queries
from tallyloom.operators import retrieval as R
from tallyloom.operators import sentences, sequences, strong, word2vec
from tallyloom.operators import vector_index as V
from tallyloom.sources import keywords as K
from tallyloom.store import store


def plans_of(monkeypatch, *modules):
    """The plans of all tables that the modules store from now on."""
    seen = []
    for module in modules:
        plain = module.store

        def noted(df, *args, _plain=plain, **more):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return _plain(df, *args, **more)

        monkeypatch.setattr(module, "store", noted)
    return seen


def test_graphs_are_never_broadcast(spark, monkeypatch):
    """Stored edges are small as files; as rows they would fill the driver."""
    seen = plans_of(monkeypatch, strong, sequences)
    df = spark.createDataFrame([(g, a, (a + 1) % 3) for g in range(4) for a in range(3)], "g long, source long, target long")
    parts = strong.strong_components(df, "g")
    assert parts.count() == 12
    rings = sequences.cycles(df, "g")
    assert {tuple(r) for r in rings.collect()} == {(g, "0>1>2", 3) for g in range(4)}
    seen += [d._jdf.queryExecution().executedPlan().toString() for d in (parts, rings)]
    assert len(seen) > 10 and not [p for p in seen if "Broadcast" in p]


@pytest.mark.parametrize("chars", [1, 8, 9, 10, 11, 19])
def test_log_tail_at_a_line_end(spark, chars):
    """Lines of four characters: a tail of nine starts with a line end."""
    turns = [(1, 0, "a", "x"), (1, 1, "b", None), (1, 2, "c", "y"), (1, 3, "d", "z"), (2, 0, "a", None), (3, None, "a", "1"), (3, 4, "b", "2")]
    got = {r.conv_id: r.log for r in R.log_tail(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), chars).collect()}
    assert got == {1: "a: x\nc: y\nd: z"[-chars:], 2: None, 3: "b: 2\na: 1"[-chars:]}


def test_networks_of_many_texts_at_once():
    """As one network after the other, for texts of all lengths."""
    rng = np.random.default_rng(3)
    texts = sorted((np.unique(rng.integers(0, m, n), return_inverse=True)[1] for m, n in rng.integers(2, 25, (60, 2))), key=len, reverse=True)
    got = word2vec.trained(texts, 2, 1, 0.1, 2)
    for text, losses in zip(texts, got):
        net, at = word2vec.Network.create(int(text.max()) + 1, 2, seed=1), text.tolist()
        for loss in losses:
            steps = [net.step(w, np.bincount(at[max(0, i - 1) : i] + at[i + 1 : i + 2], minlength=len(net.inner)), 0.1) for i, w in enumerate(at)]
            assert abs(sum(steps) / len(at) - loss) < 1e-9


def test_tokens_are_counted_before_they_travel(spark):
    docs = spark.createDataFrame([("Nr. ab Nr. Ab z.B.\u2003x ab.",), (None,), ("Nr.\n\tö ab. ",)], "text string").coalesce(1)
    for most in (1, 100):
        rows = sentences._written(docs, most).collect()
        got = {}
        for r in rows:
            got[r.w] = tuple(a + b for a, b in zip(got.get(r.w, (0, 0)), (r.times, r.small)))
        assert got == {"Nr.": (3, 2), "ab": (1, 0), "Ab": (1, 0), "z.B.\u2003x": (1, 0), "ab.": (2, 0), "ö": (1, 0)}
        assert most == 1 or len(rows) == len(got)  # one row a token


@pytest.mark.parametrize("text", ["A.b Dr. Ab „3. x. “ 3. ‚So.“ ab", "... ... Dr.", "Dr.\u2003Ab ΑΣ'Α. ΑΣ. İx! . a"])
def test_spans_are_sentences(text):
    known = frozenset({"dr"})
    assert [s.split() for s in sentences.spans(text, known) if s.split()] == sentences.split_sentences(text, known)
    assert sentences.small_words(text) == [w.lower() for w in sentences.LETTERS.findall(text)]


def test_words_are_counted_where_they_are_read(spark):
    """One shuffle of the postings; rows of one document are one document's words."""
    docs = spark.createDataFrame([(1, "b a\tb"), (2, None), (3, " \n"), (4, "a b a b")], "doc_id long, text string")
    counted = R._counted(docs)
    assert sorted(map(tuple, counted.collect())) == [("a", 1, 1, 3), ("a b", 4, 2, 2), ("b", 1, 2, 3)]
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_files_are_not_gathered(spark):
    """A file is read, merged and rewritten at once, and leaves before the next large one is opened."""
    opened = []
    run = K.one_by_one(lambda raw: opened.append(raw) or raw, K.FILE).func
    big = b"x" * (K.RUN_BYTES + 1)
    for k, made in enumerate(run(iter([(pa.array([big, big, None]),), (pa.array([b"", big]),)]))):
        assert len(opened) == (1, 2, 3, 5, 5)[k] and all(m.as_py() in (big, b"", None) for m in made)
    plan = K.write_keywords(spark.createDataFrame([("a.docx", b"", ["k"])], "path string, content binary, new array<string>"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_texts_go_through_all_steps_at_once(spark):
    """As the operators one after the other; contents of files leave no task."""
    rows = [(f"{k}{ext}", text, ["b", "a"], new, told) for k, (text, new, told) in enumerate([("eins\nzwei", ["c", " ", None], "x"), (None, None, None), ("ä", ["a"], "")]) for ext in (".docx", ".pdf", ".PNG", ".txt", "")]
    texts = spark.createDataFrame([*rows, (None, "t", None, ["k"], None)], "path string, text string, first array<string>, second array<string>, about string")
    whole = K.text_keywords(texts, ["first", "second"], description="about")
    steps = K.read_keywords(K.write_keywords(K.write_keywords(K.text_files(texts), new="first"), new="second", description="about"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, steps.collect()))
    plan = catalog.QUERIES["kw_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


@pytest.mark.parametrize("ext, stored, new, want", [(".pdf", " b,,a\t,b", ["c", None, " a "], "a, b, c"), (".pdf", " , ", ["c", "", "a", "c"], "c, a"), (".png", "x", ["b", "a"], "b, a"), (".docx", "b, a", None, "a, b"), (None, None, None, ""), (".docx", "\u00a0x", ["\U0001f600", "\uffee"], "\u00a0x, \uffee, \U0001f600")])
def test_keywords_are_merged(ext, stored, new, want):
    assert K.merged_keywords(ext, stored, new) == want


@pytest.mark.parametrize("name", ["w2v_multihot", "w2v_skipgram"])
def test_context_rows_are_compiled(spark, name):
    """One compiled stage that cuts each text once; functions within functions aren't compiled."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    nodes = plan.strip().splitlines()
    assert "lambda" not in plan and plan.count("split(") == 1 and "Exchange" not in plan
    assert all("*(1)" in n for n in nodes if "FileScan" not in n)


def test_context_rows_of_short_and_repeated_words(spark, tmp_path):
    texts = {1: "a", 2: "A a", 3: "a a a a a", 4: "a b a b b", 5: "-- ä!", 6: "", 7: None, 8: "x y\u2028x"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.QUERIES["w2v_multihot"](spark, str(tmp_path)).collect()))
    want = []
    for k, text in texts.items():
        w = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        for i in range(len(w)):
            near = w[max(0, i - 2) : i] + w[i + 1 : i + 3]
            want += [(k, i, x, near.count(x)) for x in set(near)]
    assert got == sorted(want) and (3, 2, "a", 4) in got
    shown = {(r.doc_id, r.pos): (r.target, r.context) for r in catalog.QUERIES["w2v_skipgram"](spark, str(tmp_path)).collect()}
    assert len(shown) == 17 and shown[1, 0] == ("a", "") and shown[4, 1] == ("b", "a a b") and shown[5, 0] == ("ä", "")


def test_questions_meet_cells_where_both_are_read(spark, tmp_path):
    """A question's vector is never repeated for each cell that it must see."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(400, 16)))], "vec_id long, embedding array<float>")
    index = V.VectorIndex.build(rows, f"file://{tmp_path}/index", cells=20)
    cells = V.Cells(index.cells.collect())
    asked = rows.selectExpr("vec_id AS q", "cast(embedding AS array<double>) AS v", "0.1d AS bound")
    asking = V._asking(asked, cells, 5).collect()
    assert sum(len(r.qs) for r in asking) == 400 and sum(len(r.vs) for r in asking) == 400 * 16
    assert sum(sum(r.beyond) for r in asking) > 400 * 10  # most cells, as vectors lie evenly
    plan = index._met(spark.createDataFrame(asking, "qs array<long>, vs array<double>, bounds array<double>, beyond array<long>, cells array<int>"), cells, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|")
    before = {f for f in files() if "shuffle_" in f}
    kept = store(spark.range(100_000).repartition(4, "id").groupBy("id").count(), "rows")
    for _ in range(50):
        left = {f for f in files() if "shuffle_" in f} - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and kept.df.count() == 100_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
