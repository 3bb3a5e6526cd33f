"""Queries that read whole tables and whole texts, against plain Python on small fixtures."""

import re
from collections import Counter

import pytest

from tallyloom import catalog
from tallyloom.plans import text as T  # noqa: F401  registers the queries


@pytest.fixture(scope="module")
def texts():
    words = "Haus Baum See Wald Feld Bach".split()
    long = " ".join(words[(k * k + k // 7) % 6] for k in range(60))
    return {1: long, 2: "eins", 3: "", 4: None, 99: "a b a b a", 100: "Das ist, das\nist!", 2500: f"zwei {long} ENDE"}


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, "de", "src1", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def tokens(text):
    return [w for w in re.split(r"[^a-zäöüß]+", (text or "").lower()) if w]


def neighbours(words, k):
    return words[max(0, k - 2) : k] + words[k + 1 : k + 3]


def test_word_rows(spark, folder, texts):
    words = {k: tokens(t) for k, t in texts.items() if tokens(t)}
    got = {r.doc_id: (r.vocabulary, r.n) for r in catalog.QUERIES["w2v_vocab"](spark, folder).collect()}
    assert got == {k: (" ".join(sorted(set(w))), len(set(w))) for k, w in words.items()}
    got = Counter((r.doc_id, r.pos, r.target, r.context) for r in catalog.QUERIES["w2v_skipgram"](spark, folder).collect())
    assert got == Counter((k, i, x, " ".join(neighbours(w, i))) for k, w in words.items() for i, x in enumerate(w))
    got = Counter((r.doc_id, r.pos, r.word, r.n) for r in catalog.QUERIES["w2v_multihot"](spark, folder).collect())
    assert got == Counter((k, i, x, n) for k, w in words.items() for i in range(len(w)) for x, n in Counter(neighbours(w, i)).items())


def test_marker_cut_reads_every_document(spark, folder, texts):
    got = {r.doc_id: r.body for r in catalog.QUERIES["txt_marker_cut"](spark, folder).collect()}
    assert set(got) == set(texts) and got[2500] == texts[2500] + "\n" and got[99] == "Vorwort " + texts[99]


def test_merge_of_all_events(spark, tmp_path):
    rows = [(k, k % 7, ("click", "purchase", "error", "view")[k * k % 11 % 4]) for k in range(12_000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.block_id: r for r in catalog.QUERIES["reduce_merge"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(7))
    for block, r in got.items():
        mine = {f: [str(k % 97) for k, u, t in rows if u == block and t == f] for f in ("click", "purchase", "error")}
        assert (r.first_seq, r.click, r.purchase, r.error) == (block, mine["click"][-1], mine["purchase"][-1], ",".join(mine["error"]))


def test_lookup_of_all_files(spark, tmp_path):
    rows = [(k, "x", "de", "src1", k) for k in range(190, 260)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    files = catalog.QUERIES["inv_scan"](spark, str(tmp_path)).select("path", "name").collect()
    doc = {r.path: int(k) for r in files for k in [next(iter(re.findall(r"\d{3}", r.name)), -1)]}
    first = {}
    for r in files:
        first[r.name] = min(r.path, first.get(r.name, r.path))
    got = catalog.QUERIES["join_lookup_missing"](spark, str(tmp_path)).collect()
    missing = {int(re.findall(r"\d{3}", r.name)[0]) for r in got if r.status == "fehlt" and re.search(r"\d{3}", r.name)}
    assert len(got) == len(files) and missing == {k for k in doc.values() if k >= 0 and k % 7 == 0}
    assert all(first[r.name] == r.path for r in got if r.status == "ok")


def test_word_vectors_of_rare_words(spark, tmp_path):
    rows = [(k, f"haus baum paar{k // 2} einzeln{k}", "de") for k in range(8)] + [(9, "english english", "en")]
    spark.createDataFrame([(k, t, s, "src1", len(t)) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    # letter_tokens splits at digits: paar 8 times, einzeln 8 times; a pair of its own below
    spark.createDataFrame([(20, "selten selten einmal", "de", "src1", 20)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: r.vector for r in catalog.QUERIES["w2v_train"](spark, str(tmp_path)).collect()}
    assert set(got) == {"haus", "baum", "paar", "einzeln", "selten", "english"} and all(len(v) and any(v) for v in got.values())


def test_whole_conversation_texts(spark, tmp_path):
    long = "gleicher Anfang, zwanzig Zeichen und mehr, dann "
    rows = [(1, 0, "user", long + "dies"), (1, 1, "assistant", None), (2, 0, "user", long + "das"), (2, 1, "assistant", long * 9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.shown for r in catalog.QUERIES["rows_to_text"](spark, str(tmp_path)).collect()}
    assert got == {c: "\n".join(f"{role} | {t or ''}" for k, _, role, t in rows if k == c) for c in (1, 2)}
    plan = [tuple(r) for r in catalog.QUERIES["oplog_undo_plan"](spark, str(tmp_path)).select("order", "source", "target").collect()]
    assert sorted(plan) == [(1, long * 9, "assistant"), (2, long + "das", "user")]
