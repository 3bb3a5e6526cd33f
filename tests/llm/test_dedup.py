"""Repeated passages and near copies against brute force."""

import random
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from tests_helpers import WORD, classes, covered

from tallyloom.llm import queries, signature_tree, suffix_array
from tallyloom.llm.components import components

SF = "/root/testdata/sf0.001"


def check_passages(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got, copied = defaultdict(set), Counter()
    words = {k: WORD.findall(t or "") for k, t in texts.items()}
    holder = {}
    for k in sorted(words, reverse=True):
        for i in range(len(words[k]) - 49):
            holder[tuple(words[k][i : i + 50])] = k
    for r in suffix_array.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
        copied[r.doc_id] += r.copied_words
        assert r.n_words == r.end_word - r.start_word >= 50
        assert r.first_doc_id == min(holder[tuple(words[r.doc_id][i : i + 50])] for i in range(r.start_word, r.end_word - 49))
    want = covered(texts)
    assert dict(got) == {k: v[0] for k, v in want.items()}
    assert {k: n for k, n in copied.items() if n} == {k: len(v[1]) for k, v in want.items() if v[1]}


def test_passages_brute_force(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = fresh(400)
    texts = {}
    for k in range(60):
        a = rng.randrange(300)
        part = shared[a : a + rng.choice([30, 49, 50, 51, 75, 100])]
        texts[k] = " ".join(fresh(rng.randrange(40)) + part + fresh(rng.randrange(40)) + (shared[:60] if k % 5 == 0 else []))
    # Near copies with edits here and there: runs of suffixes whose neighbours share only parts of a passage.
    root = fresh(300)
    for k in range(100, 160):
        w = root[:]
        for _ in range(rng.randrange(12)):
            w[rng.randrange(300)] = f"e{rng.randrange(5)}"
        texts[k] = "\n".join(w)
    texts[200], texts[201] = "", None
    check_passages(spark, texts)


def test_any_partitioning_gives_the_same_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (1, 3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append(sorted(tuple(r) for r in suffix_array.repeated_passages(docs.repartition(parts)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] and got[0] == got[1] == got[2]


def test_runs_cut_anywhere_give_the_same_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    rng = random.Random(12)
    shared = [f"s{k}" for k in range(120)]
    copies = spark.createDataFrame([(k, " ".join([f"n{k}"] + shared[rng.randrange(30) : rng.randrange(90, 120)])) for k in range(1000, 1300)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(copies)
    got = [sorted(tuple(r) for r in suffix_array.document_spans(docs, longest_run=n).collect()) for n in (50_000, 100, 7)]
    assert len(got[0]) > 300 and got[0] == got[1] == got[2]


def test_one_smaller_row_beside_many_that_ascend():
    n = 1_000_000
    doc, run = np.append(np.arange(1, n), 0), np.zeros(n, np.int64)
    start = time.process_time()
    above, below = suffix_array.nearest_lower(doc, run)
    assert time.process_time() - start < 5  # a pass per row would take hours
    assert (above[:-1] == np.arange(-1, n - 2)).all() and above[-1] == -1
    assert (below[:-1] == n - 1).all() and below[-1] == -1


def test_matches_are_checked(spark):
    """Windows that a match covers by mistake, a word too far or altogether, don't stay."""
    rng = random.Random(9)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    shared = fresh(60)
    rows = [(1, fresh(10) + shared + fresh(10), [(8, 73)]), (2, shared + fresh(30), [(0, 61)]), (3, fresh(80), [(5, 70)]), (3, fresh(20), [(5, 70)])]
    texts = spark.createDataFrame([(k, " ".join(w), [{"start": a, "stop": b} for a, b in at]) for k, w, at in rows], "doc_id long, text string, spans array<struct<start:long,stop:long>>")
    got = suffix_array.merged_spans(suffix_array.checked(texts, 3, 64, 1), 3).collect()
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in got} == {1: [(10, 70, 0, 1)], 2: [(0, 60, 60, 1)]}
    assert {r.doc_id: [tuple(s) for s in r.copies] for r in got} == {1: [], 2: [(0, 60)]}


def test_nearest_lower():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 400):
        doc, run = rng.integers(0, 9, n), np.sort(rng.integers(0, 5, n))
        for falling in (False, True):
            doc = np.sort(doc)[::-1] if falling else doc
            above, below = suffix_array.nearest_lower(doc, run)
            for k in range(n):
                mine = [j for j in range(n) if run[j] == run[k] and doc[j] < doc[k]]
                assert above[k] == max((j for j in mine if j < k), default=-1) and below[k] == min((j for j in mine if j > k), default=-1)


def test_few_words(spark):
    """A tiny vocabulary makes many ties."""
    rng = random.Random(7)
    line = [" ".join(rng.choices("ab", k=rng.randrange(40, 130))) for _ in range(25)]
    check_passages(spark, dict(enumerate(line + line[:3])))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in suffix_array.repeated_passages(odd_docs).collect()}
    assert set(rows) == {5, 6} and rows[6].copied_words == 30_000 and rows[5].copied_words == 0
    kept = suffix_array.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in odd_docs.collect() if r.doc_id != 6)
    assert suffix_array.repeated_passages(no_docs).count() == 0 and suffix_array.without_copies(no_docs).count() == 0


def test_cut_words():
    assert suffix_array.cut_words("a  b c\nd", [(1, 3)]) == "a  \nd"
    assert suffix_array.cut_words("ä ö", [(0, 1), (1, 9), (7, 9)]) == " "


def test_copies_are_cut(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"q{rng.randrange(10**9)}" for _ in range(n))
    passage = fresh(60)
    texts = [(1, f"{fresh(20)} {passage} {fresh(5)}"), (2, f"{fresh(9)} {passage}"), (3, fresh(99)), (4, passage)]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in texts], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in suffix_array.without_copies(docs).collect()}
    assert set(got) == {1, 2, 3} and got[1].text == texts[0][1] and got[3].text == texts[2][1]
    assert WORD.findall(got[2].text) == texts[1][1].split()[:9] and got[2].n_chars == len(got[2].text)


def test_op2(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = defaultdict(set)
    for r in queries.op2_suffix_dedup(spark, SF).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert dict(got) == {k: v[0] for k, v in covered(text).items()}


# ---------------------------------------------------------------- near copies


def test_near_copies_brute_force(spark):
    rng = random.Random(5)
    texts, k = {}, 0
    for size in [1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40, 80, 150, 300] * 3:
        root = [f"w{rng.randrange(400)}" for _ in range(size)]
        for _ in range(7):
            w = root[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                if w:
                    w[rng.randrange(len(w))] = f"e{rng.randrange(60)}"
            if rng.random() < 0.3:
                w = w[rng.randrange(1 + len(w) // 6) :]
            texts[k] = "  ".join(w).upper() if rng.random() < 0.2 else " ".join(w)
            k += 1
    texts[k], texts[k + 1] = "", None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = classes(texts)
    for blocks, size in ((2_000_000, 8 << 20), (400, 1 << 12)):  # the second cuts clusters, and the table, into many blocks
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_tree.jaccard_components(docs, block_shingles=blocks, block_bytes=size).collect()}
        assert got == want


def test_tree_finds_all_links():
    rng = np.random.default_rng(9)
    threshold = Fraction(85, 100)
    root = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = []
    for _ in range(300):
        s = root.copy()
        s[rng.random(60) < rng.choice([0.0, 0.02, 0.05, 0.1])] = rng.integers(0, 1 << 62)
        sets.append(np.unique(s[: rng.integers(45, 61)]))
    linked = lambda a, b: len(np.intersect1d(a, b)) >= threshold * len(np.union1d(a, b))
    for left, right in ((sets, None), (sets[:140], sets[140:])):
        n = len(left) + (0 if right is None else len(right))
        truth, found = signature_tree.Forest(n), signature_tree.Forest(n)
        every = left + (right or [])
        for a in range(n):
            for b in range(a):
                if (right is None or (b < len(left) <= a)) and linked(every[a], every[b]):
                    truth.join(b, a)
        for a, b in signature_tree.tree_links(left, right, threshold):
            assert linked(left[a], (left if right is None else right)[b])
            found.join(a, b + (0 if right is None else len(left)))
        assert {frozenset(m) for m in truth.members} == {frozenset(m) for m in found.members}


def places(sets, threshold, ranks=None):
    """(place, route) rows of sets of hashes, all in one block; every key is common unless ranks says otherwise."""
    block = signature_tree.BlockSets.__new__(signature_tree.BlockSets)
    block.sizes = np.array([len(x) for x in sets])
    block.h, block.routes, block.owner = np.concatenate(sets), np.arange(len(sets)), np.repeat(np.arange(len(sets)), block.sizes)
    block.keys, block.of_element, block.counts = np.unique(block.h >> np.uint64(16), return_inverse=True, return_counts=True)
    return block.meeting_places(signature_tree.rarity(block.counts) if ranks is None else ranks(block.keys), threshold)


def test_linked_sets_meet():
    """Any two sets that link have a place in common, whatever the counts are."""
    rng = np.random.default_rng(3)
    for threshold in (Fraction(85, 100), Fraction(80, 100), Fraction(1, 2), Fraction(1)):
        for _ in range(600):
            n = int(rng.integers(1, 220))
            pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            x = np.unique(pool[:n])
            cut = int(rng.integers(0, max(1, n // 8) + 1))
            y = np.unique(np.concatenate([x[cut:], pool[n : n + int(rng.integers(0, max(1, n // 8) + 1))]]))
            both = len(np.intersect1d(x, y))
            if len(y) and both >= threshold * (len(x) + len(y) - both):
                counts = rng.integers(0, 4, 4096)
                for ranks in (None, lambda keys: signature_tree.rarity(2 + counts[(keys % np.uint64(4096)).astype(np.int64)])):
                    place, route = places([x, y], threshold, ranks)
                    assert len(np.intersect1d(place[route == 0], place[route == 1]))


def test_strangers_never_meet():
    """Sets without a common element, and sets that are mostly their own, give no link: the number of meetings doesn't grow with the sets."""
    rng = np.random.default_rng(4)
    for n in (10_000, 1_000_000):
        h = rng.integers(0, 1 << 63, n * 5).astype(np.uint64)
        own = [np.unique(h[5 * k : 5 * k + 5]) for k in range(min(n, 100_000))] if n < 100_000 else np.split(h, n)
        place, route = places(own, Fraction(80, 100), lambda keys: np.full(len(keys), 9, np.uint8))
        assert len(signature_tree.stars(place, route)[2]) == 0
    shared = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    mixed = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 60).astype(np.uint64)])) for _ in range(300)]
    assert len(places(mixed, Fraction(80, 100))[0]) == 0


def test_strangers_make_no_cluster(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(f"w{rng.randrange(10**9)}" for _ in range(43))) for k in range(3000)], "doc_id long, text string")
    blocks = signature_tree.stored_blocks(docs, 4, 1 << 18, 4)
    assert signature_tree.loose_links(blocks, 4, Fraction(85, 100), 4).count() == 0


def test_odd_rows_of_the_join(spark, odd_docs, no_docs):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in signature_tree.jaccard_components(odd_docs).collect())
    assert got[(1, 0, 1)] == got[(2, 0, 2)] == got[(3, 0, 3)] == 1 and got[(4, 1, 4)] == 2 and got[(None, 1, 4)] == 1
    assert got[(6, 29_997, 5)] == 1 and got[(9, 1, 8)] == 1
    kept = signature_tree.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, None, 5, 7, 8, 10])
    assert signature_tree.jaccard_components(no_docs).count() == 0 and signature_tree.one_of_each(no_docs).count() == 0


def test_op4(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_jaccard_join(spark, SF).collect()}
    assert got == classes(text)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5), (None, 3)]
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            p, q = root(a), root(b)
            label[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: root(k) for k in label}
