"""Classifiers, mixing, tokenisation, scoring and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bpe, katz, mixing, ordinal, packing, queries, textkit, toxicity

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ---------------------------------------------------------------- primitives


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a bb", "", None, "bb", " a\tbb\x0bc\n", "ß bb", "x" * 5000]
    seen = {}
    for limit in (1, 10, 1 << 20):
        at = 0
        for lo, hi, data, off in textkit.text_chunks(pa.array(texts), limit):
            assert lo == at and hi > lo
            at = hi
            w = textkit.Words(data, off)
            h = textkit.Hasher(data).spans(w.starts, w.ends)
            for k in range(lo, hi):
                mine = [bytes(data[s:e]).decode() for s, e in zip(w.starts[w.first[k - lo] : w.first[k - lo + 1]], w.ends[w.first[k - lo] : w.first[k - lo + 1]])]
                assert mine == WORD.findall(texts[k] or "")
                for word, x in zip(mine, h[w.first[k - lo] : w.first[k - lo + 1]].tolist()):
                    assert seen.setdefault(word, x) == x
        assert at == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_packing():
    rng = np.random.default_rng(0)
    arrays = [rng.integers(0, 300, 1000).astype(np.uint32), np.zeros(0, np.int64), np.array([-1, 5]), rng.integers(0, 1 << 63, 100).astype(np.uint64), np.zeros(50, np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, packing.unpack(packing.pack(*arrays))))
    words = [b"", b"a", b"x" * 1000, "ä".encode()]
    assert packing.unpack_strings(packing.pack_strings(words)) == words


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_is_the_library(spark, odd_docs, no_docs, ranks):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tricky = spark.createDataFrame([(k, t) for k, t in enumerate(["  a   b\n\n c", "it's we'll  'x", "12345 6.7", "   ", "\n \t", "<|endoftext|>", "日本語 text x", "é́ ￿", " " * 999 + "a", "ab" * 4000])], "doc_id long, text string")
    for docs, size in ((tricky, 1), (odd_docs, 1 << 24), (spark.read.parquet(f"{SF}/documents.parquet"), 50_000)):
        want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
        got = bpe.encoded(docs, ranks, public_tokenizers.PATTERN, digest=False, block_bytes=size).collect()
        assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
        short = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(docs, ranks, public_tokenizers.PATTERN, block_bytes=size).collect())
        assert short == Counter((k, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t).hexdigest()) for (k, i, t), n in want.items() for _ in range(n))
    assert bpe.encoded(no_docs, ranks, public_tokenizers.PATTERN).count() == 0
    assert queries.op5_byte_bpe(spark, SF).count() == 200


def test_merge_loop_is_the_library(ranks):
    """Words of every length and alphabet, ties of equal pairs among them."""
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for k in range(3000):
        word = bytes(rng.choices(rng.choice([b"ab", b"the ing", b"0123456789", b"abcdefghijklmnopqrstuvwxyz", bytes(range(256))]), k=rng.choice([1, 2, 3, 7, 15, bpe.LONG, bpe.LONG + 1, 200])))
        assert bpe.encode_word(word, ranks) == library._encode_single_piece(word)
        assert len(word) < 2 or word in ranks or bpe.encode_long(word, ranks) == bpe.encode_word(word, ranks)
    for word in (b"a" * 50_000, b" " * 30_001, "日本".encode() * 9_000):
        assert bpe.encode_word(word, ranks) == library._encode_single_piece(word)


def test_token_table(ranks):
    table = bpe.TokenTable(ranks)
    some = dict(list(ranks.items())[::97])
    assert table.join(np.array(list(some.values()))).to_pylist() == list(some)
    with pytest.raises(ValueError):
        table.join(np.array([1 << 40]))
    assert bpe.TokenTable({}).join(np.zeros(0, np.int64)).to_pylist() == []


# ---------------------------------------------------------------- classifiers


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op7_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    hit = sum(r.predicted and r.toxic for r in held)
    assert hit / sum(r.toxic for r in held) > 0.85 and hit / sum(r.predicted for r in held) > 0.95


def test_toxicity_odd_rows(spark, odd_docs, no_docs, labels):
    got = toxicity.toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(r.score is not None for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert len({r.score for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()}) == 1
    assert toxicity.toxicity(no_docs, labels).count() == 0


def sample_of(texts, labels, features):
    raw = [t.encode() for t in texts]
    pairs = features.pairs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return toxicity.Sample(*features.of_texts(raw), np.array(labels), *features.changes(pairs), len(pairs))


def test_counterfactual_penalty():
    """A group that is named mostly in toxic texts is not what makes a text toxic."""
    rng = random.Random(0)
    texts, y = [], []
    for _ in range(1500):
        bad = rng.random() < 0.4
        group = "muslim" if rng.random() < (0.8 if bad else 0.1) else "christian"
        words = [f"w{rng.randrange(300)}" for _ in range(12)] + [group] + (["vermin"] if bad and rng.random() < 0.8 else [])
        rng.shuffle(words)
        texts.append(" ".join(words))
        y.append(int(bad))
    data = "we met a muslim neighbour|we met a christian neighbour|vermin all of them".split("|")
    raw = "".join(data).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in data])])
    score = {}
    features = toxicity.Features(16)
    for fairness in (0.0, 5.0):
        m = toxicity.fit_toxicity(sample_of(texts, y, features), features, fairness=fairness)
        score[fairness] = m.score(np.frombuffer(raw, np.uint8), off)
    plain, fair = score[0.0], score[5.0]
    assert abs(fair[0] - fair[1]) < 0.1 * abs(plain[0] - plain[1]) and fair[0] < 0.5 < fair[2] and plain[0] > fair[0]


def test_counterfactual_pairs():
    """Every term is swapped within its group; a text without terms gets a mention, which is then swapped."""
    features = toxicity.Features(12, [("old", "young"), ("muslim", "hindu", "jewish")])
    texts = ["Old and old, a Muslim", "no term here", "", "jewish"]
    raw = [t.encode() for t in texts]
    pairs = features.pairs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [k for k, _, _ in pairs] == [0, 1, 1, 2, 2, 3]
    words = [[re.findall(r"[a-z]+", t.decode().lower()) for t in p[1:]] for p in pairs]
    assert words[0][1][:4] == ["young", "and", "young", "a"] and words[0][1][4] in ("hindu", "jewish")
    for k in (1, 3):
        plain, named, swapped = words[k][0], words[k][1], words[k + 1][1]
        assert words[k + 1][0] == named and len(named) == len(plain) + 1 == len(swapped)
        (a,), (b,) = (list((Counter(x) - Counter(plain)).elements()) for x in (named, swapped))
        assert a != b and any({a, b} <= set(g) for g in (("old", "young"), ("muslim", "hindu", "jewish")))
    assert words[5][1][0] in ("muslim", "hindu")
    # Counts are in the change: "old" twice and "young" twice, and the beginnings of both.
    pair, ids, change = features.changes(pairs)
    found = dict(zip(ids[pair == 0].tolist(), change[pair == 0].tolist()))
    assert math.isclose(found[4096], -math.log2(3)) and math.isclose(found[4097], math.log2(3)) and len(found) > 4


def test_objective_by_brute_force():
    """Loss by sums over words and pairs, gradient by differences."""
    rng = random.Random(4)
    features = toxicity.Features(6, [("old", "young"), ("muslim", "hindu", "jewish")])
    texts = [" ".join(rng.choices(["old", "muslim", "w1", "w2", "wider", "mustang", "hint"], k=rng.randrange(7))) for _ in range(40)]
    labels = [rng.randrange(2) for _ in texts]
    s = sample_of(texts, labels, features)
    loss = toxicity.objective(s, 0.01, 0.7, features.size)
    x = np.random.default_rng(1).normal(size=features.size + 1)

    def logit(raw):
        _, ids, values = features.of_texts([raw])
        return sum(x[i] * v for i, v in zip(ids, values)) + x[-1]

    z = [logit(t.encode()) for t in texts]
    raw = [t.encode() for t in texts]
    pairs = features.pairs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = sum(math.log1p(math.exp(v)) - y * v for v, y in zip(z, labels)) / len(z) + 0.005 * float(x[:-1] @ x[:-1]) + 0.7 * sum((logit(b) - logit(a)) ** 2 for _, a, b in pairs) / len(pairs)
    value, grad = loss(x)
    assert math.isclose(value, want, rel_tol=1e-9)
    for k in range(len(x)):
        e = np.zeros(len(x))
        e[k] = 1e-5
        assert abs((loss(x + e)[0] - loss(x - e)[0]) / 2e-5 - grad[k]) < 1e-6


def test_the_query_is_fitted_to_pairs(spark):
    """On the query's own tables: two pairs a text, the penalty changes the fit, and a neutral mention leaves the score where it was."""
    docs, labels = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    models = {f: toxicity.fit_on_labels(docs, labels, fairness=f) for f in (0.0, 1.0)}
    learned = docs.join(labels, "doc_id").where("text is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0").select("text").collect()
    n = len(learned)
    assert n <= models[1.0].pairs <= 2 * n
    assert np.abs(models[0.0].weights - models[1.0].weights).max() > 1e-3
    shift = {}
    for f, m in models.items():
        plain = [r.text.encode() for r in learned[:200]]
        logits = lambda raw: m.logits(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))  # noqa: B023, E731
        shift[f] = max(float(np.abs(logits([t + b" " + term for t in plain]) - logits(plain)).mean()) for term in m.features.terms)
    assert shift[1.0] < 0.1 * shift[0.0]


def test_toxicity_bound_and_repeated_ids(spark):
    """More labelled ids than the bound, ids labelled twice, ids with two texts: always the same model."""
    rows = [(k, f"w{k % 7} x{k % 3}") for k in range(300)]
    docs = spark.createDataFrame([*rows, *[(k, "zz other") for k in range(50)]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(k, 0) for k in range(100)], "doc_id long, toxic int")
    got = [toxicity.fit_on_labels(docs.repartition(p), labels.repartition(p), most_rows=40, bits=8) for p in (1, 5)]
    assert (np.abs(got[0].weights - got[1].weights) < 1e-9).all() and got[0].pairs == got[1].pairs == 80


def test_ordinal_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    z = x @ np.array([2, -1, 0.5, 0, 0, 0]) + rng.logistic(size=3000)
    grades = np.digitize(z, [-1.0, 0.5, 2.0])
    m = ordinal.fit_ordinal(x, grades, 4)
    assert np.abs(m.thresholds - [-1.0, 0.5, 2.0]).max() < 0.25 and (np.diff(m.thresholds) > 0).all()
    tails = m.tails(x.astype(float) @ m.weights)
    assert (np.diff(tails, axis=1) <= 0).all() and abs(tails.sum(axis=1).mean() - grades.mean()) < 0.05
    assert np.allclose(ordinal.fit_ordinal(np.zeros((0, 3), np.float32), np.zeros(0, int), 3).tails(np.zeros(1)), [[2 / 3, 1 / 3]])


def test_ordinal_on_rows_not_learned_from(spark):
    docs, labels = spark.read.parquet(f"{SF2}/documents.parquet"), spark.read.parquet(f"{SF2}/labels.parquet")
    train = labels.where("crc32(cast(doc_id as string)) % 4 <> 0").select("doc_id", ordinal.graded().alias("grade"))
    rows = ordinal.ordinal_quality(docs, train).join(labels.where("crc32(cast(doc_id as string)) % 4 = 0"), "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.kept == bool(r.quality) for r in rows]) > 0.95
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_ordinal_odd_rows(spark, odd_docs, no_docs, labels):
    ratings = labels.select("doc_id", ordinal.graded().alias("grade"))
    assert ordinal.ordinal_quality(odd_docs, ratings).where("score is not null").count() == odd_docs.count()
    assert ordinal.ordinal_quality(odd_docs, ratings.limit(0)).where("kept").count() == odd_docs.count()
    kept = ordinal.keep_quality(odd_docs, ratings)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()
    assert ordinal.ordinal_quality(no_docs, ratings).count() == 0 and ordinal.keep_quality(no_docs, ratings).count() == 0


# ---------------------------------------------------------------- mixing


def test_mixing_equals_its_sql(spark):
    for sf in (SF, SF2):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = Counter(con.execute(f"SELECT doc_id, source, n_tokens, copies FROM ({queries.OP8_SQL})").fetchall())
        assert Counter(map(tuple, queries.op8_mixing(spark, sf).collect())) == want


def test_mixing_meets_its_targets(spark):
    rng = random.Random(0)
    rows = [(k, "big" if k % 10 < 6 else "mid" if k % 10 < 9 else None, " ".join("x" * rng.randrange(1, 40))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size = {k: len(WORD.findall(t)) for k, _, t in rows}
    total = Counter()
    for k, s, t in rows:
        total[s] += size[k]
    for options in ({"repetition_limit": 3.0}, {"repetition_limit": None, "target_entropy": 1.0}, {"repetition_limit": 1.0}):
        got = mixing.mixed_sources(docs, **options).collect()
        read = Counter()
        for r in got:
            assert r.copies >= 1
            read[r.source] += r.copies * size[r.doc_id]
        share = {s: n / sum(read.values()) for s, n in read.items()}
        if "target_entropy" in options:
            assert abs(-sum(p * math.log(p) for p in share.values()) - 1.0) < 0.01
        else:
            assert max(read[s] / total[s] for s in read) == pytest.approx(options["repetition_limit"], rel=0.02)
        mixed = Counter(r.doc_id for r in mixing.mix_documents(docs, **options).collect())
        assert mixed == Counter({r.doc_id: r.copies for r in got})


def test_mixing_blocks_do_not_matter(spark):
    docs = spark.createDataFrame([(k, "a" if k % 3 else "b", "x " * (k % 7)) for k in range(2000)], "doc_id long, source string, text string")
    rows = mixing.sized(docs)
    cuts = [sorted(map(str, mixing.mixture(rows, 1.7, None, block_docs=b).cutoffs.drop("cutoff").collect())) for b in (4, 100_000)]
    assert cuts[0] == cuts[1]
    inside = [{r.doc_id for b in [n] for r in rows.join(mixing.mixture(rows, 1.7, None, block_docs=b).cutoffs, "source").where("order_key < cutoff").collect()} for n in (4, 100_000)]
    assert inside[0] == inside[1]


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mixed_sources(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.copies >= 1 for r in got)
    mixed = mixing.mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mixed_sources(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0
    blank = odd_docs.withColumn("text", F.lit(None).cast("string"))
    assert {r.copies for r in mixing.mixed_sources(blank).collect()} == {1}


# ---------------------------------------------------------------- scoring


def katz_by_hand(texts, fold=7, out=2, order=2):
    """doc: (held, tokens, known, base, score) by plain dictionaries and recursion."""
    words = {k: WORD.findall((t or "").translate(LOWER)) + ["</s>"] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % fold == out for k in texts}
    uni, after = Counter(), {n: defaultdict(Counter) for n in range(2, order + 1)}
    for k, w in words.items():
        if not held[k]:
            uni.update(w)
            line = ["<s>", *w]
            for n in after:
                for i in range(n, len(line) + 1):
                    after[n][tuple(line[i - n : i - 1])][line[i - 1]] += 1
    n_of = lambda counts: np.array([0] + [sum(c == r for c in counts) for r in range(1, katz.K + 2)])
    u = katz.Unigrams(sum(uni.values()), len(uni), n_of(list(uni.values())))
    d = {n: katz.discounts(n_of([c for h in after[n].values() for c in h.values()])) for n in after}
    terms = {}

    def p(h, w):
        if not h:
            return float(u.probability(np.array([uni[w]]))[0])
        n = len(h) + 1
        if h not in after[n]:
            return p(h[1:], w)
        if (h, n) not in terms:
            counts = after[n][h]
            c = sum(counts.values())
            left = sum(r * (1 - d[n][r]) for r in counts.values() if r <= katz.K)
            whole, left = (c, left) if left > 0 else (c + 1, 1.0)
            terms[h, n] = whole, left / whole / (1 - sum(p(h[1:], x) for x in counts))
        c, (whole, weight) = after[n][h][w], terms[h, n]
        return (d[n][c] if c <= katz.K else 1.0) * c / whole if c else weight * p(h[1:], w)

    for n in after:
        for h in [*list(after[n])[:12], ("never met",) * (n - 1)]:
            assert sum(p(h, w) for w in uni) + p(h, "never met either") == pytest.approx(1)
    total, distinct = sum(uni.values()), len(uni)
    score = lambda w: sum(math.log10(p(tuple(["<s>", *w][max(0, i + 1 - (order - 1)) : i + 1]), w[i])) for i in range(len(w)))
    return {k: (held[k], len(w), sum(uni[x] > 0 for x in w), total, sum(math.log10((uni[x] + 1) / (total + distinct + 1)) for x in w), score(w)) for k, w in words.items()}


def compare_scores(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9, abs=1e-9) and r.score == pytest.approx(want[r.doc_id][5], rel=1e-9, abs=1e-9)


def test_op10(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    compare_scores(queries.op10_katz(spark, SF).collect(), katz_by_hand(texts))


def test_katz_with_hot_histories(spark):
    """Good-Turing factors in use, one word a third of all, many small blocks."""
    rng = random.Random(8)
    zipf = [f"W{int(1 / (rng.random() ** 1.3 + 1e-4)) if rng.random() > 0.33 else 0}" for _ in range(30_000)]
    texts = {k: " ".join(zipf[k * 50 : k * 50 + 50]) for k in range(600)}
    texts[601], texts[602] = "", None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for order in (2, 1, 3, 4):
        compare_scores(katz.katz_scores(docs, block_bytes=20_000, order=order).collect(), katz_by_hand(texts, order=order))


def test_counts_above_32_bits():
    """A word that the corpus has five thousand million times: questions, answers and terms keep its count."""
    text = b"a b a c b a"
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    words = textkit.Words(data, off)
    tokens = np.append(textkit.Hasher(data).spans(words.starts, words.ends), katz.END)
    block = katz.Block(katz.Block.packed([1], [0], [np.array([7])], [tokens]))
    many = 5_000_000_000
    counts = np.full(len(block.words), many)
    unigrams = katz.Unigrams(4 * many, 4, np.array([0, 1, 1, 1, 1, 1, 1]))
    level = katz.word_level(block, counts, unigrams)
    grams = katz.Grams(block, level, unigrams.total, 1)
    asked = [packing.unpack(x) for _, x in grams.questions(block, level)]
    assert (asked[0][5] == many).all()
    for q in asked:
        q[4] = q[4] * many
    (reply,), stats = katz.answer_grams(unigrams.probability)(asked)
    assert set(packing.unpack(reply)[0].tolist()) == {many, 2 * many} and stats[1:].sum() == 0
    (reply,), stats = katz.answer_words([[block.words, counts]])
    assert (packing.unpack(reply)[0] == many).all() and stats[0] == 4 * many
    assert unigrams.probability(np.array([many]))[0] == pytest.approx(0.25, rel=1e-6)


def test_discounts():
    assert katz.discounts(np.array([0, 500, 200, 110, 70, 50, 38]))[1] < 1
    assert katz.discounts(np.zeros(7))[1] == 0.5


def test_katz_odd_rows(spark, odd_docs, no_docs):
    got = katz.katz_scores(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert next(r for r in got if r.doc_id == 1).n_tokens == 1
    assert katz.katz_scores(no_docs).count() == 0


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark):
    """Each stage's decisions, from what the one before it kept."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline as P
    from tests_helpers import classes, covered

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.quality(spark, docs, SF)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(k in ids) == bool(q) for k, q in truth.items()]) > 0.97 and kept.columns == docs.columns

    single = P.near_duplicates(spark, kept, SF)
    groups = classes({r.doc_id: r.text for r in kept.collect()}, Fraction(80, 100), 5)
    assert {r.doc_id for r in single.collect()} == {k for k, (n, c) in groups.items() if k == c}

    cut = P.repeated_passages(spark, single, SF)
    before, after = {r.doc_id: r.text for r in single.collect()}, {r.doc_id: r.text for r in cut.collect()}
    low = {k: v[1] for k, v in covered(before).items()}
    for k, t in before.items():
        words = [w for i, w in enumerate(WORD.findall(t)) if i not in low.get(k, ())]
        assert WORD.findall(after.get(k, "")) == words and (low.get(k) or after[k] == t)

    mixed = P.mixture(spark, cut, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == set(after)

    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((r.doc_id, len(library.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in P.run(spark, SF).collect()) == want


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, labels, tmp_path):
    """Nulls, empty and long texts, repeated ids and clashing columns pass through every stage; so do tables without rows."""
    import corpus_pipeline as P

    for name, docs, marks in (("odd", odd_docs, labels), ("empty", no_docs, labels), ("unlabelled", odd_docs, labels.limit(0))):
        sf = f"{tmp_path}/{name}"
        docs.write.parquet(f"{sf}/documents.parquet")
        marks.write.parquet(f"{sf}/labels.parquet")
        kept = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in P.STAGES[:-1]:
            after = stage(spark, kept, sf)
            assert after.columns == docs.columns
            kept = after
        got, want = P.run(spark, sf).collect(), kept.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
        assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((r.doc_id, hashlib.sha256(r.t.encode()).hexdigest()) for r in want)
        assert (name == "empty") == (not got)
        if name == "unlabelled":  # every row passes the classifier; of the copies one stays
            assert {r.doc_id for r in got} == {1, 2, 3, 4, None, 5, 7, 8, 10}
