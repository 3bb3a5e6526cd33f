import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from tallyloom.llm import alignment
from tallyloom.llm.transducer import byte_characters

A_PATH, B_PATH = (Path(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
A_JSON, B_MODEL = A_PATH.read_text("utf-8"), B_PATH.read_bytes()


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(str(A_PATH))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=str(B_PATH))
    of = byte_characters()
    a_bytes = {k: bytes(of[c] for c in t) for t, k in a.get_vocab().items() if t != "<|endoftext|>"}

    def b_bytes(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    return a, b, a_bytes, b_bytes


def groups_of(text, libraries):
    """(A ids, B ids, groups), token by token over the whole text; None without tokens."""
    a, b, a_bytes, b_bytes = libraries
    if not text:
        return None
    whole = (" " + text).encode()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(a_bytes[k] for k in x) != whole or b"".join(map(b_bytes, y)) != whole:
        return None
    ends_x, ends_y = np.cumsum([len(a_bytes[k]) for k in x]).tolist(), np.cumsum([len(b_bytes(k)) for k in y]).tolist()
    out, i, j = [], 0, 0
    for e in sorted(set(ends_x) & set(ends_y)):
        m, n = ends_x.index(e, i) + 1, ends_y.index(e, j) + 1
        out.append((x[i:m], y[j:n]))
        i, j = m, n
    return x, y, out


def brute(texts, libraries):
    """Rows of each text, in order."""
    all_groups = [groups_of(t, libraries) for t in texts]
    docs, top = Counter(), Counter()
    for g in all_groups:
        if g:
            docs.update({(p, q) for ga, gb in g[2] for p in ga for q in gb})
    for (p, _), n in docs.items():
        top[p] = max(top[p], n)
    for g in all_groups:
        if not g:
            yield 0, 0, 0, 0, 0, 0, ""
            continue
        links = [(p, q) for ga, gb in g[2] for p in ga for q in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g[2])
        yield len(g[0]), len(g[1]), len(g[2]), len(links), sum(docs[x] == top[x[0]] for x in links), sum(docs[x] for x in links), hashlib.sha256(shown.encode()).hexdigest()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(held, brute([r.text for r in held], libraries))), key=repr)
    for block_bytes in (8 << 20, 20_000):
        assert rows(alignment.aligned(docs.repartition(5), A_JSON, B_MODEL, block_bytes=block_bytes)) == want


def test_odd_texts(spark, libraries, odd_docs, no_docs):
    held = odd_docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(held, brute([r.text for r in held], libraries))), key=repr)
    assert rows(alignment.aligned(odd_docs, A_JSON, B_MODEL)) == want
    assert alignment.aligned(no_docs, A_JSON, B_MODEL).count() == 0


def test_units_and_groups(spark, libraries):
    texts = [
        "<|endoftext|> <s> </s><unk>", "a▁b", "x \t\n  y", "  two  spaces   end  ", " \n", "don't  'll x 　y \x85 z", "\U0001f600\U0001f600 naïve Straße 一二三四", "=" * 3001,
        "ab" * 700 + "一" * 300, "\x1c \x1d a", "\x00 \x00", "tab\tend \r\n", "the the the", "The the",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(alignment.aligned(docs, A_JSON, B_MODEL))
    want = sorted(((k, *w) for k, w in enumerate(brute(texts, libraries))), key=repr)
    assert got == want
    assert next(r for r in got if r[0] == 1)[1:] == (0, 0, 0, 0, 0, 0, "")


def test_a_frequent_word_is_sent_once_a_block(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('the same words ', 20) AS text").repartition(4)
    cut = alignment.blocks_of(docs, A_JSON, B_MODEL, 8 << 20).cache()
    assert cut.where(f"kind = {alignment.GROUPS}").count() <= 4 * 8
    assert cut.where(f"kind = {alignment.PAIRS}").groupBy("a_id", "b_id").agg({"docs": "sum"}).where("`sum(docs)` = 3000").count() >= 3
