"""TIFF pages, rule votes, longest-match counts."""

import hashlib
import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import longest_match, queries, tiff, weak

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("code", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (64, 64), (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(code, predictor, tile, order):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 50, (75, 97, 3), dtype=np.uint16), rng.integers(0, 9, (130, 64), dtype=np.uint8), np.zeros((1, 1), np.uint8)]
    raw = tiff.write_tiff(pages, [tiff.Layout(code, predictor, tile, 32)], order)
    back = [tiff.read_page(raw, *d) for d in tiff.directories(raw)]
    assert len(back) == 3 and all((b.reshape(p.shape) == p).all() for b, p in zip(back, pages))


def test_codecs():
    rng = np.random.default_rng(1)
    for raw in (b"", b"a", b"aab" * 500, b"\0" * 70_000, rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes(), rng.integers(0, 3, 90_000, dtype=np.uint8).tobytes()):
        assert tiff.packbits_decode(tiff.packbits_encode(raw), len(raw)) == raw
        assert tiff.lzw_decode(tiff.lzw_encode(raw), len(raw)) == raw
    # The example of the PackBits note, and an LZW stream by hand: clear, 7, 258, 8, 8, 258, 6, 6, end.
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    assert tiff.lzw_decode(int(bits.ljust(88, "0"), 2).to_bytes(11, "big"), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_floating_point_predictor():
    rows = np.array([[1.5, -2.25, 3e7, 0.0]], ">f4")
    planes = rows.view(np.uint8).reshape(1, 4, 4).transpose(0, 2, 1).reshape(1, 16)
    coded = np.diff(planes, axis=1, prepend=np.zeros((1, 1), np.uint8)).astype(np.uint8)
    block = np.frombuffer(coded.tobytes(), "<f4").reshape(1, 4, 1)
    assert tiff.undo_predictor(block, 3, "<").ravel().tolist() == rows.ravel().tolist()


@pytest.mark.parametrize("width", [2, 4, 8])
@pytest.mark.parametrize("order", "<>")
def test_differences_of_floats_are_those_of_their_bits(width, order):
    values = np.array([[1.5, 2.5, -3.25, 7.0], [0.0, -0.0, 1e4, 1e-4]], f"{order}f{width}").reshape(2, 4, 1)
    stored = tiff.difference(values.view(f"{order}u{width}")).view(values.dtype)
    assert tiff.undo_predictor(stored, 2, order).tobytes() == values.tobytes()
    with pytest.raises(tiff.BadTiff):
        tiff.undo_predictor(values.view(f"{order}i{width}"), 3, order)


def test_damaged_files(spark):
    good = tiff.write_tiff([np.zeros((4, 4), np.uint8)] * 2)
    files = spark.createDataFrame([("ok", bytearray(good)), ("short", bytearray(good[:-30])), ("none", None), ("text", bytearray(b"hello world"))], "path string, content binary")
    got = Counter((r.path, r.error is None) for r in tiff.tiff_pages(files).collect())
    assert got[("ok", True)] == 2 and got[("none", False)] == 1 and got[("text", False)] == 1 and ("short", False) in got
    assert tiff.tiff_pages(files.limit(0)).count() == 0


def hand_made(tags, body=b"", order="<"):
    """A file of one directory with (tag, type, values or (count, raw value))."""
    at = 8 + len(body)
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + body + struct.pack(order + "H", len(tags))
    for tag, kind, count, value in tags:
        out += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
    return out + struct.pack(order + "I", 0)


def long(n):
    return struct.pack("<I", n)


def test_impossible_pages_give_error_rows():
    """Sizes that no file could hold, tags without or with odd values: a row with an error, little memory."""
    strip = [(tiff.STRIP_OFFSETS, 4, 1, long(8)), (tiff.STRIP_COUNTS, 4, 1, long(16)), (tiff.BITS, 3, 1, long(8))]
    size = lambda w, h: [(tiff.WIDTH, 4, 1, long(w)), (tiff.LENGTH, 4, 1, long(h))]
    bad = [
        size(1 << 20, 1 << 20) + strip, size(1 << 31, 1 << 31) + strip, size(1 << 20, 1 << 20) + strip + [(tiff.COMPRESSION, 3, 1, long(tiff.DEFLATE))], size(0, 4) + strip,
        [(tiff.WIDTH, 4, 0, b""), (tiff.LENGTH, 4, 1, long(4))] + strip, [(tiff.WIDTH, 2, 1, b"x"), (tiff.LENGTH, 4, 1, long(4))] + strip, [(tiff.WIDTH, 11, 1, struct.pack("<f", 4.0)), (tiff.LENGTH, 4, 1, long(4))] + strip,
        size(4, 4) + strip[:2] + [(tiff.BITS, 3, 1, long(7))], size(4, 4) + strip + [(tiff.SAMPLES, 3, 1, long(0))], size(4, 4) + strip + [(tiff.COMPRESSION, 3, 1, long(4))], size(4, 4) + strip + [(tiff.ROWS_PER_STRIP, 4, 1, long(0))],
        size(4, 4) + [(tiff.STRIP_OFFSETS, 9, 1, struct.pack("<i", -4)), *strip[1:]], size(4, 4) + [(tiff.STRIP_OFFSETS, 4, 1, long(1 << 31)), *strip[1:]], size(4, 4) + [(tiff.STRIP_OFFSETS, 4, 1 << 30, long(8)), *strip[1:]],
    ]
    tracemalloc.start()
    for tags in bad:
        rows = list(tiff.page_rows(hand_made(tags, b"\0" * 16)))
        assert len(rows) == 1 and rows[0]["error"] and rows[0].get("pixels") is None
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
    assert [r["error"] for r in tiff.page_rows(hand_made(size(4, 4) + strip, bytes(16)))] == [None]
    bomb = tiff.write_tiff([np.zeros((3000, 3000), np.uint8)])
    assert [bool(r["error"]) for r in tiff.page_rows(bomb, 1 << 20)] == [True] and [r["error"] for r in tiff.page_rows(bomb)] == [None]
    # BitsPerSample of no value means 1 bit.
    assert list(tiff.page_rows(hand_made(size(8, 8) + strip[:2] + [(tiff.BITS, 3, 0, b"")], bytes(16))))[0]["n_columns"] == 8


@pytest.mark.parametrize("order", ["<", ">"])
def test_damaged_bytes_never_raise(order):
    rng = np.random.default_rng(8)
    good = np.frombuffer(tiff.write_tiff([rng.integers(0, 9, (40, 64), dtype=np.uint8)] * 3, tiff.LAYOUTS, order), np.uint8)
    for k in range(1500):
        raw = good.copy()
        at = rng.integers(0, len(raw), rng.integers(1, 6)) if k % 2 else len(raw) - 1 - rng.integers(0, 200, 4)
        raw[at] = rng.integers(0, 256, len(at))
        rows = list(tiff.page_rows(raw[: rng.integers(1, len(raw)) if k % 7 == 0 else None].tobytes()))
        assert all((r["error"] is None) == (r.get("pixels") is not None) for r in rows)


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("code", [tiff.NONE, tiff.PACKBITS])
def test_small_samples(bits, code):
    rng = np.random.default_rng(bits)
    page = rng.integers(0, 1 << bits, (5, 13), dtype=np.uint8)
    packed = b"".join(int("".join(f"{v:0{bits}b}" for v in row).ljust(-(-13 * bits // 8) * 8, "0"), 2).to_bytes(-(-13 * bits // 8), "big") for row in page)
    body = tiff.compress(packed, code)
    tags = [(tiff.WIDTH, 4, 1, long(13)), (tiff.LENGTH, 4, 1, long(5)), (tiff.BITS, 3, 1, long(bits)), (tiff.COMPRESSION, 3, 1, long(code)), (tiff.STRIP_OFFSETS, 4, 1, long(8)), (tiff.STRIP_COUNTS, 4, 1, long(len(body)))]
    row = list(tiff.page_rows(hand_made(tags, body)))[0]
    assert row["error"] is None and row["pixels"] == page.tobytes()


def test_payloads_meet_every_layout():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 10, 100, 13_000):
        payload = rng.integers(97, 105, 64 * n, dtype=np.uint8).tobytes()
        rows = list(tiff.page_rows(tiff.store_payload(payload)))
        assert b"".join(r["pixels"] for r in rows) == payload
        assert n < 3 or {(r["compression"], r["predictor"], r["tiled"]) for r in rows} == {(tiff.PACKBITS, 1, False), (tiff.LZW, 2, False), (tiff.DEFLATE, 2, True)}
        for layout in (tiff.Layout(c, p, t) for c in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE) for p in (1, 2) for t in (None, (16, 16))):
            if n <= 100:
                assert b"".join(r["pixels"] for r in tiff.page_rows(tiff.store_payload(payload, [layout]))) == payload


def test_op1(spark, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, set()).add((r.text or "").encode())
        for r in tiff.document_media(docs).collect():
            found = False
            for raw in texts[r.doc_id]:
                payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
                media = tiff.store_payload(payload)
                found |= (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
            assert found
    assert tiff.document_media(no_docs).count() == 0


def base(t):
    words = WORD.findall(t or "")
    lines = [s for s in (t or "").split("\n") if WORD.search(s)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_op3(spark, odd_docs, no_docs):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_weak_supervision(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        n, chars, symbols, lines, repeated = base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and not (r.kept and r.base_failed)
    got = weak.weak_quality(odd_docs).collect()
    assert len(got) == odd_docs.count()
    want = sorted(base(r.text) for r in odd_docs.collect())
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert weak.weak_quality(no_docs).count() == 0


def test_posterior_by_brute_force(spark):
    """EM row by row in plain Python, from the votes, gives every row's posterior."""
    rows = weak.weak_quality(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    votes = [[r[f"vote_{x.name}"] for x in weak.RULES] for r in rows]
    prior, right = 0.5, [0.85] * len(weak.RULES)

    def good(v):
        odds = math.log(prior / (1 - prior)) + sum(math.log(a / (1 - a)) * {weak.GOOD: 1, weak.BAD: -1, weak.ABSTAIN: 0}[x] for a, x in zip(right, v))
        return 1 / (1 + math.exp(-odds))

    for _ in range(200):
        p = [good(v) for v in votes]
        old = prior, right
        hits = [sum(q if v[k] == weak.GOOD else 1 - q for q, v in zip(p, votes) if v[k] != weak.ABSTAIN) for k in range(len(right))]
        seen = [sum(v[k] != weak.ABSTAIN for v in votes) for k in range(len(right))]
        prior = min(0.95, max(0.05, (sum(p) + 5) / (len(p) + 10)))
        right = [min(0.99, max(0.55, (h + 8.5) / (n + 10))) for h, n in zip(hits, seen)]
        if max(abs(prior - old[0]), *(abs(a - b) for a, b in zip(right, old[1]))) < 1e-9:
            break
    for r, v in zip(rows, votes):
        assert r.quality == pytest.approx(good(v), abs=1e-6) and r.kept == (r.quality >= 0.5)
        shown = {x.name: v[k] for k, x in enumerate(weak.RULES)}
        assert (shown["length"] == weak.BAD) == (r.n_words < 50) and (shown["exclamation"] == weak.BAD) == (r.n_letters >= 0 and r.n_bangs * 10 > r.n_words)
    assert len({tuple(v) for v in votes}) > 5


def test_em_finds_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    accuracy = np.array([0.9, 0.8, 0.7, 0.95])
    right = rng.random((20_000, 4)) < accuracy
    votes = np.where(right == truth[:, None], weak.GOOD, weak.BAD)
    votes[rng.random(votes.shape) < 0.3] = weak.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = weak.fit_votes(patterns, counts)
    assert abs(m.prior - 0.8) < 0.03 and np.abs(m.accuracy - accuracy).max() < 0.04
    none = weak.fit_votes(np.zeros((0, 4), int), np.zeros(0, int))
    assert none.prior == 0.5


def test_labelled_quality(spark):
    rows = queries.op3_weak_supervision(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "truth"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == bool(r.truth) for r in rows]) > 0.97


def greedy(vocabulary, word):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_piece_counter():
    rng = random.Random(4)
    for _ in range(400):
        pieces = [bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 8))]
        counter = longest_match.PieceCounter(pieces)
        for _ in range(20):
            w = bytes(rng.choices(b"abcd", k=rng.randint(0, 9)))
            assert counter.count(w) == greedy(set(pieces), w)


def test_op6(spark, odd_docs, no_docs):
    import public_tokenizers

    pieces = longest_match.rank_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    vocabulary = set(pieces)
    for r in queries.op6_longest_match(spark, SF).collect():
        words = WORD.findall(text[r.doc_id])
        assert (r.n_words, r.n_pieces) == (len(words), sum(greedy(vocabulary, b" " + w.encode()) for w in words))
    want = sorted((len(w), sum(greedy(vocabulary, b" " + x.encode()) for x in w)) for w in (WORD.findall(r.text or "") for r in odd_docs.collect()))
    assert sorted((r.n_words, r.n_pieces) for r in longest_match.piece_counts(odd_docs, pieces, cache_words=10).collect()) == want
    assert longest_match.piece_counts(no_docs, pieces).count() == 0
