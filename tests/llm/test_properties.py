"""Properties on generated inputs."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_helpers import WORD

from tallyloom.llm import packing, quality_stats, textkit, tiff
from tallyloom.llm.longest_match import PieceCounter
from tallyloom.llm.suffix_array import ANCHOR, MIN_WORDS, WINDOW, select_words, window_least

SOME_TEXT = st.text(alphabet="ab#|.É \t\n\x0b\x0c\r\x1c ", max_size=60)


@given(st.binary(max_size=3000) | st.lists(st.tuples(st.integers(0, 3), st.integers(1, 300)), max_size=12).map(lambda r: b"".join(bytes((c,)) * n for c, n in r)))
@settings(max_examples=150, deadline=None)
def test_codecs(raw):
    assert tiff.packbits_decode(tiff.packbits_encode(raw), len(raw)) == raw
    assert tiff.lzw_decode(tiff.lzw_encode(raw), len(raw)) == raw


@given(st.lists(st.binary(max_size=40), max_size=20))
@settings(max_examples=100, deadline=None)
def test_strings(items):
    assert packing.unpack_strings(packing.pack_strings(items)) == items


@given(st.lists(SOME_TEXT | st.none(), max_size=8), st.integers(1, 80))
@settings(max_examples=200, deadline=None)
def test_words_and_counts(texts, limit):
    for lo, hi, data, off in textkit.text_chunks(pa.array(texts, pa.string()), limit):
        words = textkit.Words(data, off)
        counts = quality_stats.text_counts(data, off)
        for k in range(lo, hi):
            found = WORD.findall(texts[k] or "")
            span = slice(words.first[k - lo], words.first[k - lo + 1])
            assert [bytes(data[a:b]).decode() for a, b in zip(words.starts[span], words.ends[span])] == found
            lines = [s for s in (texts[k] or "").split("\n") if WORD.search(s)]
            assert (counts["n_words"][k - lo], counts["n_dup_lines"][k - lo], counts["n_distinct_words"][k - lo]) == (len(found), len(lines) - len(set(lines)), len(set(found)))


@given(st.lists(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=8), st.binary(max_size=10).map(lambda b: bytes(97 + x % 4 for x in b)))
@settings(max_examples=300, deadline=None)
def test_greedy_cut(pieces, word):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            n = 1
            break
        at, n = end, n + 1
    assert PieceCounter(pieces).count(word) == n


@given(st.lists(st.integers(0, 5), min_size=1, max_size=400), st.integers(0, 1000))
@settings(max_examples=100, deadline=None)
def test_every_window_selects_its_least_gram(numbers, seed):
    words = textkit.mix(np.array(numbers, np.uint64) + np.uint64(seed))
    owner = np.zeros(len(words), np.int64)
    at, grams = select_words(words, owner)
    chosen = set(at.tolist())
    for start in range(len(words) - MIN_WORDS + 1):
        inside = grams[start : start + WINDOW]
        assert all(start + k in chosen for k in np.flatnonzero(inside == inside.min()))
    assert len(grams) == (len(words) - ANCHOR + 1 if len(words) >= MIN_WORDS else 0)
    w = max(1, len(numbers) // 3)
    v = np.array(numbers, np.uint64)
    assert (window_least(v, w) == [min(numbers[k : k + w]) for k in range(len(numbers) - w + 1)]).all()
