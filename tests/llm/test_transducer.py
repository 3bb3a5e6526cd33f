import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm.transducer import PRE_TOKEN, SLICE, Encoder, Merges, TextMachine, kept_encoder, read_merges, slices, streamed

PATH = Path(public_tokenizers.path("byte_bpe_50k.json"))
RAW = PATH.read_text("utf-8")
BITS = [" ", "  ", "\n", "\t", "a", "the", "'", "'re", "'s", "'ll", "1", "22", "!", "<|endoftext|>", "<|end", "of", "text|>", "ä", "€", "\U0001f600", "　", "\x85", "\x1c", "一二", "====", "re", "l", "v", "e"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(PATH))
    t.no_truncation()
    t.no_padding()
    return t


def passed(text, size):
    """(ids, decoded text, most that was held back)"""
    encoder, machine, ids, shown, held = kept_encoder(RAW), TextMachine(), [], [], 0
    tokens = encoder.merges.tokens
    for part in slices(text.encode(), size):
        some = encoder.feed(part)
        ids += some
        shown.append(machine.feed(b"".join(map(tokens.__getitem__, some))))
        held = max(held, encoder.held)
    some = encoder.finish()
    shown.append(machine.feed(b"".join(map(tokens.__getitem__, some))))
    return [*ids, *some], "".join(shown) + machine.finish(), held


def test_library_in_slices_of_any_size(library):
    rng = random.Random(3)
    for n in range(1500):
        text = "".join(rng.choices(BITS, k=rng.randint(0, 40)))
        ids, shown, _ = passed(text, rng.choice([1, 2, 3, 5, 8, 1000]))
        want = library.encode(text, add_special_tokens=False).ids
        assert (ids, shown) == (want, library.decode(want, skip_special_tokens=False)), repr(text)


@settings(max_examples=200, deadline=None)
@given(st.text(), st.integers(1, 20))
def test_any_text(text, size):
    from tokenizers import Tokenizer

    lib = test_any_text.lib = getattr(test_any_text, "lib", None) or Tokenizer.from_file(str(PATH))
    text = text.encode("utf-8", "replace").decode()
    want = lib.encode(text, add_special_tokens=False).ids
    assert passed(text, size)[:2] == (want, text)


@pytest.mark.parametrize("kind", ["letters", "one", "spaces", "signs", "lines", "tokens"])
def test_long_pre_tokens_in_constant_memory(library, kind):
    rng, merges = random.Random(5), kept_encoder(RAW).merges
    text = {
        "letters": "".join(rng.choices("etaoinshr", k=150_000)), "one": "a" * 100_001, "spaces": " " * 100_001 + "x", "signs": "." * 60_000 + "'re" + "-" * 9000, "lines": "\n" * 50_000 + "x" + "\t " * 6000,
        "tokens": "".join(c for k in rng.choices(range(50_000), k=40_000) for c in merges.tokens[k].decode("utf-8", "ignore") if c.isalpha()),
    }[kind]
    ids, shown, held = passed(text, SLICE)
    assert ids == library.encode(text, add_special_tokens=False).ids and shown == text
    assert held < 2 * (merges.lookahead + 1024)


def small(rules):
    """A vocabulary of the bytes and what these merges make."""
    vocabulary = {bytes([b]): b for b in range(256)}
    for a, b in rules:
        vocabulary.setdefault(a + b, len(vocabulary))
    return Merges(vocabulary, rules)


def test_lookahead_is_enough_and_needed():
    chain = small([(b"d", b"e"), (b"c", b"d"), (b"b", b"c"), (b"a", b"b")])
    assert chain.lookahead == 4  # an e decides whether the a four bytes before it is joined: abcd is ab, cd; abcde is a, bc, de
    assert [len(chain.tokens[x]) for x in chain.encode(b"abcd")] == [2, 2]
    assert [len(chain.tokens[x]) for x in chain.encode(b"abcde")] == [1, 2, 2]
    with pytest.raises(ValueError):
        Merges({bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}, [(b"ab", b"c"), (b"a", b"b")])


def test_lookahead_on_random_merge_lists():
    rng = random.Random(8)
    for _ in range(60):
        parts, rules = [b"a", b"b", b"c"], []
        for _ in range(rng.randint(2, 12)):
            a, b = rng.choice(parts), rng.choice(parts)
            if a + b not in parts and len(a + b) < 7:
                rules.append((a, b))
                parts.append(a + b)
        m = small(rules)
        for _ in range(40):
            text = bytes(rng.choices(b"abc", k=40))
            known = rng.randint(m.lookahead, 40)
            size = lambda ids: [len(m.tokens[x]) for x in ids]
            whole, used = m.encode(text), 0
            for x, y in zip(m.encode(text[:known]), whole):
                used += len(m.tokens[x])
                if used > known - m.lookahead:
                    break
                assert x == y, (rules, text, known, size(whole))


def test_long_words_as_short_ones():
    m, rng = kept_encoder(RAW).merges, random.Random(2)
    for _ in range(200):
        word = "".join(rng.choices("etaoinshr ", k=60)).encode()
        assert m.encode(word) == m._encode_long(list(map(m.bytes.__getitem__, word)))


def test_characters_from_any_bytes(library):
    rng = random.Random(4)
    merges = kept_encoder(RAW).merges
    for _ in range(500):
        ids = rng.choices(range(50257), k=rng.randint(0, 12)) + rng.choices(range(188, 256), k=rng.randint(0, 6))
        rng.shuffle(ids)
        data = b"".join(map(merges.tokens.__getitem__, ids))
        for step in (1, 2, 7):
            machine = TextMachine()
            shown = "".join(machine.feed(data[k : k + step]) for k in range(0, len(data), step))
            assert len(machine.begun) <= 3
            assert shown + machine.finish() == data.decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_other_files_are_refused():
    for other in ("word_bpe_49k.json",):
        with pytest.raises((ValueError, KeyError)):
            read_merges(Path(public_tokenizers.path(other)).read_text("utf-8"))
    assert PRE_TOKEN == public_tokenizers.PATTERN


def test_rows(spark, library, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    special = spark.createDataFrame([(900_001, "a<|endoftext|> b<|endoftext|><|endof"), (900_002, "<|endoftext|>")], "doc_id long, text string")
    docs = docs.union(special)

    def row(r):
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        return r.doc_id, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()

    assert sorted(map(repr, map(tuple, streamed(docs, RAW).collect()))) == sorted(repr(row(r)) for r in docs.collect())
    plain = {r.doc_id: r for r in streamed(special, RAW, digest=False).collect()}
    assert plain[900_002].ids == [50256] and plain[900_001].decoded == "a<|endoftext|> b<|endoftext|><|endof"
    assert streamed(no_docs, RAW).count() == 0
    assert streamed(odd_docs, RAW).count() == odd_docs.count()


def test_encoders_leave_nothing_behind():
    e = Encoder(read_merges(RAW))
    e.feed("unfinished   " + "x" * 9000)
    e.finish()
    assert e.held == 0 and e.finish().tolist() == []
