"""Byte-level BPE as a streaming transducer with bounded lookahead.

A text comes in slices. Special tokens are taken out first, then the rest is cut
into pre-tokens, then bytes are merged; each of the three steps holds back only what
bytes to come could still change, so memory does not follow the text, nor its longest
pre-token. For the merges that is a fixed number of bytes, the lookahead, which is
computed from the merge list.

Why it is enough: merge in the order of the list, all places of one rule at a time,
once with and once without the bytes to come. At first both agree up to the end of
the known bytes. They go on agreeing up to a frontier that moves only if a rule u + v
joins the last token before it, u, to one that begins at it in one of the two and not
in the other. That v begins with what stood at the frontier: with the u of the rule that
moved it before, which comes earlier in the list. So moves are chains of rules in
ascending order in which each v has the u before it at its left edge, and the longest
sum of their u's is as far as the frontier ever gets. Tokens before it are stable, and
since no merge crosses its place, what follows is encoded without them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textkit import buffers
from tallyloom.session import ship_package

#: How byte-level BPE cuts text into pre-tokens, unless a file says otherwise.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNDECIDED = 2  # characters that a cut may still depend on: those after the apostrophe of 're, 've and 'll
RUNS = [regex.compile(x) for x in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*")]
SPACES = regex.compile(r"\s*")

SLICE = 1 << 16  # bytes of text read at a time
OPEN = 1 << 12  # characters of an unfinished pre-token from which on it is handed on in parts
STEP = 1 << 10  # bytes beyond the lookahead that are merged at a time
KEPT_WORD, KEPT_WORDS = 64, 1 << 18


def byte_characters() -> dict[str, int]:
    """Which character stands for which byte in a byte-level vocabulary: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Merges:
    """A vocabulary and its merge list.

    tokens: bytes by id; rank: place in the list by pair of ids (first << 32 | second); made: the id that a rule makes;
    special: ids of texts that are one token wherever they stand; lookahead: bytes before the end of what is known within which tokens may still change.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.tokens = {k: t for t, k in vocabulary.items()} | {k: t.encode() for t, k in (special or {}).items()}
        self.special = special or {}
        self.bytes = [vocabulary[bytes([b])] for b in range(256)]
        self.rank, self.made = {}, []
        for a, b in merges:
            self.rank.setdefault(vocabulary[a] << 32 | vocabulary[b], len(self.made))
            self.made.append(vocabulary[a + b])
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        known = set(self.bytes)
        left_parts: dict[int, set[int]] = {}
        reach: dict[int, int] = {}  # by u: the longest sum of u's of a chain so far that ends with a rule of this u
        for pair, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            u, v, whole = pair >> 32, pair & 0xFFFFFFFF, self.made[rank]
            if not {u, v} <= known:
                raise ValueError("a merge comes before the merges that make its parts")
            known.add(whole)
            seen, open_ = {v}, [v]
            while open_:
                for x in left_parts.get(open_.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        open_.append(x)
            before = max(reach.get(x, 0) for x in seen)
            reach[u] = max(reach.get(u, 0), len(self.tokens[u]) + before)
            left_parts.setdefault(whole, set()).add(u)
        return max(reach.values(), default=0)

    def encode(self, word: bytes) -> list[int]:
        """The pair with the least rank, the first of equal ones, is merged as long as there is one."""
        ids = list(map(self.bytes.__getitem__, word))
        if len(ids) > KEPT_WORD:
            return self._encode_long(ids)
        rank, made, never = self.rank.get, self.made, len(self.made)
        pairs = [rank(a << 32 | b, never) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == never:
                break
            k = pairs.index(best)
            ids[k] = made[best]
            del ids[k + 1], pairs[k]
            if k:
                pairs[k - 1] = rank(ids[k - 1] << 32 | ids[k], never)
            if k < len(pairs):
                pairs[k] = rank(ids[k] << 32 | ids[k + 1], never)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """As encode(), with the pairs in a heap; outdated ones are passed over."""
        n, rank = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            r, k, a, b = heapq.heappop(waiting)
            m = after[k] if ids[k] == a else n
            if m >= n or ids[m] != b:
                continue
            ids[k], ids[m] = self.made[r], -1
            after[k] = after[m]
            if after[k] < n:
                before[after[k]] = k
                if (s := rank(ids[k] << 32 | ids[after[k]])) is not None:
                    heapq.heappush(waiting, (s, k, ids[k], ids[after[k]]))
            p = before[k]
            if p >= 0 and (s := rank(ids[p] << 32 | ids[k])) is not None:
                heapq.heappush(waiting, (s, p, ids[p], ids[k]))
        return [x for x in ids if x >= 0]


def read_merges(raw: str) -> Merges:
    """The vocabulary of a tokenizer file in JSON; settings that this transducer does not have are an error."""
    d = json.loads(raw)
    model, cut = d["model"], d["pre_tokenizer"] or {}
    wanted = [
        model["type"] == "BPE", not model.get("dropout"), not model.get("unk_token"), not model.get("continuing_subword_prefix"), not model.get("end_of_word_suffix"),
        not model.get("ignore_merges"), not d.get("normalizer"), not d.get("post_processor"), (d.get("decoder") or {}).get("type") == "ByteLevel",
        cut.get("type") == "ByteLevel", not cut.get("add_prefix_space"), cut.get("use_regex", True),
        not any(t[x] for t in d["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized")),
    ]
    if not all(wanted):
        raise ValueError("the file asks for more than byte-level BPE")
    of = byte_characters()
    special = {t["content"]: t["id"] for t in d["added_tokens"]}
    to_bytes = lambda x: bytes(map(of.__getitem__, x))
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return Merges({to_bytes(t): k for t, k in model["vocab"].items() if t not in special}, [(to_bytes(a), to_bytes(b)) for a, b in pairs], special)


class _Known(dict):
    """Ids, as bytes, of pre-tokens met before; of bounded size."""

    def __init__(self, merges: Merges):
        self.merges = merges

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.merges.encode(word.encode("utf-8", "surrogatepass"))).tobytes()
        if len(word) <= KEPT_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Text in, ids out: feed() takes the next part of the text, finish() ends it; both return the ids that are stable now.

    One encoder serves any number of texts, one after the other.
    """

    def __init__(self, merges: Merges, pattern: str = PRE_TOKEN):
        self.merges, self.known = merges, _Known(merges)
        self.find = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.hidden = max(map(len, merges.special), default=1) - 1
        self.out: list[bytes] = []
        self.mark = ""  # characters that may begin a special token
        self.rest = ""  # characters of unfinished pre-tokens
        self.run = None  # what a pre-token that is handed on in parts consists of
        self.window = b""  # its bytes whose tokens are not stable

    @property
    def held(self) -> int:
        """Bytes and characters kept from what was fed."""
        return len(self.mark) + len(self.rest) + len(self.window)

    def feed(self, text: str) -> array:
        text = self.mark + text if self.mark else text
        self.mark = ""
        if self.special:
            at = 0
            for m in self.special.finditer(text):
                self._cut(text[at : m.start()])
                self._end()
                self.out.append(array("I", [self.merges.special[m.group()]]).tobytes())
                at = m.end()
            text = text[at:] if at else text
            keep = next((k for k in range(min(self.hidden, len(text)), 0, -1) if any(s.startswith(text[-k:]) for s in self.merges.special)), 0)
            if keep:
                text, self.mark = text[:-keep], text[-keep:]
        self._cut(text)
        return self._taken()

    def finish(self) -> array:
        self._cut(self.mark)
        self.mark = ""
        self._end()
        return self._taken()

    def _taken(self) -> array:
        ids = array("I", b"".join(self.out))
        self.out = []
        return ids

    def _cut(self, text: str) -> None:
        if self.run is not None:
            text = self._go_on(text)
        if not text:
            return
        text = self.rest + text if self.rest else text
        words, end, open_ = self.find(text), len(text), 0
        while words and end > len(text) - UNDECIDED:
            end -= len(words.pop())
            open_ += 1
        self.out += map(self.known.__getitem__, words)
        self.rest = text[end:]
        if open_ == 1 and len(self.rest) > OPEN:
            self.run = SPACES if SPACES.fullmatch(self.rest[-1]) and self.rest[-1:] else next(r for r in RUNS if r.fullmatch(self.rest[-1]))
            text, self.rest = self.rest, ""
            self._hand_on(text)

    def _hand_on(self, text: str) -> None:
        """Of white space the last character waits: it belongs to the next pre-token if one follows."""
        if self.run is SPACES:
            text, self.rest = self.rest + text[:-1], text[-1]
        self.window += text.encode("utf-8", "surrogatepass")
        while len(self.window) >= self.merges.lookahead + STEP:
            piece = self.window[: self.merges.lookahead + STEP]
            stable, used = [], 0
            for x in self.merges.encode(piece):
                used += len(self.merges.tokens[x])
                if used > STEP:
                    used -= len(self.merges.tokens[x])
                    break
                stable.append(x)
            self.out.append(array("I", stable).tobytes())
            self.window = self.window[used:]

    def _go_on(self, text: str) -> str:
        """What is left of the text after the run that is open."""
        n = self.run.match(text).end()
        if n:
            self._hand_on(text[:n])
        if n == len(text):
            return ""
        kept, self.rest = self.rest, ""
        self._close()
        return kept + text[n:]

    def _close(self) -> None:
        self.window += self.rest.encode("utf-8", "surrogatepass")
        self.out.append(array("I", self.merges.encode(self.window)).tobytes())
        self.window, self.rest, self.run = b"", "", None

    def _end(self) -> None:
        if self.run is not None:
            self._close()
        elif self.rest:
            self.out += map(self.known.__getitem__, self.find(self.rest))
            self.rest = ""


@lru_cache(maxsize=2)
def kept_encoder(tokenizer_json: str) -> Encoder:
    """A worker keeps the encoder of a file, with its known pre-tokens, for its next task."""
    return Encoder(read_merges(tokenizer_json))


class TextMachine:
    """Bytes in, characters out, as soon as they are complete; bytes that are none become U+FFFD, one for each longest beginning of a character.

    Its state is the at most three bytes of a character that has begun.
    """

    def __init__(self) -> None:
        self.begun = b""

    def feed(self, data: bytes) -> str:
        data = self.begun + data if self.begun else data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    cut -= back
                break
            if lead < 0x80:
                break
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.begun = self.begun, b""
        return rest.decode("utf-8", "replace")


def slices(data: bytes, size: int = SLICE):
    """Text of some bytes, at most `size` at a time and cut between characters."""
    if len(data) <= size:
        yield data.decode("utf-8", "replace")
        return
    machine = TextMachine()
    for at in range(0, len(data), size):
        yield machine.feed(data[at : at + size])
    yield machine.finish()


def streamed(docs: DataFrame, tokenizer_json: str, doc_id: str = "doc_id", text: str = "text", digest: bool = True) -> DataFrame:
    """Token ids of every text, special tokens in it included, and the text decoded from them.

    digest: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256. Otherwise: doc_id, ids, decoded. `tokenizer_json` is the
    content of the tokenizer's file.
    Null is the empty text, which has no tokens; repeated rows are encoded alike; a null
    id stays null; an empty table gives an empty one; extra columns are ignored. Texts of
    any length are read in slices; digests are carried along, so beside the row itself a
    task holds a slice, a window and the table of known pre-tokens, all of fixed size.
    """
    spark = ship_package(docs.sparkSession)
    sent = spark.sparkContext.broadcast(tokenizer_json)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string"

    def run(batches):
        encoder = kept_encoder(sent.value)
        bytes_of = encoder.merges.tokens.__getitem__

        def stream(data: bytes):
            machine = TextMachine()
            for part in slices(data):
                ids = encoder.feed(part)
                yield ids, machine.feed(b"".join(map(bytes_of, ids)))
            ids = encoder.finish()
            yield ids, machine.feed(b"".join(map(bytes_of, ids)))
            yield array("I"), machine.finish()

        for batch in batches:
            data, off = buffers(batch.column(1))
            rows = []
            for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
                if digest:
                    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                    for ids, out in stream(data[lo:hi].tobytes()):
                        n += len(ids)
                        of_ids.update(ids.tobytes())
                        of_text.update(out.encode())
                    rows.append((n, of_ids.hexdigest(), of_text.hexdigest()))
                else:
                    whole, shown = array("I"), []
                    for ids, out in stream(data[lo:hi].tobytes()):
                        whole += ids
                        shown.append(out)
                    rows.append((whole.tolist(), "".join(shown)))
            types = (pa.int64(), pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return plain.mapInArrow(run, schema)
