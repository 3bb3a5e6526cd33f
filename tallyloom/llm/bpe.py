"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens and dealt into blocks of a bounded size. A block
keeps each pre-token's number at its position and sends each distinct one to the
bucket of its hash. A bucket encodes each distinct word it gets once, whoever sent
it, and answers every block in the order of its question. The block puts the ids
back at the positions. So a word crosses the network once per block that has it,
however often it occurs: the commonest word is no hot key. Decoding joins the ids with
the table of tokens' bytes, sorted by id and no larger than the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.packing import pack, pack_strings, unpack, unpack_strings
from tallyloom.store import store_bucketed
from tallyloom.llm.textkit import Hasher, buffers
from tallyloom.session import ship_package

WORDS, TEXTS = 0, 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


NEVER = 1 << 62
LONG = 64  # bytes from which on pairs wait in a heap


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of neighbours with the least rank, the first of equal ones, is merged as long as there is one."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG:
        return encode_long(word, ranks)
    rank_of = ranks.get
    parts = [word[k : k + 1] for k in range(len(word))]
    pairs = [rank_of(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == NEVER:
            break
        k = pairs.index(best)
        parts[k] += parts.pop(k + 1)
        del pairs[k]
        if k:
            pairs[k - 1] = rank_of(parts[k - 1] + parts[k], NEVER)
        if k < len(pairs):
            pairs[k] = rank_of(parts[k] + parts[k + 1], NEVER)
    return [ranks[x] for x in parts]


def encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As encode_word(), in n log n steps: parts are known by where they begin, outdated pairs are passed over."""
    n = len(word)
    stop = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is merged into the one before
    before = list(range(-1, n - 1))
    waiting = []

    def offer(a: int) -> None:
        b = stop[a]
        if b < n:
            rank = ranks.get(word[a : stop[b]])
            if rank is not None:
                waiting.append((rank, a, b, stop[b])) if fresh else heapq.heappush(waiting, (rank, a, b, stop[b]))

    fresh = True
    for a in range(n - 1):
        offer(a)
    fresh = False
    heapq.heapify(waiting)
    while waiting:
        _, a, b, c = heapq.heappop(waiting)
        if stop[a] != b or stop[b] != c:
            continue
        stop[a], stop[b] = c, 0
        if c < n:
            before[c] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : stop[a]]])
        a = stop[a]
    return out


class TokenTable:
    """Tokens' bytes by id."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = np.array([ranks[t] for t in tokens], np.int64)
        self.bytes = pa.array(tokens, pa.large_binary())

    def join(self, ids: np.ndarray) -> pa.Array:
        """The bytes of each id, in order."""
        at = np.minimum(np.searchsorted(self.ids, ids), max(0, len(self.ids) - 1))
        if len(ids) and (not len(self.ids) or (self.ids[at] != ids).any()):
            raise ValueError("an id that is not in the table")
        return self.bytes.take(pa.array(at))


def regrouped(values: pa.Array, starts: np.ndarray) -> pa.Array:
    """Runs of consecutive values, each as one: run k begins at value starts[k]; the last entry is the number of values."""
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(off[starts])), data])


def word_hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    return Hasher(np.frombuffer(b"".join(words), np.uint8)).spans(starts, ends)


class _Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class _Block:
    def __init__(self) -> None:
        self.numbers, self.ids, self.sizes, self.positions, self.bytes = _Numbers(), [], [], [], 0

    def rows(self, block: int, buckets: int) -> list[tuple[int, int, int, bytes]]:
        words = [w.encode("utf-8", "surrogatepass") for w in self.numbers]
        bucket = (word_hashes(words) % np.uint64(buckets)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        order = order.tolist()
        out = [(WORDS, block, b, pack_strings([words[k] for k in order[lo:hi]])) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
        ids = pa.array(self.ids, pa.int64())
        known = np.array([x is not None for x in self.ids], np.uint8)
        flat = np.fromiter(chain.from_iterable(self.positions), np.uint32, sum(map(len, self.positions)))
        return [*out, (TEXTS, block, 0, pack(ids.fill_null(0).to_numpy(zero_copy_only=False), known, np.array(self.sizes, np.uint32), flat, bucket))]


ROWS = "kind int, block long, bucket int, payload binary"


def blocks_of(docs: DataFrame, pattern: str, block_bytes: int, buckets: int) -> DataFrame:
    """ROWS: a block's texts as numbers of its words, and its distinct words by bucket."""

    def run(batches):
        find = regex.compile(pattern).findall
        first, made, block = TaskContext.get().partitionId() << 32, 0, _Block()

        def emit():
            columns = zip(*block.rows(first + made, buckets))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["kind", "block", "bucket", "payload"])

        for batch in batches:
            data, off = buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for k in range(batch.num_rows):
                text = data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")
                tokens = find(text)
                block.ids.append(ids[k])
                block.sizes.append(len(tokens))
                block.positions.append(np.fromiter(map(block.numbers.__getitem__, tokens), np.uint32, len(tokens)))
                block.bytes += int(off[k + 1] - off[k])
                if block.bytes >= block_bytes:
                    yield emit()
                    made, block = made + 1, _Block()
        if block.ids:
            yield emit()

    return docs.mapInArrow(run, ROWS)


def _answers(payloads: DataFrame, ranks) -> DataFrame:
    """block, bucket, payload: numbers of ids and the ids of the words of each question, in its order."""

    def run(batches):
        table = ranks.value
        at, known = None, {}
        for batch in batches:
            out = []
            for block, bucket, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:  # rows are sorted by bucket
                    at, known = bucket, {}
                found = []
                for w in unpack_strings(payload):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = encode_word(w, table)
                    found.append(ids)
                sizes = np.fromiter(map(len, found), np.uint32, len(found))
                out.append((block, bucket, pack(sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "bucket", "payload"])

    return payloads.mapInArrow(run, "block long, bucket int, payload binary")


def word_ids(bucket: np.ndarray, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words of a block, in the order of their numbers; where each word's begin, and the end)."""
    order = np.argsort(bucket, kind="stable")
    parts = [unpack(p) for _, p in sorted(answers)]
    sizes = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    ids = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    by_number = np.argsort(order, kind="stable")
    sizes, begin = sizes[by_number], begin[by_number]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return ids[np.repeat(begin - starts[:-1], sizes) + np.arange(starts[-1])], starts


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", digest: bool = True, block_bytes: int = 8 << 20) -> DataFrame:
    """Token ids of every text, and the texts decoded from them.

    digest: doc_id, n_tokens, n_words, ids_sha256 (of decimal ids joined by one
    space), decoded_sha256. Otherwise: doc_id, ids, decoded (binary).
    Null is the empty text; repeated rows are encoded alike; a null id stays null; an
    empty table gives an empty one; extra columns are ignored. A text of any length is
    in one block. The vocabulary, at most a few MB, goes out with the task.
    """
    spark = ship_package(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(64, 2 * parts), 65_535)
    sent = spark.sparkContext.broadcast(ranks)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = store_bucketed(blocks_of(plain, pattern, block_bytes, buckets), "bpe", "block", parts, partition="kind")
    questions = cut.where(f"kind = {WORDS}").select("block", "bucket", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket")
    answers = _answers(questions, sent).groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias("answers"))
    texts = cut.where(f"kind = {TEXTS}").select("block", F.col("payload").alias("texts"))
    joined = texts.join(answers, "block", "left").select("texts", "answers")

    def run(batches):
        table = TokenTable(sent.value)
        for batch in batches:
            for row in range(batch.num_rows):
                answers = [(x["bucket"], x["payload"]) for x in batch.column(1)[row].as_py() or []]
                doc_ids, known, sizes, flat, bucket = unpack(batch.column(0)[row].as_py())
                ids, starts = word_ids(bucket, answers)
                at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                where = pa.array(flat)
                decoded = regrouped(regrouped(table.join(ids), starts).take(where), at)
                mine = pa.array(doc_ids, mask=known == 0)
                n_ids = np.concatenate([[0], np.cumsum(np.diff(starts)[flat])])[at]
                if digest:
                    shown = pc.binary_join_element_wise(pa.array(ids).cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", " "))).cast(pa.large_binary())
                    shown = regrouped(regrouped(shown, starts).take(where), at)
                    digests = [[hashlib.sha256(x.as_buffer()[: max(0, len(x.as_buffer()) - cut)]).hexdigest() for x in column] for column, cut in ((shown, 1), (decoded, 0))]
                    columns = [mine, pa.array(np.diff(n_ids)), pa.array(sizes.astype(np.int64)), *(pa.array(d, pa.string()) for d in digests)]
                else:
                    lists = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(ids.astype(np.int32))).take(where)
                    columns = [mine, pa.ListArray.from_arrays(pa.array(n_ids.astype(np.int32)), lists.flatten()), decoded.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, n_words long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded binary"
    names = [x.split()[0] for x in schema.split(", ")]
    return joined.mapInArrow(run, schema)
