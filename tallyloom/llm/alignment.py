"""Alignment of two tokenizers by a dictionary of groups.

A group is the tokens of both tokenizers between two byte offsets at which tokens of
both end. Every token of the one is linked with every token of the other there. Since
texts repeat few groups very often, a group is a number wherever it occurs:

- A block of texts cuts them into units, at places where neither tokenizer can join
  what stands on both sides, and encodes, aligns and numbers each distinct one once.
- Links are expanded once per distinct group, with how often an id stands in it. Which
  documents hold a pair is settled within the block by sets of (document, pair), so
  what leaves it is a number of documents per pair.
- The groups of all blocks are interned in one table. Their links meet the pairs' counts
  there, and each block gets a group's sums back by its key.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.bpe import regrouped
from tallyloom.llm.packing import pack, unpack
from tallyloom.llm.textkit import buffers
from tallyloom.llm.transducer import read_merges
from tallyloom.session import ship_package
from tallyloom.store import store

TEXTS, GROUPS, PAIRS = 0, 1, 2
ROWS = "kind int, block long, number int, payload binary, a array<int>, b array<int>, a_id int, b_id int, docs long"
BAR = 0xFFFFFFFF
AT_A_TIME = 1024

#: Before a single space between characters other than white space: byte-level BPE begins a pre-token there, and no piece has a space behind another character.
UNIT_ENDS = re.compile(r"(?<=\S)(?= \S)")


def byte_level_tokens(tokenizer_json: str) -> dict[bytes, int]:
    """Tokens' bytes of a byte-level BPE file, without special tokens."""
    merges = read_merges(tokenizer_json)
    special = set(merges.special.values())
    return {t: k for k, t in merges.tokens.items() if k not in special}


def piece_tokens(model: bytes) -> dict[int, bytes]:
    """Pieces' bytes of a sentencepiece model: U+2581 is a space, <0xHH> a byte."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("pieces with a space behind another character would reach over units")
    return {k: bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)}


@lru_cache(maxsize=1)
def _encoders(tokenizer_json: str, model: bytes):
    """Kept by a worker for its next task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(tokenizer_json)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, SentencePieceProcessor(model_proto=model)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all values, where each list begins, and the end)."""
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=starts[1:])
    return np.fromiter((x for y in lists for x in y), np.int64, int(starts[-1])), starts


def expanded(index: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs starts[k] to starts[k + 1]: (place in index, position) of every position of the runs that index names."""
    sizes = starts[index + 1] - starts[index]
    owner = np.repeat(np.arange(len(index)), sizes)
    return owner, np.arange(len(owner)) + np.repeat(starts[index] - (np.cumsum(sizes) - sizes), sizes)


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending; by a sort, which is several times as fast here as what unique() does."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def distinct_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = distinct((x << 32) | y)
    return both >> 32, both & 0xFFFFFFFF


class TokenBytes:
    """Bytes by id, for ids that may have gaps."""

    def __init__(self, tokens: dict[int, bytes]):
        top = max(tokens, default=-1) + 1
        self.values = pa.array([tokens.get(k, b"") for k in range(top)], pa.large_binary())
        self.sizes = np.fromiter((len(tokens.get(k, b"")) for k in range(top)), np.int64, top)


class Units:
    """Distinct units of a block, encoded and aligned.

    good: units whose bytes both tokenizers give back; groups[starts[k] : starts[k + 1]]: a unit's groups, in order;
    group_a, group_b: (ids, starts) of the distinct groups; shown: each unit's groups as text.
    """

    def __init__(self, units: list[str], encoders, of_a: TokenBytes, of_b: TokenBytes):
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        whole = pa.array(raw, pa.large_binary())
        a_ids, b_ids = [], []
        for at in range(0, len(units), AT_A_TIME):
            some = units[at : at + AT_A_TIME]
            a_ids += [x.ids for x in encoders[0].encode_batch_fast(some, add_special_tokens=False)]
            b_ids += encoders[1].encode([u[1:] for u in some], num_threads=1)  # it adds the space
        (a, a_starts), (b, b_starts) = flat(a_ids), flat(b_ids)
        same = [pc.equal(regrouped(t.values.take(pa.array(x)), s), whole).to_numpy(zero_copy_only=False) for t, x, s in ((of_a, a, a_starts), (of_b, b, b_starts))]
        self.good = same[0] & same[1]
        keep_a, keep_b = np.repeat(self.good, np.diff(a_starts)), np.repeat(self.good, np.diff(b_starts))
        a, b = a[keep_a], b[keep_b]
        ends_a, ends_b = np.cumsum(of_a.sizes[a]), np.cumsum(of_b.sizes[b])  # over all good units, one after the other
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # either side ascends
        common = both[1:][both[1:] == both[:-1]] if len(both) else both
        first_a = np.concatenate([[0], np.searchsorted(ends_a, common, "right")])
        first_b = np.concatenate([[0], np.searchsorted(ends_b, common, "right")])
        n_a, n_b = np.diff(first_a), np.diff(first_b)
        key_starts = np.concatenate([[0], np.cumsum(n_a + n_b + 1)])
        keys = np.empty(key_starts[-1], np.uint32)
        keys[np.arange(len(a)) + np.repeat(key_starts[:-1] - first_a[:-1], n_a)] = a
        keys[key_starts[:-1] + n_a] = BAR
        keys[np.arange(len(b)) + np.repeat(key_starts[:-1] + n_a + 1 - first_b[:-1], n_b)] = b
        named = pa.Array.from_buffers(pa.large_binary(), len(common), [None, pa.py_buffer(np.ascontiguousarray(key_starts * 4)), pa.py_buffer(keys)])
        coded = named.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, at = np.unique(coded, return_index=True)
        self.groups = coded
        sizes = np.where(self.good, np.fromiter(map(len, raw), np.int64, len(raw)), 0)
        self.starts = np.concatenate([[0], np.searchsorted(common, np.cumsum(sizes), "right")]) if len(raw) else np.zeros(1, np.int64)
        self.group_a = self._runs(a, first_a, at)
        self.group_b = self._runs(b, first_b, at)
        self.n_a, self.n_b = n_a[at], n_b[at]
        self.group_shown = ["%s|%s" % (",".join(map(str, x)), ",".join(map(str, y))) for x, y in zip(self._lists(self.group_a), self._lists(self.group_b))]
        names, s = list(map(self.group_shown.__getitem__, coded.tolist())), self.starts.tolist()
        self.shown = [names[lo] if hi - lo == 1 else ";".join(names[lo:hi]) for lo, hi in zip(s, s[1:])]

    @staticmethod
    def _runs(values: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, where = expanded(at, first)
        return values[where], np.concatenate([[0], np.cumsum(first[at + 1] - first[at])])

    @staticmethod
    def _lists(runs: tuple[np.ndarray, np.ndarray]):
        values, starts = runs[0].tolist(), runs[1].tolist()
        return (values[lo:hi] for lo, hi in zip(starts, starts[1:]))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, A id, B id) of all distinct ones, in the order of groups."""
        sides = []
        for values, starts in (self.group_a, self.group_b):
            group, ids = distinct_pairs(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), values)
            sides.append((group, ids, np.searchsorted(group, np.arange(len(starts)))))
        (group, a, _), (_, b, b_starts) = sides
        owner, where = expanded(group, b_starts)
        return group[owner], a[owner], b[where]


class _Numbers(dict):
    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


class _Block:
    def __init__(self) -> None:
        self.numbers, self.ids, self.sequences, self.bytes = _Numbers(), [], [], 0

    def add(self, doc_id, text: str, size: int) -> None:
        self.ids.append(doc_id)
        self.sequences.append(np.fromiter(map(self.numbers.__getitem__, UNIT_ENDS.split(" " + text)), np.int64) if text else np.zeros(0, np.int64))
        self.bytes += size

    def batches(self, block: int, encoders, of_a: TokenBytes, of_b: TokenBytes):
        units = Units(list(self.numbers), encoders, of_a, of_b)
        n_docs = len(self.ids)
        good = np.array([bool(units.good[s].all()) for s in self.sequences], bool)
        sequences = [s if ok else s[:0] for s, ok in zip(self.sequences, good)]
        digests = [hashlib.sha256(";".join(map(units.shown.__getitem__, s.tolist())).encode()).digest() if len(s) else bytes(32) for s in sequences]
        sizes = np.fromiter(map(len, sequences), np.int64, n_docs)
        seen = np.concatenate(sequences) if sequences else np.zeros(0, np.int64)
        doc, unit = distinct_pairs(np.repeat(np.arange(n_docs), sizes), seen)
        owner, where = expanded(unit, units.starts)
        doc, group = distinct_pairs(doc[owner], units.groups[where])
        of_group, a, b = units.links()
        pairs = distinct((a << 32) | b)
        pair = np.searchsorted(pairs, (a << 32) | b)
        owner, where = expanded(group, np.searchsorted(of_group, np.arange(len(units.n_a) + 1)))
        _, held = distinct_pairs(doc[owner], pair[where])
        docs = np.bincount(held, minlength=len(pairs))
        used = distinct(group)

        known = np.array([x is not None for x in self.ids], np.uint8)
        ids = pa.array(self.ids, pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        payload = pack(
            ids, known, sizes.astype(np.uint32), seen.astype(np.uint32), units.starts.astype(np.uint32), units.groups.astype(np.uint32),
            units.n_a.astype(np.uint32), units.n_b.astype(np.uint32), np.frombuffer(b"".join(digests), np.uint8),
        )
        yield _rows(TEXTS, 1, block=pa.array([block]), payload=pa.array([payload], pa.binary()))
        for at in range(0, len(used), 1 << 15):
            some = used[at : at + (1 << 15)]
            a_runs, b_runs = (lists_of(x, some) for x in (units.group_a, units.group_b))
            yield _rows(GROUPS, len(some), block=pa.array(np.full(len(some), block)), number=pa.array(some.astype(np.int32)), a=a_runs, b=b_runs)
        pairs, docs = pairs[docs > 0], docs[docs > 0]
        for at in range(0, len(pairs), 1 << 16):
            some = pairs[at : at + (1 << 16)]
            yield _rows(PAIRS, len(some), a_id=pa.array((some >> 32).astype(np.int32)), b_id=pa.array((some & 0xFFFFFFFF).astype(np.int32)), docs=pa.array(docs[at : at + (1 << 16)].astype(np.int64)))


def lists_of(runs: tuple[np.ndarray, np.ndarray], some: np.ndarray) -> pa.Array:
    """The runs of these numbers as lists."""
    values, starts = runs
    _, where = expanded(some, starts)
    offsets = np.concatenate([[0], np.cumsum(starts[some + 1] - starts[some])])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[where].astype(np.int32)))


_TYPES = {"kind": pa.int32(), "block": pa.int64(), "number": pa.int32(), "payload": pa.binary(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "a_id": pa.int32(), "b_id": pa.int32(), "docs": pa.int64()}


def _rows(kind: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
    columns["kind"] = pa.array(np.full(n, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in _TYPES.items()], names=list(_TYPES))


def blocks_of(docs: DataFrame, tokenizer_json: str, model: bytes, block_bytes: int) -> DataFrame:
    """ROWS of every block: its texts, its distinct groups, and how many of its documents hold each pair."""
    spark = docs.sparkSession
    tables = {k: t for t, k in byte_level_tokens(tokenizer_json).items()}, piece_tokens(model)
    sent = spark.sparkContext.broadcast((tokenizer_json, model, *tables))

    def run(batches):
        raw, model, of_a, of_b = sent.value
        encoders, of_a, of_b = _encoders(raw, model), TokenBytes(of_a), TokenBytes(of_b)
        first, made, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in batches:
            data, off = buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for k in range(batch.num_rows):
                text = data[off[k] : off[k + 1]].tobytes()
                block.add(ids[k], text.decode("utf-8", "replace"), len(text))
                if block.bytes >= block_bytes:
                    yield from block.batches(first + made, encoders, of_a, of_b)
                    made, block = made + 1, _Block()
        if block.ids:
            yield from block.batches(first + made, encoders, of_a, of_b)

    return docs.mapInArrow(run, ROWS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a_id, b_id, docs, best: documents of every pair, and whether no other pair of its A id has more."""
    counts = pairs.groupBy("a_id", "b_id").agg(F.sum("docs").alias("docs"))
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a_id")))  # an A id has at most as many pairs as B has ids


def group_sums(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """a, b, n_best, count_sum of every distinct group: over all its links, those that are the best of their A id, and the pairs' documents."""
    interned = store(groups.groupBy("a", "b").agg(F.lit(1).alias("one")).select(F.monotonically_increasing_id().alias("group"), "a", "b"), "groups").df
    times = "transform(array_distinct({0}), x -> struct(x as id, size(filter({0}, y -> y = x)) as times))"
    links = interned.select("group", F.explode(F.expr(times.format("a"))).alias("x"), "b").select("group", "x", F.explode(F.expr(times.format("b"))).alias("y"))
    links = links.select("group", F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id"), (F.col("x.times").cast("long") * F.col("y.times")).alias("times"))
    sums = links.join(counts, ["a_id", "b_id"]).groupBy("group").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    return interned.join(sums, "group").select("a", "b", "n_best", "count_sum")


def aligned(docs: DataFrame, tokenizer_json: str, model: bytes, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Per document, how the tokens of two tokenizers for it are linked.

    doc_id, n_a, n_b, n_groups, n_links, n_best (links that no other pair of their A id
    exceeds in documents), count_sum (documents of the pair, over links), groups_sha256
    (of ``a1,a2|b1;a3|b2,b3``). A is a byte-level BPE (content of its file), B a
    sentencepiece model with byte fallback; a space is put before the text.

    Null and empty texts, and those that either tokenizer does not give back byte for
    byte, have no tokens: zeros, and '' as the digest. Every row is a document of its
    own, so repeated rows count as often as they occur and ids may be null; an empty
    table gives an empty one; extra columns are ignored. A text of any length is in
    one block, of `block_bytes` or one text if that is longer. A group crosses the
    network once per block that has it, a pair as well.
    """
    ship_package(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = store(blocks_of(plain, tokenizer_json, model, block_bytes), "alignment", partition="kind").df
    counts = pair_counts(cut.where(f"kind = {PAIRS}").select("a_id", "b_id", "docs"))
    groups = cut.where(f"kind = {GROUPS}").select("block", "number", "a", "b")
    answers = groups.join(group_sums(groups, counts), ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("number", "n_best", "count_sum")).alias("answers"))
    joined = cut.where(f"kind = {TEXTS}").select("block", "payload").join(answers, "block", "left").select("payload", "answers")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, known, sizes, seen, starts, groups, n_a, n_b, digests = unpack(batch.column(0)[row].as_py())
                best, total = np.zeros(len(n_a), np.int64), np.zeros(len(n_a), np.int64)
                found = batch.column(1)[row].values
                if found is not None and len(found):
                    number, n_best, count_sum = (x.to_numpy(zero_copy_only=False) for x in found.flatten())
                    best[number], total[number] = n_best, count_sum
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
                columns = [pa.array(ids, mask=known == 0)]
                for of_group in (n_a, n_b, np.ones(len(n_a), np.int64), n_a * n_b, best, total):
                    of_unit = np.diff(np.concatenate([[0], np.cumsum(of_group[groups])])[starts])
                    columns.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(of_unit[seen])])[ends])))
                shown = [digests[32 * k : 32 * k + 32].tobytes().hex() if n else "" for k, n in enumerate(sizes)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shown, pa.string())], names=names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    return joined.mapInArrow(run, schema)
