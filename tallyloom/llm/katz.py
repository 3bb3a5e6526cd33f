"""LM scoring: a Katz back-off n-gram model over all training texts.

Counting and scoring share one layout. Texts are dealt into blocks; a block knows
its words by number, and asks buckets of a hash for what is global: first the
training counts of its words, then those of its bigrams, and so on up to the order,
each distinct one once. A bucket of an n-gram table holds whole histories, so it also
knows what a history's back-off weight needs: how many of its successors were seen
1 to K times, and the summed lower-order probability of those seen. Histories with a
large share of all tokens are split over several buckets by successor, and their
parts are added up. The tables of answers are stored by bucket; nothing but counts
of counts, a few numbers per bucket, reaches the driver.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.packing import pack, unpack
from tallyloom.store import store, store_bucketed
from tallyloom.llm.textkit import SALT, U64, Hasher, Words, lower, mix, rows_and_texts
from tallyloom.session import ship_package

K = 5  # counts above are taken as they are
START, END = mix(np.array([0x5354415254, 0x454E44], np.uint64))


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d[0..K]: Good-Turing factors of counts 1 to K; d[0] is unused.

    counts_of_counts: n[1..K + 1] at these places. Where they don't give factors
    in (0, 1], which happens on small or odd data, (r - 0.5) / r is taken.
    """
    n = counts_of_counts.astype(float)
    out = np.ones(K + 1)
    r = np.arange(1, K + 1)
    out[1:] = (r - 0.5) / r
    if (n[1:] > 0).all():
        common = (K + 1) * n[K + 1] / n[1]
        good = ((r + 1) * n[2:] / (n[1:-1] * r) - common) / (1 - common) if common < 1 else np.zeros(K)
        if ((good > 0) & (good <= 1)).all():
            out[1:] = good
    return out


@dataclass
class Unigrams:
    """Katz unigrams: discounted counts, and one class of unknown words with the mass that is left."""

    total: int
    distinct: int
    counts_of_counts: np.ndarray

    def __post_init__(self) -> None:
        self.factor = discounts(self.counts_of_counts)
        r = np.arange(1, K + 1)
        self.whole = float(self.total)
        left = float((self.counts_of_counts[1 : K + 1] * r * (1 - self.factor[1:])).sum())
        if left <= 0:  # nothing was discounted: one more token is set aside
            left, self.whole = 1.0, self.whole + 1
        self.unknown = left / self.whole

    def probability(self, counts: np.ndarray) -> np.ndarray:
        d = self.factor[np.minimum(counts, K)]
        return np.where(counts > 0, np.where(counts <= K, d, 1.0) * counts / self.whole, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.total + self.distinct + 1.0))


def history_terms(history: np.ndarray, seen_by_count: np.ndarray, seen_mass: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, back-off weight) of each history.

    history: its count; seen_by_count: numbers of its successors seen 1..K times
    (rows of K); seen_mass: the unigram mass of all seen ones. A history whose counts
    are all above K has nothing discounted; one more token is then set aside for it.
    """
    h = np.maximum(history, 1).astype(float)
    left = seen_by_count @ (np.arange(1, K + 1) * (1 - factor[1:]))
    whole = np.where(left > 0, h, h + 1)
    left = np.where(left > 0, left, 1.0)
    return whole, left / whole / np.maximum(1 - seen_mass, 1e-15)


def backed_off(count: np.ndarray, history: np.ndarray, whole: np.ndarray, weight: np.ndarray, lower: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """P(word | history) of rows of the n-gram's count, its history's count and terms, and P(word | shorter history).

    A seen n-gram has its discounted share; an unseen one backs off to the shorter
    history; an unseen history backs off with weight 1. So the probabilities of all words
    and of the unknown class add up to 1 for any history.
    """
    d = factor[np.minimum(count, K)]
    d[count > K] = 1.0
    return np.where(history <= 0, lower, np.where(count > 0, d * count / whole, weight * lower))


# ---------------------------------------------------------------- blocks


class Block:
    """Texts as numbers of the block's words, sorted by hash. START stands before each text."""

    def __init__(self, payload: bytes):
        self.doc_ids, self.known, self.held, self.sizes, self.flat, self.words = unpack(payload)
        self.flat = self.flat.view(np.int32)

    @staticmethod
    def packed(doc_ids: list, held: list, sizes: list, tokens: list) -> bytes:
        flat = np.concatenate([*tokens, np.array([START])])
        words, numbers = np.unique(flat, return_inverse=True)
        known = np.array([x is not None for x in doc_ids], np.uint8)
        return pack(np.array([x or 0 for x in doc_ids], np.int64), known, np.array(held, np.uint8), np.concatenate(sizes).astype(np.uint32), numbers[:-1].astype(np.uint32), words)

    def trains(self) -> np.ndarray:
        """Whether each token is of a training text."""
        return np.repeat(self.held == 0, self.sizes)

    def word_counts(self) -> np.ndarray:
        counts = np.bincount(self.flat[self.trains()], minlength=len(self.words))
        counts[np.searchsorted(self.words, START)] = int((self.held == 0).sum())
        return counts


@dataclass
class Level:
    """A block's distinct n-grams of one length: hashes, training counts, P(last word | words before); of_token: the one that ends at each token, or -1."""

    names: np.ndarray
    counts: np.ndarray
    chance: np.ndarray
    of_token: np.ndarray


def word_level(block: Block, counts: np.ndarray, unigrams: Unigrams) -> Level:
    return Level(block.words, counts, unigrams.probability(counts), block.flat)


class Grams:
    """A block's distinct n-grams that are one word longer than `below`'s, and the questions about them; the same each time it is made.

    The history of an n-gram is the one of `below` that ends a token earlier. START is
    before the first word of a text, and no history reaches further back.
    """

    def __init__(self, block: Block, below: Level, total: int, buckets: int):
        n, m = len(block.words), len(below.names)
        cur = block.flat
        history = np.full(len(cur), -1, np.int32)
        history[1:] = below.of_token[:-1]
        ends = np.cumsum(block.sizes, dtype=np.int64)
        history[(ends - block.sizes)[block.sizes > 0]] = np.searchsorted(block.words, START) if below.names is block.words else -1
        trains = block.trains()
        some = history >= 0
        if some.all():
            keys, self.of_token = np.unique(history * np.int64(n) + cur, return_inverse=True)
            self.of_token = self.of_token.astype(np.int32)
        else:
            keys, numbers = np.unique(history[some] * np.int64(n) + cur[some], return_inverse=True)
            self.of_token = np.full(len(cur), -1, np.int32)
            self.of_token[some] = numbers
        self.history = (keys // n).astype(np.int32)
        self.last = (keys - self.history * np.int64(n)).astype(np.int32)
        del keys
        self.suffix = self.last
        if below.names is not block.words:
            self.suffix = np.empty(len(self.last), np.int32)
            self.suffix[self.of_token[some]] = below.of_token[some]
        self.trained = np.bincount(self.of_token[trains & some], minlength=len(self.history))
        self.needs = np.bincount(history[~trains & some], minlength=m) > 0
        # An n-gram with a history or an end that was not seen was not seen either: no question.
        counts = below.counts
        self.asked = np.flatnonzero((counts[self.history] > 0) & (counts[self.suffix] > 0))
        h, w = self.history[self.asked], self.last[self.asked]
        spread = np.maximum(1, np.ceil(2.0 * buckets * counts / max(total, 1))).astype(np.int64)
        spread = np.minimum(spread, buckets)
        home = (mix(below.names + U64(1)) % U64(buckets)).astype(np.int64)
        bucket = (home[h] + (mix(block.words[w]) % spread[h].astype(np.uint64)).astype(np.int64)) % buckets
        order = np.argsort(bucket, kind="stable")
        self.asked, self.bucket = self.asked[order], bucket[order]
        # A split history asks all its buckets, and a needed one its own, whether it has successors there or not.
        met = np.zeros(m, bool)
        met[self.history] = True
        split = np.flatnonzero((counts > 0) & (self.needs | (met & (spread > 1))))
        every = np.repeat(split, spread[split])
        slot = np.arange(len(every)) - np.repeat(np.cumsum(spread[split]) - spread[split], spread[split])
        entry = self.bucket * m + self.history[self.asked]
        self.entries, self.successors = np.unique(np.concatenate([entry, (home[every] + slot) % buckets * m + every]), return_counts=True)
        self.successors = self.successors - np.isin(self.entries, (home[every] + slot) % buckets * m + every)
        self.entry_bucket, self.entry_history = self.entries // m, self.entries % m
        self.buckets = buckets

    def questions(self, block: Block, below: Level):
        """(bucket, payload): histories (hash, needed, successors) and successors (48 bits of the hash, count here, lower-order terms).

        The lower-order term is the word's count in bigrams, from which the bucket has its
        probability, and the probability itself in longer ones.
        """
        cut = np.searchsorted(self.bucket, np.arange(self.buckets + 1))
        cut_h = np.searchsorted(self.entry_bucket, np.arange(self.buckets + 1))
        hashes, trained = block.words[self.last[self.asked]] >> U64(16), self.trained[self.asked].astype(np.int64)
        lower = (below.counts if below.names is block.words else below.chance.view(np.int64))[self.suffix[self.asked]].astype(np.int64)
        for b in range(self.buckets):
            lo, hi = cut_h[b], cut_h[b + 1]
            if hi > lo:
                who = self.entry_history[lo:hi]
                here = slice(cut[b], cut[b + 1])
                yield b, pack(below.names[who], self.needs[who].astype(np.uint8), self.successors[lo:hi].astype(np.uint32), hashes[here], trained[here], lower[here])

    def level(self, block: Block, below: Level, found: list[dict], factor: np.ndarray, last: bool) -> Level:
        """These n-grams with what the buckets answered; names only where a longer level follows."""
        m = len(below.names)
        total = np.zeros(len(self.history), np.int64)
        by_count, mass, occurs = np.zeros((m, K)), np.zeros(m), np.zeros(m, np.uint8)
        needed = self.needs[self.entry_history]
        at = 0
        for x in found:
            counts, flags, seen, seen_mass = unpack(x["payload"])
            total[self.asked[at : at + len(counts)]] = counts
            at += len(counts)
            lo, hi = np.searchsorted(self.entry_bucket, [x["bucket"], x["bucket"] + 1])
            occurs[self.entry_history[lo:hi]] |= flags
            who = self.entry_history[lo:hi][needed[lo:hi]]
            by_count[who] += seen.reshape(-1, K)
            mass[who] += seen_mass.view(np.float64)
        # A history without a held-out token backs off nowhere; it is enough to know which counts occur.
        by_count[~self.needs] = (occurs[~self.needs, None] >> np.arange(K)) & 1
        whole, weight = history_terms(below.counts, by_count, mass, factor)
        h = self.history
        chance = backed_off(total, below.counts[h], whole[h], weight[h], below.chance[self.suffix], factor)
        with np.errstate(over="ignore"):
            names = np.zeros(0, np.uint64) if last else mix(below.names[h] * SALT[1] + block.words[self.last])
        return Level(names, total, chance, self.of_token)


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    def run(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, held, sizes, tokens, size = [], [], [], [], 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([Block.packed(ids, held, sizes, tokens)], pa.binary())], names=["block", "payload"])

        for part, data, off in rows_and_texts(batches):
            low = lower(data)
            words = Words(low, off)
            hashed = Hasher(low).spans(words.starts, words.ends)
            ids += part.column(0).to_pylist()
            held += part.column(1).to_pylist()
            sizes.append(words.counts + 1)
            tokens.append(np.insert(hashed, words.first[1:], END))
            size += len(data)
            if size >= block_bytes:
                yield emit()
                made, ids, held, sizes, tokens, size = made + 1, [], [], [], [], 0
        if ids:
            yield emit()

    return docs.mapInArrow(run, "block long, payload binary")


REPLY, STATS = 0, 1
ANSWERS = "kind int, block long, bucket int, payload binary"


def by_bucket(questions: DataFrame, parts: int, answer) -> DataFrame:
    """ANSWERS: answer(payloads) of each bucket gives a list of replies, in order, and the bucket's statistics."""

    def run(batches):
        at, blocks, payloads = None, [], []

        def emit():
            replies, stats = answer([unpack(p) for p in payloads])
            n = len(blocks)
            return pa.RecordBatch.from_arrays([pa.array([REPLY] * n + [STATS], pa.int32()), pa.array([*blocks, 0], pa.int64()), pa.array([at] * (n + 1), pa.int32()), pa.array([*replies, pack(stats)], pa.binary())], names=["kind", "block", "bucket", "payload"])

        for batch in batches:
            for block, bucket, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at and blocks:
                    yield emit()
                    blocks, payloads = [], []
                at = bucket
                blocks.append(block)
                payloads.append(payload)
        if blocks:
            yield emit()

    return questions.select("block", "bucket", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWERS)


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[: K + 2]


def answer_words(questions: list[list[np.ndarray]]):
    """Training counts of each question's words; statistics: tokens, distinct words, counts of counts."""
    words, where = np.unique(np.concatenate([q[0] for q in questions]), return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, where, np.concatenate([q[1] for q in questions]).astype(np.int64))
    cuts = np.cumsum([0] + [len(q[0]) for q in questions])
    real = total[words != START]
    stats = np.concatenate([[real.sum(), (real > 0).sum()], counts_of_counts(real[real > 0])])
    return [pack(total[where[a:b]]) for a, b in zip(cuts, cuts[1:])], stats.astype(np.int64)


def answer_grams(lower):
    """Counts of each question's n-grams; of its histories, which of the counts 1..K occur; of its needed ones, how often, and the lower-order mass of all seen successors.

    lower: probabilities from the questions' lower-order terms.
    """

    def answer(questions: list[list[np.ndarray]]):
        history, h_at = np.unique(np.concatenate([q[0] for q in questions]), return_inverse=True)
        cut_h = np.cumsum([0] + [len(q[0]) for q in questions])
        cut_w = np.cumsum([0] + [len(q[3]) for q in questions])
        of_pair = np.repeat(h_at, np.concatenate([q[2] for q in questions]))
        words = np.concatenate([q[3] for q in questions])
        _, first, where = np.unique(mix(history[of_pair] + words * SALT[1]), return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, where, np.concatenate([q[4] for q in questions]))
        seen = total > 0
        owner, counts = of_pair[first][seen], total[seen]
        mass = np.bincount(owner, lower(np.concatenate([q[5] for q in questions])[first][seen]), minlength=len(history))
        by_count = np.stack([np.bincount(owner[counts == r], minlength=len(history)) for r in range(1, K + 1)], axis=1)
        flags = ((by_count > 0) << np.arange(K)).sum(axis=1).astype(np.uint8)
        replies = []
        for k, q in enumerate(questions):
            mine = h_at[cut_h[k] : cut_h[k + 1]][q[1] > 0]
            replies.append(pack(total[where[cut_w[k] : cut_w[k + 1]]], flags[h_at[cut_h[k] : cut_h[k + 1]]], by_count[mine].reshape(-1).astype(np.int64), mass[mine].view(np.uint64)))
        return replies, counts_of_counts(counts).astype(np.int64)

    return answer


def statistics(answers: DataFrame) -> np.ndarray:
    """Sum of the buckets' statistics: a few numbers per bucket."""
    rows = answers.where(f"kind = {STATS}").select("payload").collect()
    return np.sum([unpack(bytes(r[0]))[0] for r in rows], axis=0) if rows else np.zeros(K + 4, np.int64)


def with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    out = blocks.select("block", "payload")
    for k, a in enumerate(answers):
        mine = a.where(f"kind = {REPLY}").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "payload"))).alias(f"answers{k}"))
        out = out.join(mine, "block", "left")
    return out


def word_answers(found: list[dict]) -> np.ndarray:
    return np.concatenate([unpack(x["payload"])[0] for x in found]) if found else np.zeros(0, np.int64)


def katz_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: int = 7, held_out: int = 2, block_bytes: int = 8 << 20, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A-Z is lower-cased; tokens are words ``[^\\x20\\x09-\\x0D]+`` and one end per
    text. Rows whose crc32(doc_id as text) mod `fold` is not `held_out` train;
    base_score adds one to each unigram count, score is the back-off model's
    log10 probability, both summed over tokens. `order` is the length of the longest
    n-grams. A text of any length is in one block. Null and empty texts are an end
    only; repeated rows count as often as they occur; a null id hashes as the
    empty string; extra columns are ignored. Words are told apart by 64 bits of a
    hash, the successors of a history by 48. Counts have 64 bits. An empty table
    gives an empty one.
    """
    if order < 1:
        raise ValueError("the order is 1 at least")
    spark = ship_package(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (2 * parts - 1).bit_length())
    buckets = 1 << bits
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.expr(f"crc32(coalesce(cast({doc_id} as string), '')) % {fold} = {held_out}").alias("held"), F.col(text).alias("text"))
    blocks = store_bucketed(blocks_of(plain, block_bytes), "blocks", "block", parts)

    def ask_words(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.column(1)[k].as_py())
                counts = block.word_counts()
                cuts = np.searchsorted(block.words >> U64(64 - bits), np.arange(buckets + 1, dtype=np.uint64))
                some = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
                payloads = [pack(block.words[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]].astype(np.int64)) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(payloads, pa.binary())], names=["block", "bucket", "payload"])

    words = store(by_bucket(blocks.mapInArrow(ask_words, "block long, bucket int, payload binary"), parts, answer_words), "words", partition="kind").df
    release(spark)
    stats = statistics(words)
    unigrams = Unigrams(int(stats[0]), int(stats[1]), stats[2:])
    tables, factors = [words], []

    def levels(batch, k: int, last: bool):
        """The block of row k, and its levels as far as they are answered."""
        block = Block(batch.column(1)[k].as_py())
        below = word_level(block, word_answers(batch.column(2)[k].as_py()), unigrams)
        yield block, below
        for length, factor in enumerate(factors, 2):
            grams = Grams(block, below, unigrams.total, buckets)
            below = grams.level(block, below, batch.column(length + 1)[k].as_py() or [], factor, last and length == order)
            yield block, below

    def ask_grams(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                *_, (block, below) = levels(batch, k, False)
                rows = list(Grams(block, below, unigrams.total, buckets).questions(block, below))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["block", "bucket", "payload"])

    for length in range(2, order + 1):
        lower = unigrams.probability if length == 2 else lambda bits_of: bits_of.view(np.float64)
        asked = with_answers(blocks, *tables).mapInArrow(ask_grams, "block long, bucket int, payload binary")
        tables.append(store(by_bucket(asked, parts, answer_grams(lower)), f"grams{length}", partition="kind").df)
        release(spark)
        factors.append(discounts(statistics(tables[-1])[: K + 2]))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield scored(batch, k)

    def scored(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        chance = None
        for block, level in levels(batch, k, True):
            if chance is None:
                of_word, chance = level.counts[block.flat], level.chance[block.flat]
            else:
                some = level.of_token >= 0
                chance[some] = level.chance[level.of_token[some]]
        text = np.repeat(np.arange(len(block.sizes)), block.sizes)
        sums = lambda v: np.bincount(text, v, minlength=len(block.sizes))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(block.doc_ids, pa.int64(), mask=block.known == 0),
                pa.array(block.held > 0),
                pa.array(block.sizes.astype(np.int64)),
                pa.array(sums((of_word > 0).astype(float)).astype(np.int64)),
                pa.array(np.full(len(block.sizes), unigrams.total)),
                pa.array(sums(unigrams.base(of_word))),
                pa.array(sums(np.log10(chance))),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return with_answers(blocks, *tables).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def release(spark) -> None:
    """Let Spark remove the shuffle files of what has just been stored, rather than when memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
