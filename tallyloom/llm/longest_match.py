"""Greedy longest-match piece counts in linear time."""

from __future__ import annotations

import base64
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textkit import buffers
from tallyloom.session import ship_package

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class PieceCounter:
    """A vocabulary trie with failure links that count instead of cutting.

    Node u stands for the string from the root. When no edge fits, the greedy
    matcher would cut off the longest pieces of u until what is left can go on;
    fail[u] is the node that is left and popped[u] how many pieces were cut. Both
    are worked out once, breadth first, so a word costs one step per byte plus at
    most as many failure steps, and no piece is built.
    """

    def __init__(self, vocabulary: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in vocabulary:
            at = 0
            for b in piece:
                nxt = self.next[at].get(b)
                if nxt is None:
                    nxt = self.next[at][b] = len(self.next)
                    self.next.append({})
                    is_piece.append(False)
                at = nxt
            is_piece[at] = bool(piece) or is_piece[at]
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for b, v in self.next[u].items():
                todo.append(v)
                if is_piece[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                z, count = self.fail[u], self.popped[u]
                while z >= 0 and b not in self.next[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][b], count

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match cut; 1 (one unknown piece) where it gets stuck."""
        edges, fail, popped = self.next, self.fail, self.popped
        u = total = 0
        for b in word:
            v = edges[u].get(b)
            while v is None:
                total += popped[u]
                u = fail[u]
                if u < 0:
                    return 1
                v = edges[u].get(b)
            u = v
        while u > 0:
            total += popped[u]
            u = fail[u]
        return 1 if u < 0 else total


def rank_pieces(path: str) -> list[bytes]:
    """The pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


_built: list = [None, None]


class _Lengths(dict):
    """Counts of words met so far; emptied when full, so memory is bounded."""

    def __init__(self, counter: PieceCounter, prefix: bytes, most: int):
        self.counter, self.prefix, self.most = counter, prefix, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self.counter.count(self.prefix + word)
        if len(word) <= 64:
            self[word] = n
        return n


def piece_counts(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text", prefix: bytes = b" ", cache_words: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_words, n_pieces of every text.

    Each word ``[^\\x20\\x09-\\x0D]+``, with `prefix` before it, is cut greedily
    into the longest pieces of the vocabulary; a word that can't be cut counts
    one. Null and empty texts have no pieces; texts of any length are counted whole;
    repeated rows are counted alike; a null id stays null; extra columns are ignored;
    an empty table gives an empty one. The vocabulary is a fixed file of a few hundred
    KB that goes out with the task; nothing is shuffled.
    """
    spark = ship_package(docs.sparkSession)
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        if _built[0] is not sent.value:  # a worker keeps the trie for its next task
            _built[:] = [sent.value, PieceCounter(sent.value)]
        lengths = _Lengths(_built[1], prefix, cache_words)
        known = lengths.__getitem__
        for batch in batches:
            data, off = buffers(batch.column(1))
            n_words, n_pieces = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                words = WORD.findall(data[off[k] : off[k + 1]])
                n_words[k] = len(words)
                n_pieces[k] = sum(map(known, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n_words), pa.array(n_pieces)], names=["doc_id", "n_bytes", "n_words", "n_pieces"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_pieces long")
