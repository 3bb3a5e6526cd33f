"""Repeated passages by a sparse suffix array.

Suffixes begin at words that the text itself selects: the least of the hashed
ANCHOR-word grams of every window of WINDOW consecutive ones (minimisers). Any
passage of MIN_WORDS = WINDOW + ANCHOR - 1 words that occurs twice selects the same
word in both places, so both occurrences have a suffix there with the same anchor.
Suffixes are sorted by anchor, then by the words that follow, then by those before,
by one range sort over all data; equal anchors form runs. Neighbours in a run are
compared, and a match is extended right and left of the selected word.

Context words are compared by 16 bits, so a match may go a word too far, but none is
missed. An exact check follows: every window of MIN_WORDS words within the matches is
looked up by a 64-bit hash of its words, and only windows of two documents stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.llm.packing import pack, unpack
from tallyloom.store import store, store_bucketed
from tallyloom.llm.textkit import U64, Hasher, Words, mix, ngrams, rows_and_texts
from tallyloom.session import ship_package

MIN_WORDS = 50
ANCHOR = 19
WINDOW = MIN_WORDS - ANCHOR + 1
LEFT, RIGHT = WINDOW - 1, MIN_WORDS - ANCHOR  # words of context that can decide about a match
CONTEXT = 8 + 2 * (LEFT + RIGHT)  # bytes of anchor, words right of it, words left of it
KEY = CONTEXT + 2 + 12  # bytes of a sort key: these, reach to both sides, document, position


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of h[i : i + w] for each i that has a whole window."""
    out, span = h, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def select_words(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the selected suffixes, hashes of all grams) of hashed words; windows never cross texts."""
    n = len(words)
    if n < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = ngrams(words, ANCHOR)[: n - ANCHOR + 1]
    least = window_least(grams, WINDOW)
    whole = owner[MIN_WORDS - 1 :] == owner[: n - MIN_WORDS + 1]
    least, start = least[whole], np.flatnonzero(whole)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # A selected word holds the least hash of some window that covers it (all such words, should hashes tie).
    n_grams = len(grams)
    padded = np.full(n_grams + 2 * WINDOW, np.iinfo(np.uint64).max, np.uint64)
    padded[start + WINDOW - 1] = least
    # Some window that starts in [p - WINDOW + 1, p] has grams[p] as its least value: its least is never above grams[p], so compare with the greatest.
    low = padded.copy()
    low[low == np.iinfo(np.uint64).max] = 0
    greatest = ~window_least(~low, WINDOW)
    best = greatest[:n_grams] == grams
    return np.flatnonzero(best), grams


def reach(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance from each selected word to the nearest gram before it that is not greater, and after it that is less; WINDOW if there is none so near.

    The selected word is the least one of a window exactly if the window ends before both.
    """
    before, after = np.full(len(at), WINDOW, np.uint8), np.full(len(at), WINDOW, np.uint8)
    mine = grams[at]
    for d in range(WINDOW - 1, 0, -1):
        left, right = at - d, at + d
        ok = left >= 0
        before[ok] = np.where(grams[left[ok]] <= mine[ok], d, before[ok])
        ok = right < len(grams)
        after[ok] = np.where(grams[right[ok]] < mine[ok], d, after[ok])
    return before, after


def suffix_keys(data: np.ndarray, off: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
    """(suffixes, KEY) bytes whose lexicographic order is that of the suffixes."""
    words = Words(data, off)
    hashed = Hasher(data).spans(words.starts, words.ends)
    owner = words.owner()
    at, grams = select_words(hashed, owner)
    out = np.zeros((len(at), KEY), np.uint8)
    if not len(at):
        return out
    out[:, :8] = grams[at].astype(">u8").view(np.uint8).reshape(-1, 8)
    # 16 bits of each context word, 1 to 65535; 0 stands for the end of the text.
    short = np.zeros(len(hashed) + LEFT + RIGHT + ANCHOR, np.uint16)
    short[LEFT : LEFT + len(hashed)] = np.maximum(1, (hashed >> U64(48)).astype(np.uint16))
    first, last = words.first[:-1][owner[at]], words.first[1:][owner[at]]
    offsets = np.arange(RIGHT)
    right = short[LEFT + at[:, None] + ANCHOR + offsets]
    right[at[:, None] + ANCHOR + offsets >= last[:, None]] = 0
    offsets = np.arange(LEFT)
    left = short[LEFT + at[:, None] - 1 - offsets]
    left[at[:, None] - 1 - offsets < first[:, None]] = 0
    out[:, 8 : 8 + 2 * RIGHT] = right.astype(">u2").view(np.uint8).reshape(len(at), -1)
    out[:, CONTEXT], out[:, CONTEXT + 1] = reach(grams, at)
    out[:, 8 + 2 * RIGHT : CONTEXT] = left.astype(">u2").view(np.uint8).reshape(len(at), -1)
    out[:, -12:-4] = (doc_ids[owner[at]].astype(np.uint64) ^ U64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, -4:] = (at - first).astype(">u4").view(np.uint8).reshape(-1, 4)
    return out


def suffixes(docs: DataFrame) -> DataFrame:
    """One binary column: the sort keys of all selected suffixes."""

    def run(batches):
        for part, data, off in rows_and_texts(batches):
            keys = suffix_keys(data, off, part.column(0).to_numpy(zero_copy_only=False))
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, (len(keys) + 1) * KEY, KEY, dtype=np.int32)), pa.py_buffer(keys)])], names=["key"])

    return docs.select("doc_id", "text").mapInArrow(run, "key binary")


def _equal_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading words that rows of a and b share; an end of text is never shared."""
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(axis=1)


class Run:
    """Consecutive keys, parsed."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.anchor = np.ascontiguousarray(keys[:, :8]).view(">u8").reshape(n).astype(np.uint64)
        self.right = np.ascontiguousarray(keys[:, 8 : 8 + 2 * RIGHT]).view(">u2").reshape(n, RIGHT).astype(np.uint16)
        self.left = np.ascontiguousarray(keys[:, 8 + 2 * RIGHT : CONTEXT]).view(">u2").reshape(n, LEFT).astype(np.uint16)
        self.before, self.after = keys[:, CONTEXT].astype(np.int64), keys[:, CONTEXT + 1].astype(np.int64)
        self.doc = (np.ascontiguousarray(keys[:, -12:-4]).view(">u8").reshape(n).astype(np.uint64) ^ U64(1 << 63)).view(np.int64)
        self.at = np.ascontiguousarray(keys[:, -4:]).view(">u4").reshape(n).astype(np.int64)


def nearest_before(doc: np.ndarray) -> np.ndarray:
    """For each row, the nearest row above it with a smaller doc; -1 where there is none.

    Least docs of 1, 2, 4... rows form a tree. A row climbs until the subtree before it
    holds a smaller doc, then descends to the last row that does: two passes over the
    levels, so the work is n log n whatever the order of the rows.
    """
    top = np.iinfo(np.int64).max
    levels = [doc.astype(np.int64)]
    while len(levels[-1]) > 1:
        below = levels[-1] if len(levels[-1]) % 2 == 0 else np.append(levels[-1], top)
        levels.append(np.minimum(below[::2], below[1::2]))
    out = np.full(len(doc), -1)
    rows = node = np.arange(len(doc))
    turns = []  # per level, the rows that descend from there and the node they start with
    for level in levels:
        ends = np.zeros(len(rows), bool)
        right = np.flatnonzero(node & 1)
        ends[right] = level[node[right] - 1] < doc[rows[right]]
        turns.append((rows[ends], node[ends] - 1))
        rows, node = rows[~ends], node[~ends] >> 1
    rows = node = np.zeros(0, np.int64)
    for level, (new, start) in zip(levels[::-1], turns[::-1]):
        last = np.minimum(2 * node + 1, len(level) - 1)
        node = np.where(level[last] < doc[rows], last, 2 * node)
        rows, node = np.concatenate([rows, new]), np.concatenate([node, start])
    out[rows] = node
    return out


def nearest_lower(doc: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the nearest row above and below it in its run with a smaller doc; -1 where there is none."""
    above = nearest_before(doc)
    below = nearest_before(doc[::-1])[::-1]
    below = np.where(below >= 0, len(doc) - 1 - below, -1)
    return tuple(np.where((best >= 0) & (run[best] == run), best, -1) for best in (above, below))


#: Rows of one anchor that a task compares at once: some 7 MB of keys.
LONGEST_RUN = 50_000

FOUND, ASKED = 0, 1
#: Columns of what compare() gives: FOUND rows, then ASKED rows.
FOUND_TYPES = (np.int64, np.int32, np.int32, np.int32, np.int32, np.int64)  # document, start, stop, low start, low stop, first document
ASKED_TYPES = (np.uint64, np.int64, np.int32)  # window's hash, document, start


def left_order(r: "Run", run: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rows sorted by run, then by the words before the anchor."""
    text = np.zeros((len(rows), 8 + 2 * LEFT), np.uint8)
    text[:, :8] = run[rows].astype(">u8").view(np.uint8).reshape(-1, 8)
    text[:, 8:] = r.left[rows].astype(">u2").view(np.uint8).reshape(len(rows), -1)
    return rows[np.argsort(text.view(f"S{text.shape[1]}").reshape(-1), kind="stable")]


def other_documents(doc: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the nearest rows above and below it in its run with another doc; -1 where there is none."""
    n = len(doc)
    change = np.concatenate([[True], (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])])
    start = np.flatnonzero(change)
    block = np.cumsum(change) - 1
    above, below = start[block] - 1, np.append(start[1:], n)[block]
    above[(above >= 0) & (run[above] != run)] = -1
    below[(below < n) & (run[np.minimum(below, n - 1)] != run)] = n
    below[below == n] = -1
    return above, below


def greatest(words: np.ndarray, n: int, neighbours: tuple[np.ndarray, ...], places: np.ndarray) -> np.ndarray:
    """Most words that each of n rows shares with one of its neighbours (row numbers within `places`, or -1)."""
    out = np.zeros(n, np.int64)
    for other in neighbours:
        ok = other >= 0
        me, you = places[ok], places[other[ok]]
        np.maximum.at(out, me, _equal_words(words[me], words[you]))
    return out


def windows_within(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bit k is set where a window of MIN_WORDS words that begins k words before the anchor fits into a match that goes so far."""
    low = np.clip(MIN_WORDS - ANCHOR - right, 0, LEFT + 1).astype(np.uint64)
    high = (np.clip(left, -1, LEFT) + 1).astype(np.uint64)
    bits = (U64(1) << high) - U64(1)
    return bits & ~((U64(1) << low) - U64(1))


def common_row(keys: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each run, the first row of its most frequent context: what most near copies were made from."""
    change = np.concatenate([[True], (keys[1:, :CONTEXT] != keys[:-1, :CONTEXT]).any(axis=1)])
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, len(keys)))
    order = np.lexsort((-size, run[start]))
    first = np.concatenate([[True], np.diff(run[start][order]) > 0])
    return start[order[first]]


def compare(keys: np.ndarray, touches_edge: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]] | None:
    """(FOUND columns, ASKED columns) of sorted keys in whole runs.

    Each row is compared with its nearest neighbours in other documents, with
    the nearest ones of a smaller doc_id, with the run's most common row and with
    its row of the smallest doc_id. Neighbours share the most words to the right
    that any such row does; the same in the order of the words before share the
    most to the left.
    FOUND: words start..stop of doc_id stand in other documents too, at least
    MIN_WORDS of them; low_start..low_stop in ones of a smaller id; the
    last column is the smallest partner met.
    ASKED: windows of MIN_WORDS words that have their least gram here and lie
    within both bounds, but in no match found, and such windows of a run that goes
    on in another partition, are listed by their hash, to be matched exactly later:
    for each row that lacks them, and for the smallest and the greatest document
    among all rows that have them. So no repeated window is left out.
    """
    r = Run(keys)
    n = len(keys)
    run = np.cumsum(np.concatenate([[0], (r.anchor[1:] != r.anchor[:-1]).astype(np.int64)]))
    sizes = np.bincount(run)
    edge = touches_edge[run]
    live = np.flatnonzero((sizes[run] > 1) | edge)
    if not len(live):
        return None
    any_doc, low_doc = other_documents(r.doc[live], run[live]), nearest_lower(r.doc[live], run[live])
    least_row = np.lexsort((r.doc, run))[np.searchsorted(run, np.arange(len(sizes)))]
    least_doc = r.doc[least_row]
    most_doc = np.maximum.reduceat(r.doc, np.searchsorted(run, np.arange(len(sizes))))
    pivots = [row[run[live]] for row in (common_row(keys, run), least_row)]
    have, have_low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    far = {False: (np.full(n, -1), np.full(n, -1)), True: (np.full(n, -1), np.full(n, -1))}
    partner = np.full(n, np.iinfo(np.int64).max)
    for other in [*[np.where(o >= 0, live[o], -1) for o in (*any_doc, *low_doc)], *pivots]:
        ok = other >= 0
        me, you = live[ok], other[ok]
        apart = r.doc[me] != r.doc[you]
        me, you = me[apart], you[apart]
        right, left = _equal_words(r.right[me], r.right[you]), _equal_words(r.left[me], r.left[you])
        hit = ANCHOR + right + left >= MIN_WORDS
        me, you, right, left = me[hit], you[hit], right[hit], left[hit]
        within, low = windows_within(left, right), r.doc[you] < r.doc[me]
        have[me] |= within
        have_low[me] |= np.where(low, within, U64(0))
        partner[me] = np.minimum(partner[me], r.doc[you])
        for lower, rows in ((False, slice(None)), (True, low)):
            for bound, value in zip(far[lower], (left, right)):
                bound[me[rows]] = np.maximum(bound[me[rows]], value[rows])
    found = np.flatnonzero(have)
    left, right = (b[found] for b in far[False])
    low_left, low_right = (b[found] for b in far[True])
    some = low_left >= 0
    columns = [r.doc[found], r.at[found] - left, r.at[found] + ANCHOR + right, np.where(some, r.at[found] - low_left, -1), np.where(some, r.at[found] + ANCHOR + low_right, -1), partner[found]]
    asked = [np.zeros(0, t) for t in ASKED_TYPES]

    own = windows_within(np.minimum(r.before - 1, LEFT), np.minimum(r.after - 1, RIGHT))
    maybe = ((own & ~have) != 0) & (least_doc[run] < most_doc[run]) | ((own & ~have_low) != 0) & (r.doc > least_doc[run])
    pending = np.zeros(len(sizes), bool)
    pending[run[maybe & (sizes[run] > 2)]] = True
    rows = np.flatnonzero(pending[run])
    may = np.where(edge, own, U64(0))  # windows to list
    lacks = np.where(edge, own & ~(have & have_low), U64(0))  # those that the row itself has no match for
    if len(rows):
        turned = left_order(r, run, rows)
        bound = own & windows_within(greatest(r.left, n, other_documents(r.doc[turned], run[turned]), turned), greatest(r.right, n, any_doc, live))
        bound_low = own & windows_within(greatest(r.left, n, nearest_lower(r.doc[turned], run[turned]), turned), greatest(r.right, n, low_doc, live))
        missing = np.zeros(n, np.uint64)
        missing[rows] = ((bound & ~have) | (bound_low & ~have_low))[rows]
        of_run = np.zeros(len(sizes), np.uint64)
        np.bitwise_or.at(of_run, run, missing)
        may = np.where(edge, own, bound & of_run[run])
        lacks = np.where(edge, lacks, missing)
    rows = np.flatnonzero(may)
    if len(rows):
        line = np.concatenate([r.left[rows][:, ::-1], r.right[rows]], axis=1).astype(np.uint64)
        power = np.multiply.accumulate(np.full(LEFT + RIGHT, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(mix(line + U64(1)) * power, axis=1)], axis=1)
        solid = np.concatenate([np.zeros((len(rows), 1), np.int64), np.cumsum(line == 0, axis=1)], axis=1)
        listed_rows, listed_k, listed_h = [], [], []
        for k in range(LEFT + 1):  # the window begins k words before the selected one
            lo, hi = LEFT - k, LEFT + MIN_WORDS - ANCHOR - k
            listed = (solid[:, hi] == solid[:, lo]) & (may[rows] >> U64(k) & U64(1)).astype(bool)
            listed_rows.append(rows[listed])
            listed_k.append(np.full(int(listed.sum()), k))
            listed_h.append(mix((sums[listed, hi] - sums[listed, lo]) ^ (r.anchor[rows[listed]] + U64(k))))
        who, k, h = (np.concatenate(x) for x in (listed_rows, listed_k, listed_h))
        # Rows that lack the window ask; of the others, the smallest and the greatest document answer for all.
        order = np.lexsort((r.doc[who], h))
        lead = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
        keep = (lacks[who] >> k.astype(np.uint64) & U64(1)).astype(bool)
        keep[order[lead]] = True
        keep[order[np.roll(lead, -1)]] = True
        who, k, h = who[keep], k[keep], h[keep]
        asked = [h, r.doc[who], r.at[who] - k]
    return columns, asked


def by_bucket(kind: int, columns: list[np.ndarray], bucket: np.ndarray, types: tuple) -> list[tuple[int, int, bytes]]:
    """(kind, bucket, packed columns) of rows dealt by bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(bucket) else np.zeros(0, int)
    columns = [c[order].astype(t) for c, t in zip(columns, types)]
    return [(kind, int(bucket[order[lo]]), pack(*(c[lo:hi] for c in columns))) for lo, hi in zip(edges, np.append(edges[1:], len(bucket)))]


def to_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["kind", "bucket", "payload"])


def document_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % U64(buckets)).astype(np.int64)


def joined(payloads: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*(unpack(p) for p in payloads))]


def buckets_of(batches) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, columns) of rows bucket, payload that are sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != at and held:
                yield at, joined(held)
                held = []
            at = bucket
            held.append(payload)
    if held:
        yield at, joined(held)


def neighbours(keys: DataFrame, buckets: int, longest_run: int = LONGEST_RUN) -> DataFrame:
    """kind, bucket, payload of range-sorted partitions.

    A run goes to compare() whole, unless it has more than longest_run rows: then it is
    cut there, like a run that crosses the edge of a partition, and window hashes settle
    the cut. So a task holds a bounded number of rows whatever a passage's frequency.
    """

    def run(batches):
        held, n_held, wanted = [], 0, 20_000
        first, made, n_made = True, ([], []), 0

        def take(part: np.ndarray, last: bool) -> None:
            nonlocal first, n_made
            anchors = part[:, :8]
            edges = np.zeros(1 + int((anchors[1:] != anchors[:-1]).any(axis=1).sum()), bool)
            edges[0] |= first
            edges[-1] |= last
            first = last
            if (got := compare(part, edges)) is not None:
                for into, columns in zip(made, got):
                    into.append(columns)
                    n_made += len(columns[0])

        def emit() -> pa.RecordBatch:
            nonlocal made, n_made
            found, asked = ([np.concatenate(c) for c in zip(*m)] for m in made)
            rows = by_bucket(FOUND, found, document_bucket(found[0], buckets), FOUND_TYPES) + by_bucket(ASKED, asked, (asked[0] % U64(buckets)).astype(np.int64), ASKED_TYPES)
            made, n_made = ([], []), 0
            return to_batch(rows)

        for batch in batches:
            column = batch.column(0)
            _, offsets, data = column.buffers()
            lo = np.frombuffer(offsets, np.int32)[column.offset]
            rows = np.frombuffer(data, np.uint8)[lo : lo + len(column) * KEY].reshape(-1, KEY)
            for lo in range(0, len(rows), longest_run):
                held.append(rows[lo : lo + longest_run].copy())
                n_held += len(held[-1])
                if n_held < min(wanted, longest_run):
                    continue
                part = np.concatenate(held)
                differs = np.flatnonzero((part[:, :8] != part[-1, :8]).any(axis=1))
                if len(differs):
                    cut = int(differs[-1]) + 1
                    take(part[:cut], False)
                    part = part[cut:].copy()
                elif len(part) >= longest_run:
                    take(part, True)
                    part = part[:0]
                held, n_held = [part], len(part)
                wanted = max(20_000, 2 * n_held)
                if n_made > 300_000:
                    yield emit()
        if n_held:
            take(np.concatenate(held), True)
        if n_made:
            yield emit()

    return keys.mapInArrow(run, "kind int, bucket int, payload binary")


def answers(asked: DataFrame, buckets: int) -> DataFrame:
    """kind, bucket, payload: FOUND rows of the windows that two documents listed."""

    def run(batches):
        for _, (h, doc, start) in buckets_of(batches):
            order = np.lexsort((doc, h))
            h, doc, start = h[order], doc[order], start[order]
            lead = np.concatenate([[True], h[1:] != h[:-1]])
            first = np.flatnonzero(lead)
            group = np.cumsum(lead) - 1
            least, most = doc[first][group], doc[np.append(first[1:], len(h)) - 1][group]
            ok = least < most
            doc, start, least, most = doc[ok], start[ok], least[ok], most[ok]
            if len(doc):
                low = least < doc
                columns = [doc, start, start + MIN_WORDS, np.where(low, start, -1), np.where(low, start + MIN_WORDS, -1), np.where(low, least, most)]
                yield to_batch(by_bucket(FOUND, columns, document_bucket(doc, buckets), FOUND_TYPES))

    return asked.mapInArrow(run, "kind int, bucket int, payload binary")


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row order, first row of each span, its start, its stop): spans of a document joined where they overlap or touch."""
    order = np.lexsort((start, doc))
    d, a, b = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    number = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1]).astype(np.int64)]))
    wide = 1 << 33
    reached = np.maximum.accumulate(number * wide + b)
    new = np.concatenate([[True], number[1:] * wide + a[1:] > reached[:-1]])
    first = np.flatnonzero(new)
    return order, first, a[first], np.maximum.reduceat(b, first)


def merged_spans(rows: DataFrame, parts: int) -> DataFrame:
    """doc_id, spans (start, stop, copied, first), copies (start, stop) from FOUND rows: one row per document."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("copied", pa.int64()), ("first", pa.int64())]))
    copy = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for _, (doc, start, stop, low_start, low_stop, least) in buckets_of(batches):
            order, first, a, b = merged(doc, start, stop)
            owner, least = doc[order][first], np.minimum.reduceat(least[order], first)
            low = low_start >= 0
            if low.any():
                low_order, low_first, c, d = merged(doc[low], low_start[low], low_stop[low])
                low_owner = doc[low][low_order][low_first]
            else:
                c = d = low_owner = np.zeros(0, np.int64)
            ids = np.unique(owner)
            number, low_number = np.searchsorted(ids, owner), np.searchsorted(ids, low_owner)
            wide = 1 << 33
            within = np.searchsorted(number * wide + a, low_number * wide + c, "right") - 1
            copied = np.bincount(within, d - c, minlength=len(a)).astype(np.int64)
            cut = lambda n: pa.array(np.searchsorted(n, np.arange(len(ids) + 1)).astype(np.int32))
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (a, b, copied, least)], names=["start", "stop", "copied", "first"])
            copies = pa.StructArray.from_arrays([pa.array(c), pa.array(d)], names=["start", "stop"])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(cut(number), spans).cast(span), pa.ListArray.from_arrays(cut(low_number), copies).cast(copy)], names=["doc_id", "spans", "copies"])

    dealt = rows.select("bucket", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "doc_id long, spans array<struct<start:long,stop:long,copied:long,first:long>>, copies array<struct<start:long,stop:long>>")


class WindowBlock:
    """The windows within the matches of a block's texts: each row's document, its runs of consecutive windows, and which distinct window each one is."""

    def __init__(self, payload: bytes):
        self.ids, self.run_row, self.run_start, self.run_count, self.of_window, self.hashes, self.least, self.most = unpack(payload)

    @staticmethod
    def packed(ids: list, runs: list, hashes: list) -> bytes:
        ids = np.concatenate(ids)
        run_row, run_start, run_count = (np.concatenate(c) for c in zip(*runs))
        distinct, of_window = np.unique(np.concatenate(hashes), return_inverse=True)
        doc = ids[np.repeat(run_row, run_count)]
        order = np.argsort(of_window, kind="stable")
        first = np.searchsorted(of_window[order], np.arange(len(distinct)))
        least, most = (f.reduceat(doc[order], first) if len(distinct) else doc for f in (np.minimum, np.maximum))
        return pack(ids, *(x.astype(np.uint32) for x in (run_row, run_start, run_count, of_window)), distinct, least, most - least)

    def questions(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, payload): distinct windows with the smallest document here and how far the greatest is from it."""
        cuts = np.searchsorted(self.hashes >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            here = slice(cuts[b], cuts[b + 1])
            yield b, pack(np.diff(self.hashes[here], prepend=U64(0)), self.least[here], self.most[here])

    def found(self, least: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
        """FOUND columns from the smallest document of each distinct window and the distance of the greatest."""
        row = np.repeat(self.run_row, self.run_count).astype(np.int64)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.run_count, dtype=np.int64) - self.run_count, self.run_count)
        start = np.repeat(self.run_start, self.run_count).astype(np.int64) + place
        out = [[np.zeros(0, t)] for t in FOUND_TYPES]
        some = (most > 0)[self.of_window]
        low = some & (least[self.of_window] < self.ids[row])
        for rows, is_low in ((some, False), (low, True)):
            if rows.any():
                order, first, a, b = merged(row[rows], start[rows], start[rows] + MIN_WORDS)
                docs = self.ids[row[rows][order][first]]
                ends = (a, b) if is_low else (np.full(len(a), -1),) * 2
                for column, values in zip(out, (docs, a, b, *ends, np.minimum.reduceat(least[self.of_window[rows]][order], first))):
                    column.append(values)
        return [np.concatenate(c) for c in out]


def window_blocks(texts: DataFrame, block_bytes: int, parts: int) -> DataFrame:
    """block, payload: WindowBlock of rows doc_id, text, spans."""

    def run(batches):
        start, made = TaskContext.get().partitionId() << 32, 0
        ids, runs, hashes, n_rows, held = [], [], [], 0, 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([start + made], pa.int64()), pa.array([WindowBlock.packed(ids, runs, hashes)], pa.binary())], names=["block", "payload"])

        for part, data, off in rows_and_texts(batches):
            words = Words(data, off)
            grams = ngrams(Hasher(data).spans(words.starts, words.ends), MIN_WORDS)
            spans = part.column(part.schema.get_field_index("spans"))
            flat = spans.flatten()
            row = np.repeat(np.arange(part.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
            begin = flat.field("start").to_numpy(zero_copy_only=False)
            stop = np.minimum(flat.field("stop").to_numpy(zero_copy_only=False), words.counts[row])
            count = np.maximum(0, stop - begin - MIN_WORDS + 1)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            hashes.append(grams[np.repeat(words.first[:-1][row] + begin, count) + place])
            ids.append(part.column(0).to_numpy(zero_copy_only=False))
            runs.append((row + n_rows, begin, count))
            n_rows += part.num_rows
            held += len(data)
            if held >= block_bytes:
                yield emit()
                made, ids, runs, hashes, n_rows, held = made + 1, [], [], [], 0, 0
        if ids:
            yield emit()

    return store_bucketed(texts.select("doc_id", "text", "spans").mapInArrow(run, "block long, payload binary"), "windows", "block", parts)


def checked(texts: DataFrame, parts: int, buckets: int, block_bytes: int) -> DataFrame:
    """bucket, payload: FOUND rows of the windows that two documents have, out of those in rows doc_id, text, spans.

    Windows are compared whole, by 64-bit hashes of their words.

    A block sends each distinct window once to the bucket of its hash, with its
    smallest and greatest document, and gets those of all blocks back: a passage that
    very many documents have costs a row per block.
    """
    bits = max(6, (2 * parts - 1).bit_length())
    blocks = window_blocks(texts, block_bytes, parts)

    def ask(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(WindowBlock(payload.as_py()).questions(bits))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["block", "bucket", "payload"])

    def answer(batches):
        at, asked, of = None, [], []

        def emit():
            hashes = [np.cumsum(q[0], dtype=np.uint64) for q in asked]
            _, where = np.unique(np.concatenate(hashes), return_inverse=True)
            order = np.argsort(where, kind="stable")
            first = np.flatnonzero(np.diff(where[order], prepend=-1))
            least, most = np.concatenate([q[1] for q in asked]), np.concatenate([q[1] + q[2] for q in asked])
            least, most = np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)
            cuts = np.cumsum([0, *map(len, hashes)])
            payloads = [pack(least[where[a:b]], (most - least)[where[a:b]]) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array([at] * len(of), pa.int32()), pa.array(payloads, pa.binary())], names=["block", "bucket", "payload"])

        for batch in batches:
            for block, bucket, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at and asked:
                    yield emit()
                    asked, of = [], []
                at = bucket
                asked.append(unpack(payload))
                of.append(block)
        if asked:
            yield emit()

    def tell(batches):
        for batch in batches:
            for payload, found in zip(batch.column(0), batch.column(1)):
                parts_of = [unpack(x["payload"]) for x in found.as_py() or []]
                if parts_of:
                    columns = WindowBlock(payload.as_py()).found(*(np.concatenate(c) for c in zip(*parts_of)))
                    if len(columns[0]):
                        yield to_batch(by_bucket(FOUND, columns, document_bucket(columns[0], buckets), FOUND_TYPES))

    asked = blocks.mapInArrow(ask, "block long, bucket int, payload binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    replies = asked.mapInArrow(answer, "block long, bucket int, payload binary").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "payload"))).alias("found"))
    return blocks.join(replies, "block", "left").select("payload", "found").mapInArrow(tell, "kind int, bucket int, payload binary").select("bucket", "payload")


def document_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20, longest_run: int = LONGEST_RUN) -> DataFrame:
    """doc_id, spans (start, stop, copied, first), copies (start, stop): a row per document that shares a passage.

    spans: runs of words that passages of MIN_WORDS words or more cover which
    stand in other documents too; copied counts the words of those in documents of a
    smaller id, first is the smallest document that has a passage of the span, itself
    included. copies: the spans of copied words. Every window of MIN_WORDS words that
    two documents share is in a span of each, and in a copy of all but the smallest
    id; no other word is. So the rows don't depend on how the data are dealt.
    """
    spark = ship_package(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(65_535, max(64, 2 * parts))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    ordered = suffixes(plain).repartitionByRange(parts, "key").sortWithinPartitions("key")
    found = store(neighbours(ordered, buckets, longest_run), "matches", partition="kind").df
    dealt = lambda df: df.select("bucket", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket")
    direct = found.where(f"kind = {FOUND}").select("bucket", "payload")
    rows = direct.unionByName(answers(dealt(found.where(f"kind = {ASKED}")), buckets).select("bucket", "payload"))
    maybe = store(merged_spans(rows, parts).select(F.col("doc_id").alias(SPAN_DOC), "spans"), "maybe").df
    few = maybe.count() <= MOST_SENT
    texts = plain.join(F.broadcast(maybe) if few else maybe, F.col("doc_id") == F.col(SPAN_DOC))
    return merged_spans(checked(texts, parts, buckets, block_bytes), parts)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, n_words, copied_words, first_doc_id: a row per span (see document_spans()).

    Words are ``[^\\x20\\x09-\\x0D]+``; copied_words is 0 for the first
    occurrence. Repeats within one document don't count. Null and empty texts, and
    texts of fewer words, have no span; texts of any length are read whole; rows
    without an id are left out; rows that share an id count as one document, ties of
    equal passages go to the smallest id. Extra columns are ignored; an empty table
    gives an empty one. Windows of words are told apart by 64-bit hashes.
    """
    rows = document_spans(docs, doc_id, text).select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", F.col("s.start").alias("start_word"), F.col("s.stop").alias("end_word"), (F.col("s.stop") - F.col("s.start")).alias("n_words"), F.col("s.copied").alias("copied_words"), F.col("s.first").alias("first_doc_id"))


MOST_SENT = 300_000  # rows of spans that are broadcast, some 20 MB; beyond, both sides are shuffled
SPANS, SPAN_DOC = "__tallyloom_spans", "__tallyloom_doc"


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stands between two of them goes too."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = Words(raw, np.array([0, len(raw)]))
    keep = np.ones(len(raw), bool)
    for lo, hi in spans:
        if lo < len(words.ends):
            keep[words.starts[lo] : words.ends[min(hi, len(words.ends)) - 1]] = False
    return raw[keep].tobytes().decode()


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut out of all documents but the one with the smallest id.

    n_chars, where there is one, is counted anew; a document whose words all go
    is left out. Texts without a copied passage don't change, null and empty ones
    among them, nor do rows without an id. Rows that share an id are one document and
    keep what they share; texts of any length are cut whole; an empty table gives an
    empty one, of the same columns. Spans, not texts, are gathered per document; the
    join with the documents is by id.
    """
    spans = document_spans(docs).where(F.size("copies") > 0).select(F.col("doc_id").alias(SPAN_DOC), F.col("copies").alias(SPANS))
    spans = store(spans, "copies").df
    few = spans.count() <= MOST_SENT
    both = docs.join(F.broadcast(spans) if few else spans, docs.doc_id == spans[SPAN_DOC], "left")
    text_at = docs.columns.index("text")
    schema = docs.schema
    out_schema = StructType([*schema.fields, both.schema[SPANS]])

    def run(batches):
        for batch in batches:
            found = batch.column(batch.schema.get_field_index(SPANS))
            columns = [batch.column(k) for k in range(len(schema))]
            if found.null_count < len(found):
                texts = columns[text_at].to_pylist()
                for k, spans_of in enumerate(found.to_pylist()):
                    if spans_of and texts[k]:
                        texts[k] = cut_words(texts[k], [(s["start"], s["stop"]) for s in spans_of])
                columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*schema.names, SPANS])

    cut = both.select(*[docs[c] for c in docs.columns], SPANS).mapInArrow(run, out_schema)
    kept = cut.where(F.col(SPANS).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(SPANS).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return kept.select(*docs.columns)
