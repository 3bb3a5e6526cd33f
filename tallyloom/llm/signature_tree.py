"""N-gram Jaccard self-join with signature trees.

1. Routing: sets that can link meet. All shingles have one order, rarest first. Two
   sets that link share at least ceil(threshold * size) elements, so the first one
   that they share stands among the first size - ceil(threshold * size) + 1 of
   each. Elements that only one set has need no meeting place: a set that is mostly
   its own goes nowhere, and sets without a common element never meet.
2. Join: sets that meet make clusters, whose sets are the leaves of a tree. Nodes hold
   OR-combined token bitmaps and size ranges; a dual traversal drops node pairs
   whose largest possible overlap is too small, and pairs already in one class.
3. Links make components; equal sets are one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tallyloom.llm.components import components
from tallyloom.llm.packing import pack, unpack
from tallyloom.store import store, store_bucketed
from tallyloom.llm.textkit import SALT, U64, Hasher, Words, lower, mix, ngrams, rows_and_texts, runs, to_signed
from tallyloom.session import ship_package

# ---------------------------------------------------------------- sets


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct n-word shingles, ascending.

    A-Z is lower-cased; a text of fewer words is one shingle, one without words
    has none.
    """
    low = lower(data)
    words = Words(low, off)
    hashed = Hasher(low).spans(words.starts, words.ends)
    owner = words.owner()
    out, at = [], []
    if len(hashed) >= n:
        starts = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])
        out.append(ngrams(hashed, n)[starts])
        at.append(owner[starts])
    for k in range(1, n):
        texts = np.flatnonzero(words.counts == k)
        if len(texts):
            out.append(mix(ngrams(hashed, k)[words.first[texts]] + U64(k * int(SALT[3]) % (1 << 64))))
            at.append(texts)
    texts = len(off) - 1
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    who = np.concatenate(at) if at else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(who[order].astype(np.uint16 if texts < 65_536 else np.int64), kind="stable")]
    h, who = h[order], who[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    h, who = h[fresh], who[fresh]
    return h, np.searchsorted(who, np.arange(texts + 1))


def set_hashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash per set; 0 for an empty one."""
    out = np.zeros(len(at) - 1, np.uint64)
    full = at[:-1] < at[1:]
    with np.errstate(over="ignore"):
        if full.any():
            out[full] = mix(np.add.reduceat(mix(h), at[:-1][full]) + np.diff(at)[full].astype(np.uint64) * SALT[0])
    return out


# ---------------------------------------------------------------- routing

KEY_SHIFT = 16  # counts know a shingle by the upper 48 bits of its hash; a collision only makes it seem less rare
TEXTS, SETS = 0, 1


def least_overlap(sizes: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Elements that a set of this size shares with any set that it links with."""
    return -(-sizes * threshold.numerator // threshold.denominator)


def size_bands(sizes: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Numbers of size ranges; the sizes of two sets that link are in one range or in neighbours."""
    hi = [0]
    while hi[-1] < (sizes.max() if len(sizes) else 0):
        hi.append(max(hi[-1] + 1, int(Fraction(hi[-1] + 1) / threshold)))
    return np.searchsorted(np.array(hi), sizes, "left")


def rarity(counts: np.ndarray) -> np.ndarray:
    """Ranks 0 to 255 that rise with the count; 0 for 1."""
    return np.where(counts > 1, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(counts, 1)))), 0).astype(np.uint8)


class BlockSets:
    """The distinct non-empty sets of a block of texts, each once, and their elements' keys in ascending order."""

    def __init__(self, payload: bytes, n: int):
        data, sizes = unpack(payload)
        off = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        parts = [shingle_sets(part, cuts, n) for _, _, part, cuts in runs(data, off)]
        hashes = np.concatenate([set_hashes(h, at) for h, at in parts])
        sizes = np.concatenate([np.diff(at) for _, at in parts])
        one = np.zeros(len(sizes), bool)
        one[np.unique(hashes, return_index=True)[1]] = True
        one &= sizes > 0
        self.h = np.concatenate([h for h, _ in parts])[np.repeat(one, sizes)]
        self.sizes, self.routes = sizes[one], to_signed(hashes[one])
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.keys, self.of_element, self.counts = np.unique(self.h >> U64(KEY_SHIFT), return_inverse=True, return_counts=True)

    def questions(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, payload): keys and in how many of these sets each is; buckets are ranges of keys."""
        buckets = 1 << bits
        cuts = np.searchsorted(self.keys >> U64(64 - KEY_SHIFT - bits), np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            keys = self.keys[cuts[b] : cuts[b + 1]]
            yield b, pack(np.diff(keys, prepend=U64(0)), self.counts[cuts[b] : cuts[b + 1]].astype(np.uint32))

    def meeting_places(self, ranks: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
        """(place, route) rows from the rank of each key: any two linked sets have a place in common."""
        rank = ranks[self.of_element]
        common = rank > 0
        first = self.sizes - least_overlap(self.sizes, threshold) + 1
        alone = self.sizes - np.bincount(self.owner[common], minlength=len(self.sizes))
        rows = (alone < first)[self.owner]
        h, owner, rank, common = self.h[rows], self.owner[rows], rank[rows], common[rows]
        order = np.lexsort((h, rank, owner))
        h, common = h[order], common[order]  # owners stay in place
        if not len(h):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        lead = np.concatenate([[True], owner[1:] != owner[:-1]])
        position = np.arange(len(h)) - np.flatnonzero(lead)[np.cumsum(lead) - 1]
        keep = common & (position < first[owner])
        h, owner = h[keep], owner[keep]
        band = size_bands(self.sizes, threshold)[owner].astype(np.uint64)
        with np.errstate(over="ignore"):
            places = [mix(h ^ mix((band + U64(k)) * SALT[1])) for k in (0, 1)]
        return np.concatenate(places), np.tile(self.routes[owner], 2)


def stars(place: np.ndarray, route: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, the smallest route of each, distinct pairs of another route there and the smallest)."""
    order = np.lexsort((route, place))
    place, route = place[order], route[order]
    lead = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    at = np.flatnonzero(lead)
    first = route[at][np.cumsum(lead) - 1]
    other = route != first
    return place[at], route[at], np.unique(np.stack([route[other], first[other]], axis=1), axis=0)


def stored_blocks(docs: DataFrame, n: int, block_bytes: int, parts: int) -> DataFrame:
    """kind, block, payload: TEXTS, a block's texts; SETS, its rows of doc_id, size of the set, hash of the set."""

    def run(batches):
        start, made = TaskContext.get().partitionId() << 32, 0
        texts, lengths, rows, held = [], [], [], 0

        def emit():
            ids, known, sizes, hashes = (np.concatenate(c) for c in zip(*rows))
            payloads = [pack(np.concatenate(texts), np.concatenate(lengths).astype(np.uint32)), pack(ids, known, sizes, hashes)]
            return pa.RecordBatch.from_arrays([pa.array([TEXTS, SETS], pa.int32()), pa.array([start + made] * 2, pa.int64()), pa.array(payloads, pa.binary())], names=["kind", "block", "payload"])

        for part, data, off in rows_and_texts(batches):
            h, at = shingle_sets(data, off, n)
            ids = part.column(0)
            rows.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), np.diff(at).astype(np.uint32), set_hashes(h, at)))
            texts.append(data)
            lengths.append(np.diff(off))
            held += len(data)
            if held >= block_bytes:
                yield emit()
                made, texts, lengths, rows, held = made + 1, [], [], [], 0
        if rows:
            yield emit()

    return store_bucketed(docs.select("doc_id", "text").mapInArrow(run, "kind int, block long, payload binary"), "sets", "block", parts, partition="kind")


def document_sets(blocks: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set) of every row."""

    def run(batches):
        for batch in batches:
            for payload in batch.column(0):
                ids, known, sizes, hashes = unpack(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(sizes.astype(np.int64)), pa.array(to_signed(hashes), mask=sizes == 0)], names=["doc_id", "n_shingles", "set_hash"])

    return blocks.where(f"kind = {SETS}").select("payload").mapInArrow(run, "doc_id long, n_shingles long, set_hash long")


def key_ranks(questions: DataFrame, parts: int) -> DataFrame:
    """block, bucket, payload: the rank of each key of each question, in its order."""

    def run(batches):
        at, blocks, asked = None, [], []

        def emit():
            keys = [np.cumsum(q[0], dtype=np.uint64) for q in asked]
            _, where = np.unique(np.concatenate(keys), return_inverse=True)
            ranks = rarity(np.bincount(where, np.concatenate([q[1] for q in asked])))[where]
            cuts = np.cumsum([0, *map(len, keys)])
            payloads = [pack(ranks[a:b]) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([at] * len(blocks), pa.int32()), pa.array(payloads, pa.binary())], names=["block", "bucket", "payload"])

        for batch in batches:
            for block, bucket, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at and blocks:
                    yield emit()
                    blocks, asked = [], []
                at = bucket
                blocks.append(block)
                asked.append(unpack(payload))
        if blocks:
            yield emit()

    return questions.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, bucket int, payload binary")


def loose_links(blocks: DataFrame, n: int, threshold: Fraction, parts: int) -> DataFrame:
    """a, b: sets, by their hashes, that meet somewhere. Each place links all its sets with the smallest.

    A block sends each distinct key once to the bucket of its range and gets the
    rank of each back. It then links the sets of a place among themselves and
    sends on the smallest only, so a place that very many sets share costs a row
    per block.
    """
    bits = max(6, (2 * parts - 1).bit_length())
    texts = blocks.where(f"kind = {TEXTS}").select("block", "payload")

    def ask(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(BlockSets(payload.as_py(), n).questions(bits))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["block", "bucket", "payload"])

    def meet(batches):
        for batch in batches:
            for payload, answers in zip(batch.column(0), batch.column(1)):
                ranks = [unpack(x["payload"])[0] for x in answers.as_py() or []]
                if not ranks:
                    continue
                place, route, links = stars(*BlockSets(payload.as_py(), n).meeting_places(np.concatenate(ranks), threshold))
                bucket = (place >> U64(64 - bits)).astype(np.int64)  # ascending, as places are
                used, cuts = np.unique(bucket, return_index=True)
                cuts = np.append(cuts, len(bucket))
                payloads = [pack(place[a:b], route[a:b], links[:0]) for a, b in zip(cuts, cuts[1:])]
                if len(links):
                    payloads[0] = pack(place[: cuts[1]], route[: cuts[1]], links.reshape(-1))
                if payloads:
                    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])

    def link(batches):
        at, held = None, []

        def emit():
            _, _, links = stars(np.concatenate([q[0] for q in held]), np.concatenate([q[1] for q in held]))
            links = np.unique(np.concatenate([links, *(q[2].reshape(-1, 2) for q in held)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != at and held:
                    yield emit()
                    held = []
                at = bucket
                held.append(unpack(payload.as_py()))
        if held:
            yield emit()

    ranks = key_ranks(texts.mapInArrow(ask, "block long, bucket int, payload binary"), parts)
    answers = ranks.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "payload"))).alias("answers"))
    places = texts.join(answers, "block", "left").select("payload", "answers").mapInArrow(meet, "bucket int, payload binary")
    return places.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(link, "a long, b long")


# ---------------------------------------------------------------- the tree


class Forest:
    """Disjoint classes; the smaller of two takes the larger one's label."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = [[k] for k in range(n)]

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.label[self.members[y]] = x
        self.members[x] += self.members[y]
        self.members[y] = []
        return True


class SignatureTree:
    """Sets in an order that keeps similar ones close; levels of nodes above leaves of LEAF sets.

    A node has the OR of its sets' bitmaps, its range of sizes and the least
    number of bits that one of its sets sets. A set x has at least
    bits(x) - bits(x AND other) elements outside anything within `other`, which
    bounds the overlap from above.
    """

    LEAF, FAN, BITS = 32, 8, 1024

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        m = len(sets)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(m), self.sizes)
        bit = (mix(flat) >> U64(54)).astype(np.int64)
        bitmaps = np.zeros((m, self.BITS // 64), np.uint64)
        np.bitwise_or.at(bitmaps, (owner, bit >> 6), U64(1) << (bit & 63).astype(np.uint64))
        self.bitmaps, self.bits = bitmaps, np.bitwise_count(bitmaps).sum(axis=1).astype(np.int64)
        self.levels = []
        step, lows = self.LEAF, (bitmaps, self.sizes, self.sizes, self.bits)
        while True:
            cuts = np.arange(0, len(lows[0]), step)
            lows = (np.bitwise_or.reduceat(lows[0], cuts), np.minimum.reduceat(lows[1], cuts), np.maximum.reduceat(lows[2], cuts), np.minimum.reduceat(lows[3], cuts))
            self.levels.append(lows)
            if len(cuts) == 1:
                break
            step = self.FAN


def needed(a, b, threshold: Fraction):
    """Least overlap of sets of these sizes that link."""
    up, down = threshold.numerator, threshold.numerator + threshold.denominator
    return -(-(a + b) * up // down)


def possible(x: SignatureTree, y: SignatureTree, level: int, i: int, js: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Which nodes js of y may have a set that links with one of node i of x, by the largest possible overlap."""
    orx, lox, hix, bitx = (v[i] for v in x.levels[level])
    ory, loy, hiy, bity = (v[js] for v in y.levels[level])
    shared = np.bitwise_count(ory & orx).sum(axis=1).astype(np.int64)
    most = np.minimum(hix - np.maximum(0, bitx - shared), hiy - np.maximum(0, bity - shared))
    return most >= needed(np.maximum(lox, 0), loy, threshold)


def join_leaves(x: SignatureTree, y: SignatureTree, xs: slice, ys: slice, forest: Forest, shift: int, threshold: Fraction) -> list[tuple[int, int]]:
    """New class-joining links between two leaves; y's sets are numbered from `shift` on in the forest."""
    la, lb = forest.label[xs], forest.label[ys.start + shift : ys.stop + shift]
    if la[0] == lb[0] and (la == la[0]).all() and (lb == lb[0]).all():
        return []
    need = needed(x.sizes[xs, None], y.sizes[None, ys], threshold)
    shared = np.bitwise_count(x.bitmaps[xs, None] & y.bitmaps[None, ys]).sum(axis=2).astype(np.int64)
    most = np.minimum(x.sizes[xs, None] - np.maximum(0, x.bits[xs, None] - shared), y.sizes[None, ys] - np.maximum(0, y.bits[None, ys] - shared))
    open_pairs = (most >= need) & (la[:, None] != lb[None])
    if not open_pairs.any():
        return []
    rows, cols = np.flatnonzero(open_pairs.any(axis=1)), np.flatnonzero(open_pairs.any(axis=0))
    out = []
    # Exact overlaps of the sets that are still open, from their common elements.
    left = [x.sets[xs.start + k] for k in rows]
    right = [y.sets[ys.start + k] for k in cols]
    a, b = np.concatenate(left), np.concatenate(right)
    who_a, who_b = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    values = np.intersect1d(a, b)
    at = np.searchsorted(values, a)
    ok = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == a) if len(values) else np.zeros(len(a), bool)
    at_b = np.searchsorted(values, b)
    ok_b = (at_b < len(values)) & (values[np.minimum(at_b, len(values) - 1)] == b) if len(values) else np.zeros(len(b), bool)
    overlap = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, len(values), 16_384):
        width = min(16_384, len(values) - lo)
        left_has, right_has = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        pick = ok & (at >= lo) & (at < lo + width)
        left_has[who_a[pick], at[pick] - lo] = 1
        pick = ok_b & (at_b >= lo) & (at_b < lo + width)
        right_has[who_b[pick], at_b[pick] - lo] = 1
        overlap += (left_has @ right_has.T).astype(np.int64)
    linked = (overlap >= need[np.ix_(rows, cols)]) & open_pairs[np.ix_(rows, cols)]
    for r, c in zip(*np.nonzero(linked)):
        i, j = xs.start + int(rows[r]), ys.start + int(cols[c])
        if forest.join(i, j + shift):
            out.append((i, j))
    return out


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: Fraction) -> list[tuple[int, int]]:
    """Links that join all classes: within `left`, or between `left` and `right`.

    Dual traversal from the roots down; only node pairs that may hold a link are
    opened, and leaves whose sets are one class already are passed over.
    """
    x = SignatureTree(left)
    y = x if right is None else SignatureTree(right)
    shift = 0 if right is None else len(left)
    forest = Forest(len(left) + (0 if right is None else len(right)))
    # Bring both trees to one height: a lone root may stand above itself.
    while len(x.levels) < len(y.levels):
        x.levels.append(x.levels[-1])
    while len(y.levels) < len(x.levels):
        y.levels.append(y.levels[-1])
    out, todo = [], [(len(x.levels) - 1, 0, 0)]
    while todo:
        level, i, j = todo.pop()
        if level == 0:
            xs = slice(i * x.LEAF, min(len(left), (i + 1) * x.LEAF))
            ys = slice(j * x.LEAF, min(len(y.sets), (j + 1) * x.LEAF))
            out += join_leaves(x, y, xs, ys, forest, shift, threshold)
            continue
        below = level - 1

        def children(tree: SignatureTree, k: int) -> np.ndarray:
            n, up = len(tree.levels[below][0]), len(tree.levels[level][0])
            return np.array([0]) if n == up == 1 else np.arange(k * tree.FAN, min(n, (k + 1) * tree.FAN))

        for a in children(x, i).tolist():
            bs = children(y, j)
            if right is None and i == j:
                bs = bs[bs >= a]
            for b in bs[possible(x, y, below, a, bs, threshold)].tolist():
                todo.append((below, a, b))
    return out


# ---------------------------------------------------------------- the operator


def _with_set(texts: DataFrame, n: int) -> DataFrame:
    """text, set_hash of each text."""

    def run(batches):
        for part, data, off in rows_and_texts(batches):
            h, at = shingle_sets(data, off, n)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("text")), pa.array(to_signed(set_hashes(h, at)))], names=["text", "set_hash"])

    return texts.select("text").mapInArrow(run, "text string, set_hash long")


def _cluster_rows(texts: DataFrame, n: int) -> DataFrame:
    """key columns and the set of each clustered text; texts: doc_id, text, set_hash, cluster, mine, n_blocks."""

    def run(batches):
        for part, data, off in rows_and_texts(batches):
            h, at = shingle_sets(data, off, n)
            hashes = to_signed(set_hashes(h, at))
            wanted = part.column(part.schema.get_field_index("set_hash")).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(hashes == wanted)
            packed = [pack(h[at[k] : at[k + 1]]) for k in rows]
            keep = part.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*(keep.column(keep.schema.get_field_index(c)) for c in ("cluster", "mine", "n_blocks", "set_hash")), pa.array(packed, pa.binary())], names=["cluster", "mine", "n_blocks", "set_hash", "payload"])

    rows = texts.mapInArrow(run, "cluster long, mine int, n_blocks int, set_hash long, payload binary")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    return rows.select("*", other).select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "set_hash", "payload")


def _links(rows: DataFrame, threshold: Fraction, parts: int) -> DataFrame:
    def run(batches):
        key, held = None, {}

        def emit():
            sides = {}
            for (mine, h), s in held.items():
                sides.setdefault(mine, []).append((int(s[0]), h, s))
            for side in sides.values():
                side.sort(key=lambda m: m[:2])  # near sets tend to share their least element
            if key[1] == key[2]:
                left, right = sides.get(key[1], []), None
            else:
                left, right = sides.get(key[1], []), sides.get(key[2], [])
            found = tree_links([m[2] for m in left], None if right is None else [m[2] for m in right], threshold) if left and (right is None or right) else []
            other = left if right is None else right
            return pa.RecordBatch.from_arrays([pa.array([left[a][1] for a, _ in found], pa.int64()), pa.array([other[b][1] for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            cluster, i, j, mine, hashes = (batch.column(k).to_pylist() for k in range(5))
            for k in range(batch.num_rows):
                if (now := (cluster[k], i[k], j[k])) != key:
                    if held:
                        yield emit()
                    key, held = now, {}
                if (mine[k], hashes[k]) not in held:
                    held[mine[k], hashes[k]] = unpack(batch.column(5)[k].as_py())[0]
        if held:
            yield emit()

    rows = rows.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return rows.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, threshold: Fraction = Fraction(85, 100), n: int = 4, doc_id: str = "doc_id", text: str = "text", block_shingles: int = 2_000_000, few_blocks: int = 8, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Rows link when the Jaccard similarity of their sets of n-word shingles is at
    least `threshold`; component_id is the smallest doc_id reachable. Null and
    empty texts, and texts without words, link with nothing. Equal sets (copies)
    are joined as one. A cluster is cut into blocks of at most
    `block_shingles` shingles, smaller ones (an eighth) as long as that gives no
    more than `few_blocks`; each pair of blocks is a task of its own, so a large
    cluster is never in one task and no pair is left out. Sets are told apart by 64-bit
    hashes of shingles. Texts of any length are read whole; repeated rows are equal
    sets; extra columns are ignored; an empty table gives an empty one; a null doc_id
    is never a component's id unless all its ids are null.
    """
    spark = ship_package(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = stored_blocks(plain, n, block_bytes, parts)
    sets = store(document_sets(blocks), "sets").df
    distinct_sets = sets.where("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"))
    loose = components(loose_links(blocks, n, threshold, parts))
    members = distinct_sets.join(loose, F.col("set_hash") == F.col("node")).select("set_hash", "rep", "n_shingles", F.col("component").alias("cluster"))
    members = store(members, "members").df
    total = F.sum("n_shingles")
    n_blocks = F.greatest(F.ceil(total / block_shingles), F.least(F.lit(few_blocks), F.ceil(total * few_blocks / block_shingles)))
    sizes = members.groupBy("cluster").agg(n_blocks.cast("int").alias("n_blocks"), F.count("*").alias("n"))
    placed = members.join(sizes.where("n > 1"), "cluster").withColumn("mine", F.pmod(F.hash("set_hash"), F.col("n_blocks"))).select("rep", "set_hash", "cluster", "mine", "n_blocks")
    small = members.count() <= 500_000  # at most 20 MB; beyond, both sides are shuffled
    texts = plain.join(F.broadcast(placed) if small else placed, plain.doc_id == placed.rep).select("text", "set_hash", "cluster", "mine", "n_blocks")
    unnamed = placed.where("rep is null")
    if not unnamed.isEmpty():  # sets of rows without an id only: their texts are found by the set
        texts = texts.unionByName(_with_set(plain.where("doc_id is null"), n).join(unnamed, "set_hash").select(*texts.columns))
    linked = components(_links(_cluster_rows(texts, n), threshold, parts))
    named = linked.join(members, linked.node == members.set_hash).groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = linked.join(named, "component").select(F.col("node").alias("set_hash"), F.col("component_id").alias("linked_id"))
    ids = distinct_sets.join(classes, "set_hash", "left").select("set_hash", F.coalesce("linked_id", "rep").alias("class_id"))
    ids = store(ids, "classes").df  # so that the join below reads two tables and a frequent set can be split
    return sets.join(ids, "set_hash", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, threshold: Fraction = Fraction(85, 100), n: int = 4) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their component; of rows that share such an id, the one with the least text, then the least other columns.

    Rows without an id, a text or words all stay; texts of any length are compared
    whole; an empty table gives an empty one, of the same columns, whatever their
    names. Only ids are matched against the documents.
    """
    found = store(jaccard_components(docs, threshold, n), "components").df
    gone = store(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__tallyloom_gone")).distinct(), "gone").df
    small = gone.count() <= 1_000_000  # at most 16 MB; beyond, both sides are shuffled
    kept = docs.join(F.broadcast(gone) if small else gone, F.col("doc_id") == F.col("__tallyloom_gone"), "left_anti")
    twice = found.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__tallyloom_twice"))
    twice = store(twice, "twice").df
    if twice.isEmpty():
        return kept
    again = kept.join(twice, F.col("doc_id") == F.col("__tallyloom_twice"), "left_semi")
    order = ["text", *(f.name for f in docs.schema.fields if f.name not in ("doc_id", "text") and not isinstance(f.dataType, (MapType, VariantType)))]
    again = again.groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(*(F.col(f"`{c}`") for c in order))).alias("__tallyloom_row")).select("__tallyloom_row.*")
    return kept.join(twice, F.col("doc_id") == F.col("__tallyloom_twice"), "left_anti").unionByName(again)
