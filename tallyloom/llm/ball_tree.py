"""Exact k-means over partition-local ball trees.

Vectors are dealt into blocks as they lie in the input, and each block is stored
once as a binary tree of balls: a node has its members' number and exact integer
sum, and the greatest distance of a member from their mean. A round sends the
centroids to every block. A ball whose centroids but one are further than any
member can be adds its number and sum to that one as a whole; others are opened, and
at the leaves distances are exact integers. So a round reads the members only of
balls near a border, and what leaves a task is a sum per centroid and component.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.packing import pack, unpack
from tallyloom.session import ship_package
from tallyloom.store import store

LEAF = 32
EXACT = 1 << 20  # components up to here have products that 64-bit floats hold exactly


def integer_vectors(vectors: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of the vectors with `dims` components, none null or non-finite, held within what keeps squared distances in 64 bits."""
    bound = isqrt((1 << 62) // dims) // 2
    whole = f"size({embedding}) = {dims} and forall({embedding}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    held = F.expr(f"transform({embedding}, x -> cast(greatest({-bound}.0D, least({bound}.0D, floor({scale} * cast(x as double)))) as int))")
    return vectors.where(whole).select(F.col(vec_id).cast("long").alias("vec_id"), held.alias("v"))


class Tree:
    """Balls over the rows of one block, which are put in the order of the leaves.

    first, last: a ball's rows; left: its first child, whose sibling follows, or -1.
    """

    def __init__(self, first, last, left, sums, radius):
        self.first, self.last, self.left, self.sums, self.radius = first, last, left, sums, radius
        self.centres = sums / np.maximum(1, last - first)[:, None]

    def packed(self) -> bytes:
        return pack(self.first, self.last, self.left, self.sums.reshape(-1), self.radius.view(np.int64))

    @staticmethod
    def unpacked(raw: bytes) -> Tree:
        first, last, left, sums, radius = unpack(raw)
        return Tree(first, last, left, sums.reshape(len(first), -1), radius.view(np.float64))


def grown(rows: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree of these integer rows, and their order in it. Equal rows are one ball of radius 0, however many."""
    n, d = rows.shape
    order = np.arange(n)
    first, last, left, sums, radius = [0], [n], [-1], [], []
    at = 0
    while at < len(first):
        lo, hi = first[at], last[at]
        mine = rows[order[lo:hi]].astype(np.float64)
        total = rows[order[lo:hi]].sum(0, dtype=np.int64)
        away = ((mine - total / (hi - lo)) ** 2).sum(1)
        sums.append(total)
        radius.append(float(np.sqrt(away.max())))
        if hi - lo > leaf and (mine != mine[0]).any():
            one = mine[away.argmax()]
            other = mine[((mine - one) ** 2).sum(1).argmax()]
            along = mine @ (other - one)
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(along, half)]
            left[at] = len(first)
            first += [lo, lo + half]
            last += [lo + half, hi]
            left += [-1, -1]
        at += 1
    tree = Tree(np.array(first, np.int64), np.array(last, np.int64), np.array(left, np.int64), np.array(sums, np.int64).reshape(-1, d), np.array(radius))
    return tree, order


def exact_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows from integer centroids, as integers."""
    if max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT and rows.shape[1] <= 1 << 10:
        x, c = rows.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((rows - c) ** 2).sum(1) for c in centroids], 1) if len(centroids) else np.zeros((len(rows), 0), np.int64)


def spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All rows of several runs, one after the other."""
    sizes = last - first
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def assigned(tree: Tree, rows, centroids: np.ndarray, label: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, int]:
    """(members of each centroid, their sums, each row's centroid if asked for, rows compared one by one).

    rows: a function that gives the rows in the tree's order; it is called only if a leaf has to be opened.
    """
    k, d = centroids.shape
    counts, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
    labels = np.zeros(int(tree.last[0]), np.int64) if label else None
    c = centroids.astype(np.float64)
    norms = (c * c).sum(1)
    balls, alive, compared = np.zeros(1, np.int64), np.ones((1, k), bool), 0
    while len(balls):
        centre, radius = tree.centres[balls], tree.radius[balls]
        own = (centre * centre).sum(1)
        far = np.sqrt(np.maximum(0, own[:, None] - 2 * (centre @ c.T) + norms))
        near = np.where(alive, far, np.inf).min(1)
        rounding = 1e-6 + 1e-6 * np.sqrt(own + norms.max())  # more than these floats can be off
        alive &= far <= (near + 2 * radius * (1 + 1e-9) + rounding)[:, None]
        whole = alive.sum(1) == 1
        if whole.any():
            at = alive[whole].argmax(1)
            np.add.at(counts, at, tree.last[balls[whole]] - tree.first[balls[whole]])
            np.add.at(sums, at, tree.sums[balls[whole]])
            if label:
                sizes = tree.last[balls[whole]] - tree.first[balls[whole]]
                labels[spans(tree.first[balls[whole]], tree.last[balls[whole]])] = np.repeat(at, sizes)
        leaf = ~whole & (tree.left[balls] < 0)
        if leaf.any():
            held = balls[leaf]
            where = spans(tree.first[held], tree.last[held])
            mine = rows()[where]
            allowed = np.repeat(alive[leaf], tree.last[held] - tree.first[held], 0)
            at = np.where(allowed, exact_distances(mine, centroids), np.iinfo(np.int64).max).argmin(1)  # the first of equal ones
            compared += len(where)
            np.add.at(counts, at, 1)
            np.add.at(sums, at, mine)
            if label:
                labels[where] = at
        more = ~whole & ~leaf
        left = tree.left[balls[more]]
        balls, alive = np.concatenate([left, left + 1]), np.concatenate([alive[more], alive[more]])
    return counts, sums, labels, compared


def planted(vectors: DataFrame, dims: int, block_rows: int) -> DataFrame:
    """tree, members: a row for each block of up to `block_rows` vectors of a task."""

    def run(batches):
        ids, rows, held = [], [], 0

        def emit():
            nonlocal ids, rows, held
            column = pa.chunked_array(ids).combine_chunks()
            whole = np.concatenate(rows)
            tree, order = grown(whole)
            known = np.array(column.is_valid())[order].astype(np.uint8)
            numbers = column.fill_null(0).to_numpy(zero_copy_only=False)[order]
            members = pack(numbers.astype(np.int64), known, whole[order].reshape(-1))
            ids, rows, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([tree.packed()], pa.binary()), pa.array([members], pa.binary())], names=["tree", "members"])

        for batch in batches:
            for lo in range(0, batch.num_rows, block_rows):
                part = batch.slice(lo, block_rows)
                ids.append(part.column(0))
                rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims))
                held += part.num_rows
                if held >= block_rows:
                    yield emit()
        if held:
            yield emit()

    return vectors.mapInArrow(run, "tree binary, members binary")


def _rows(members: pa.Scalar, dims: int):
    held = []

    def rows() -> np.ndarray:
        if not held:
            held.append(unpack(members.as_py())[2].reshape(-1, dims))
        return held[0]

    return rows


def _round(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """number: (members, sums), of every centroid that has a member."""
    dims = centroids.shape[1]

    def run(batches):
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                n, s, _, _ = assigned(Tree.unpacked(batch.column(0)[k].as_py()), _rows(batch.column(1)[k], dims), centroids)
                counts += n
                sums += s
        used = np.flatnonzero(counts)
        if len(used):
            columns = [pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    partial = blocks.mapInArrow(run, "cluster int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(dims)]
    return {r[0]: (int(r[1]), [int(x) for x in r[2:]]) for r in partial.groupBy("cluster").agg(F.sum("n"), *exact).collect()}


def _settled(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    dims = centroids.shape[1]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                numbers, known, flat = unpack(batch.column(1)[k].as_py())
                rows = flat.reshape(-1, dims)
                _, _, labels, _ = assigned(Tree.unpacked(batch.column(0)[k].as_py()), lambda rows=rows: rows, centroids, label=True)
                distance = ((rows - centroids[labels]) ** 2).sum(1)
                columns = [pa.array(numbers, mask=known == 0), pa.array(labels.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def ball_tree_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = 16_384) -> DataFrame:
    """Clusters of integer vectors floor(scale * x): vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    The first centroids are the k vectors with the least sha256 of ``seed:vec_id``. A
    round assigns each vector to the nearest centroid, the smallest number on ties, and
    moves every centroid that has members to the floor of their mean; at the end vectors
    are assigned once more. All of it is exact, so neither blocks nor their order matter.

    Vectors of another length, and null ones or ones with a null or non-finite component,
    have no row. Components beyond sqrt(2^62 / dims) / 2 count as that, so that squared
    distances fit 64 bits. Rows without an id are clustered but never a first centroid;
    repeated rows are rows of their own, in the order of their components where their ids
    are equal. With fewer vectors than k every one of them is a first centroid; an empty
    table gives an empty one. Extra columns are ignored.

    On the driver: the centroids, k * dims numbers. A task holds one block.
    """
    spark = ship_package(vectors.sparkSession)
    whole = integer_vectors(vectors, dims, scale, vec_id, embedding)
    blocks = store(planted(whole, dims, block_rows), "balls").df
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = whole.where("vec_id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    if not chosen:  # only rows without an id, or none
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in chosen], np.int64)
    for _ in range(rounds):
        for number, (n, sums) in _round(blocks, centroids).items():
            centroids[number] = [s // n for s in sums]
    final = store(_settled(blocks, centroids), "clusters").df
    by_cluster = {r[0]: int(r[1]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    held = [(c, min(s, (1 << 63) - 1), min(sum(by_cluster.values()), (1 << 63) - 1), centroid_digest(centroids[c])) for c, s in by_cluster.items()]
    facts = spark.createDataFrame(held, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
