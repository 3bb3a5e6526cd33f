import hashlib
import math

import duckdb
import numpy as np
import pytest

from tallyloom.llm import ball_tree
from tallyloom.llm.ball_tree import assigned, ball_tree_clusters, exact_distances, grown
from tallyloom.llm.queries import op13_ball_tree, op13_sql


def brute(rows, k, rounds, dims, scale=256, seed=2):
    """rows: (vec_id, components); one centroid after the other, in whole numbers."""
    bound = math.isqrt((1 << 62) // dims) // 2
    kept = [(i, [max(-bound, min(bound, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    if not centroids:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for a, (_, v) in zip(at, kept) if a == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    return [(i, n, d, sum(e for _, e, m in last if m == n), total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in last]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(n, dims, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    return (centres[rng.integers(7, size=n)] + rng.normal(size=(n, dims)) * spread).astype(np.float32)


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = con.execute(op13_sql()).fetchall()
    names = [d[0] for d in con.description]
    got = op13_ball_tree(spark, "/root/testdata/sf0.01").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_balls_give_what_every_distance_gives():
    for spread, clear in ((0.02, True), (0.5, False)):
        rows = np.floor(256 * made(4000, 6, 1, spread).astype(float)).astype(np.int64)
        tree, order = grown(rows)
        assert sorted(order) == list(range(4000)) and (tree.sums[0] == rows.sum(0)).all()
        centroids = rows[:1]
        while len(centroids) < (7 if clear else 12):  # the farthest from those so far: one in each of the seven heaps
            centroids = np.concatenate([centroids, rows[exact_distances(rows, centroids).min(1).argmax()][None]])
        near = exact_distances(rows[order], centroids).argmin(1)
        counts, sums, labels, compared = assigned(tree, lambda: rows[order], centroids, label=True)
        assert (labels == near).all() and (counts == np.bincount(near, minlength=len(centroids))).all()
        assert all((sums[k] == rows[order][near == k].sum(0)).all() for k in range(len(centroids)))
        assert compared < 400 or not clear


def test_equal_vectors_are_one_ball():
    rows = np.repeat(np.array([[1, 2], [9, 9]]), 5000, 0)
    tree, order = grown(rows)
    assert len(tree.first) <= 4 * math.ceil(math.log2(10_000)) and tree.radius.min() == 0
    counts, _, _, compared = assigned(tree, lambda: rows[order], np.array([[1, 1], [9, 8]]))
    assert counts.tolist() == [5000, 5000] and compared == 0


def test_ties_go_to_the_smaller_number():
    rows = np.array([[0, 0]] * 100 + [[4, 0]] * 100)
    tree, order = grown(rows)
    for centroids in ([[2, 0], [2, 0]], [[2, 1], [2, -1]], [[9, 9], [-2, 0], [6, 0], [2, 0]]):
        want = exact_distances(rows[order], np.array(centroids)).argmin(1)
        assert (assigned(tree, lambda: rows[order], np.array(centroids), label=True)[2] == want).all()


def test_large_components_are_exact():
    rows = np.array([[1 << 27, -(1 << 27)], [(1 << 27) - 1, 5]])
    assert exact_distances(rows, rows)[0, 1] == 1 + (5 + (1 << 27)) ** 2


@pytest.mark.parametrize("block_rows", [7, 16_384])
def test_odd_rows(spark, block_rows):
    good = [(k, [float(x) for x in v]) for k, v in enumerate(made(60, 4, 3, 0.3))]
    odd = [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.25, -0.125, 0.0]), (None, [1e30, -1e30, 0.0, 0.0]), (7, good[7][1]), (7, [0.0] * 4), *((200 + k, [0.5] * 4) for k in range(30))]
    rows = good + odd
    df = spark.createDataFrame([(i, v, "x", k, -1) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, cluster string, v long, distance int").repartition(3)
    got = rows_of(ball_tree_clusters(df, k=9, rounds=3, dims=4, block_rows=block_rows))
    assert got == sorted(brute(rows, 9, 3, 4), key=repr)


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert rows_of(ball_tree_clusters(one, dims=2)) == brute([(5, [1.0, 2.0])], 40, 5, 2)
    assert ball_tree_clusters(one.limit(0), dims=2).count() == 0
    assert ball_tree_clusters(one.selectExpr("cast(null AS long) AS vec_id", "embedding"), dims=2).count() == 0


def test_a_round_reads_no_members_of_clear_balls(spark):
    """What a block stores apart is not needed where its balls are clear."""
    rows = np.concatenate([np.zeros((500, 3), np.int64), np.full((500, 3), 1000)])
    tree, _ = grown(rows)

    def never():
        raise AssertionError

    assert assigned(ball_tree.Tree.unpacked(tree.packed()), never, np.array([[1, 1, 1], [999, 999, 999]]))[0].tolist() == [500, 500]
