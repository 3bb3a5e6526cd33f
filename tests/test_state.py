import uuid

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import state as S
from tallyloom.store import shared_folder
from tallyloom.versions import Versions


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"


def ids(df):
    return None if df is None else sorted(r[0] for r in df.collect())


def test_log_is_a_stack(spark, folder):
    log = S.OperationLog(spark, folder)
    assert log.last() is None and log.pop("x") is None and log.height() == 0
    rows = spark.range(9)
    assert log.append(rows.where("id < 3"), "a") and log.append(rows.where("id = 5"), "b") and log.append(rows.where("id > 6"), "c")
    assert not log.append(rows.where("id > 6"), "c") and log.height() == 3
    assert ids(log.pop("1")) == [7, 8] and ids(log.last()) == [5]
    assert ids(log.pop("1")) == [7, 8] and log.height() == 2  # the job that asked died and asks again
    assert log.append(rows.where("id = 0"), "d") and ids(log.last()) == [0]
    assert ids(log.pop("2")) == [0] and ids(log.pop("3")) == [5] and ids(log.pop("4")) == [0, 1, 2] and log.pop("5") is None
    assert log.append(rows, "e") and log.height() == 1


def test_a_lost_batch_is_made_again(spark, folder):
    done = S.Checkpoint(spark, folder, "id long")
    done.save(spark.range(3), "one")
    spark.range(3, 6).write.parquet(Versions(spark, folder).fresh())  # the second batch died before its commit
    assert ids(done.load()) == [0, 1, 2]
    assert done.save(spark.range(3, 6), "two") and not done.save(spark.range(3, 6), "two")
    assert ids(done.load()) == list(range(6)) and ids(done.pending(spark.range(8), "id")) == [6, 7]
    done.reset()
    assert ids(done.load()) == [] and ids(done.pending(spark.range(2), "id")) == [0, 1]


def test_many_parts_are_put_together(spark, folder, monkeypatch):
    monkeypatch.setattr(S, "MOST_PARTS", 3)
    done = S.Checkpoint(spark, folder, "id long")
    for k in range(8):
        done.save(spark.range(k, k + 2), str(k))
    assert ids(done.load().distinct()) == list(range(9)) and len(Versions(spark, folder).read()["parts"]) <= 3


def test_tail_of_any_batches_is_that_of_all(spark, folder):
    rows = [(k % 3, k, f"line {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "c long, t long, line string")
    for n, cuts in enumerate(([0, 200], [0, 5, 6, 120, 200])):
        tail = S.RollingTail(spark, f"{folder}-{n}", n=7)
        for lo, hi in zip(cuts, cuts[1:]):
            tail.add(df.where(f"t >= {lo} and t < {hi}"), "c", ["t"], "line", str(lo))
        assert sorted(tuple(r) for r in tail.lines().collect()) == sorted(r for c in range(3) for r in [r for r in rows if r[0] == c][-7:])


def test_pool_gives_no_term_twice_before_its_reset(spark):
    pool = spark.createDataFrame([(f"w{k}",) for k in range(11)], "w string")
    picks = {}
    for r in S.rotating_picks(pool, "w", 4, 9, "s").collect():
        picks.setdefault(r.round, set()).add(r.w)
    assert sorted(picks) == list(range(9)) and all(len(p) == 4 for p in picks.values())
    assert all(not picks[k] & picks[k + 1] for k in (0, 2, 4, 6))  # two rounds to a pool of eleven
    assert {r.w for r in S.rotating_picks(pool.limit(2), "w", 4, 1).collect()} == {r.w for r in pool.limit(2).collect()}


def test_replay_runs_backwards(spark):
    rows = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "c", "d"), (2, 1, "e", "f")], "g long, step long, source string, target string")
    assert sorted(tuple(r) for r in S.replay(rows, "g", "step").collect()) == [(1, 1, 2, "d", "c"), (1, 2, 1, "b", "a"), (2, 1, 1, "f", "e")]


def test_lines(spark):
    df = spark.createDataFrame([(1, 1, "a\n\nb"), (1, 2, None), (1, 3, "")], "c long, t long, x string")
    assert [tuple(r) for r in S.line_rows(df, "c", "t", F.col("x")).collect()] == [(1, 1, 0, "a"), (1, 1, 2, "b")]
