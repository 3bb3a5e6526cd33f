import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import machines as M
from tallyloom.operators import sequences as S


def by_hand(machine, inputs):
    """(state, output, read, rejected) after each input, one after the other."""
    state, rejected = machine.start, False
    for x in inputs:
        if rejected or state in machine.stop:
            yield state, None, False, rejected
            continue
        target = machine.transitions.get((state, x))
        if target is None and machine.undefined == S.ERROR:
            raise ValueError(x)
        rejected = target is None and machine.undefined == S.REJECT
        state, out = target or (state, None)
        yield state, out, True, rejected


def rows_of(rng, n, keys, symbols):
    """One key has half of all events."""
    return [(rng.choice([keys[0], rng.choice(keys)]), k, rng.choice(symbols)) for k in range(n)]


@pytest.mark.parametrize("machine,symbols", [(S.TURNSTILE, ["bezahlen", "durchgehen", "x", None]), (S.SHOP, ["checkout", "pay", "error", "back", "y"]), (S.FORM, ["Event_sub", "voll", "mail", "visa"]), (S.MOORE_DRINKS, ["1€ einwerfen", "abbrechen", "warten"]), (S.ADDER, list("0123"))])
@pytest.mark.parametrize("parts", ["1", "7"])
def test_every_event_by_hand(spark, machine, symbols, parts):
    rng = random.Random(len(symbols))
    rows = rows_of(rng, 900, [5, 1, None, 8, 3], symbols)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "k long, t long, x string").repartition(3)
        got = {(r.k, r.t): (r.state, r.output, r.read, r.rejected) for r in M.transduced(df, "k", ["t"], F.col("x"), machine).collect()}
        ends = {r.k: (r.state, r.read, r.rejected) for r in M.ends(df, "k", ["t"], F.col("x"), machine).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        want = list(by_hand(machine, [r[2] for r in mine]))
        assert [got[key, r[1]] for r in mine] == want
        assert ends[key] == (want[-1][0], sum(w[2] for w in want), want[-1][3])


def test_a_missing_transition_is_an_error_only_where_it_is_met(spark):
    good = spark.createDataFrame([(1, 0, "1"), (1, 1, "0")], "k long, t long, x string")
    assert M.transduced(good, "k", ["t"], F.col("x"), S.PARITY).count() == 2
    with pytest.raises(Exception, match="no transition"):
        M.transduced(good.union(spark.createDataFrame([(2, 0, "7")], "k long, t long, x string")), "k", ["t"], F.col("x"), S.PARITY).collect()
    assert M.outputs(good.limit(0), "k", ["t"], F.col("x"), S.MOORE_DRINKS).count() == 0


def test_prefixes_are_compositions():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        f = rng.integers(0, 5, (n, 5)).astype(np.uint8)
        at = np.arange(5)
        for k, row in enumerate(M.prefixes(f)):
            at = f[k][at]
            assert (row == at).all()


def test_batches_pass_on_their_state(spark, monkeypatch):
    monkeypatch.setattr(M, "AT_A_TIME", 5)
    df = spark.createDataFrame([(k // 40, k, str(k * 7 % 3 % 2)) for k in range(120)], "k long, t long, x string")
    got = {(r.k, r.t): (r.state, r.output) for r in M.transduced(df, "k", ["t"], F.col("x"), S.INVERTER).collect()}
    for key in range(3):
        want = by_hand(S.INVERTER, [str(k * 7 % 3 % 2) for k in range(40 * key, 40 * key + 40)])
        assert [got[key, k] for k in range(40 * key, 40 * key + 40)] == [w[:2] for w in want]
