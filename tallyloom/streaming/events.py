"""Extension: windows and state machines over an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators.sequences import ERROR, REJECT, Machine
from tallyloom.session import ship_package


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """window_start, kind, n, total of tumbling windows; rows later than the watermark are left out, state older than it goes."""
    windows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), F.col(kind).alias("kind"))
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "kind", "n", "total")


def machine_states(events: DataFrame, machine: Machine, symbol: Column, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """key, state, read, rejected after each batch, for keys that had events in it.

    The state of a key is kept between batches; within a batch its events are
    read in order.
    """
    ship_package(events.sparkSession)

    def step(state: str, x: str) -> tuple[str, bool]:
        nxt = machine.transitions.get((state, x))
        if nxt is None and machine.undefined == ERROR:
            raise ValueError(f"no transition for {x}")
        return (nxt[0], False) if nxt else (state, machine.undefined == REJECT)

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, read, rejected = held.get if held.exists else (machine.start, 0, False)
        for x in pd.concat(list(batches)).sort_values(list(order))["_symbol"]:
            if rejected or state in machine.stop:
                break
            state, rejected = step(state, x)
            read += 1
        held.update((state, int(read), bool(rejected)))
        yield pd.DataFrame({key: [k[0]], "state": [state], "read": [int(read)], "rejected": [bool(rejected)]})

    kind = dict(events.dtypes)[key]
    rows = events.select(key, *order, symbol.alias("_symbol"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state string, read long, rejected boolean", "state string, read long, rejected boolean", "update", GroupStateTimeout.NoTimeout)
