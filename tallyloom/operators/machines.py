"""State machines with a row for every output, by a parallel prefix over transition functions.

Events are dealt by ranges of key and order. Within a range every event is a
function from state to state, and functions are composed in log n array steps, so each
event gets the function of all events before it in its range. What a range does
as a whole is one function; the exclusive scan over these, one per range, gives each
range its start state. Then every event's state and output is a look-up. A key with
any share of all events is spread over ranges, and no row holds more than an event.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from tallyloom.operators.sequences import ERROR, REJECT, Machine
from tallyloom.session import ship_package
from tallyloom.store import store

EVENT, FIRST, TOTAL = 0, 1, 2
AT_A_TIME = 8192


class Tables:
    """A machine as arrays. States beyond `n` are those in which it has rejected, and the last one stands for a missing transition that is an error."""

    def __init__(self, machine: Machine):
        self.names = sorted({machine.start, *machine.stop, *machine.final, *(s for s, _ in machine.transitions), *(t for t, _ in machine.transitions.values())})
        self.inputs = sorted({x for _, x in machine.transitions})
        self.outputs = sorted({o for _, o in machine.transitions.values() if o is not None})
        n = self.n = len(self.names)
        at = {s: k for k, s in enumerate(self.names)}
        self.start, self.width = at[machine.start], 2 * n + 1
        if self.width > 256:
            raise ValueError("a machine has at most 127 states")
        row = np.arange(self.width)
        undefined = {REJECT: row + n, ERROR: np.full(self.width, 2 * n)}.get(machine.undefined, row.copy())
        undefined[n:] = row[n:]
        for s in machine.stop:
            undefined[at[s]] = at[s]
        self.next = np.tile(undefined, (len(self.inputs) + 1, 1)).astype(np.uint8)  # the last input is any that no transition has
        self.output = np.full(self.next.shape, -1, np.int32)
        for (s, x), (t, o) in machine.transitions.items():
            if s not in machine.stop:
                self.next[self.inputs.index(x), at[s]] = at[t]
                self.output[self.inputs.index(x), at[s]] = -1 if o is None else self.outputs.index(o)
        self.halted = (row >= n) | np.isin(row, [at[s] for s in machine.stop])
        self.shown = pa.array([*self.names, *self.names, None], pa.string())
        self.output_names = pa.array([*self.outputs, None], pa.string())

    def codes(self, symbols: pa.Array) -> np.ndarray:
        found = pc.index_in(symbols, pa.array(self.inputs, pa.string()))
        return pc.fill_null(found, len(self.inputs)).to_numpy(zero_copy_only=False).astype(np.int64)


def prefixes(functions: np.ndarray) -> np.ndarray:
    """All compositions of the first functions: row k maps a state to what functions 0 to k make of it."""
    out, step = functions, 1
    while step < len(out):
        out = np.concatenate([out[:step], np.take_along_axis(out[step:], out[:-step].astype(np.int64), 1)])
        step *= 2
    return out


def _scan(events: DataFrame, key: str, tables: Tables) -> DataFrame:
    """The events of each range with the function of what comes before them, a row with the range's first key, and one with its last key and what the range does."""
    columns = events.columns[:-1]
    identity = np.arange(tables.width, dtype=np.uint8)

    def run(batches):
        chunk, carried, last = TaskContext.get().partitionId(), identity, None

        def marked(kind: int, like: pa.RecordBatch, keys: pa.Array, function: np.ndarray) -> pa.RecordBatch:
            cells = [keys if c == key else pa.nulls(1, like.column(k).type) for k, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays([*cells, pa.array([chunk], pa.int32()), pa.array([kind], pa.int32()), pa.nulls(1, pa.int32()), pa.array([function.tobytes()], pa.binary())], names=names)

        for batch in batches:
            for lo in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(lo, AT_A_TIME)
                keys = part.column(columns.index(key))
                if last is None:
                    yield marked(FIRST, part, keys.slice(0, 1), identity)
                both = pa.concat_arrays([keys.slice(0, 1) if last is None else last, keys])
                same = pc.equal(both[:-1], both[1:])
                same = pc.if_else(pc.is_valid(same), same, pc.and_(pc.is_null(both[:-1]), pc.is_null(both[1:])))  # null keys are one key
                starts = ~same.to_numpy(zero_copy_only=False).astype(bool)
                x = tables.codes(part.column(len(columns)))
                functions = tables.next[x]
                functions[starts] = tables.next[x[starts], tables.start][:, None]
                done = carried[:0].reshape(0, tables.width) if not len(x) else np.take_along_axis(prefixes(functions), np.broadcast_to(carried.astype(np.int64), functions.shape), 1)
                before = np.concatenate([carried[None], done[:-1]])
                before[starts] = tables.start
                carried, last = done[-1], keys.slice(len(keys) - 1, 1)
                offsets = pa.py_buffer((np.arange(len(x) + 1) * tables.width).astype(np.int32))
                held = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(np.ascontiguousarray(before))])
                n = len(x)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.full(n, chunk, np.int32)), pa.array(np.full(n, EVENT, np.int32)), pa.array(x.astype(np.int32)), held], names=names)
        if last is not None:
            yield marked(TOTAL, part, last, carried)

    added = [StructField("_chunk", IntegerType()), StructField("_kind", IntegerType()), StructField("_x", IntegerType()), StructField("_before", BinaryType())]
    names = [*columns, *(f.name for f in added)]
    return events.mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in events.schema.fields[:-1]), *added]))


def start_states(marks: list, tables: Tables) -> np.ndarray:
    """The exclusive scan over ranges. marks: (chunk, kind, key, function) of the ranges that have events."""
    first = {c: k for c, kind, k, _ in marks if kind == FIRST}
    total = {c: (k, np.frombuffer(f, np.uint8)) for c, kind, k, f in marks if kind == TOTAL}
    starts = np.zeros(max(first, default=-1) + 1, np.int64)
    at, before = tables.start, object()
    for c in sorted(first):
        starts[c] = at if first[c] == before else tables.start
        before, function = total[c]
        at = int(function[starts[c]])
    return starts


def transduced(events: DataFrame, key: str, order: list[str], symbol: Column, machine: Machine) -> DataFrame:
    """key, order, state (after the event), output, read, rejected: a row for every event.

    Events of a key are taken by `order`, which tells them apart; null keys are one
    key. read: the machine had not stopped or rejected before; output is null where a
    transition has none. What an input without a transition does is the machine's
    `undefined`; a null input has none. On the driver: two rows for each range, that is
    for each shuffle partition.
    """
    spark = ship_package(events.sparkSession)
    tables = Tables(machine)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(key, *order, symbol.cast("string").alias("_symbol"))
    dealt = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    held = store(_scan(dealt, key, tables), "machine").df
    starts = start_states([tuple(r) for r in held.where(f"_kind <> {EVENT}").select("_chunk", "_kind", key, "_before").collect()], tables)
    kept = [key, *order]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            chunk, x = (batch.column(len(kept) + k).to_numpy(zero_copy_only=False) for k in (0, 1))
            functions = batch.column(len(kept) + 2)
            at = functions.offset * tables.width
            functions = np.frombuffer(functions.buffers()[2], np.uint8)[at : at + n * tables.width].reshape(n, tables.width)
            before = functions[np.arange(n), starts[chunk]]
            after = tables.next[x, before]
            if (after == 2 * tables.n).any():
                raise ValueError("no transition for an input")
            read = ~tables.halted[before]
            output = tables.output_names.take(pa.array(np.where(read, tables.output[x, before], -1) % (len(tables.outputs) + 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], tables.shown.take(pa.array(after)), output, pa.array(read), pa.array(after >= tables.n)], names=[*kept, "state", "output", "read", "rejected"])

    schema = StructType([*(held.schema[c] for c in kept), *StructType.fromDDL("state string, output string, read boolean, rejected boolean").fields])
    return held.where(f"_kind = {EVENT}").select(*kept, "_chunk", "_x", "_before").mapInArrow(run, schema)


def outputs(events: DataFrame, key: str, order: list[str], symbol: Column, machine: Machine) -> DataFrame:
    """key, order, state, output: a row for each output; those that a machine has before any input (`seed`) with a null order."""
    out = transduced(events, key, order, symbol, machine).where("output is not null").select(key, *order, "state", "output")
    for o in machine.seed:
        seeds = events.select(key).distinct().select(key, *(F.lit(None).cast(events.schema[c].dataType).alias(c) for c in order), F.lit(machine.start).alias("state"), F.lit(o).alias("output"))
        out = out.unionByName(seeds)
    return out


def ends(events: DataFrame, key: str, order: list[str], symbol: Column, machine: Machine) -> DataFrame:
    """key, state, read, rejected, accepted of each key once all its events are read; a sum per task and key leaves a task."""
    rows = transduced(events, key, order, symbol, machine)
    last = rows.groupBy(key).agg(F.max_by("state", F.struct(*order)).alias("state"), F.count_if("read").alias("read"), F.bool_or("rejected").alias("rejected"))
    return last.withColumn("accepted", ~F.col("rejected") & F.col("state").isin(list(machine.final)))
