"""State machines over ordered inputs, reducers and cycles."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.strong import SORTED, strong_components
from tallyloom.store import store

STAY, REJECT, ERROR = "stay", "reject", "error"


@dataclass(frozen=True)
class Machine:
    """transitions: (state, input) to (next state, output or None).

    undefined: what an input without a transition does. STAY reads it and stays,
    REJECT stops and rejects, ERROR fails the query. Nothing is read after a state
    in `stop`.
    """

    start: str
    transitions: dict[tuple[str, str], tuple[str, str | None]]
    final: frozenset[str] = frozenset()
    stop: frozenset[str] = frozenset()
    undefined: str = STAY
    seed: tuple[str, ...] = field(default_factory=tuple)


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def run(machine: Machine, inputs: Column) -> Column:
    """struct<state, read, rejected, outputs> of a machine over an array of inputs.

    A fold within each row: sequences don't leave the JVM, and their number, not
    their order across rows, is what is spread over tasks.
    """
    key = lambda s, x: F.concat(s, F.lit("\u0001"), x)
    nexts = literal_map({f"{s}\u0001{x}": n for (s, x), (n, _) in machine.transitions.items()})
    outs = {f"{s}\u0001{x}": o for (s, x), (_, o) in machine.transitions.items() if o is not None}
    first = F.struct(F.lit(machine.start).alias("state"), F.lit(0).cast("long").alias("read"), F.lit(False).alias("rejected"), F.array(*[F.lit(o) for o in machine.seed]).cast("array<string>").alias("outputs"))

    def step(acc: Column, x: Column) -> Column:
        at = key(acc.getField("state"), x)
        target = F.element_at(nexts, at)
        halted = acc.getField("rejected") | acc.getField("state").isin(list(machine.stop)) if machine.stop else acc.getField("rejected")
        missing = target.isNull()
        if machine.undefined == ERROR:
            target = F.when(missing, F.raise_error(F.concat(F.lit("no transition for "), x)).cast("string")).otherwise(target)
        out = F.element_at(literal_map(outs), at) if outs else F.lit(None).cast("string")
        emitted = F.when(out.isNotNull(), F.concat(acc.getField("outputs"), F.array(out))).otherwise(acc.getField("outputs"))
        rejected = missing if machine.undefined == REJECT else F.lit(False)
        moved = F.struct(F.coalesce(target, acc.getField("state")).alias("state"), (acc.getField("read") + 1).alias("read"), rejected.alias("rejected"), emitted.alias("outputs"))
        return F.when(halted, acc).otherwise(moved)

    return F.aggregate(inputs, first, step)


def accepted(machine: Machine, result: Column) -> Column:
    return ~result.getField("rejected") & result.getField("state").isin(list(machine.final))


def from_json(text: str, undefined: str = ERROR) -> Machine:
    """A machine from its JSON description; a byte order mark is passed over.

    Labels are "x" (the output is the target's, if it has one) or ["x", "out"].
    Two targets for one state and input are refused.
    """
    states = json.loads(text.lstrip("﻿"))["automaton"]["States"]
    names = {s["ID"]: s["Name"] for s in states}
    output = {s["ID"]: s.get("Output") for s in states}
    transitions: dict[tuple[str, str], tuple[str, str | None]] = {}
    for s in states:
        for t in s["Transitions"]:
            for label in t["Labels"]:
                x, out = (label, output[t["Target"]]) if isinstance(label, str) else (label[0], label[1])
                at = (names[t["Source"]], x)
                if transitions.setdefault(at, (names[t["Target"]], out)) != (names[t["Target"]], out):
                    raise ValueError(f"two transitions from {at}")
    starts = [s["Name"] for s in states if s.get("Start")]
    if len(starts) != 1:
        raise ValueError("a machine has one start")
    return Machine(starts[0], transitions, frozenset(s["Name"] for s in states if s.get("Final")), undefined=undefined)


#: States, inputs and outputs of the machines.
TURNSTILE = Machine("Zu", {("Zu", "bezahlen"): ("Offen", None), ("Offen", "durchgehen"): ("Zu", None)})
MICROWAVE = Machine("Offen", {("Offen", "schliessen"): ("Zu", None), ("Zu", "öffnen"): ("Offen", None), ("Zu", "starten"): ("Läuft", None), ("Läuft", "warten"): ("OK", None), ("Läuft", "öffnen"): ("Offen", None), ("OK", "öffnen"): ("Offen", None)})
SHOP = Machine("Shop", {("Shop", "checkout"): ("Kasse", None), ("Shop", "error"): ("Trap", "Verbindungsfehler"), ("Kasse", "pay"): ("Deal", None), ("Kasse", "error"): ("Trap", "Zahlungsfehler"), ("Kasse", "back"): ("Shop", None)}, stop=frozenset({"Deal", "Trap"}))
PATTERN_101 = Machine("q0", {("q0", "0"): ("q0", "nix"), ("q0", "1"): ("q1", "nix"), ("q1", "1"): ("q1", "nix"), ("q1", "0"): ("q2", "nix"), ("q2", "1"): ("q1", "treffer"), ("q2", "0"): ("q0", "nix")}, undefined=ERROR)
MOORE_DRINKS = Machine("hat0€", {("hat0€", "1€ einwerfen"): ("hat1€", '"1€"'), ("hat1€", "1€ einwerfen"): ("OK", "Limo"), ("hat1€", "abbrechen"): ("back", "-1€"), ("OK", "warten"): ("hat0€", '"2€"'), ("back", "warten"): ("hat0€", '"2€"')}, seed=('"2€"',))
MEALY_DRINKS = Machine("hat0€", {("hat0€", "1€ einwerfen"): ("hat1€", "'piep'"), ("hat0€", "abbrechen"): ("hat0€", "'piep'"), ("hat1€", "1€ einwerfen"): ("hat0€", "Limo"), ("hat1€", "abbrechen"): ("hat0€", "-1€")}, undefined=ERROR)
FORM = Machine("q0", {("q0", "Event_sub"): ("q1", None), ("q1", "voll"): ("q2", None), ("q1", "unvoll"): ("q0", None), ("q2", "mail"): ("q3", None), ("q2", "nomail"): ("q0", None), ("q3", "visa"): ("q4", None), ("q3", "novisa"): ("q0", None)}, final=frozenset({"q4"}), undefined=REJECT)
PARITY = Machine("gerade", {("gerade", "0"): ("gerade", "gerade"), ("gerade", "1"): ("ungerade", "ungerade"), ("ungerade", "0"): ("ungerade", "ungerade"), ("ungerade", "1"): ("gerade", "gerade")}, undefined=ERROR)
ADDER = Machine("carry_0", {(f"carry_{c}", str(x)): (f"carry_{(c + x // 2 + x % 2) // 2}", str((c + x // 2 + x % 2) % 2)) for c in (0, 1) for x in range(4)}, undefined=ERROR)


TRAFFIC_LIGHT = Machine("ROT", {("ROT", "takt"): ("ROT_GELB", "rot/gelb"), ("ROT_GELB", "takt"): ("GRUEN", "gruen"), ("GRUEN", "takt"): ("GELB", "gelb"), ("GELB", "takt"): ("ROT", "rot")}, undefined=ERROR, seed=("rot",))
PARKING = Machine("0€", {("0€", "1€"): ("1€", "nichts"), ("0€", "2€"): ("≥2€", "nichts"), ("0€", "drucken"): ("0€", "nichts"), ("1€", "1€"): ("≥2€", "nichts"), ("1€", "2€"): ("≥2€", "nichts"), ("1€", "drucken"): ("1€", "nichts"), ("≥2€", "1€"): ("≥2€", "nichts"), ("≥2€", "2€"): ("≥2€", "nichts"), ("≥2€", "drucken"): ("0€", "schein+1€")}, undefined=ERROR)
INVERTER = Machine("start", {("start", "0"): ("nach_0", "0"), ("start", "1"): ("nach_0", "0"), ("nach_0", "0"): ("nach_0", "1"), ("nach_0", "1"): ("nach_1", "1"), ("nach_1", "0"): ("nach_0", "0"), ("nach_1", "1"): ("nach_1", "0")}, undefined=ERROR)
DETECTOR_AB = Machine("start", {("start", "a"): ("nach_a", "0"), ("start", "b"): ("start", "0"), ("nach_a", "a"): ("nach_a", "0"), ("nach_a", "b"): ("start", "1")}, undefined=ERROR)
DETECTOR_11 = Machine("q0", {("q0", "0"): ("q0", None), ("q0", "1"): ("q1", None), ("q1", "0"): ("q0", None), ("q1", "1"): ("q2", None), ("q2", "0"): ("q0", None), ("q2", "1"): ("q2", None)}, final=frozenset({"q2"}), undefined=ERROR)
RAG = Machine("idle", {("idle", "run not"): ("retrieved", None), ("retrieved", "auto ok"): ("validated", None), ("validated", "auto ok"): ("generated", None), ("validated", "auto not"): ("failed", None)}, final=frozenset({"generated", "failed"}))
RAG_LOOP = Machine("idle", {("idle", "run not"): ("first_gen", None), ("first_gen", "auto ok"): ("accepted", None), ("first_gen", "auto not"): ("critiqued", None), ("critiqued", "auto not"): ("retrieved_2", None), ("retrieved_2", "auto ok"): ("final_gen", None)}, final=frozenset({"accepted", "final_gen"}))


def sequences(events: DataFrame, key: str, order: list[str], symbol: Column) -> DataFrame:
    """key, inputs: each key's symbols in order, for keys with few events; see machines.transduced() for others."""
    rows = events.select(key, F.struct(*order, symbol.alias("x")).alias("e"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("s")).select(key, F.col("s.x").alias("inputs"))


def run_in_pieces(events: DataFrame, key: str, order: list[str], symbol: Column, machine: Machine, chunk: Column, counted: str | None = None) -> DataFrame:
    """key, state, read, rejected, hits, first, last of a machine over each key's events, without holding them together.

    read: inputs read; hits: outputs equal to `counted`; first, last: outputs. A chunk
    (an expression that never falls along the order, such as the day) of a key's
    events is a function from state to what run() would give from there; functions
    are composed in the order of the chunks. So a key with very many events is read by
    many tasks, and what meets in one row is a small map per chunk.
    """
    states = sorted({machine.start, *machine.stop, *(s for s, _ in machine.transitions), *(n for n, _ in machine.transitions.values())})
    at = lambda s, x: F.concat(s, F.lit("\u0001"), x)
    nexts = literal_map({f"{s}\u0001{x}": n for (s, x), (n, _) in machine.transitions.items()})
    outs = {f"{s}\u0001{x}": o for (s, x), (_, o) in machine.transitions.items() if o is not None}
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")

    def result(state: Column, read: Column, rejected: Column, hits: Column, first: Column, last: Column) -> Column:
        return F.struct(state.alias("state"), read.alias("read"), rejected.alias("rejected"), hits.alias("hits"), first.alias("first"), last.alias("last"))

    def step(acc: Column, x: Column) -> Column:
        halted = acc["rejected"] | acc["state"].isin([*machine.stop]) if machine.stop else acc["rejected"]
        move = at(acc["state"], x)
        target = F.element_at(nexts, move)
        missing = target.isNull()
        if machine.undefined == ERROR:
            target = F.when(missing, F.raise_error(F.concat(F.lit("no transition for "), x)).cast("string")).otherwise(target)
        out = F.element_at(literal_map(outs), move) if outs else none
        hit = F.coalesce((out == counted).cast("long"), zero) if counted else zero
        moved = result(F.coalesce(target, acc["state"]), acc["read"] + 1, missing if machine.undefined == REJECT else F.lit(False), acc["hits"] + hit, F.coalesce(acc["first"], out), F.coalesce(out, acc["last"]))
        return F.when(halted, acc).otherwise(moved)

    begin = lambda s: result(F.lit(s), zero, F.lit(False), zero, none, none)
    rows = events.select(key, chunk.alias("_chunk"), F.struct(*order, symbol.alias("x")).alias("e"))
    folded = rows.groupBy(key, "_chunk").agg(F.array_sort(F.collect_list("e")).alias("s"))
    function = F.create_map(*[c for s in states for c in (F.lit(s), F.aggregate(F.col("s.x"), begin(s), step))])
    parts = folded.select(key, F.struct("_chunk", function.alias("f")).alias("p")).groupBy(key).agg(F.collect_list("p").alias("ps"))
    in_order = F.array_sort("ps", lambda a, b: F.when(a["_chunk"] < b["_chunk"], -1).when(a["_chunk"] > b["_chunk"], 1).otherwise(0))

    def compose(acc: Column, p: Column) -> Column:
        more = F.element_at(p["f"], acc["state"])
        both = result(more["state"], acc["read"] + more["read"], more["rejected"], acc["hits"] + more["hits"], F.coalesce(acc["first"], more["first"]), F.coalesce(more["last"], acc["last"]))
        return F.when(acc["rejected"], acc).otherwise(both)

    return parts.select(key, F.aggregate(in_order, begin(machine.start), compose).alias("r")).select(key, "r.*")


def merge_updates(updates: DataFrame, key: str, seq: str, last: list[str], appended: list[str], chunk: Column) -> DataFrame:
    """One row per key: the last value of each overwritten field, all values of the appended ones in order, the first seq.

    updates: key, seq, field, value. A chunk (an expression that never falls along
    seq) of a key's updates is merged by itself; what meets in one row is a merged
    row per chunk, so a key with very many updates is read by many tasks.
    """
    of = lambda f: F.col("field") == f
    newest = [F.max(F.when(of(f) & F.col("value").isNotNull(), F.struct(seq, "value"))).alias(f) for f in last]
    lists = [F.transform(F.array_sort(F.collect_list(F.when(of(f), F.struct(seq, "value")))), lambda s: s.getField("value")).alias(f) for f in appended]
    merged = updates.groupBy(key, chunk.alias("_chunk")).agg(F.min(seq).alias("first_seq"), *newest, *lists)
    parts = [F.max(f).getField("value").alias(f) for f in last]
    parts += [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", F.col(f).alias("values")))), lambda s: s.getField("values"))).alias(f) for f in appended]
    return merged.groupBy(key).agg(F.min("first_seq").alias("first_seq"), *parts)


def cycles(edges: DataFrame, *keys: str) -> DataFrame:
    """keys, cycle, n: every simple cycle of each key's graph, of any length, written from its smallest node on.

    A cycle lies within one strongly connected component, so only edges within one are
    followed. Paths grow one edge per pass and only from their smallest node, so each
    cycle is found once; it ends when no path is open. The number of simple cycles is
    exponential in the worst case: this is meant for many small graphs, each told apart
    by its keys.
    """
    by = list(keys)
    parts = store(strong_components(edges, *by), "components").df
    of = lambda c: parts.select(*by, F.col("node").alias(c), F.col("component").alias(f"_{c}")).hint(SORTED)
    e = edges.select(*by, F.col("source").alias("u"), F.col("target").alias("v")).distinct()
    e = store(e.join(of("u"), [*by, "u"]).join(of("v"), [*by, "v"]).where("_u = _v").select(*by, "u", "v"), "edges").df
    paths = store(e.select(*by, F.array("u").alias("path"), F.col("v").alias("at")), "paths")
    found = []
    while True:
        found.append(paths.df.where(F.col("at") == F.get("path", F.lit(0))).select(*by, "path"))
        ahead = paths.df.where((F.col("at") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("at"))).withColumnRenamed("at", "u")
        longer = store(ahead.join(e.hint(SORTED), [*by, "u"]).select(*by, F.concat("path", F.array("u")).alias("path"), F.col("v").alias("at")), "paths")
        if longer.df.isEmpty():
            break
        paths = longer
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(*by, F.array_join("path", ">").alias("cycle"), F.size("path").cast("long").alias("n"))
