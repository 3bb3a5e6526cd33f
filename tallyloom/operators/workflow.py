"""A small workflow: nodes give partial updates, routers pick the next node, reducers merge, every run is bounded."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

END = "__end__"


class Pause(Exception):
    """Raised by a node to hand control back; the run goes on from this node with resume()."""


def append(old, new):
    return [*(old or []), *new]


def overwrite(old, new):
    return new


@dataclass
class Workflow:
    """nodes: name to function of the state; edges: name to the next name or to a router of the state.

    reducers: how a field's update is merged, overwrite where none is given. A
    router only reads the state. States hold control values and DataFrames;
    the data itself stays in Spark.
    """

    start: str
    nodes: dict[str, Callable[[dict], dict]]
    edges: dict[str, str | Callable[[dict], str]]
    reducers: dict[str, Callable] = field(default_factory=dict)
    most_steps: int = 25

    def __post_init__(self) -> None:
        unknown = {self.start, *self.edges, *(t for t in self.edges.values() if isinstance(t, str))} - {*self.nodes, END}
        if unknown:
            raise ValueError(f"unknown nodes: {sorted(unknown)}")

    def merge(self, state: dict, update: dict) -> dict:
        return state | {k: self.reducers.get(k, overwrite)(state.get(k), v) for k, v in update.items()}

    def stream(self, state: dict, at: str | None = None) -> Iterator[tuple[str, dict, dict]]:
        """(node, its update, the state after it) step by step."""
        at, steps = at or self.start, 0
        while at != END:
            steps += 1
            if steps > self.most_steps:
                raise RecursionError(f"more than {self.most_steps} steps")
            update = self.nodes[at](dict(state))
            state = self.merge(state, update)
            yield at, update, state
            nxt = self.edges.get(at, END)
            at = nxt if isinstance(nxt, str) else nxt(state)
            if at != END and at not in self.nodes:
                raise ValueError(f"unknown node: {at}")

    def run(self, state: dict, at: str | None = None, checkpoints: dict | None = None, key: str = "run") -> dict:
        """The last state; a checkpoint (node to go on with, state) is kept under key after each step and where a node pauses."""
        try:
            last, here = state, at or self.start
            steps = self.stream(state, at)
            while True:
                try:
                    node, _, last = next(steps)
                except StopIteration:
                    return last
                nxt = self.edges.get(node, END)
                here = nxt if isinstance(nxt, str) else nxt(last)
                if checkpoints is not None:
                    checkpoints[key] = (here, last)
        except Pause:
            if checkpoints is not None:
                checkpoints[key] = (here, last)
            raise

    def resume(self, checkpoints: dict, key: str = "run", update: dict | None = None) -> dict:
        at, state = checkpoints[key]
        return state if at == END else self.run(self.merge(state, update or {}), at, checkpoints, key)
