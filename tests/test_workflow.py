"""Bounded loops, pure routers, reducers, pauses."""

import pytest

from tallyloom.operators.workflow import END, Pause, Workflow, append


def looping(accept, most=3):
    nodes = {"ask": lambda s: {"question": s["question"] + "?", "history": [s["question"]]}, "check": lambda s: {"tries": s.get("tries", 0) + 1, "ok": accept(s)}}
    route = lambda s: END if s["ok"] or s["tries"] >= most else "ask"
    return Workflow("ask", nodes, {"ask": "check", "check": route}, {"history": append})


def test_a_checker_that_never_accepts_ends():
    out = looping(lambda s: False).run({"question": "q", "history": []})
    assert out["tries"] == 3 and out["history"] == ["q", "q?", "q??"]
    assert [n for n, _, _ in looping(lambda s: True).stream({"question": "q"})] == ["ask", "check"]


def test_unbounded_loop_is_stopped():
    with pytest.raises(RecursionError):
        Workflow("a", {"a": lambda s: {}}, {"a": "a"}, most_steps=5).run({})


def test_unknown_nodes():
    with pytest.raises(ValueError, match="unknown"):
        Workflow("a", {"a": lambda s: {}}, {"a": "b"})
    with pytest.raises(ValueError, match="unknown"):
        Workflow("a", {"a": lambda s: {}}, {"a": lambda s: "b"}).run({})


def test_pause_and_resume():
    def review(s):
        if "approved" not in s:
            raise Pause
        return {"done": s["approved"]}

    flow = Workflow("scan", {"scan": lambda s: {"files": 3}, "review": review}, {"scan": "review"})
    kept = {}
    with pytest.raises(Pause):
        flow.run({}, checkpoints=kept)
    assert kept["run"] == ("review", {"files": 3})
    assert flow.resume(kept, update={"approved": True}) == {"files": 3, "approved": True, "done": True}


def test_nodes_do_not_change_the_state_they_are_given():
    def bad(s):
        s["x"] = 99
        return {}

    assert Workflow("a", {"a": bad}, {}).run({"x": 1}) == {"x": 1}
