"""Calls that a TAP run on a stream makes to its state."""

from datetime import datetime

import pandas as pd

from testlog.streaming import close


class Calls:
    """A value and a map as the state store keeps them, counting the calls made."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "containsKey", "getValue", "updateValue", "removeKey", "registerTimer", "deleteTimer"):
            self.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def iterator(self):
        return iter(list(self.map.items()))

    def registerTimer(self, _):
        pass

    deleteTimer = registerTimer


def play(parts):
    state = Calls()
    runs = close.TapRuns(False, 0, 1000)
    runs.init(state)
    token = dict.fromkeys(close.TOKEN_NAMES) | {"spaces": 0, "tab": False, "kind": close.KINDS.index("point"), "ok": True}
    for numbers in parts:
        rows = [{"line_no": n, "event_ts": pd.Timestamp(datetime(2024, 1, 1)), **token} for n in numbers]
        list(runs.handleInputRows((1,), iter([pd.DataFrame(rows)]), None))
    fold, held, expected, *_ = runs._load()
    return state, fold.stack[0]["total"], held.items(), expected


EARLY = [[3, 6, 9, 7], [1, 4, 10, 8], [2, 5]]


def test_early_lines_of_a_short_run_cost_no_calls():
    state, total, held, expected = play(EARLY)
    assert (total, held, expected) == (10, [], 11)
    assert state.calls <= 10


def test_early_lines_over_the_limit_go_to_the_map(monkeypatch):
    monkeypatch.setattr(close, "HELD_CHARS", 150)
    state, total, held, expected = play(EARLY)
    assert (total, held, expected, state.map) == (10, [], 11, {})
    state, total, held, expected = play([[5, 3, 4], [2, 3]])
    assert (total, [n for n, _ in held], expected) == (0, [2, 3, 4, 5], 1) and state.map
