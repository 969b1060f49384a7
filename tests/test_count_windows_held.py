"""What a count window's task holds at once: the rows of an hour, or a part of a full one, not all that wait."""

import random

import pandas as pd

from wardline.streaming import streams


class State(dict):
    """A map, list and value state of one key."""

    getValue, removeKey, exists = dict.get, dict.pop, dict.__len__
    updateValue = dict.__setitem__

    def update(self, value):
        self[0] = value

    def get(self, *_):
        return self.get_list() if isinstance(self.getValue(0), list) else self.getValue(0, ())

    def get_list(self):
        return iter(self.getValue(0))

    def put(self, rows):
        self[0] = rows


class Handle:
    def __init__(self):
        self.timers, self.states = [], {}

    def _state(self, name, *_):
        return self.states.setdefault(name, State())

    getMapState = getListState = getValueState = _state

    def registerTimer(self, ms):
        self.timers.append(ms)


class Time:
    def __init__(self, us):
        self.ms = us // 1000

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_rows_held_are_bounded(monkeypatch):
    monkeypatch.setattr(streams, "_HELD", 50)
    r, hour = random.Random(2), 3_600_000_000
    rows = [(r.randrange(5 * hour), i, float(i)) for i in range(300)] + [(hour + r.randrange(hour), 300 + i, float(i)) for i in range(400)]
    rows += rows[:20]
    r.shuffle(rows)
    processor, held = streams._CountWindows("k", "long", 10, 5, None, 1.0), []
    processor.init(Handle())
    windows = processor._windows
    processor._windows = lambda ready: held.append(len(ready)) or windows(ready)
    frames = (pd.DataFrame(rows[i : i + 30], columns=["us", "id", "value"]) for i in range(0, len(rows), 30))
    assert list(processor.handleInputRows(("a",), frames, None)) == []
    got = []
    for passed in (90 * hour // 60, 200 * hour // 60, 9 * hour):
        got += list(processor.handleExpiredTimer(("a",), Time(passed), None))
        assert not processor.slots or min(processor.handle.timers[-2:]) * 1000 >= passed
    got = pd.concat(got)
    mine = sorted(set(rows))
    want = [(mine[i - 9][0], mine[i][0], sum(v for _, _, v in mine[i - 9 : i + 1]) / 10) for i in range(9, len(mine), 5)]
    assert list(zip(got["start"], got["end"], got["mean"])) == want and got["window"].tolist() == list(range(len(want)))
    # Parts are cut by time, so they differ in rows.
    assert sum(held) == 700 and max(held) <= 150
    assert not processor.slots and not processor.pending
