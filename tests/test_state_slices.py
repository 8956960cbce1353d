"""Facts share values of the state store, and what they tell does not depend on how they are dealt."""

from __future__ import annotations

import random
from datetime import timedelta

from fleetlens.session import scratch_path
from fleetlens.streaming import jobs
from fleetlens.streaming.state import FactHistory
from test_keyed_state import SCHEMA, START, expected


class Store:
    """A state store of one key that counts its calls."""

    def __init__(self):
        self.value, self.timers, self.calls, self.watermark = None, set(), 0, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def fire(self, history):
        """All timers before the watermark."""
        for at in sorted(t for t in self.timers if t < self.watermark):
            self.timers.discard(at)
            list(history.handleExpiredTimer((0,), self, type("Info", (), {"getExpiryTimeInMs": lambda self: at})()))


def history(expire=None):
    store, told = Store(), FactHistory(expire)
    told.init(store)
    return store, told


def test_a_micro_batch_costs_calls_by_slices_and_not_by_facts():
    store, told = history()
    rows = [(repo, "t", f"n{name}", repo, 10 + repo, "a") for repo in range(50) for name in range(10)]
    out = list(told.handleInputRows((0,), iter(rows), store))
    assert len(out) == 500 and store.calls <= 4
    assert {r.newest for r in out} == {True} and {r.from_sha for r in out} == {None}


def test_facts_of_a_slice_fold_and_expire_one_by_one():
    store, told = history(expire=100)
    tell = lambda *rows: [(r.repo, r.push_id, r.from_sha, r.again) for r in told.handleInputRows((0,), iter(rows), store)]
    row = lambda repo, push, sha: (repo, "t", "n", push, push, sha)
    tell(row(1, 10, "a"), row(1, 20, "b"), row(2, 10, "a"), row(None, 50, "a"))
    store.watermark = 15
    store.fire(told)
    assert tell(row(1, 15, "x")) == [(1, 15, "a", False), (1, 20, "x", True)]
    store.watermark = 115  # repository 2 is forgotten after 110, the others after 120 and 150
    store.fire(told)
    assert tell(row(1, 116, "c"), row(2, 116, "z")) == [(1, 116, "b", False), (2, 116, None, False)]
    store.watermark = 400
    store.fire(told)
    assert store.value is None and not store.timers


def test_any_number_of_slices_tells_the_same_and_a_restart_keeps_it(spark):
    rng = random.Random(5)
    rows = [(p % 9 or None, "t", f"n{rng.randrange(4)}", p, START + timedelta(hours=p), rng.choice("abc")) for p in range(200)]
    wanted = expected([(-1 if r[0] is None else r[0], *r[1:]) for r in rows])[0]
    for slices in (1, 7):
        folder, location = scratch_path(spark, "in"), scratch_path(spark, "state")
        for i, wave in enumerate((rows[:90] + rows[120:130], rows[90:120] + rows[130:])):
            spark.createDataFrame(wave, SCHEMA).coalesce(2).write.mode("append").parquet(folder)
            stream = jobs.read_folder_stream(spark, folder, spark.read.parquet(folder).schema)
            out = jobs.write_changes(stream, location, "30 days", slices=slices + i)  # the first run's number holds
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, out.collect())) == sorted(wanted)
