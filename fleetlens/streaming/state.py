"""Keyed state of facts: the pushes of every (repo, type, name), kept by the state store of the stream.

Kept are the pushes of a fact that a late push may still come before, in the order of their events, and the one before
them. Reading and writing a value of the state store costs far more than a fact, so facts are dealt by a hash of their key over
slices and a slice is one value: a micro-batch reads and writes the slices it meets, once each. How many facts a slice
holds follows the number of slices and not how many one repository has. Once the watermark has passed a push nothing can come before it any more:
a slice is folded when it is met, or by a timer when it stays quiet. With ``expire_days`` the timer also forgets facts
that have had no push for so long.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["repo", "type", "name"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
HISTORY = "facts binary, timer bigint"
#: Slices of a stream that does not say how many it wants.
SLICES = 1 << 16

TOLD = Row(*KEY, "push_id", "millis", "from_sha", "to_sha", "again", "newest")
Push = tuple[int, int, str]  # event time in milliseconds, push, hash of the fact


def merge(known: list[Push], arrived: list[Push]) -> tuple[list[Push], list[tuple[Push, str | None, bool]]]:
    """The history with arrived pushes, and what to tell: (push, hash before it, told before).

    Told are the arrived pushes and those that now stand right behind one. A push that is known already is not told again.
    """
    fresh = set(arrived) - set(known)
    history = sorted([*known, *fresh])
    told = []
    for i, push in enumerate(history):
        before = history[i - 1] if i else None
        if push in fresh or (before in fresh):
            told.append((push, before[2] if before else None, push not in fresh))
    return history, told


def fold(history: list[Push], watermark: int) -> list[Push]:
    """The pushes at or after the watermark, and the newest one before it."""
    at = sum(push[0] < watermark for push in history)
    return history[max(at - 1, 0) :]


class FactHistory(StatefulProcessor):
    """Tells every arrived push of a fact with the hash before it, and again those a late push comes before."""

    def __init__(self, expire_millis: int | None = None):
        self.expire = expire_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("history", HISTORY)

    def _read(self) -> tuple[dict[tuple, list[Push]], int | None]:
        """The facts of the slice and its timer."""
        found = self.value.get()
        return (pickle.loads(found[0]), found[1]) if found else ({}, None)

    def _write(self, facts: dict[tuple, list[Push]], timer: int | None, watermark: int) -> None:
        """Store the facts, folded, with one timer at or before the next time there is something to fold or to forget."""
        wanted = []
        for key, history in facts.items():
            if len(history) > 1:
                facts[key] = history = fold(history, watermark)
                wanted += [history[-1][0] + 1] if len(history) > 1 else []
        wanted = [max(wanted)] if wanted else []
        if self.expire is not None:
            wanted.append(min(history[-1][0] for history in facts.values()) + self.expire)
        if wanted and (timer is None or min(wanted) < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = min(wanted)
            self.handle.registerTimer(timer)
        self.value.update((pickle.dumps(facts, pickle.HIGHEST_PROTOCOL), timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived: dict[tuple, list[Push]] = {}
        for repo, type_, name, push, millis, sha, *_ in rows:
            # equal texts are one object, which is stored once
            fact = (repo, type_ and sys.intern(type_), name and sys.intern(name))
            arrived.setdefault(fact, []).append((millis, push, sha))
        facts, timer = self._read()
        out = []
        for fact, pushes in arrived.items():
            facts[fact], told = merge(facts.get(fact, []), pushes)
            newest = facts[fact][-1]
            out += [TOLD(*fact, push[1], push[0], before, push[2], again, push == newest) for push, before, again in told]
        self._write(facts, timer, timerValues.getCurrentWatermarkInMs())
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        facts, timer = self._read()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            watermark = timerValues.getCurrentWatermarkInMs()
            if self.expire is not None:
                facts = {fact: history for fact, history in facts.items() if history[-1][0] + self.expire >= watermark}
            if facts:
                self._write(facts, None, watermark)
            else:
                self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def told_facts(facts: DataFrame, delay: str, expire_days: int | None = None, slices: int = SLICES) -> DataFrame:
    """Stream of (repo, type, name, push_id, millis, from_sha, to_sha, again, newest) from a stream of
    (repo, type, name, push_id, ts, sha).

    ``again`` marks a push told before whose predecessor is now another one; the last telling of a push holds. Facts more
    than ``delay`` behind the newest event are dropped. Start the query with ``with_keyed_state``; a checkpoint keeps its
    number of ``slices``.
    """
    at = F.col("ts").cast("timestamp")
    slice_ = F.pmod(F.xxhash64(*KEY), F.lit(slices)).alias("slice")
    rows = facts.select(*KEY, "push_id", F.unix_millis(at).alias("millis"), "sha", slice_, at.alias("at")).withWatermark("at", delay)
    expire = None if expire_days is None else expire_days * 86_400_000
    types = {f.name: f.dataType.simpleString() for f in facts.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in [*KEY, "push_id"]) + ", millis bigint, from_sha string, to_sha string, again boolean, newest boolean"
    return rows.groupBy("slice").transformWithState(FactHistory(expire), schema, "Update", "EventTime")


class with_keyed_state:
    """Queries started inside keep their state in RocksDB on local disks, with changelogs in their checkpoint."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(PROVIDER, None)
        self.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *error):
        self.conf.unset(PROVIDER) if self.before is None else self.conf.set(PROVIDER, self.before)
