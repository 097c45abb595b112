"""The guard machine with clocks: a host that falls silent is a sensor failure, and the least pause ends by itself.

``guard.run_machine`` acts on readings alone. Here two clocks act too, both in event time:

* silence: no reading for ``silence_seconds`` after a host's last one is a failure of its sensors at that moment, so what the
  host watches is paused though nothing was read;
* the least pause: a host that has cooled for enough readings while the pause was too short resumes when the pause is long
  enough, if nothing came before.

A reading of more than one device (several rows of one host and time) is one failure. At one moment a reading comes before
silence, silence before the end of a pause. Events up to ``horizon`` count: the last reading of all hosts, or a stream's watermark.

Defined cases. A null host is a host of its own. Rows without a time are left out. Repeated rows are readings of several
devices. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.guard import Limits, Machine, decision

SCHEMA = "host long, us long, event_id long, kind string, decision string, action string, paused boolean, cool int"
SECOND = 1_000_000


@dataclass(frozen=True)
class Watch:
    """Limits of the machine and the seconds without a reading that are silence."""

    limits: Limits = field(default_factory=Limits)
    silence_seconds: int = 300


@dataclass
class Clocked:
    """A machine with its clocks, in microseconds. ``advance`` and ``read`` return rows without their host."""

    watch: Watch
    machine: Machine = field(default_factory=Machine)
    last: int | None = None
    event_id: int | None = None
    silent: bool = False

    def _row(self, us: int, kind: str, what: str, action: str) -> tuple:
        return (us, self.event_id, kind, what, action, self.machine.paused, self.machine.cool)

    def clock(self) -> tuple[int, str] | None:
        """The next moment at which something happens without a reading."""
        if self.last is None:
            return None
        found = [] if self.silent else [(self.last + self.watch.silence_seconds * SECOND, "silence")]
        m, limits = self.machine, self.watch.limits
        if m.paused and m.owned and m.cool >= limits.cool_readings:
            found.append((int(m.since) + limits.least_pause_seconds * SECOND, "timer"))
        return min(found, key=lambda x: (x[0], x[1] == "timer"), default=None)

    def advance(self, to: int, inside: bool) -> list[tuple]:
        """What the clocks do before ``to``, and at it if ``inside``."""
        rows = []
        while (at := self.clock()) and (at[0] < to or inside and at[0] == to):
            us, kind = at
            if kind == "silence":
                self.silent = True
                rows.append(self._row(us, kind, "sensor_failure", self._feed("sensor_failure", us)))
            else:
                self.machine.paused, self.machine.owned, self.machine.cool = False, False, 0
                rows.append(self._row(us, kind, "cool", "resume"))
        return rows

    def read(self, us: int, event_id: int, what: str) -> list[tuple]:
        rows = self.advance(us, False)
        self.last, self.event_id, self.silent = us, event_id, False
        return [*rows, self._row(us, "reading", what, self._feed(what, us))]

    def _feed(self, what: str, us: int) -> str:
        limits = self.watch.limits
        action = self.machine.feed(what, us, Limits(**(limits.__dict__ | {"least_pause_seconds": limits.least_pause_seconds * SECOND})))
        return action


def events(readings: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(host, us, event_id, decision): one row for each host and time."""
    rows = readings.where("ts is not null").select("host", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").cast("long").alias("event_id"), decision(limits).alias("what"))
    merged = rows.groupBy("host", "us").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"), F.min("what").alias("what"))
    return merged.select("host", "us", "event_id", F.when(F.col("n") > 1, "sensor_failure").otherwise(F.col("what")).alias("decision"))


def run(readings: DataFrame, watch: Watch = Watch()) -> DataFrame:  # noqa: B008
    """``SCHEMA`` rows of every host; readings stream through sorted tasks, so no host is held in memory."""
    rows = events(readings, watch.limits)
    ends = rows.agg(F.max("us").alias("horizon"))
    placed = rows.join(F.broadcast(ends)).repartition("host").sortWithinPartitions("host", "us")  # one row

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, now, horizon = object(), None, 0
        out: list[tuple] = []
        for f in frames:
            for r in f.astype({"host": object}).itertuples(index=False):
                mine = None if pd.isna(r.host) else int(r.host)
                if mine != host:
                    out += [(host, *x) for x in now.advance(horizon, True)] if now else []
                    host, now, horizon = mine, Clocked(watch), int(r.horizon)
                out += [(host, *x) for x in now.read(int(r.us), None if pd.isna(r.event_id) else int(r.event_id), r.decision)]
            yield frame(out)
            out = []
        yield frame([(host, *x) for x in now.advance(horizon, True)] if now else [])

    return placed.select("host", "us", "event_id", "decision", "horizon").mapInPandas(walk, SCHEMA)


def frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["host", "us", "event_id", "kind", "decision", "action", "paused", "cool"])
    return made.astype({"host": "Int64", "us": "int64", "event_id": "Int64", "kind": object, "decision": object, "action": object, "paused": bool, "cool": "int32"})


def silences(readings: DataFrame, watch: Watch = Watch()) -> DataFrame:  # noqa: B008
    """(host, us, until): when hosts fell silent and when they were heard again, null where they were not."""
    rows = events(readings, watch.limits)
    after = F.lead("us").over(Window.partitionBy("host").orderBy("us"))
    gaps = rows.select("host", "us", after.alias("until")).join(F.broadcast(rows.agg(F.max("us").alias("horizon"))))  # one row
    edge = F.col("us") + watch.silence_seconds * SECOND
    return gaps.where((edge < F.col("until")) | F.col("until").isNull() & (edge <= F.col("horizon"))).select("host", edge.alias("us"), "until")


def latest(log: DataFrame) -> DataFrame:
    """(host, us, event_id, decision, action, paused, cool) of the last row of each host."""
    order = F.struct("us", F.when(F.col("kind") == "reading", 0).when(F.col("kind") == "silence", 1).otherwise(2))
    return log.groupBy("host").agg(F.max_by(F.struct("us", "event_id", "kind", "decision", "action", "paused", "cool"), order).alias("r")).select("host", "r.*")
