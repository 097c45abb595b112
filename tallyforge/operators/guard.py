"""Hysteresis monitoring of sensor readings: classification, and the pause and resume machine in batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Degrees, watts, kHz, readings and seconds."""

    cpu_pause: int = 85
    gpu_pause: int = 80
    cpu_resume: int = 75
    gpu_resume: int = 72
    gpu_watts: int = 200
    cpu_khz: int = 3_000_000
    cool_readings: int = 15
    least_pause_seconds: int = 60


def decision(limits: Limits = Limits()) -> Column:  # noqa: B008
    """sensor_failure before limits_changed before hot before cool before hold.

    A reading that is missing or not possible is a failure of the sensors, never a reason to go on. One of several devices at
    once is several rows: ``watch.events`` makes them one failure.
    """
    c = F.col
    return (
        F.when(broken(), "sensor_failure").when((c("gpu_limit_w") > limits.gpu_watts) | (c("cpu_max_khz") > limits.cpu_khz), "limits_changed")
        .when((c("cpu_c") >= limits.cpu_pause) | (c("gpu_c") >= limits.gpu_pause) | c("slowdown"), "hot")
        .when((c("cpu_c") <= limits.cpu_resume) & (c("gpu_c") <= limits.gpu_resume), "cool")
        .otherwise("hold")
    )


def broken() -> Column:
    """Whether a reading cannot be believed: a value is missing, or a temperature is outside (0, 120)."""
    good = lambda x: F.coalesce((F.col(x) > 0) & (F.col(x) < 120), F.lit(False))
    known = F.col("gpu_limit_w").isNotNull() & F.col("cpu_max_khz").isNotNull() & F.col("slowdown").isNotNull()
    return ~(good("cpu_c") & good("gpu_c") & known)


def invalid(readings: DataFrame) -> DataFrame:
    """Readings that cannot be believed."""
    return readings.where(broken())


def several_devices(readings: DataFrame) -> DataFrame:
    """(host, ts, devices) where one reading of a host is about more devices than one."""
    return readings.groupBy("host", "ts").agg(F.count("*").alias("devices")).where("devices > 1")


def stopping(log: DataFrame) -> DataFrame:
    """(host, event_id, action) that ends each host's log: a guard that stops leaves what it watches paused."""
    last = log.groupBy("host").agg(F.max_by(F.struct("event_id", "paused"), "event_id").alias("r"))
    return last.select("host", "r.event_id", F.when(F.col("r.paused"), "none").otherwise("pause").alias("action"))


def latest(readings: DataFrame) -> DataFrame:
    """The last reading of each host with its decision."""
    return readings.withColumn("decision", decision()).groupBy("host").agg(F.max_by(F.struct("event_id", "decision", "cpu_c", "gpu_c"), F.struct("ts", "event_id")).alias("r")).select("host", "r.*")


@dataclass
class Machine:
    """Paused, owner of the pause, readings in a row that were cool, and when the pause began."""

    paused: bool = False
    owned: bool = False
    cool: int = 0
    since: float = 0.0

    def feed(self, what: str, now: float, limits: Limits) -> str:
        """The action that a decision (or 'sensor_failure') causes: pause, resume or none."""
        if what in ("hot", "limits_changed", "sensor_failure"):
            self.cool = 0
            if not self.paused:
                self.paused, self.owned, self.since = True, True, now
                return "pause"
            return "none"
        if self.paused and self.owned:
            self.cool = self.cool + 1 if what == "cool" else 0
            if self.cool >= limits.cool_readings and now - self.since >= limits.least_pause_seconds:
                self.paused, self.owned, self.cool = False, False, 0
                return "resume"
        return "none"


SCHEMA = "host long, event_id long, decision string, action string, paused boolean, cool int"


def run_machine(readings: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The machine over each host's readings in order of time.

    Hosts are dealt by hash and sorted inside a partition, and the readings stream through it, so a host with very many
    readings needs no more memory than any other.
    """
    rows = readings.select("host", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").cast("double").alias("t"), decision(limits).alias("decision")).repartition("host").sortWithinPartitions("host", "t", "event_id")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, machine = object(), Machine()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.host != host:
                    host, machine = r.host, Machine()
                action = machine.feed(r.decision, r.t, limits)
                out.append((r.host, r.event_id, r.decision, action, machine.paused, machine.cool))
            yield pd.DataFrame(out, columns=["host", "event_id", "decision", "action", "paused", "cool"])

    return rows.mapInPandas(walk, SCHEMA)
