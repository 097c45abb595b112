"""The pause and resume machine as a stateful stream: one state per host, kept by the checkpoint over restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.operators.guard import SCHEMA, Limits, Machine, decision

STATE = "paused boolean, owned boolean, cool int, since double"


def stream_machine(readings: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Actions for a stream of readings, in arrival order inside a micro-batch's event time."""
    rows = readings.select("host", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").cast("double").alias("t"), decision(limits).alias("decision"))

    def feed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine(*state.get) if state.exists else Machine()
        pdf = pd.concat(frames).sort_values(["t", "event_id"])
        out = []
        for r in pdf.itertuples(index=False):
            action = machine.feed(r.decision, r.t, limits)
            out.append((key[0], r.event_id, r.decision, action, machine.paused, machine.cool))
        state.update((machine.paused, machine.owned, machine.cool, machine.since))
        yield pd.DataFrame(out, columns=["host", "event_id", "decision", "action", "paused", "cool"])

    return rows.groupBy("host").applyInPandasWithState(feed, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream's rows as Parquet; restarts go on where the checkpoint says."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
