"""The clocked guard as a stream: state and timers of each host in the state store, and a sink whose commits repeat safely.

Readings wait in a list state until the watermark has passed them, so they act in the order of their times however they
arrive within the delay; later ones are dropped by the watermark. A timer per host stands at the next moment that something
can happen: a waiting reading, silence, the end of a pause. Once the watermark is past it the host is brought up to date,
by the code that the batch runs.

The sink keeps the log of a batch in a folder of its id and the newest row of each host beside it. Both count from the moment a
small pointer file is replaced, in one rename. A batch that runs again writes the same folders, so a restart changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyforge.operators import watch as w
from tallyforge.operators.guard import Machine, decision
from tallyforge.sources.io import read_text, replace_text

STORE = "spark.sql.streaming.stateStore.providerClass"


class Guard(StatefulProcessor):
    def __init__(self, watch: w.Watch):
        self.watch = watch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "paused boolean, owned boolean, cool int, since double, last long, event_id long, silent boolean")
        self.waiting = handle.getListState("waiting", "us long, event_id long, what string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.us), None if pd.isna(r.event_id) else int(r.event_id), r.what) for f in rows for r in f.itertuples(index=False)]
        self.waiting.appendList(new)
        self.handle.registerTimer(-(-min(x[0] for x in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(((int(u), e, d) for u, e, d in self.waiting.get()), key=lambda x: (x[0], x[1] is None, x[1] or 0)) if self.waiting.exists() else []
        ready, rest = [x for x in waiting if x[0] <= mark], [x for x in waiting if x[0] > mark]
        now = w.Clocked(self.watch)
        if self.machine.exists():
            paused, owned, cool, since, last, event_id, silent = self.machine.get()
            now = w.Clocked(self.watch, Machine(paused, owned, cool, since), last, event_id, silent)
        out, i = [], 0
        while i < len(ready):
            j = i
            while j < len(ready) and ready[j][0] == ready[i][0]:
                j += 1
            ids = [e for _, e, _ in ready[i:j] if e is not None]
            out += now.read(ready[i][0], min(ids, default=None), "sensor_failure" if j - i > 1 else ready[i][2])
            i = j
        out += now.advance(mark, True)
        m = now.machine
        if now.last is not None:
            self.machine.update((m.paused, m.owned, m.cool, float(m.since), now.last, now.event_id, now.silent))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        at = [x for x in ((now.clock() or (None,))[0], rest[0][0] if rest else None) if x is not None]
        if at:
            self.handle.registerTimer(-(-min(at) // 1000))
        host = None if key[0] is None or pd.isna(key[0]) else int(key[0])
        if out:
            yield w.frame([(host, *x) for x in out])

    def close(self) -> None:
        pass


def stream(readings: DataFrame, watch: w.Watch = w.Watch(), delay: str = "10 seconds") -> DataFrame:  # noqa: B008
    """``watch.SCHEMA`` rows of a stream of readings; ``delay`` is how late a reading may come."""
    readings.sparkSession.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = readings.withWatermark("ts", delay).select("host", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), decision(watch.limits).alias("what"))
    return rows.groupBy("host").transformWithStateInPandas(Guard(watch), w.SCHEMA, "Append", "EventTime")


def committed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(log, newest row of each host) as of the last commit in ``path``; None before the first."""
    told = read_text(spark, f"{path}/committed.json")
    if told is None:
        return None
    batch = json.loads(told)["batch"]
    log = spark.read.schema(f"{w.SCHEMA}, batch long").parquet(f"{path}/log").where(F.col("batch") <= batch).drop("batch")
    return log, spark.read.parquet(f"{path}/newest/batch={batch}")


def keep(path: str):
    """A function for ``foreachBatch`` that commits a batch's log and the newest rows together."""

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        told = read_text(spark, f"{path}/committed.json")
        last = json.loads(told)["batch"] if told else None
        if last is not None and last >= batch:
            return  # ran before, to its end
        rows.write.mode("overwrite").parquet(f"{path}/log/batch={batch}")
        new = w.latest(spark.read.schema(w.SCHEMA).parquet(f"{path}/log/batch={batch}"))
        if last is not None:
            new = w.latest(spark.read.parquet(f"{path}/newest/batch={last}").unionByName(new))
        new.write.mode("overwrite").parquet(f"{path}/newest/batch={batch}")
        replace_text(spark, f"{path}/committed.json", json.dumps({"batch": batch}))

    return run


def start(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Runs ``rows`` of ``stream`` into the sink in ``path``."""
    return rows.writeStream.foreachBatch(keep(path)).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "1 second"})).start()
