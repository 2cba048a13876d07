"""The versioned history of names as stream state: what :func:`worldpulse.operators.identity.history` gives for a batch.

Observations ``(key, name, seen_at, id)`` may come out of order within the watermark. They wait in the state until it has
passed them, by timers, and are then taken in order of time and id. A name that was given up stays known until the
horizon; a timer forgets it then. State is kept by RocksDB, so it needs no room in the heap: a row per key, with the names
that are still known, and one per batch of its observations that wait. A key has a timer for the first thing it waits for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HORIZON_MONTHS = 6
STATE_STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What became of a name: it was taken on, given up, or, some time later, forgotten.
OPENED, CLOSED, FORGOTTEN = "opened", "closed", "forgotten"


def forgotten_at(given_up: datetime, months: int = HORIZON_MONTHS) -> datetime:
    """The first instant from which ``months`` calendar months back lies no earlier than ``given_up``."""
    year, month = divmod(given_up.year * 12 + given_up.month - 1 + months, 12)
    try:
        return given_up.replace(year=year, month=month + 1)
    except ValueError:
        # The month is too short for the day: the first of the next one is the earliest that reaches it.
        year, month = divmod(year * 12 + month + 1, 12)
        return given_up.replace(year=year, month=month + 1, day=1, hour=0, minute=0, second=0, microsecond=0)


def _millis(t: datetime) -> int:
    """The first whole millisecond that is not before ``t``, a time in UTC."""
    return -int(-t.replace(tzinfo=timezone.utc).timestamp() * 1000 // 1)


def _utc(t: datetime) -> datetime:
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


class Names(StatefulProcessor):
    """One key's names."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "name string, micros long, version long, known string")
        self.waiting = handle.getListState("waiting", "observations string")

    # Each call to the state is a message to the JVM, each row of it a conversion: there are a few per key and batch, none per
    # observation. What waits, and the names that are known, are JSON: lists of (micros, id, name), and micros by name.

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(r["micros"], r["id"], r["name"]) for r in rows]
        self.waiting.appendValue((json.dumps(new),))
        # The first one's timer registers the next.
        self.handle.registerTimer(-(-min(new)[0] // 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for (batch,) in self.waiting.get() for x in json.loads(batch))
        ready = [x for x in waiting if x[0] <= reached]
        later = waiting[len(ready) :]
        stored = self.state.get()
        now, before = (None, {}) if stored is None else (tuple(stored)[:3], json.loads(stored[3]))
        known = dict(before)
        out: list[Row] = []
        timers = [-(-later[0][0] // 1000)] if later else []
        if ready:
            self.waiting.put([(json.dumps(later),)]) if later else self.waiting.clear()
            for at, _, name in ready:
                if now is not None and now[0] == name:
                    continue
                if now is not None:
                    out.append(Row(key=key[0], name=now[0], event=CLOSED, version=now[2], valid_from=now[1], valid_to=at))
                    known[now[0]] = at
                # A name that comes back is current, not one that was given up.
                known.pop(name, None)
                version = 0 if now is None else now[2] + 1
                out.append(Row(key=key[0], name=name, event=OPENED, version=version, valid_from=at, valid_to=None))
                now = (name, at, version)
        for name, at in list(known.items()):
            until = _millis(forgotten_at(datetime.fromtimestamp(at / 1e6, timezone.utc).replace(tzinfo=None)))
            if until * 1000 <= reached:
                del known[name]
                out.append(Row(key=key[0], name=name, event=FORGOTTEN, version=None, valid_from=at, valid_to=until * 1000))
            else:
                timers.append(until)
        # An expired timer that changed nothing leaves the next one as it was registered before.
        if ready or known != before:
            self.state.update((*now, json.dumps(known)))
            if timers:
                self.handle.registerTimer(min(timers))
        return iter(out)

    def close(self) -> None:
        pass


def changes(observations: DataFrame, key: str, name: str, seen_at: str, order: str, late_by: str = "10 minutes") -> DataFrame:
    """Events ``(key, name, event, version, valid_from, valid_to)`` of a stream of observations. Those later than the watermark are dropped, as are null names and times.

    ``closed`` and ``opened`` come in pairs, once the watermark has passed the change; ``forgotten`` has the times at which a
    name was given up and forgotten.
    """
    rows = observations.select(F.col(key).cast("long").alias("key"), F.col(name).alias("name"), F.col(seen_at).cast("timestamp").alias("seen_at"), F.col(order).cast("long").alias("id"))
    known = rows.filter("key is not null and name is not null and seen_at is not null").withWatermark("seen_at", late_by)
    timed = known.withColumn("micros", F.unix_micros("seen_at"))
    found = timed.groupBy("key").transformWithState(Names(), "key long, name string, event string, version long, valid_from long, valid_to long", "Append", "EventTime")
    return found.select("key", "name", "event", "version", F.timestamp_micros("valid_from").alias("valid_from"), F.timestamp_micros("valid_to").alias("valid_to"))


def run_to(events: DataFrame, path: str, checkpoint: str) -> None:
    """Take in what there is and add its events to the Parquet folder ``path``, each once; the state stays in ``checkpoint``."""
    spark = events.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def history(events: DataFrame) -> DataFrame:
    """``(key, name, valid_from, valid_to, active)`` from the stored events of :func:`changes`: a version is closed if any event says so."""
    versions = events.filter(F.col("event").isin(OPENED, CLOSED)).groupBy("key", "version").agg(F.min("name").alias("name"), F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"))
    return versions.select("key", "name", "valid_from", "valid_to", F.col("valid_to").isNull().alias("active"))
