"""Leases of a run's shards as a stream: each run's shards are keyed state, stale leases come back by timers, and runs are forgotten after a time.

One function, `moved`, says what an event does to a run. `lease_stream` applies it to keyed state in a stream, `lease_replay` to a table of all events; both report
each change of a shard, so a stream that was stopped and went on tells the same as the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# States of a shard and of a run, and what a lease that went stale is told.
PENDING, RUNNING, COMPLETED, RETRY, FAILED = "pending", "running", "completed", "retry", "failed"
STALE = "stale_assignment"

#: The state store that keyed maps and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENTS = "run string, seq long, event string, shard int, worker string, detail string, at timestamp"
#: Times are microseconds here, whatever the workers' time zone.
_CHANGES = "run string, shard int, status string, attempts int, worker_id string, error string, at long, run_status string"
_SHARD = "status string, attempts int, worker_id string, error string, at long"
_MINUTE = 60_000_000
_FIELDS = ("status", "attempts", "worker_id", "error", "at")


def run_status(shards: dict[int, tuple]) -> str:
    """failed if a shard is, completed if all are, pending if nothing was begun, else running."""
    seen = {s[0] for s in shards.values()}
    return FAILED if FAILED in seen else seen.pop() if len(seen) == 1 and seen <= {COMPLETED, PENDING} else RUNNING


def moved(shards: dict[int, tuple], event: str, shard: int | None, worker: str | None, detail: str | None, at: int, retries: int) -> tuple[int, tuple] | None:
    """(shard, its new state) that an event makes of a run's shards (status, attempts, worker, error, since), None if it changes nothing.

    plan adds a shard, pending; of one that is there it begins anew. claim gives a worker the first shard that is pending or to be retried. complete ends a shard, fail gives it
    back until it was tried over `retries` times. Other events, and those of shards that aren't there, change nothing.
    """
    if event == "plan" and shard is not None:
        return shard, (PENDING, 0, None, None, at)
    if event == "claim":
        free = min((k for k, s in shards.items() if s[0] in (PENDING, RETRY)), default=None)
        return None if free is None else (free, (RUNNING, shards[free][1] + 1, worker, None, at))
    if shard not in shards:
        return None
    _, attempts, holder, _, _ = shards[shard]
    if event == "complete":
        return shard, (COMPLETED, attempts, holder, None, at)
    if event == "fail":
        return shard, (RETRY if attempts <= retries else FAILED, attempts, holder, detail, at)
    return None


def expired(shards: dict[int, tuple], now: int, stale: int) -> list[tuple[int, tuple]]:
    """The leases that are older than `stale` at a time, each given back as of the moment when it became so."""
    out = [(k, (RETRY, s[1], None, STALE, s[4] + stale)) for k, s in shards.items() if s[0] == RUNNING and s[4] + stale < now]
    return sorted(out, key=lambda x: (x[1][4], x[0]))


class Leases(StatefulProcessor):
    """A run's shards as a map in keyed state. Timers stand at the moment when a running lease becomes stale and when a run that nothing happens to is forgotten."""

    def __init__(self, stale: int, retention: int, retries: int) -> None:
        self.stale, self.retention, self.retries = stale, retention, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shards = handle.getMapState("shards", "shard int", _SHARD)
        self.last = handle.getValueState("last", "at long")

    def _load(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.shards.iterator()}

    def _changes(self, run: str, shards: dict[int, tuple], changes: list[tuple[int, tuple]]) -> Iterator[Row]:
        for shard, state in changes:
            shards[shard] = state
            self.shards.updateValue((shard,), state)
            yield Row(run=run, shard=shard, **dict(zip(_FIELDS, state, strict=True)), run_status=run_status(shards))

    def _wake(self, shards: dict[int, tuple], last: int) -> None:
        """The next moments at which something is due."""
        due = {(s[4] + self.stale) // 1000 + 1 for s in shards.values() if s[0] == RUNNING} | {(last + self.retention) // 1000}
        there = set(self.handle.listTimers())
        for at in there - due:
            self.handle.deleteTimer(at)
        for at in due - there:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        shards, run = self._load(), key[0]
        last = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: (r["us"], r["seq"])):
            # leases that were stale by then came back before the event
            yield from self._changes(run, shards, expired(shards, r["us"], self.stale))
            change = moved(shards, r["event"], r["shard"], r["worker"], r["detail"], r["us"], self.retries)
            if change:
                yield from self._changes(run, shards, [change])
            last = r["us"] if last is None else max(last, r["us"])
        if last is not None:
            self.last.update((last,))
            self._wake(shards, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        shards, last = self._load(), self.last.get()[0] if self.last.exists() else None
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if last is not None and (last + self.retention) // 1000 * 1000 <= now:
            yield from self._changes(key[0], shards, expired(shards, now, self.stale))
            self.shards.clear()
            self.last.clear()
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            return
        yield from self._changes(key[0], shards, expired(shards, now, self.stale))
        if last is not None:
            self._wake(shards, last)

    def close(self) -> None:
        pass


def _timed(changes: DataFrame) -> DataFrame:
    return changes.withColumn("at", F.timestamp_micros("at"))


def lease_stream(events: DataFrame, stale_minutes: int = 60, retention_days: int = 7, retries: int = 2, late: str = "10 minutes") -> DataFrame:
    """A stream of changes (run, shard, status, attempts, worker_id, error, at, run_status) from a stream of events (run, seq, event, shard, worker, detail, at).

    Events of one micro-batch apply in order of `at` and seq; events later than the watermark are left out by Spark. Rows without run or time are left out. State is what runs of the last
    `retention_days` hold. The session's state store must be STORE.
    """
    rows = events.where("run is not null and at is not null").withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    processor = Leases(stale_minutes * _MINUTE, retention_days * 1440 * _MINUTE, retries)
    return _timed(rows.groupBy("run").transformWithState(processor, _CHANGES, "update", "EventTime"))


def lease_replay(events: DataFrame, stale_minutes: int = 60, retries: int = 2, until: str | None = None) -> DataFrame:
    """The same changes from a table of all events; `until` is a time up to which leases that went stale after the last event are given back too.

    Events are dealt out by run and sorted; a task goes through them in Arrow batches and holds one run's shards at a time.
    """
    stale = stale_minutes * _MINUTE
    kinds = {"run": "string", "seq": "long", "event": "string", "shard": "int", "worker": "string", "detail": "string"}
    rows = events.where("run is not null and at is not null").select(*(F.col(c).cast(k) for c, k in kinds.items()), F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    rows = rows.repartition("run").sortWithinPartitions("run", "us", "seq")
    end = events.sparkSession.range(1).select(F.unix_micros(F.lit(until).cast("timestamp"))).first()[0] if until else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shards, out = None, {}, []

        def note(changes: list[tuple[int, tuple]]) -> None:
            for shard, state in changes:
                shards[shard] = state
                out.append((now, shard, *state, run_status(shards)))

        for batch in batches:
            for key, _, event, shard, worker, detail, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    note(expired(shards, end, stale) if end else [])
                    now, shards = key, {}
                note(expired(shards, at, stale))
                change = moved(shards, event, shard, worker, detail, at, retries)
                note([change] if change else [])
            yield _batch(out)
            out = []
        note(expired(shards, end, stale) if end else [])
        yield _batch(out)

    return _timed(rows.mapInArrow(run, _CHANGES))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string())
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _CHANGES.split(", ")])


def with_store(spark: SparkSession) -> None:
    """Let the session keep streams' state where maps and timers are possible."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
