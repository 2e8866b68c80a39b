"""Leases: what events do, and a stream that is stopped and goes on against the replay of all events."""

import datetime as dt
import random

import pytest
from lotwise.streaming import leases as L

T0 = dt.datetime(2026, 1, 1, 8)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def replay(spark, rows, **more):
    made = L.lease_replay(spark.createDataFrame(rows, L.EVENTS), **more).collect()
    return [tuple(r) for r in sorted(made, key=lambda r: (r["run"], r["at"], r["shard"]))]


def test_a_run(spark):
    rows = [
        ("r", 0, "plan", 0, None, None, at(0)), ("r", 1, "plan", 1, None, None, at(0)), ("r", 2, "claim", None, "w1", None, at(1)), ("r", 3, "claim", None, "w2", None, at(2)), ("r", 4, "claim", None, "w3", None, at(3)),
        ("r", 5, "complete", 0, None, None, at(4)), ("r", 6, "fail", 1, None, "boom", at(5)), ("r", 7, "claim", None, "w1", None, at(6)), ("r", 8, "noise", 1, None, None, at(7)), ("r", 9, "fail", 9, None, "none", at(8)), ("r", 10, "complete", 1, None, None, at(66)),
    ]
    got = replay(spark, rows)
    assert [(r[1], r[2], r[3], r[4], r[5], r[7]) for r in got] == [
        (0, "pending", 0, None, None, "pending"), (1, "pending", 0, None, None, "pending"), (0, "running", 1, "w1", None, "running"), (1, "running", 1, "w2", None, "running"),
        (0, "completed", 1, "w1", None, "running"), (1, "retry", 1, "w2", "boom", "running"), (1, "running", 2, "w1", None, "running"), (1, "completed", 2, "w1", None, "completed"),
    ]


def test_stale_and_failed(spark):
    rows = [("r", 0, "plan", 0, None, None, at(0)), ("r", 1, "claim", None, "w", None, at(0)), ("r", 2, "claim", None, "v", None, at(61)), ("r", 3, "fail", 0, None, "x", at(62)), ("r", 4, "claim", None, "v", None, at(63)), ("r", 5, "fail", 0, None, "y", at(64)), ("r", 6, "claim", None, "v", None, at(65))]
    got = replay(spark, rows, retries=2)
    assert [(r[2], r[3], r[5], r[6]) for r in got][2:] == [("retry", 1, "stale_assignment", at(60)), ("running", 2, None, at(61)), ("retry", 2, "x", at(62)), ("running", 3, None, at(63)), ("failed", 3, "y", at(64))]
    assert replay(spark, rows[:2])[-1][2] == "running" and replay(spark, rows[:2], until=str(at(61)))[-1][2:6] == ("retry", 1, None, "stale_assignment")
    assert L.lease_replay(spark.createDataFrame([], L.EVENTS)).count() == 0 and replay(spark, [(None, 0, "plan", 0, None, None, at(0)), ("r", 0, "plan", 0, None, None, None)]) == []


def events(seed):
    r = random.Random(seed)
    rows, minute = [], 0
    for run in "abc":
        rows += [(run, k, "plan", k, None, None, at(0)) for k in range(4)]
    for k in range(90):
        minute += r.choice((0, 1, 2, 25))
        event = r.choice(("claim", "claim", "complete", "fail", "noise"))
        rows.append((r.choice("abc"), 100 + k, event, r.randrange(5), f"w{k % 3}", f"e{k}", at(minute)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_with_a_restart_equals_the_replay(spark, tmp_path, seed):
    rows = events(seed)
    L.with_store(spark)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    last = max(r[6] for r in rows)

    def step(part):
        spark.createDataFrame(part, L.EVENTS).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(L.EVENTS).json(source)
        q = L.lease_stream(stream, late="0 minutes").writeStream.outputMode("update").foreachBatch(lambda d, n: d.write.mode("append").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    cut = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    ordered = sorted(rows, key=lambda r: (r[6], r[1]))
    # parts of a stream don't share a minute, so that no event is late
    parts = [ordered[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
    for one, two in zip(parts, parts[1:], strict=False):
        while two and two[0][6] == one[-1][6]:
            one.append(two.pop(0))
    try:
        for part in parts:
            step(part)
        # a later event of another run moves the watermark, and with it the timers
        step([("z", 0, "plan", 0, None, None, last + dt.timedelta(hours=3))])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((tuple(r) for r in spark.read.parquet(out).where("run <> 'z'").collect()), key=lambda r: (r[0], r[6], r[1], r[2]))
    want = sorted(replay(spark, rows, until=str(last + dt.timedelta(hours=3))), key=lambda r: (r[0], r[6], r[1], r[2]))
    assert got == want and any(r[5] == "stale_assignment" for r in want)
