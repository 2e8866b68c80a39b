"""Tables of versions: snapshots, replays, writers at once, compaction, removal, a stream with a restart."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.sources.versions import Versioned, merge_stream

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("at", T.LongType()), T.StructField("v", T.StringType())])


def table(spark, tmp_path, buckets=4):
    return Versioned(spark, str(tmp_path / "t"), SCHEMA, "k", "at", buckets)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted((r["k"], r["at"], r["v"]) for r in df.collect())


def test_snapshots_and_replay(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.versions() == [] and content(t.at()) == []
    first = [(k, 1, f"a{k}") for k in range(20)]
    assert t.merge(frame(spark, [*first, (None, 9, "x"), (3, 0, "older")]), "s", 0) == 1
    assert t.merge(frame(spark, [(3, 2, "b"), (4, 0, "late"), (5, 1, "same time, later"), (99, 1, None)]), "s", 1) == 2
    then = content(t.at())
    assert content(t.at(1)) == first and then == sorted([*(r for r in first if r[0] not in (3, 5)), (3, 2, "b"), (5, 1, "same time, later"), (99, 1, None)])
    assert t.merge(frame(spark, [(3, 7, "again")]), "s", 1) == 2 and t.merge(frame(spark, []), "other") == 2
    assert content(t.at()) == then and t.merge(frame(spark, []), "s", 2) == 3


def test_two_writers_lose_nothing(spark, tmp_path):
    """One writer has read the newest manifest when another one commits: it goes on after that one."""
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    a.merge(frame(spark, [(1, 1, "a")]))
    create, raced = a.store.create, []

    def late(name, text):
        if not raced:
            raced.append(b.merge(frame(spark, [(2, 1, "b"), (1, 3, "b wins")])))
        return create(name, text)

    a.store.create = late
    assert a.merge(frame(spark, [(3, 1, "c"), (1, 2, "lost")])) == 3 and raced == [2]
    assert content(a.at()) == [(1, 3, "b wins"), (2, 1, "b"), (3, 1, "c")] and content(b.at(2)) == [(1, 3, "b wins"), (2, 1, "b")]


def test_compaction_beside_a_merge_and_removal(spark, tmp_path):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    for n in range(4):
        t.merge(frame(spark, [(k, n, f"{n}") for k in range(n, 12)]))
    before = t.at()
    then, write, raced = content(before), t._write, []

    def slow(rows):
        out = write(rows)
        if not raced:
            raced.append(other.merge(frame(spark, [(0, 9, "meanwhile")])))
        return out

    t._write = slow
    assert t.compact() == 6 and raced == [5]
    t._write = write
    expected = sorted([(0, 9, "meanwhile"), *(r for r in then if r[0] != 0)])
    assert content(t.at()) == expected and content(t.at(4)) == then
    assert max(map(len, t.manifest().buckets.values())) <= 2 and t.compact() == 7 and {len(f) for f in t.manifest().buckets.values()} == {1}
    # a reader of an old version goes on until it is removed; young folders stay
    assert content(before) == then and t.vacuum(last=1) == 0 and t.versions() == [7]
    assert t.vacuum(last=1, minutes=-1) > 0 and content(t.at()) == expected
    with pytest.raises(Exception, match="manifests"):
        t.at(4)
    assert t.compact(keep="at >= 3") == 8 and content(t.at()) == [r for r in expected if r[1] >= 3]
    assert t.compact(keep="false") == 9 and content(t.at()) == []


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    t = table(spark, tmp_path, 2)
    source = str(tmp_path / "in")
    expected = {}
    for n in range(3):
        rows = [(k, n, f"{n}") for k in range(n, 9)]
        expected |= {r[0]: r for r in rows}
        frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = merge_stream(stream, t, str(tmp_path / "cp"), "in", every=2)
        assert query.awaitTermination(60) and query.exception() is None
    assert content(t.at()) == sorted(expected.values()) and t.manifest().batches == {"in": 2}
    assert t.merge(frame(spark, [(0, 99, "replayed")]).where(F.lit(True)), "in", 2) == t.manifest().version and content(t.at()) == sorted(expected.values())
