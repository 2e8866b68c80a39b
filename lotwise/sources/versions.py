"""A table of keyed rows with versions: each commit is a manifest that names the folders of every bucket, so readers see a whole version and never half of one.

Keys are dealt into buckets by hash. A merge writes only its own rows, one for each key, as one more folder of each bucket that it touches; reading takes the latest row of each key among a bucket's
folders. Compaction writes buckets of many folders anew as one, and vacuum removes manifests and folders that nobody can ask for any more. Two writers can't commit one version: the later one looks again and goes on after the earlier one.

    path/manifests/00000000000000000003.json     version, folders of each bucket, last batch of each source
    path/data/<commit>/bucket=7/part-....parquet
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Store:
    """Files beside Spark's tables, in whatever store the path names, through the session's own file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark._jvm
        self.path_of = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        root = self.path_of(path)
        self.fs = root.getFileSystem(conf)
        self.root = self.fs.makeQualified(root).toString()
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(root).toUri(), conf)
        self.plainly = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self.io = jvm.org.apache.commons.io.IOUtils

    def names(self, folder: str) -> dict[str, int]:
        """What a folder holds, with times of change in milliseconds; nothing if it isn't there."""
        at = self.path_of(f"{self.root}/{folder}")
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path_of(f"{self.root}/{name}"))
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file under another name and gives it its own in one step; False if there is one already."""
        draft = self.path_of(f"{self.root}/drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self.path_of(f"{self.root}/{name}")
        self.fs.mkdirs(target.getParent())
        try:
            self.context.rename(draft, target, self.plainly)
        except Exception:
            self.fs.delete(draft, False)
            if self.fs.exists(target):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self.path_of(f"{self.root}/{name}"), True)


@dataclass
class Manifest:
    version: int = 0
    #: folders of each bucket, oldest first
    buckets: dict[str, list[str]] = field(default_factory=dict)
    #: the last batch of each source that is in the table
    batches: dict[str, int] = field(default_factory=dict)


class Versioned:
    """Rows by `key`, the latest by `order` (a column; of equals the one that was merged later) at each version.

    Rows whose key is null are left out. All commits have one schema. `buckets` stays as it was when the table began; choose it so that a bucket fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: str, buckets: int = 64) -> None:
        self.spark, self.schema, self.key, self.order, self.buckets = spark, T.StructType([T.StructField(f.name, f.dataType) for f in schema]), key, order, buckets
        self.store = _Store(spark, path)
        self.stored = T.StructType([*self.schema, T.StructField("__commit", T.LongType())])

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.store.names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """Of a version, by default the newest; before the first commit it is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        return Manifest(**json.loads(self.store.read(f"manifests/{version:020d}.json"))) if version else Manifest()

    def at(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the newest. Versions that were removed raise."""
        return self._latest(self._rows([f for folders in self.manifest(version).buckets.values() for f in folders])).select(*self.schema.names)

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(*(f"{self.store.root}/data/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.stored)

    def _latest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self.stored.names if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*others), F.struct(self.order, "__commit", F.xxhash64(*others))).alias("__r")).select(self.key, "__r.*").select(*self.stored.names)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Folder of each bucket of which there are rows."""
        name = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.store.root}/data/{name}")
        return {n.removeprefix("bucket="): f"{name}/{n}" for n in self.store.names(f"data/{name}") if n.startswith("bucket=")}

    def _commit(self, change: Callable[[Manifest], Manifest | None]) -> int:
        """Applies a change to the newest manifest until no other writer comes first; None leaves the table as it is."""
        while True:
            old = self.manifest()
            new = change(Manifest(**json.loads(json.dumps(old.__dict__))))
            if new is None:
                return old.version
            new.version = old.version + 1
            if self.store.create(f"manifests/{new.version:020d}.json", json.dumps(new.__dict__)):
                return new.version

    def merge(self, rows: DataFrame, source: str = "", batch: int | None = None) -> int:
        """Version after rows were merged. A batch of a source that isn't later than the last one that was merged changes nothing, so that it can be sent again."""
        seen = lambda m: batch is not None and m.batches.get(source, -1) >= batch
        now = self.manifest()
        if seen(now):
            return now.version
        # of equal rows in order the one of the later commit counts; numbers of commits that lost a race may repeat, their content decides then
        written = self._write(self._latest(rows.where(F.col(self.key).isNotNull()).select(*self.schema.names).withColumn("__commit", F.lit(now.version + 1).cast("long"))))

        def change(m: Manifest) -> Manifest | None:
            if seen(m) or not written and batch is None:
                return None
            for bucket, folder in written.items():
                m.buckets.setdefault(bucket, []).append(folder)
            if batch is not None:
                m.batches[source] = batch
            return m

        return self._commit(change)

    def compact(self, most: int = 1, keep: str | None = None) -> int:
        """Version after buckets of more than `most` folders were written anew as one; with `keep`, a condition, all buckets, without the rows that it isn't true of. What others merged meanwhile stays behind it."""
        old = {b: f for b, f in self.manifest().buckets.items() if keep or len(f) > most}
        if not old:
            return self.manifest().version
        rows = self._latest(self._rows([x for folders in old.values() for x in folders]))
        written = self._write(rows.where(keep) if keep else rows)

        def change(m: Manifest) -> Manifest | None:
            for bucket, folders in old.items():
                there = m.buckets.get(bucket, [])
                if there[: len(folders)] != folders:  # another compaction was first
                    continue
                rest = ([written[bucket]] if bucket in written else []) + there[len(folders) :]
                m.buckets[bucket] = rest
                if not rest:
                    del m.buckets[bucket]
            return m

        return self._commit(change)

    def vacuum(self, last: int = 10, minutes: float = 24 * 60) -> int:
        """Removes all but the `last` versions, and the folders that these don't name and that are older than some minutes, as a writer may be about to commit younger ones. How many folders went."""
        there = self.versions()
        for v in there[: max(0, len(there) - max(1, last))]:
            self.store.remove(f"manifests/{v:020d}.json")
        named = {f for v in self.versions() for folders in self.manifest(v).buckets.values() for f in folders}
        now, gone = self.spark.range(1).select(F.unix_millis(F.current_timestamp())).first()[0], 0
        for commit, changed in self.store.names("data").items():
            if changed > now - minutes * 60_000:
                continue
            inside = [f"{commit}/{n}" for n in self.store.names(f"data/{commit}") if n.startswith("bucket=")]
            dead = [f for f in inside if f not in named]
            for folder in dead if len(dead) < len(inside) else [commit]:
                self.store.remove(f"data/{folder}")
            gone += len(dead)
        return gone


def merge_stream(stream: DataFrame, table: Versioned, checkpoint: str, source: str, every: int = 16):
    """A query that merges a stream's micro-batches into a table, and compacts buckets of more than `every` folders. A micro-batch that is run again after a failure changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        table.merge(rows, source, number)
        table.compact(every)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
