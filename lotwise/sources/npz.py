"""NPZ files of key points: a reader of the format over any store that Spark reads, and a writer with a commit protocol.

Reading goes through Spark's binary files, so paths may be in any store; a task parses the files' bytes. A file that is damaged or isn't of the kind is a row with an error, not a failed job. Writing is
a data source in Python: each task writes its references' files under names of its own attempt, and only those of the tasks that the driver commits get their final names.
"""

from __future__ import annotations

import ast
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

POINTS = "reference string, point int, x float, y float, descriptor binary, width int, height int"
#: What unpacking a damaged file ends in.
DAMAGED = (ValueError, KeyError, IndexError, TypeError, SyntaxError, MemoryError, OverflowError, struct.error, zlib.error, UnicodeDecodeError)
#: Bytes that deflate makes of one byte, at most.
_EXPANDS = 1100


def unpack(raw: bytes, wanted: tuple[str, ...] | None = None) -> dict[str, np.ndarray]:
    """The arrays of an NPZ file, or those wanted: the zip directory at its end, each entry's bytes with their checksum, and the header of each .npy within."""
    end = raw.rfind(b"PK\x05\x06", max(0, len(raw) - 65_557))
    if end < 0:
        raise ValueError("no zip directory")
    entries, at = struct.unpack_from("<H", raw, end + 10)[0], struct.unpack_from("<I", raw, end + 16)[0]
    out = {}
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a damaged zip directory")
        method, check, packed, size, n_name, n_extra, n_note, place = struct.unpack_from("<10xH4xIIIHHH8xI", raw, at)
        name = raw[at + 46 : at + 46 + n_name].decode().removesuffix(".npy")
        at += 46 + n_name + n_extra + n_note
        if wanted is not None and name not in wanted:
            continue
        own_name, own_extra = struct.unpack_from("<HH", raw, place + 26)
        begin = place + 30 + own_name + own_extra
        body = raw[begin : begin + packed]
        if method == 8:
            if size > _EXPANDS * max(1, len(body)):
                raise ValueError("an entry of more bytes than it can hold")
            body = zlib.decompressobj(-15).decompress(body, size + 1)
        elif method != 0:
            raise ValueError("a way of packing that isn't read here")
        if len(body) != size or zlib.crc32(body) != check:
            raise ValueError("an entry fails its checksum")
        out[name] = _array(body)
    return out


def _array(raw: bytes) -> np.ndarray:
    """An .npy file's array: magic, version, and a header that is a Python literal."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("no array")
    size, begin = (struct.unpack_from("<H", raw, 8)[0], 10) if raw[6] == 1 else (struct.unpack_from("<I", raw, 8)[0], 12)
    header = ast.literal_eval(raw[begin : begin + size].decode("latin-1"))
    kind = np.dtype(header["descr"])
    if kind.hasobject:
        raise ValueError("an array of objects isn't read")
    shape = tuple(header["shape"])
    flat = np.frombuffer(raw, kind, offset=begin + size)
    return flat.reshape(shape, order="F" if header["fortran_order"] else "C")


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """An NPZ file of arrays, deflated; the same arrays make the same bytes."""
    body, directory = bytearray(), bytearray()
    for name, x in arrays.items():
        x = np.asarray(x, order="C")
        header = repr({"descr": np.lib.format.dtype_to_descr(x.dtype), "fortran_order": False, "shape": x.shape}).encode()
        header += b" " * (-(len(header) + 11) % 64) + b"\n"
        raw = b"\x93NUMPY\x01\x00" + struct.pack("<H", len(header)) + header + x.tobytes()
        coder = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = coder.compress(raw) + coder.flush()
        file = f"{name}.npy".encode()
        common = struct.pack("<HHHHHIIIHH", 20, 0, 8, 0, 33, zlib.crc32(raw), len(packed), len(raw), len(file), 0)
        directory += b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, len(body)) + file
        body += b"PK\x03\x04" + common + file + packed
    return bytes(body + directory + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(arrays), len(arrays), len(directory), len(body), 0))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(reference, point, x, y, descriptor, width, height, error) of the NPZ files below a path: a row for each key point; a file without points or that can't be read has one row, with an error in the latter case.

    A file has `points` (n, 2), `descriptors` (n, any number of bytes) and `size` (2); its name is the reference.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                error, points, marks, size = None, np.zeros((0, 2), np.float32), np.zeros((0, 0), np.uint8), (None, None)
                try:
                    own = unpack(raw.as_py(), ("points", "descriptors", "size"))
                    points, marks, size = own["points"].reshape(-1, 2).astype(np.float32), own["descriptors"], tuple(own["size"].astype(int).tolist())
                    if len(points) != len(marks) or len(size) != 2 or marks.dtype != np.uint8:
                        raise ValueError("points and descriptors don't fit")
                except DAMAGED as e:
                    error, points, marks, size = f"{type(e).__name__}: {e}", points[:0], marks[:0], (None, None)
                n = max(1, len(points))
                name = path.rsplit("/", 1)[-1].removesuffix(".npz")
                x, y = (pa.array(points[:, k]) if len(points) else pa.nulls(1, pa.float32()) for k in range(2))
                place = pa.array(range(n), pa.int32()) if len(points) else pa.nulls(1, pa.int32())
                marks = pa.array([m.tobytes() for m in marks] if len(points) else [None], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), place, x, y, marks, *(pa.array([v] * n, pa.int32()) for v in size), pa.array([error] * n, pa.string())], ["reference", "point", "x", "y", "descriptor", "width", "height", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path)
    return files.select("path", "content").mapInArrow(run, f"{POINTS}, error string")


@dataclass
class _Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class _PointWriter(DataSourceArrowWriter):
    """Each task's files under temporary names; the driver renames those of committed tasks and removes the others."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = self._store()
        there = f"{root}/_temporary-{self.job}"
        store.create_dir(there, recursive=True)
        names: list[tuple[str, str]] = []
        now, held = None, []

        def flush() -> None:
            rows = pa.Table.from_batches(held)
            marks = [m or b"" for m in rows.column("descriptor").to_pylist()]
            points = np.column_stack([rows.column(c).to_numpy() for c in ("x", "y")]).astype(np.float32)
            size = np.array([rows.column(c)[0].as_py() or 0 for c in ("width", "height")], np.int32)
            there_ = f"{there}/{uuid.uuid4().hex}"
            with store.open_output_stream(there_) as f:
                f.write(pack({"points": points, "descriptors": np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), -1), "size": size}))
            names.append((there_, f"{root}/{now}.npz"))

        for batch in iterator:
            owner = batch.column("reference").to_pylist()
            cut = [k for k in range(len(owner)) if k == 0 or owner[k] != owner[k - 1]] + [len(owner)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if held and owner[i] != now:
                    flush()
                    held = []
                now = owner[i]
                held.append(batch.slice(i, j - i))
        if held:
            flush()
        return _Written(names)

    def commit(self, messages: list) -> None:
        store, root = self._store()
        for message in messages:
            for old, new in message.names if message else ():
                store.move(old, new)
        self._clean(store, root)

    def abort(self, messages: list) -> None:
        self._clean(*self._store())

    def _clean(self, store, root: str) -> None:
        from pyarrow import fs

        there = f"{root}/_temporary-{self.job}"
        if store.get_file_info(there).type == fs.FileType.Directory:
            store.delete_dir(there)


class NpzPoints(DataSource):
    """The format "npz_points", to write (reference, point, x, y, descriptor, width, height) as a file for each reference."""

    @classmethod
    def name(cls) -> str:
        return "npz_points"

    def schema(self) -> str:
        return POINTS

    def writer(self, schema, overwrite: bool) -> _PointWriter:
        return _PointWriter(self.options["path"])


def write_points(points: DataFrame, path: str) -> None:
    """A file `<reference>.npz` for each reference of points, whose key points come in order of `point`; a file of that name that is there is replaced. Rows without a reference are left out.

    A reference's points are one file, and so one row group of a task; references are dealt out by hash.
    """
    spark = points.sparkSession
    spark.dataSource.register(NpzPoints)
    kinds = dict(x.rsplit(" ", 1) for x in POINTS.split(", "))
    rows = points.where("reference is not null").select(*(F.col(c).cast(k) for c, k in kinds.items()))
    rows.repartition("reference").sortWithinPartitions("reference", "point").write.format("npz_points").option("path", path).mode("append").save()
