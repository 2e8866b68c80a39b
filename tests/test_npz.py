"""NPZ files against numpy's own, written and read through Spark."""

import io
import random

import numpy as np
import pytest
from lotwise.sources import npz


def saved(**arrays):
    out = io.BytesIO()
    (np.savez_compressed if len(arrays) % 2 else np.savez)(out, **arrays)
    return out.getvalue()


def test_reads_what_numpy_writes_and_back():
    rng = np.random.default_rng(1)
    arrays = {"points": rng.random((40, 2), np.float32), "descriptors": rng.integers(0, 256, (40, 32), np.uint8), "size": np.array([640, 480], np.int32)}
    for more in ({}, {"f": np.asfortranarray(rng.random((3, 5))), "none": np.zeros((0, 32), np.uint8)}, {"s": np.float64(3.5)}):
        for raw in (saved(**arrays, **more), npz.pack({k: np.asarray(v) for k, v in {**arrays, **more}.items()})):
            for own in (npz.unpack(raw), dict(np.load(io.BytesIO(raw)))):
                assert own.keys() == (arrays | more).keys() and all(np.array_equal(own[k], v) and own[k].dtype == np.asarray(v).dtype for k, v in {**arrays, **more}.items())
    assert npz.unpack(raw, ("size",)).keys() == {"size"} and npz.pack(arrays) == npz.pack(arrays)


def test_damaged_files_are_errors():
    rng = random.Random(2)
    raw = saved(points=np.ones((30, 2), np.float32), descriptors=np.arange(960, dtype=np.uint8).reshape(30, 32), size=np.array([3, 4], np.int32))
    with pytest.raises(ValueError, match="objects"):
        npz.unpack(saved(o=np.array([{}], object)))
    for _ in range(3000):
        file = bytearray(raw)
        for _ in range(rng.randint(1, 4)):
            file[rng.randrange(len(file))] = rng.randrange(256)
        try:
            npz.unpack(bytes(file[: rng.randrange(len(file))] if rng.random() < 0.2 else file))
        except npz.DAMAGED:
            pass


def test_round_trip_and_error_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"r{k % 7}", k // 7, float(k), k / 2, bytes(rng.randrange(256) for _ in range(8)), 640, 480) for k in range(100)] + [(None, 0, 1.0, 1.0, b"x" * 8, 1, 1)]
    path = str(tmp_path / "features")
    df = spark.createDataFrame(rows, npz.POINTS)
    npz.write_points(df.repartition(5), path)
    npz.write_points(df.where("reference = 'r1'"), path)
    assert sorted(p.name for p in (tmp_path / "features").iterdir() if not p.name.startswith(".")) == [f"r{k}.npz" for k in range(7)]
    (tmp_path / "features" / "bad.npz").write_bytes(b"PK junk")
    (tmp_path / "features" / "odd.npz").write_bytes(saved(points=np.ones((2, 2)), descriptors=np.ones((3, 8), np.uint8), size=np.array([1, 1])))
    (tmp_path / "features" / "none.npz").write_bytes(npz.pack({"points": np.zeros((0, 2)), "descriptors": np.zeros((0, 32), np.uint8), "size": np.array([5, 6])}))
    got = npz.read_points(spark, path).collect()
    assert sorted(tuple(r)[:7] for r in got if r["error"] is None and r["point"] is not None) == sorted(r for r in rows if r[0])
    others = {r["reference"]: (r["width"], r["error"]) for r in got if r["point"] is None}
    assert others["none"] == (5, None) and "directory" in others["bad"][1] and "fit" in others["odd"][1] and len(others) == 3


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "failed")
    df = spark.range(50).select(F.concat(F.lit("r"), (F.col("id") % 5).cast("string")).alias("reference"), F.col("id").cast("int").alias("point"), F.lit(1.0).alias("x"), F.when(F.col("id") == 44, F.raise_error(F.lit("broken"))).otherwise(F.lit(1.0)).alias("y"), F.lit(b"d").alias("descriptor"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    with pytest.raises(Exception, match="broken"):
        npz.write_points(df, path)
    assert not [p for p in tmp_path.glob("failed/*") if p.suffix == ".npz"]
