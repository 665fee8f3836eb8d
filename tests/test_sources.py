"""TIFF files by page ranges, bricks stored by place, completeness as state of a stream."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelbrick.operators import bricks as B
from voxelbrick.sources import pages, tiff


def back(df, shape):
    out = np.full(shape, np.nan)
    for r in B.to_voxels(df).collect():
        out[r.z, r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("big", [True, False])
def test_pages_equal_the_file(spark, tmp_path, big):
    a = np.random.default_rng(1).integers(0, 60000, (11, 9, 14)).astype("uint16")
    (tmp_path / "a.tif").write_bytes(tiff.encode(a, big))
    got = pages.read_tiff_pages(spark, str(tmp_path), (4, 5, 6), partition_bytes=1)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 3 * 2 * 3
    assert np.array_equal(back(got, a.shape), a)
    some = pages.read_tiff_pages(spark, str(tmp_path / "a.tif"), (4, 5, 6), (5, 7), 1)
    assert [r.bz for r in some.select("bz").distinct().collect()] == [1] and some.rdd.getNumPartitions() == 1


def test_filters_on_z_prune_pages(spark, tmp_path):
    a = np.arange(12 * 4 * 4).reshape(12, 4, 4).astype("float32")
    (tmp_path / "a.tif").write_bytes(tiff.encode(a))
    spark.conf.set(pages.PUSHDOWN, "true")
    try:
        df = pages.read_tiff_pages(spark, str(tmp_path), (2, 4, 4), partition_bytes=1)
        for where, want in (("bz >= 2 and bz < 4", [2, 3]), ("z0 = 6", [3]), ("z0 > 6 and z0 <= 10", [4, 5]), ("bz > 9", [])):
            got = df.where(where)
            assert sorted(r.bz for r in got.collect()) == want and got.rdd.getNumPartitions() <= max(1, len(want) + 1), where
    finally:
        spark.conf.unset(pages.PUSHDOWN)


def huge(path, planes=40, side=8192):
    """A BigTIFF of more than 2 GB whose pixels are holes of the file; page i holds i + 1 in its first row's strip."""
    n = side * side
    size = 8 + 9 * 20 + 8
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
        data = 16 + planes * size
        for i in range(planes):
            body = struct.pack("<Q", 9)
            for tag, kind, v in ((256, 4, side), (257, 4, side), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 16, data + i * n), (277, 3, 1), (278, 4, side), (279, 16, n)):
                body += struct.pack("<HHQ", tag, kind, 1) + struct.pack("<" + {3: "H", 4: "I", 16: "Q"}[kind], v).ljust(8, b"\0")
            f.write(body + struct.pack("<Q", 16 + (i + 1) * size if i < planes - 1 else 0))
        for i in range(planes):
            f.seek(data + i * n)
            f.write(bytes([i + 1]))
        f.truncate(data + planes * n)


def test_a_file_above_two_gigabytes(spark, tmp_path):
    huge(tmp_path / "huge.tif")
    assert (tmp_path / "huge.tif").stat().st_size > 2**31
    assert pages.read_tiff_pages(spark, str(tmp_path), (2, 64, 64)).rdd.getNumPartitions() == 20
    few = pages.read_tiff_pages(spark, str(tmp_path), (2, 1024, 1024), (36, 38))
    rows = few.where("by = 0 and bx = 0").collect()
    assert [(r.bz, r.data[0], r.data[1024 * 1024]) for r in rows] == [(18, 37, 38)]


def test_only_the_pages_asked_for_are_read(tmp_path, monkeypatch):
    a = np.zeros((64, 32, 32), "uint16")
    (tmp_path / "a.tif").write_bytes(tiff.encode(a))
    read = []
    real = tiff.Ranged._bytes
    monkeypatch.setattr(tiff.Ranged, "_bytes", lambda self, at, n: (read.append(n), real(self, at, n))[1])
    reader = pages.PageReader({"path": str(tmp_path), "brick": "8,8,8", "low": "16", "high": "24"})
    (part,) = reader.partitions()
    assert sum(read) < 64 * 300  # directories only
    read.clear()
    assert sum(b.num_rows for b in reader.read(part)) == 16
    assert 8 * 32 * 32 * 2 <= sum(read) < 8 * (32 * 32 * 2 + 300)


def test_pages_that_differ_are_an_error(spark, tmp_path):
    one, two = tiff.encode(np.zeros((1, 3, 4), "uint8"), False), tiff.encode(np.zeros((1, 3, 4), "uint16"), False)
    shift = len(one)
    body = bytearray(two[8:])
    at = struct.unpack_from("<I", two, 4)[0] - 8
    for i in range(struct.unpack_from("<H", body, at)[0]):
        o = at + 2 + 12 * i
        if struct.unpack_from("<H", body, o)[0] == tiff.OFFSETS:
            struct.pack_into("<I", body, o + 8, struct.unpack_from("<I", body, o + 8)[0] - 8 + shift)
    joined = bytearray(one + bytes(body))
    end = struct.unpack_from("<I", one, 4)[0] + 2 + 12 * struct.unpack_from("<H", one, struct.unpack_from("<I", one, 4)[0])[0]
    struct.pack_into("<I", joined, end, shift)
    (tmp_path / "a.tif").write_bytes(bytes(joined))
    with pytest.raises(Exception, match="pages differ"):
        pages.read_tiff_pages(spark, str(tmp_path), (4, 4, 4)).collect()


# ---------------------------------------------------------------- bricks by place


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def cube(spark):
    """A volume of 8 x 8 x 8 bricks, of 4 voxels a side, and a copy of it that lacks a brick."""
    a = np.random.default_rng(3).integers(0, 1000, (32, 32, 32)).astype("uint16")
    rows = [B._row("a", 0, k, at, piece) for k, at, piece in B._cut("a", 0, np.zeros(3, int), a, (4, 4, 4))]
    df = spark.createDataFrame(rows, B.BRICKS)
    return a, df, df.where("not (bz = 1 and by = 2 and bx = 3)").withColumn("volume_id", F.lit("b"))


def test_cells_are_morton_keys(spark):
    from voxelbrick.sources import placed

    r = np.random.default_rng(4)
    rows = [tuple(int(n) for n in r.integers(0, 2**17, 3)) for _ in range(50)] + [(0, 0, 0), (2**17 - 1,) * 3]
    df = spark.createDataFrame(rows, "bz int, by int, bx int")
    for grain in (0, 1, 3):
        got = df.select("*", F.lit(4000).alias("channel")).select("*", placed.cell_of(grain).alias("c"), placed.place_of().alias("p")).collect()
        assert all(g.c == placed.morton(g.bz >> grain, g.by >> grain, g.bx >> grain) for g in got)
        assert all(g.p == (4000 << 51) + placed.morton(g.bz, g.by, g.bx) for g in got)


def test_placed_volumes_meet_without_a_shuffle(spark, cube, tmp_path):
    from voxelbrick.operators import metrics
    from voxelbrick.sources import placed

    _, f, m = cube
    two = f.unionByName(f.withColumn("channel", F.lit(1)))
    placed.place_bricks(two, "placed_a", str(tmp_path / "a"), 8, 2)
    placed.place_bricks(m.unionByName(m.withColumn("channel", F.lit(1))), "placed_b", str(tmp_path / "b"), 8, 2)
    a, b = (placed.read_placed(spark, t) for t in ("placed_a", "placed_b"))
    pairs = metrics.pair_bricks(a, b)
    assert "SortMergeJoin" in plan(pairs) and "Exchange" not in plan(pairs)
    want = {tuple(r) for r in metrics.moments(metrics.pair_bricks(two, m.unionByName(m.withColumn("channel", F.lit(1))))).select("pair_id", "n", F.round("sab", 3)).collect()}
    assert {tuple(r) for r in metrics.moments(pairs).select("pair_id", "n", F.round("sab", 3)).collect()} == want
    for t in ("placed_a", "placed_b"):
        spark.sql(f"drop table {t}")


@pytest.mark.parametrize("low, high", [((3, 9, 17), (11, 15, 30)), ((0, 0, 0), (1, 1, 1)), ((0, 0, 0), (32, 32, 32)), ((31, 31, 31), (32, 32, 32))])
def test_a_box_opens_a_share_of_the_files(spark, cube, tmp_path, low, high):
    from voxelbrick.sources import placed

    v, f, _ = cube
    placed.place_bricks(f, "placed_box", str(tmp_path / "box"), 4, 1)
    got = placed.crop_placed(spark, "placed_box", low, high, (4, 4, 4), 1)
    assert np.array_equal(back(got, [q - p for p, q in zip(low, high)]), v[tuple(slice(p, q) for p, q in zip(low, high))])
    cells = len(placed.box_cells(low, high, (4, 4, 4), 1))
    box = placed.read_box(spark, "placed_box", low, high, (4, 4, 4), 1)
    scan = [line for line in plan(box).split("\n") if "FileScan" in line][0]
    assert "cell" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "bz" in scan.split("PushedFilters")[1]
    opened = {r.f for r in box.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(opened) <= 4 * cells and len({f.split("cell=")[1].split("/")[0] for f in opened}) == cells
    spark.sql("drop table placed_box")


# ---------------------------------------------------------------- the stream's state


@pytest.fixture
def cycle(spark, cube, tmp_path):
    """Steps of a stream that keeps volumes as they are: put(rows) writes one new file, go(**options) runs it."""
    from voxelbrick.operators import resample
    from voxelbrick.streaming.apply import stream_apply

    v, f, _ = cube
    t = spark.createDataFrame([(n, list(resample.IDENTITY), [0.0] * 3) for n in "ab"], "volume_id string, m array<double>, t array<double>")
    complete = spark.createDataFrame([("a", 512), ("b", 512)], "volume_id string, bricks long")

    def put(df):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go(checkpoint="c", **o):
        return stream_apply(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / checkpoint), (32, 32, 32), (4, 4, 4), t, complete, **o)

    return v, f, put, go


def test_a_repeated_brick_does_not_complete_a_volume(spark, cycle, tmp_path):
    v, f, put, go = cycle
    put(f.where("bz < 4"))
    assert go().count() == 0
    put(f.where("bz < 7"))
    put(f.where("bz < 4"))
    assert go().count() == 0  # 960 rows, 448 bricks
    changed = f.where("bz = 7").unionByName(f.where("bz = 7 and by = 0"))  # a file that holds bricks twice
    put(changed)
    out = go()
    assert out.count() == 512 and np.array_equal(back(out, v.shape), v)
    again = spark.read.parquet(str(tmp_path / "out-found")).where("bz < 4").select("file").distinct().collect()
    assert len(again) == 1  # the last of the three files that hold these
    put(f.where("bz = 0"))
    go()
    assert spark.read.parquet(str(tmp_path / "out-found")).count() == 512  # a done volume stays as it is


def test_the_last_brick_counts_and_force_makes_again(spark, cycle, cube):
    v, f, put, go = cycle
    old = f.withColumn("data", F.when(F.col("bz") == 2, cube[1].select("data").first().data).otherwise(F.col("data")))
    put(old)
    assert not np.array_equal(back(go(force=True), v.shape), v)
    put(f.where("bz = 2"))
    assert np.array_equal(back(go(force=True), v.shape), v)


def test_two_volumes_over_many_batches(spark, cycle):
    v, f, put, go = cycle
    for z in range(0, 8, 2):
        put(f.where(f"bz between {z} and {z + 1}").unionByName(f.where(f"bz = {z}").withColumn("volume_id", F.lit("b"))))
    put(f.where("bz in (1, 3)").withColumn("volume_id", F.lit("b")))
    out = go(files_a_batch=2)
    assert {r.volume_id for r in out.select("volume_id").distinct().collect()} == {"a"} and np.array_equal(back(out, v.shape), v)
    put(f.where("bz in (5, 7)").withColumn("volume_id", F.lit("b")))
    out = go()
    assert out.count() == 1024 and np.array_equal(back(out.where("volume_id = 'b'"), v.shape), v)


def test_bricks_outside_the_grid_are_an_error(spark, cycle):
    _, f, put, go = cycle
    put(f.where("bz = 1").withColumn("bz", F.lit(9)))
    with pytest.raises(Exception, match="outside the grid"):
        go("c2")
