"""Steps whose memory or time must not grow faster than their tables."""

import numpy as np
from pyspark.sql import functions as F

from voxelbrick.functions import kernels, parse
from voxelbrick.operators import bricks as B
from voxelbrick.operators import catalog, fields, metrics, register, resample, tiling
from voxelbrick.sources.scratch import stored


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_are_numbered_without_sorting(spark):
    one = spark.createDataFrame([("a", 20, 23, 30), ("b", 5, 3, 2)], "p string, nz int, ny int, nx int")
    t = tiling.make_tiles(one, (9, 6, 7), (2, 3, 3), ["p"])
    assert "Window" not in _plan(t) and "Sort" not in _plan(t)
    boxes = {}
    for r in t.collect():
        boxes.setdefault(r.p, {})[r.tile_index] = (r.z0, r.y0, r.x0)
    for b in boxes.values():
        assert [b[i + 1] for i in range(len(b))] == sorted(set(b.values()))
    assert len(boxes["a"]) == 3 * 7 * 7 and boxes["b"] == {1: (0, 0, 0)}
    few = tiling.make_tiles(one, (9, 6, 7), (2, 3, 3), ["p"], first=4).collect()
    assert sorted((r.p, r.tile_index) for r in few) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1)]


def test_a_region_is_parsed_once(spark):
    texts = ['{"x0":1,"y0":2,"z0":0,"x1":4,"y1":5,"z1":6}', '{"x":1,"y":2,"z":1,"size_x":3,"size_y":5,"size_z":2}', "1, 2,0,4,5,9", "4,5,0,1,2,9", "1,2,3", "", None, "{", '{"x":2147483647,"y":2,"z":1,"size_x":3,"size_y":5,"size_z":2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse.parse_roi(F.col("t")).alias("r"))
    assert _plan(df).count("from_json") == 1
    got = [None if r.r is None else tuple(r.r) for r in df.orderBy("i").collect()]
    assert got == [(1, 2, 0, 4, 5, 6), (1, 2, 1, 4, 7, 3), (1, 2, 0, 4, 5, 9), *[None] * 6]


def test_slices_are_numbered_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(catalog, "RANGE", 5)
    rows = [(d, f"{n}_{i}.tif") for d, many in (("Ex_9", 3), ("Ex_10", 41), ("Ex_200", 17)) for i in range(many) for n in ("img", "IMG2")]
    got = catalog.discover_slices(spark.createDataFrame(rows[::-1], "dir string, file string").repartition(3))
    ranges = got.select("dir", "file", "z")  # no folder is sorted whole
    assert "row_number() windowspecdefinition(dir" not in _plan(ranges)
    want = {(d, f"{n}_{i}.tif"): (k, i + j * many) for k, (d, many) in enumerate((("Ex_9", 3), ("Ex_10", 41), ("Ex_200", 17))) for j, n in enumerate(("IMG2", "img")) for i in range(many)}
    assert sorted(got.columns) == ["dir", "dir_index", "file", "z"]
    assert len(rows) == got.count()
    assert {(r.dir, r.file): (r.dir_index, r.z) for r in got.collect()} == want


def test_frames_are_bounded():
    rows = [B._row("v", 0, (0, 0, i), (0, 0, 64 * i), np.full((32, 64, 64), i)) for i in range(40)]
    out = list(B.frames(iter(rows)))
    assert max(sum(map(len, f["data"])) for f in out) <= B.FRAME + len(rows[0][-1])
    assert [x for f in out for x in f["bx"]] == list(range(40))
    assert len(list(B.frames(iter(())))) == 1 and len(out) > 3


def test_small_bricks_are_made_a_block_at_a_time(spark):
    shape, brick = (9, 17, 70), (4, 8, 32)
    at = [(z, y, x) for z, y, x in np.ndindex(*shape) if (z, y, x) == (8, 16, 69) or z < 4 and x < 40]
    v = spark.createDataFrame([("v", 0, *p, float(np.ravel_multi_index(p, shape) + 1)) for p in at], "volume_id string, channel int, z int, y int, x int, v double")
    b = B.to_bricks(v, shape, brick, given=True)
    assert "gz" in _plan(b)  # calls are by block
    got = {(r.bz, r.by, r.bx): r for r in b.collect()}
    assert set(got) == {(0, j, k) for j in range(3) for k in range(2)} | {(2, 2, 2)}  # bricks without voxels aren't made
    last = got[2, 2, 2]
    assert (last.z0, last.y0, last.x0, last.nz, last.ny, last.nx) == (8, 16, 64, 1, 1, 6)
    assert np.frombuffer(last.data).tolist() == [0.0] * 5 + [float(np.prod(shape))] and list(last.mask) == [0] * 5 + [1]
    assert got[0, 0, 0].mask is None and got[0, 0, 1].mask is not None
    back = {(r.z, r.y, r.x): r.v for r in B.to_voxels(b).collect()}
    assert back == {p: float(np.ravel_multi_index(p, shape) + 1) for p in at}


def test_a_round_takes_blocks(spark, monkeypatch):
    shape, brick, sides = (16, 16, 64), (8, 8, 32), []
    z, y, x = np.indices(shape).astype(float)
    a = np.exp(-((z - 8) ** 2 + (y - 7) ** 2) / 18 - (x - 30) ** 2 / 200)
    b = np.exp(-((z - 8.3) ** 2 + (y - 6.6) ** 2) / 18 - (x - 30.5) ** 2 / 200)
    fixed, moving = (spark.createDataFrame([B._row("v", 0, k, at, part) for k, at, part in B._cut("v", 0, np.zeros(3, int), v, brick)], B.BRICKS) for v in (a, b))
    sent = resample.sent
    monkeypatch.setattr(resample, "sent", lambda m, n, s, side, reach=0.0: sides.append(side) or sent(m, n, s, side, reach))
    m, t = register.staged(fixed, moving, shape, shape, brick, {("v", 0): (np.eye(3), np.zeros(3))}, ("translation",), 6)["v", 0]
    assert set(sides) == {(64, 32, 32)}  # not the small bricks, of which each would get a halo and a call of its own
    assert np.allclose(m, np.eye(3)) and np.abs(t - [0.3, -0.4, 0.5]).max() < 0.02


def test_several_arrays_are_sampled_at_once():
    r = np.random.default_rng(3)
    one, two = r.normal(size=(2, 5, 6, 7))
    one[2, 3, 4] = np.inf
    c = r.uniform(-2, 9, (3, 500))
    c[:, :100] = np.floor(c[:, :100])
    for mode in ("linear", "nearest"):
        got = kernels.samples([one, two], (1, 0, 2), (7, 6, 10), c, mode)
        assert all(np.array_equal(g, kernels.sample(v, (1, 0, 2), (7, 6, 10), c, mode), equal_nan=True) for g, v in zip(got, (one, two), strict=True))
        assert not np.isnan(got[0]).any()  # a weight of 0 takes nothing from a value that isn't finite


def test_smoothing_and_demons_take_blocks(spark, monkeypatch):
    shape, brick, sides = (16, 30, 70), (8, 8, 32), []
    a = np.random.default_rng(5).normal(size=shape).astype(np.float32)
    rows = [B._row("v", 0, k, at, part) for k, at, part in B._cut("v", 0, np.zeros(3, int), a, brick)]
    sent = fields.sent
    monkeypatch.setattr(fields, "sent", lambda m, n, s, side, reach=0.0: sides.append(side) or sent(m, n, s, side, reach))
    f = fields.smooth(spark.createDataFrame(rows, B.BRICKS), 1.0, shape, brick)
    m = fields.smooth(spark.createDataFrame([r for r in rows if r[2:5] in ((0, 0, 0), (1, 3, 2))], B.BRICKS), 1.0, shape, brick)
    # A brick is made if it is near one that is there, as it was brick by brick.
    near = {k for k in np.ndindex(2, 4, 3) for r in ((0, 0, 0), (1, 3, 2)) if all(abs(i - j) <= 1 for i, j in zip(k, r, strict=True))}
    assert {(r.bz, r.by, r.bx) for r in m.collect()} == near
    want = a.astype(float)
    for axis in range(3):
        want = fields.blurred(want, 1.0, 3, axis)
    got = {(r.bz, r.by, r.bx): kernels.unpacked(r) for r in f.collect()}
    for k, at, part in B._cut("v", 0, np.zeros(3, int), want.astype(np.float32), brick):
        assert np.array_equal(got[tuple(k)], part)
    found = fields.demons(f, f, shape, brick, 1)
    assert len(sides) > 4 and set(sides) == {(64, 32, 32)}  # not the small bricks, whose halos are several times their voxels
    assert not any(np.frombuffer(r.data, r.dtype).any() for r in found.collect())  # equal volumes: no displacement


def test_batches_of_bricks_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had, brick = spark.conf.get(key), (8, 8, 32)
    try:
        for given, want in (("64MB", B.FRAME), ("67108864b", B.FRAME), ("1048576", 1 << 20), ("2m", 2 << 20)):
            spark.conf.set(key, given)
            v = spark.createDataFrame([("v", 0, 0, 0, 0, 1.0)], "volume_id string, channel int, z int, y int, x int, v double")
            b = B.to_bricks(v, (8, 8, 32), brick)
            assert B._bytes(spark.conf.get(key)) == want
        spark.conf.set(key, "64MB")
        b = B.to_bricks(v, (8, 8, 32), brick).crossJoin(spark.range(0, 3000, numPartitions=1))
        sizes = b.select("data").mapInPandas(lambda batches: (x.assign(s=x["data"].str.len().sum())[["s"]][:1] for x in batches), "s long").collect()
        assert sum(r.s for r in sizes) == 3000 * 2048 * 8 and max(r.s for r in sizes) <= B.FRAME + 2048 * 8
    finally:
        spark.conf.set(key, had)


def _batches(df) -> int:
    """Batches that the scan of a collected df has decoded."""
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "ColumnarToRow":
            return p.metrics().apply("numInputBatches").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    raise AssertionError("no scan by batches")


def test_few_bricks_are_decoded_at_once(spark):
    """However small their file is: a batch of 4096 sparse bricks of 123 KB each was half a gigabyte in each core."""
    v = spark.range(3 * B.ROWS).selectExpr("'v' volume_id", "0 channel", "0 z", "0 y", "cast(id as int) * 4 x", "1.0D v")
    b = stored(B.to_bricks(v, (1, 1, 12 * B.ROWS), (1, 1, 4)).coalesce(1), "bricks")
    assert len(b.inputFiles()) == 1 and b.count() == 3 * B.ROWS
    assert _batches(b.select("bx", "data")) >= 3


def test_blocks_keep_to_the_volume():
    assert B.side_of((10, 64, 24), (10, 540000, 24)) == (10, 256, 24)
    assert B.side_of((8, 8, 32), (4, 4, 20)) == (8, 8, 32)
    assert B.side_of((8, 8, 32), (10**6, 10**6, 10**6)) == B.side_of((8, 8, 32))


def test_pairs_of_a_grid_make_no_zeros(spark, monkeypatch):
    """Bricks that one or both sides lack are compared as zeros, but have no pixels."""
    monkeypatch.setattr(metrics, "HELD", 2)
    monkeypatch.setattr(metrics, "JOINED", 1 << 10)
    shape, brick, rng = (5, 17, 20), (4, 4, 8), np.random.default_rng(3)
    sides = [np.where(rng.random((3, *shape)) < 0.1, rng.integers(1, 900, (3, *shape)), 0) for _ in "fm"]
    sides[0][:, :, 8:] = 0
    sides[1][:, :, :4] = sides[1][1, :, 12:] = 0
    sparse = lambda a: B.to_bricks(spark.createDataFrame([("v", *map(int, p), float(a[tuple(p)])) for p in np.argwhere(a)], "volume_id string, channel int, z int, y int, x int, v double"), shape, brick)
    ids = spark.createDataFrame([("v", i) for i in range(3)], "volume_id string, channel int")
    pairs = metrics.pair_bricks(*map(sparse, sides), grid=resample.output_grid(ids, shape, brick))
    rows = pairs.collect()
    assert len(rows) == 3 * 2 * 5 * 3 and {r.a_data is None for r in rows} == {r.b_data is None for r in rows} == {True, False}
    assert any(r.a_data is None and r.b_data is None for r in rows)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString() and pairs.rdd.getNumPartitions() > 4
    sums = metrics.moments(pairs)
    got = {r.pair_id: r for r in metrics.ncc(sums).join(metrics.nmi(metrics.joint_counts(pairs, sums)), ["pair_id", "phase"]).collect()}
    for i, (a, b) in enumerate(zip(*sides, strict=True)):
        h = np.bincount(metrics.bin_index(a.ravel(), 0, a.max(), 64) * 64 + metrics.bin_index(b.ravel(), 0, b.max(), 64), minlength=4096).reshape(64, 64) / a.size
        ent = lambda q: -(q * np.log(q + 1e-12)).sum()
        r = got[f"pair/{i}"]
        assert r.n == a.size and np.isclose(r.ncc, np.corrcoef(a.ravel(), b.ravel())[0, 1]) and np.isclose(r.nmi, (ent(h.sum(1)) + ent(h.sum(0))) / ent(h))
