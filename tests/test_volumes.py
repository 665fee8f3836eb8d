"""Kernels and operators without SQL, on analytic volumes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelbrick.functions import kernels as K
from voxelbrick.operators import bricks as B
from voxelbrick.operators import estimate, intensity, jobs, metrics, resample, tiling
from voxelbrick.plans import volumes
from voxelbrick.sources import fixtures as X
from voxelbrick.sources import tiff

SHAPE = (9, 11, 13)


def ramp(spark, shape=SHAPE, a=3.0, b=-2.0, c=0.5, channel=0):
    z, y, x = np.indices(shape)
    v = a * z + b * y + c * x + 100
    rows = [("r", channel, int(i), int(j), int(k), float(v[i, j, k])) for i, j, k in np.ndindex(*shape)]
    return spark.createDataFrame(rows, "volume_id string, channel int, z int, y int, x int, v double"), v


def array(bricks, shape):
    out = np.full(shape, np.nan)
    for r in B.to_voxels(bricks).collect():
        out[r.z, r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("brick", [(4, 4, 4), (7, 7, 7), (16, 16, 16)])
def test_brick_size_does_not_matter(spark, brick):
    df, v = ramp(spark)
    b = B.to_bricks(df, SHAPE, brick)
    assert np.array_equal(array(b, SHAPE), v)
    assert np.array_equal(array(B.crop(b, (1, 2, 3), (8, 9, 12), brick), (7, 7, 9)), v[1:8, 2:9, 3:12])
    assert np.array_equal(array(B.stride(b, (2, 3, 4), SHAPE, brick), (5, 4, 4)), v[::2, ::3, ::4])


def test_trilinear_ramp_is_exact(spark):
    df, v = ramp(spark)
    b = B.to_bricks(df, SHAPE, (4, 4, 8))
    out = array(resample.warp(b, SHAPE, SHAPE, (4, 4, 8), t=(0.25, 0.5, -0.75)), SHAPE)
    z, y, x = np.indices(SHAPE)
    want = 3.0 * (z + 0.25) - 2.0 * (y + 0.5) + 0.5 * (x - 0.75) + 100
    inner = (slice(0, 8), slice(0, 10), slice(1, 13))
    assert np.allclose(out[inner], want[inner])


def test_warp_there_and_back(spark):
    df, v = ramp(spark)
    b = B.to_bricks(df, SHAPE, (4, 4, 8))
    there = resample.warp(b, SHAPE, SHAPE, (4, 4, 8), t=(1.0, 2.0, -1.0))
    back = array(resample.warp(there, SHAPE, SHAPE, (4, 4, 8), t=(-1.0, -2.0, 1.0)), SHAPE)
    assert np.array_equal(back[1:, 2:, :-1], v[1:, 2:, :-1])


def test_sheared_affine_over_brick_borders(spark):
    df, v = ramp(spark)
    m, t = (1.0, 0.05, 0.0, -0.1, 1.0, 0.02, 0.0, 0.03, 0.95), (0.2, 0.4, 0.3)
    out = array(resample.warp(B.to_bricks(df, SHAPE, (4, 4, 4)), SHAPE, SHAPE, (4, 4, 4), m, t), SHAPE)
    coords = np.array(m).reshape(3, 3) @ K.grid((0, 0, 0), SHAPE) + np.array(t)[:, None]
    assert np.allclose(out, K.sample(v, (0, 0, 0), SHAPE, coords).reshape(SHAPE))


def test_field_equals_its_formula(spark):
    df, v = ramp(spark)
    f = df.withColumn("v", F.lit(0.5)).unionAll(df.withColumns({"channel": F.lit(1), "v": F.lit(-0.25)})).unionAll(df.withColumns({"channel": F.lit(2), "v": F.col("x") / 20.0}))
    out = array(resample.warp_field(B.to_bricks(df, SHAPE, (4, 4, 8)), SHAPE, B.to_bricks(f, SHAPE, (4, 4, 8)), (4, 4, 8), 1.0), SHAPE)
    c = K.grid((0, 0, 0), SHAPE)
    assert np.allclose(out, K.sample(v, (0, 0, 0), SHAPE, c + np.stack([np.full(c.shape[1], 0.5), np.full(c.shape[1], -0.25), c[2] / 20.0])).reshape(SHAPE))


def test_blend_of_equal_tiles_is_the_volume_but_for_the_corner_floor(spark):
    df, v = ramp(spark)
    one = spark.createDataFrame([("r", *SHAPE)], "volume_id string, nz int, ny int, nx int")
    t = tiling.make_tiles(one, (9, 6, 7), (0, 3, 3), ["volume_id"]).drop("volume_id").withColumns({f"d{a}": F.lit(0.0) for a in "zyx"})
    b = B.to_bricks(df, SHAPE, (4, 4, 8))
    plain = array(resample.tiled_apply(b, SHAPE, t, SHAPE, (4, 4, 8), (0, 3, 3), eps=None), SHAPE)
    assert np.allclose(plain, v)
    floor = array(resample.tiled_apply(b, SHAPE, t, SHAPE, (4, 4, 8), (0, 3, 3)), SHAPE)
    assert np.isclose(floor[0, 0, 0], v[0, 0, 0] * 0.01) and np.allclose(floor[:, 1:-1, 1:-1], v[:, 1:-1, 1:-1])
    once = array(resample.tiled_apply(b, SHAPE, t, SHAPE, (4, 4, 8), (0, 3, 3), t=(0.0, 0.5, 0.0), mode="composed", eps=None), SHAPE)
    assert np.allclose(once[:, :-1], v[:, :-1] - 1.0)


def test_cosine_ramp():
    assert np.allclose(K.cosine_ramp(7, 0), 1) and np.allclose(K.cosine_ramp(1, 5), 1)
    w = K.cosine_ramp(8, 3)
    assert w[0] == w[-1] == 1e-4 and np.isclose(w[1], 0.25) and w[3] == 1 and w[4] == 1


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=SHAPE), rng.normal(size=SHAPE)
    df = lambda v: spark.createDataFrame([("v", 0, *map(int, i), float(v[i])) for i in np.ndindex(*SHAPE)], "volume_id string, channel int, z int, y int, x int, v double")
    p = metrics.pair_bricks(B.to_bricks(df(a), SHAPE, (4, 4, 8)), B.to_bricks(df(b), SHAPE, (4, 4, 8)))
    r = metrics.similarity(p).first()
    h = np.histogram2d(a.ravel(), b.ravel(), bins=64)[0] / a.size
    ent = lambda q: -(q * np.log(q + 1e-12)).sum()
    assert np.isclose(r.ncc, np.corrcoef(a.ravel(), b.ravel())[0, 1])
    assert np.isclose(r.nrmse, np.sqrt(((a - b) ** 2).mean()) / np.ptp(a))
    assert np.isclose(r.nmi, (ent(h.sum(1)) + ent(h.sum(0))) / ent(h), rtol=1e-3)
    c = metrics.pair_bricks(B.to_bricks(df(a * 0 + 5), SHAPE, (4, 4, 8)), B.to_bricks(df(b), SHAPE, (4, 4, 8)))
    assert metrics.ncc(metrics.moments(c)).first().ncc == 0


def rows_of(spark, a, name="g"):
    return spark.createDataFrame([(name, 0, *map(int, i), float(a[i])) for i in np.ndindex(*a.shape)], "volume_id string, channel int, z int, y int, x int, v double")


def test_bright_flat_volumes_keep_their_digits(spark):
    rng = np.random.default_rng(4)
    a = 60000 + rng.normal(size=SHAPE) * 1e-3
    b = a + rng.normal(size=SHAPE) * 1e-3
    p = metrics.pair_bricks(B.to_bricks(rows_of(spark, a), SHAPE, (4, 4, 8)), B.to_bricks(rows_of(spark, b), SHAPE, (4, 4, 8)))
    assert np.isclose(metrics.ncc(metrics.moments(p)).first().ncc, np.corrcoef(a.ravel(), b.ravel())[0, 1], rtol=1e-6)


def test_a_brick_that_one_side_lacks_is_zeros(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=SHAPE), rng.normal(size=SHAPE)
    b[:4, :4, :8] = 0
    f = B.to_bricks(rows_of(spark, a), SHAPE, (4, 4, 8))
    m = B.to_bricks(rows_of(spark, b), SHAPE, (4, 4, 8)).where("bz > 0 or by > 0 or bx > 0")
    for x, y, p, q in ((f, m, a, b), (m, f, b, a)):
        r = metrics.nrmse(metrics.ncc(metrics.moments(metrics.pair_bricks(x, y)))).first()
        assert r.n == a.size and np.isclose(r.ncc, np.corrcoef(p.ravel(), q.ravel())[0, 1]) and np.isclose(r.nrmse, np.sqrt(((p - q) ** 2).mean()) / np.ptp(p))


def test_affine_recovers_a_translation(spark):
    shape, brick = (12, 14, 16), (6, 7, 8)
    z, y, x = np.indices(shape)
    f = lambda dz, dy, dx: np.exp(-((z - 6 - dz) ** 2 + (y - 7 - dy) ** 2 + (x - 8 - dx) ** 2) / 30) * 100
    one = lambda *d: B.to_bricks(rows_of(spark, f(*d)), shape, brick)
    m, t = estimate.estimate_affine(one(0, 0, 0), one(0.6, -0.4, 0.5), shape, shape, brick, (2, 1), 8)
    assert np.allclose(m @ np.array([6.0, 7.0, 8.0]) + t, [6.6, 6.6, 8.5], atol=0.1)


def test_affine_of_the_table(spark, sf):
    got = sorted(map(tuple, volumes.e4_affine(spark, sf).collect()))
    m, t = np.array([r[1:4] for r in got]), np.array([r[4] for r in got])
    print(m, t)
    assert np.allclose(m, np.eye(3), atol=0.02) and np.allclose(t, [0.3, -0.4, 0.5], atol=0.15)


def test_refined_tiles_find_the_shift_and_skip_background(spark):
    rng = np.random.default_rng(1)
    v = rng.uniform(1000, 2000, size=(8, 16, 16))
    v[:, :, 8:] = 0
    shape, brick = v.shape, (4, 8, 8)
    one = lambda a: B.to_bricks(rows_of(spark, a), shape, brick)
    t = spark.createDataFrame([(1, 0, 8, 0, 16, 0, 8), (2, 0, 8, 0, 16, 8, 16)], "tile_index int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    t = intensity.tile_foreground(t, one(v), brick, 10.0, 1)
    got = {r.tile_index: r for r in estimate.refine_tiles(t, one(v), one(np.roll(v, 1, axis=1)), shape, brick, 1).collect()}
    assert (got[1].dz, got[1].dy, got[1].dx, got[1].skipped) == (0, 1, 0, False)
    assert got[2].skipped and got[2].reason == "background" and got[2].dy == 0


@pytest.mark.parametrize("brick", [(3, 4, 5), (16, 16, 16)])
def test_shift_scores_against_numpy(spark, brick):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=SHAPE), rng.normal(size=SHAPE)
    got = {(r.dz, r.dy, r.dx): r for r in estimate.shift_scores(B.to_bricks(rows_of(spark, a), SHAPE, brick), B.to_bricks(rows_of(spark, b), SHAPE, brick), SHAPE, brick, 1).collect()}
    assert len(got) == 27
    for d, r in got.items():
        i = tuple(slice(max(0, -k), n - max(0, k)) for k, n in zip(d, SHAPE, strict=True))
        j = tuple(slice(max(0, k), n - max(0, -k)) for k, n in zip(d, SHAPE, strict=True))
        assert r.n == a[i].size and np.isclose(r.ncc, np.corrcoef(a[i].ravel(), b[j].ravel())[0, 1])


def test_bricks_and_long_form_agree(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(-50, 70000, SHAPE).astype(float)
    v[0, 0, :3] = [np.nan, np.inf, -np.inf]
    df = rows_of(spark, v)
    b = B.to_bricks(df, SHAPE, (4, 4, 8))
    for mode in ("clip", "minmax", "robust"):
        want = {(r.z, r.y, r.x): r.v for r in intensity.to_uint16(df, mode).collect()}
        assert {(r.z, r.y, r.x): int(r.v) for r in B.to_voxels(intensity.uint16_bricks(b, mode)).collect()} == want
    p, q = intensity.array_stats(df, ["volume_id", "channel"]).first(), intensity.brick_array_stats(b).first()
    assert p.asDict() == q.asDict()


def test_uint16_pixels_are_shuffled_once(spark):
    """What the gather sends is the volume and the halo of its bricks, in the volume's own type."""
    from voxelbrick.operators.resample import sent, with_transforms

    shape, brick = (32, 32, 32), (16, 16, 16)
    b = B.to_bricks(rows_of(spark, np.random.default_rng(8).integers(0, 65535, shape)), shape, brick, "uint16")
    pieces = sent(with_transforms(b, (1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0), (0.5, 0.25, -0.5), None), shape, shape, brick)
    assert pieces.agg(F.sum(F.length("s_data"))).first()[0] <= 1.5 * 2 * np.prod(shape)
    plan = resample.warp(b, shape, shape, brick, t=(0.5, 0.25, -0.5))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("FlatMapCoGroups")[1].split("MapInPandas")[0]


def test_each_volume_by_its_own_transform(spark):
    df, v = ramp(spark)
    two = df.unionAll(df.withColumn("volume_id", F.lit("s")))
    t = spark.createDataFrame([("r", list(resample.IDENTITY), [1.0, 0.0, 0.0]), ("s", list(resample.IDENTITY), [0.0, 0.0, -2.0])], "volume_id string, m array<double>, t array<double>")
    out = resample.warp(B.to_bricks(two, SHAPE, (4, 4, 8)), SHAPE, SHAPE, (4, 4, 8), transforms=t)
    assert np.array_equal(array(out.where("volume_id = 'r'"), SHAPE)[:-1], v[1:])
    assert np.array_equal(array(out.where("volume_id = 's'"), SHAPE)[:, :, 2:], v[:, :, :-2])


def test_saved_transforms_that_are_missing_are_an_error(spark):
    df, _ = ramp(spark)
    b = B.to_bricks(df, SHAPE, (4, 4, 8))
    one = spark.createDataFrame([("r", *SHAPE)], "volume_id string, nz int, ny int, nx int")
    tiles = tiling.make_tiles(one, (9, 6, 7), (0, 3, 3), ["volume_id"])
    whole, saved = jobs.register_tiles(b, b, SHAPE, (4, 4, 8), (9, 6, 7), (0, 3, 3), 1, 1, 1)
    assert saved.count() == tiles.count() == 9 and jobs.pending_tiles(tiles, saved).count() == 0 and jobs.pending_tiles(tiles, saved, force=True).count() == 9
    assert jobs.apply_tiles(b, SHAPE, (4, 4, 8), tiles, (0, 3, 3), whole, saved).count() > 0
    some = saved.where("tile_index > 1")
    assert jobs.pending_tiles(tiles, some).count() == 1
    with pytest.raises(ValueError, match="no transform is saved"):
        jobs.apply_tiles(b, SHAPE, (4, 4, 8), tiles, (0, 3, 3), whole, some)
    with pytest.raises(ValueError, match="no transform is saved"):
        jobs.apply_tiles(b, SHAPE, (4, 4, 8), tiles, (0, 3, 3), whole.where("false"), saved)


def test_stack_checks_shapes(spark):
    df, _ = ramp(spark)
    small = df.where("z < 5").withColumn("channel", F.lit(2))
    b = B.to_bricks(df.unionAll(df.withColumn("channel", F.lit(1))).unionAll(small), SHAPE, (4, 4, 8))
    assert {r.channel for r in jobs.stack_channels(b, [1], SHAPE).select("channel").distinct().collect()} == {0, 1}
    for order in ([1, 2], [7]):
        with pytest.raises(ValueError, match="shape"):
            jobs.stack_channels(b, order, SHAPE)


def test_uint16_of_odd_values(spark):
    df = spark.createDataFrame([("v", 0, v) for v in (float("nan"), None, -3.0, 0.5, 1.5, 2.5, 70000.0, float("inf"))], "volume_id string, channel int, v double")
    assert [r.v for r in intensity.to_uint16(df).collect()] == [0, 0, 0, 0, 2, 2, 65535, 0]
    flat = spark.createDataFrame([("v", 0, 7.0)] * 3, "volume_id string, channel int, v double")
    assert {r.v for mode in ("minmax", "robust") for r in intensity.to_uint16(flat, mode).collect()} == {0}
    with pytest.raises(ValueError):
        intensity.to_uint16(flat, "other")


@pytest.mark.parametrize("big", [True, False])
@pytest.mark.parametrize("dtype", ["uint8", "uint16", "float32"])
def test_tiff_round_trip(big, dtype):
    a = (np.random.default_rng(2).uniform(0, 250, (3, 5, 7))).astype(dtype)
    assert np.array_equal(tiff.decode(tiff.encode(a, big)), a)
    with pytest.raises(ValueError):
        tiff.decode(b"II*")


def test_tiff_pages_that_turn_back():
    data = bytearray(tiff.encode(np.zeros((2, 3, 4), "uint8"), big=False))
    last = len(data) - 12 - 4
    data[last : last + 4] = (8).to_bytes(4, "little")
    with pytest.raises(ValueError, match="turns back"):
        tiff.decode(bytes(data))


def test_index_affine_turns_axes():
    m, t = resample.index_affine(resample.IDENTITY, (3.0, 0, 0), {"spacing": (1, 1, 1)}, {"spacing": (1, 1, 2)})
    assert np.allclose(np.array(m).reshape(3, 3), np.diag([0.5, 1, 1])) and np.allclose(t, [0, 0, 3])


def test_full_size_tiles(spark):
    one = spark.createDataFrame([("a", 1568, 2304, 12800)], "p string, nz int, ny int, nx int")
    t = tiling.make_tiles(one, (1568, 2048, 2048), (0, 512, 512), ["p"])
    assert t.count() == 16 and sorted({r.y0 for r in t.collect()}) == [0, 256] and max(r.x0 for r in t.collect()) == 10752


def test_stream_waits_for_whole_volumes_and_leaves_out_what_is_there(spark, tmp_path):
    from voxelbrick.streaming.apply import stream_apply

    df, v = ramp(spark)
    b = B.to_bricks(df.unionAll(df.withColumn("volume_id", F.lit("s"))), SHAPE, (4, 4, 8)).cache()
    complete = b.groupBy("volume_id").agg(F.count("*").alias("bricks"))
    t = spark.createDataFrame([(n, list(resample.IDENTITY), [1.0, 0.0, 0.0]) for n in "rs"], "volume_id string, m array<double>, t array<double>")
    go = lambda c="c", target="out", t=t, **o: stream_apply(spark, str(tmp_path / "in"), str(tmp_path / target), str(tmp_path / c), SHAPE, (4, 4, 8), t, complete, **o)
    b.where("volume_id = 'r' or bz = 0").write.parquet(str(tmp_path / "in"))
    assert {r.volume_id for r in go().select("volume_id").distinct().collect()} == {"r"}
    b.where("volume_id = 's' and bz > 0").write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        out = go()
        assert out.count() == b.count() and all(np.array_equal(array(out.where(F.col("volume_id") == n), SHAPE)[:-1], v[1:]) for n in "rs")
    one = spark.createDataFrame([(n, *SHAPE) for n in "rs"], "volume_id string, nz int, ny int, nx int")
    tiles = tiling.make_tiles(one, (9, 6, 7), (0, 3, 3), ["volume_id"])
    saved = tiles.select("volume_id", "tile_index", *[F.lit(0).alias(f"d{a}") for a in "zyx"], F.lit(False).alias("skipped"), F.lit(False).alias("output_skipped"))
    blended = go("c2", "out2", tiles=tiles, saved=saved, overlap=(0, 3, 3))
    assert np.allclose(array(blended.where("volume_id = 'r'"), SHAPE)[:-1, 1:-1, 1:-1], v[1:, 1:-1, 1:-1])
    with pytest.raises(Exception, match="no transform is saved for s"):
        go("c3", "out3", t=t.where("volume_id = 'r'"))


def _still_in(region):
    """X.shifted, but the voxels of a region stay where they are."""
    real = X.shifted

    def shifted(v, by, shape, name="emb"):
        return real(v, by, shape, name).where(f"not ({region})").unionByName(v.where(region).withColumn("volume_id", F.lit(name)))

    return shifted


def test_shift_searches_see_the_whole_volume(spark, sf, monkeypatch):
    """A corner that didn't move doesn't decide the shift."""
    monkeypatch.setattr(X, "shifted", _still_in("z < 8 and y < 16 and x < 32"))
    got = {r.channel: (r.dz, r.dy, r.dx) for r in volumes.e6_intracycle(spark, sf).collect()}
    assert got == {1: (1, 0, 0), 2: (0, 2, -1), 3: (-1, 1, 2)}
    monkeypatch.undo()
    monkeypatch.setattr(X, "shifted", _still_in("z < 8 and y < 15"))
    assert {(r.dz, r.dy, r.dx) for r in volumes.x1_roi_registration(spark, sf).collect()} == {X.PLANTED}


def test_numbers_that_are_too_long_are_null(spark):
    from voxelbrick.functions import parse

    rows = ["1,2,3,4,5,99999999999", "ResolutionLevel 0/TimePoint 0/Channel 99999999999/Data", "99999999999", "99999999999,3,4", '{"x": 2147483647, "y": 0, "z": 0, "size_x": 5, "size_y": 1, "size_z": 1}', None, ""]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select(*[f(F.col("t")).alias(n) for n, f in (("roi", parse.parse_roi), ("key", parse.parse_dataset_key), ("z", parse.z_range), ("list", parse.parse_channels), ("triple", parse.parse_triplet))]).collect()
    assert all(v is None for r in got for v in r)
    assert df.select(parse.channel_order(F.concat(F.lit("ch"), F.lit("9" * 30)))).first()[0] == 10**9
    names = ["img_100000000000000000000000.tif", "img_9.tif", "img_010.tif", "img_99999999999999999999999.tif"]
    df = spark.createDataFrame([(r,) for r in names], "t string")
    assert [r.t for r in df.orderBy(parse.natural_key(F.col("t"))).collect()] == [names[1], names[2], names[3], names[0]]


def test_folders_are_compared_with_the_first_slice(spark):
    from voxelbrick.operators import catalog

    rows = [("c2", f"{i}.tif", "2,2", "u2") for i in range(3)] + [("c10", f"{i}.tif", "9,9", "u1") for i in range(3)] + [("c11", "0.tif", "2,2", "u2")] + [("c12", f"{i}.tif", "2,2", None if i else "u2") for i in range(3)]
    got = {r.dir: (r.n_slices, r.off_shape, r.off_dtype, r.bad) for r in catalog.validate_slices(spark.createDataFrame(rows, "dir string, file string, shape string, dtype string")).collect()}
    assert got == {"c2": (3, 0, 0, False), "c10": (3, 3, 3, True), "c11": (1, 0, 0, True), "c12": (3, 0, 2, True)}
    files = spark.createDataFrame([(1, "/registered/a.tif"), (2, "/x/a_registered.tif"), (2, "/x/b.tif")], "folder int, path string")
    assert {r.folder: r.path for r in catalog.pick_one(files, ["folder"]).collect()} == {1: "/registered/a.tif", 2: "/x/b.tif"}
