"""Registration of many volumes, dense fields, exact percentiles and the jobs on them, against planted transforms and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelbrick.functions.kernels import grid, sample
from voxelbrick.operators import bricks as B
from voxelbrick.operators import estimate, fields, intensity, jobs, metrics, ranks, register, resample, tiling
from voxelbrick.plans import volumes
from voxelbrick.sources import fixtures
from voxelbrick.sources.scratch import dropped, stored

SHAPE, BRICK = (20, 24, 28), (8, 8, 16)


def table(spark, volumes_, brick=BRICK):
    """{(volume_id, channel): array} as stored bricks."""
    rows = [B._row(v, c, k, at, part) for (v, c), a in volumes_.items() for k, at, part in B._cut(v, c, np.zeros(3, int), a, brick)]
    return stored(spark.createDataFrame(rows, B.BRICKS), "test")


def whole(df, shape=SHAPE, numbers=None):
    """{(volume_id, channel): array} of bricks."""
    out = {}
    for r in df.collect():
        a = out.setdefault((r.volume_id, r.channel), np.full((numbers or 1, *shape), np.nan))
        a[:, r.z0 : r.z0 + r.nz, r.y0 : r.y0 + r.ny, r.x0 : r.x0 + r.nx] = np.frombuffer(r.data, r.dtype).reshape(-1, r.nz, r.ny, r.nx)
    return {k: a if numbers else a[0] for k, a in out.items()}


def soft(shape, sigma=2.0, seed=0):
    a = np.random.default_rng(seed).normal(size=shape)
    for i in range(3):
        a = fields.blurred(a, sigma, int(3 * sigma), i)
    return (a - a.min()) / np.ptp(a) * 1000


def test_pooled_levels(spark):
    a = np.random.default_rng(1).integers(0, 60000, SHAPE).astype(np.uint16)
    steps = [(2, 3, 4), (5, 7, 9)]
    out = B.pooled(table(spark, {("v", 0): a}), steps, SHAPE, BRICK)
    for level, by in enumerate(steps):
        small = register.smaller(SHAPE, by)
        want = np.array([[[a[z * by[0] : (z + 1) * by[0], y * by[1] : (y + 1) * by[1], x * by[2] : (x + 1) * by[2]].mean() for x in range(small[2])] for y in range(small[1])] for z in range(small[0])])
        got = whole(out.where(F.col("level") == level), small)[("v", 0)]
        assert np.allclose(got, want, rtol=1e-6)


def test_levels_carry_transforms():
    m, t = np.array([[1.1, 0.1, 0], [0, 0.9, 0.2], [0.05, 0, 1]]), np.array([3.0, -2.0, 1.0])
    p, q = register.to_level(m, t, (2, 3, 4))
    i = np.array([3.0, 5.0, 2.0])
    middle = lambda x: x * [2, 3, 4] + (np.array([2, 3, 4]) - 1) / 2
    assert np.allclose(middle(p @ i + q), m @ middle(i) + t)
    back = register.from_level(p, q, (2, 3, 4))
    assert np.allclose(back[0], m) and np.allclose(back[1], t)
    g = np.array([[0, 0.1, 0], [-0.1, 0, 0], [0, 0, 0]])
    assert np.allclose(register.exponential(g)[:2, :2], [[np.cos(0.1), np.sin(0.1)], [-np.sin(0.1), np.cos(0.1)]])


def test_stages_of_many_volumes(spark, sf):
    f, m, shape = volumes.turned(spark, sf)
    found = {r.volume_id: (np.array(r.m).reshape(3, 3), np.array(r.t)) for r in register.register(f, m, shape, volumes.BRICK, "affine", (1, 1, 1), (1,), 2).collect()}
    full = tuple(n + 8 for n in shape)
    at = grid((0, 0, 0), shape)
    for name in fixtures.PLANTED_MAPS:
        pm, pt = fixtures.planted_map(name, full)
        pt = pm @ np.full(3, 4.0) + pt - 4  # indices of the inner crop
        e = np.abs((found[name][0] - pm) @ at + (found[name][1] - pt)[:, None])
        assert np.median(e) < 0.15 and e.max() < 0.6, name


def test_a_turn_of_six_degrees_in_the_preview(spark):
    shape, big = (24, 32, 40), (44, 52, 60)
    huge = soft(big, 2.5)
    a = np.radians(6)
    m = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    c = (np.array(shape) - 1) / 2
    fixed = sample(huge, (0, 0, 0), big, m @ grid((0, 0, 0), shape) + (c - m @ c + 10)[:, None]).reshape(shape)
    f, g = table(spark, {("v", 0): fixed}), table(spark, {("v", 0): huge[10:-10, 10:-10, 10:-10]})
    report, found, _ = jobs.preview(f, g, shape, BRICK, (2, 2, 2), 2, "rigid")
    r = found.first()
    assert np.abs(np.array(r.m).reshape(3, 3) - m).max() < 0.01 and r.downsample == "2x2x2"
    assert {x.phase for x in report.collect()} == {"before", "after"}
    moved = whole(resample.warp(g, shape, shape, BRICK, transforms=found), shape)[("v", 0)]
    inside = (slice(4, -4),) * 3
    assert np.corrcoef(moved[inside].ravel(), fixed[inside].ravel())[0, 1] > 0.99


def test_a_second_run_estimates_nothing(spark, monkeypatch):
    a = soft(SHAPE, 1.0)
    f = table(spark, {("u", 0): a, ("v", 0): a})
    m = table(spark, {("u", 0): np.roll(a, (1, 2, -1), (0, 1, 2)), ("v", 0): np.roll(a, (-1, 1, 2), (0, 1, 2))})
    once = register.register(f, m, SHAPE, BRICK, "shift", (1, 1, 1), radius=3)
    calls = []
    real = register.find_translation
    monkeypatch.setattr(register, "find_translation", lambda *x, **y: calls.append(x) or real(*x, **y))
    rows = lambda d: sorted((r.volume_id, tuple(r.t)) for r in d.collect())
    assert rows(register.register(f, m, SHAPE, BRICK, "shift", (1, 1, 1), radius=3, saved=once)) == rows(once) == [("u", (1.0, 2.0, -1.0)), ("v", (-1.0, 1.0, 2.0))]
    assert not calls
    part = once.where("volume_id = 'u'")
    assert rows(register.register(f, m, SHAPE, BRICK, "shift", (1, 1, 1), radius=3, saved=part)) == rows(once) and len(calls) == 1
    register.register(f, m, SHAPE, BRICK, "shift", (2, 2, 2), radius=2, saved=once)
    register.register(f, m, SHAPE, BRICK, "shift", (1, 1, 1), radius=3, saved=once, force=True)
    assert len(calls) == 3
    tiles = jobs.register_tiles(f, m, SHAPE, BRICK, (20, 16, 16), (0, 4, 4), 3, saved=(once, once.limit(0).selectExpr("volume_id", "1 tile_index", "type", "downsample")))
    scored = []
    monkeypatch.setattr(estimate, "METRICS", {k: lambda *x, v=v, **y: scored.append(1) or v(*x, **y) for k, v in estimate.METRICS.items()})
    again = jobs.register_tiles(f, m, SHAPE, BRICK, (20, 16, 16), (0, 4, 4), 3, saved=tiles)
    assert not scored and again[1].count() == tiles[1].count()


def test_a_cached_crop_is_used_as_it_is(spark):
    a = soft((24, 30, 40), 0.7)
    m = np.roll(a, (1, 2, 3), (0, 1, 2))
    f, g = table(spark, {("v", 0): a}), table(spark, {("v", 0): m})
    box = ((4, 5, 6), (16, 20, 30), (3, 3, 3), (24, 30, 40), BRICK)
    crop, first = jobs.register_roi(f, g, *box, 4)
    same, second = jobs.register_roi(None, g, *box, 4, fixed_crop=crop)
    assert first.first().t == second.first().t == [1.0, 2.0, 3.0] and same is crop
    with pytest.raises(ValueError, match="shape"):
        jobs.register_roi(None, g, *box, 4, fixed_crop=f)


def test_dim_volumes_keep_their_voxels(spark):
    a = soft(SHAPE, 1.0)
    bright, dim = (a * 60).astype(np.uint16), (20 + a * 0.08).astype(np.uint16)
    f = table(spark, {("b", 0): bright, ("d", 0): dim})
    kept = {}
    for skip in (False, True):
        by, local = jobs.register_tiles(f, f, SHAPE, BRICK, (20, 14, 16), (0, 4, 4), 1, 1, 2, skip_background=skip)
        tiles = tiling.make_tiles(spark.createDataFrame([("b", *SHAPE), ("d", *SHAPE)], "volume_id string, nz int, ny int, nx int"), (20, 14, 16), (0, 4, 4), ["volume_id"])
        out = whole(jobs.apply_tiles(f, SHAPE, BRICK, tiles, (0, 4, 4), by, local, eps=None))
        kept[skip] = out
        assert np.allclose(out[("d", 0)], dim) and np.allclose(out[("b", 0)], bright)


def test_flat_bright_volumes(spark):
    a = 60000 + np.random.default_rng(3).normal(size=SHAPE) * 0.0005
    got = estimate.shift_scores(table(spark, {("v", 0): a}), table(spark, {("v", 0): np.roll(a, (1, 2, 1), (0, 1, 2))}), SHAPE, BRICK, 2).collect()
    assert all(-1 <= r.ncc <= 1 for r in got)
    best = max(got, key=lambda r: r.ncc)
    assert (best.dz, best.dy, best.dx) == (1, 2, 1) and best.ncc > 0.99


def test_shifts_are_scored_by_blocks(spark):
    """Of a block of small bricks one row a shift leaves its task; a brick that isn't there, voxels that a mask leaves out and those that aren't numbers don't count."""
    a, m = (np.random.default_rng(i).normal(size=SHAPE) for i in (5, 6))
    there = np.ones(SHAPE, bool)
    there[: BRICK[0], : BRICK[1], : BRICK[2]] = False
    there[-1, 2:, :] = False
    m[1, 2, 3] = np.nan
    rows = [("v", 0, *map(int, i), float(a[i])) for i in zip(*np.nonzero(there), strict=True)]
    f = B.to_bricks(spark.createDataFrame(rows, "volume_id string, channel int, z int, y int, x int, v double"), SHAPE, BRICK, given=True)
    extra = f.select("volume_id", "channel").distinct()
    each = estimate._shifted(f, table(spark, {("v", 0): m}), SHAPE, BRICK, 1, None, None, extra, lambda r, p, q: (p, q), lambda p, q: [[len(p)], [float(p @ q)]], "volume_id string, channel int, tile_index int, dz int, dy int, dx int, n long, s double").collect()
    blocks = np.prod([-(-n // s) for n, s in zip(SHAPE, B.side_of(BRICK), strict=True)])
    assert len(each) == 27 * blocks < 27 * np.prod([-(-n // s) for n, s in zip(SHAPE, BRICK, strict=True)])
    for d in np.ndindex(3, 3, 3):
        d = np.array(d) - 1
        i, j = np.maximum(0, -d), np.minimum(SHAPE, SHAPE - d)
        p, q = (tuple(slice(u, v) for u, v in zip(i + e, j + e, strict=True)) for e in (0, d))
        keep = there[p] & np.isfinite(m[q])
        got = [(r.n, r.s) for r in each if (r.dz, r.dy, r.dx) == tuple(d)]
        assert np.allclose(np.sum(got, axis=0), (keep.sum(), a[p][keep] @ m[q][keep]))


def test_information_sees_a_folded_copy(spark):
    a = soft(SHAPE, 0.8)
    m = np.roll(np.abs(a - np.median(a)), (1, -1, 2), (0, 1, 2))
    f, g = table(spark, {("v", 0): a}), table(spark, {("v", 0): m})
    r = estimate.search_shift(f, g, SHAPE, BRICK, 2, metric="nmi").first()
    assert (r.dz, r.dy, r.dx) == (1, -1, 2)
    r = estimate.search_shift(f, g, SHAPE, BRICK, 2).first()
    assert (r.dz, r.dy, r.dx) != (1, -1, 2) or r.ncc < 0.5


def test_smoothing_crosses_bricks(spark):
    a = np.random.default_rng(5).normal(size=SHAPE)
    want = a.copy()
    for i in range(3):
        want = fields.blurred(want, 1.3, 4, i)
    assert np.allclose(whole(fields.smooth(table(spark, {("v", 0): a}), 1.3, SHAPE, BRICK))[("v", 0)], want, atol=1e-5)


def test_demons_recover_a_planted_field(spark):
    shape, big = (20, 24, 32), (40, 44, 52)
    huge = soft(big, 2.0, 4)
    g = grid((0, 0, 0), shape)
    d = np.stack([1.2 * np.sin(g[1] / 24 * np.pi), 1.0 * np.sin(g[2] / 32 * np.pi) * np.cos(g[0] / 20 * 2), -1.2 * np.sin(g[0] / 20 * np.pi + 0.5)])
    fixed = sample(huge, (0, 0, 0), big, g + d + 10).reshape(shape)
    f, m = table(spark, {("v", 0): fixed}), table(spark, {("v", 0): huge[10:-10, 10:-10, 10:-10]})
    found = fields.demons(f, m, shape, BRICK, 12)
    got = whole(found, shape, 3)[("v", 0)]
    error = np.sqrt(((got - d.reshape(got.shape)) ** 2).sum(axis=0))[3:-3, 3:-3, 3:-3]
    assert np.sqrt((d**2).sum(axis=0)).mean() > 1.0 and error.mean() < 0.3
    same = whole(fields.demons(f, f, shape, BRICK, 3), shape, 3)[("v", 0)]
    assert np.abs(same).max() < 1e-6


def test_coarse_fields_equal_full_ones(spark):
    rng = np.random.default_rng(9)
    steps, small = (2, 3, 4), register.smaller(SHAPE, (2, 3, 4))
    a = rng.integers(0, 60000, SHAPE).astype(np.uint16)
    coarse = rng.normal(size=(3, *small)).astype(np.float32)
    coarse[:, 0, 0, 0] = 3.0  # one wild place
    rows = []
    for k, at, _ in B._cut("v", 0, np.zeros(3, int), coarse[0], BRICK):
        part = coarse[(slice(None), *[slice(p, p + s) for p, s in zip(at, BRICK, strict=True)])]
        rows.append(fields._brick(("v", 0, *k), at, part))
    field = stored(spark.createDataFrame(rows, B.BRICKS), "field")
    m, t = np.array([[1, 0.02, 0], [0, 0.98, 0], [0, 0.01, 1]]), np.array([0.4, 0.7, -1.2])
    by = spark.createDataFrame([("v", m.ravel().tolist(), t.tolist())], "volume_id string, m array<double>, t array<double>")
    moving = table(spark, {("v", 0): a, ("v", 3): (a // 2).astype(np.uint16)})
    g = grid((0, 0, 0), SHAPE)
    s = np.array(steps, float)
    c = np.clip((g - ((s - 1) / 2)[:, None]) / s[:, None], 0, np.array(small)[:, None] - 1)
    d = np.stack([sample(x.astype(float), (0, 0, 0), small, c) * k for x, k in zip(coarse, s, strict=True)])
    out = whole(fields.warp_coarse(moving, SHAPE, field, steps, SHAPE, BRICK, by))
    for ch, v in ((0, a), (3, a // 2)):
        assert np.abs(out[("v", ch)] - sample(v.astype(float), (0, 0, 0), SHAPE, m @ (g + d) + t[:, None]).reshape(SHAPE)).max() < 1e-6


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "float32", "float64", "int32"])
def test_exact_percentiles(spark, dtype):
    rng = np.random.default_rng(13)
    a = rng.normal(size=SHAPE) * 50
    a = np.abs(a).astype(dtype) if dtype.startswith("u") else a.astype(dtype)
    b = a.copy()
    if dtype.startswith("float"):
        b.ravel()[:5] = np.nan, np.inf, -np.inf, -0.0, 0.0
        b.ravel()[5:3000] = 7.5
    at = [0.0, 0.001, 0.01, 0.5, 0.9, 0.999, 1.0]
    got = {r.volume_id: r for r in ranks.percentiles(table(spark, {("a", 0): a, ("b", 0): b, ("c", 0): np.zeros(SHAPE, dtype) + (np.nan if dtype.startswith("float") else 3)}), at).collect()}
    for k, v in (("a", a), ("b", b)):
        v = v[np.isfinite(v)].astype(float)
        assert got[k].n == v.size and np.allclose(got[k].q, np.percentile(v, np.array(at) * 100), rtol=1e-12, atol=0)
    assert ("c" in got) == (not dtype.startswith("float"))
    assert all(ranks.value_of(int(ranks.keys_of(np.array([x], dtype), 64)[0]), 64) == x for x in a.ravel()[:20]) if dtype == "float64" else True


def test_percentile_rows_stay_few(spark):
    """Of a float volume, no row a voxel leaves a task: counts of at most 2**16 digits a pass and prefix."""
    a = np.random.default_rng(1).normal(size=(40, 40, 40)) + 5
    v = table(spark, {("v", 0): a}, (20, 20, 20))
    u = whole(intensity.uint16_bricks(v, "robust"), (40, 40, 40))[("v", 0)]
    lo, hi = np.percentile(a, [0.1, 99.9])
    assert np.array_equal(u, np.rint(np.clip((a - lo) / (hi - lo), 0, 1) * 65535))


def test_singular_transforms_are_an_error(spark):
    v = table(spark, {("v", 0): soft(SHAPE)})
    by = spark.createDataFrame([("v", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0])], "volume_id string, m array<double>, t array<double>")
    with pytest.raises(ValueError, match="inverted"):
        resample.warp(v, SHAPE, SHAPE, BRICK, transforms=by)


def test_dense_registration_after_a_global_one(spark):
    shape, big = (20, 24, 32), (40, 44, 52)
    huge = soft(big, 3.0, 6)
    g = grid((0, 0, 0), shape)
    d = np.stack([2.0 * np.sin(g[1] / 24 * np.pi) + 1, np.full(g.shape[1], -2.0), 2.0 * np.sin(g[0] / 20 * np.pi)])
    fixed = sample(huge, (0, 0, 0), big, g + d + 10).reshape(shape)
    f, m = table(spark, {("v", 0): fixed}), table(spark, {("v", 0): huge[10:-10, 10:-10, 10:-10]})
    by = register.register(f, m, shape, BRICK, "translation", (1, 1, 1), (1,), 3)
    field = jobs.register_dense(f, m, shape, BRICK, by, (2, 2, 2), rounds=12)
    inside = (slice(4, -4),) * 3
    shift = np.array(by.first().t)
    at = np.clip((g - 0.5) / 2, 0, np.array(register.smaller(shape, (2, 2, 2)))[:, None] - 1)
    proxy = whole(field, register.smaller(shape, (2, 2, 2)), 3)[("v", 0)]
    more = np.stack([2 * sample(x, (0, 0, 0), x.shape, at) for x in proxy])
    error = [np.sqrt(((e - d) ** 2).sum(axis=0)).reshape(shape)[inside].mean() for e in (shift[:, None] + 0 * d, shift[:, None] + more)]
    assert error[1] < 0.8 * error[0]
    moved = whole(fields.warp_coarse(m, shape, field, (2, 2, 2), shape, BRICK, by), shape)[("v", 0)]
    want = sample(huge[10:-10, 10:-10, 10:-10], (0, 0, 0), shape, g + shift[:, None] + more).reshape(shape)
    assert np.abs(moved - want).max() < 1e-3


def test_shifts_below_a_voxel(spark):
    shape, big = (20, 24, 32), (32, 36, 44)
    huge = soft(big, 1.2, 7)
    g = grid((0, 0, 0), shape)
    moving = huge[6:-6, 6:-6, 6:-6]
    made, planted = {}, {"a": (1.3, -0.3, 0.0), "b": (0.25, 2.0, -1.4)}
    for k, d in planted.items():
        spectrum = np.fft.fftn(huge)  # moved without interpolation
        turn = np.einsum("i,j,k->ijk", *[np.exp(2j * np.pi * np.fft.fftfreq(n) * x) for n, x in zip(big, d, strict=True)])
        made[(k, 0)] = np.fft.ifftn(spectrum * turn).real[6:-6, 6:-6, 6:-6]
    f, m = table(spark, made), table(spark, {(k, 0): moving for k in planted})
    start = register.find_translation(f, m, shape, BRICK, 3)
    for r in estimate.subvoxel(f, m, shape, (16, 16, 16), start).collect():
        assert np.abs(np.array([r.dz, r.dy, r.dx]) - planted[r.volume_id]).max() < 0.05
    assert len(g[0]) == moving.size


def test_dropped_tables_are_gone(spark):
    t = stored(spark.range(5), "gone")
    dropped(t)
    with pytest.raises(Exception):  # noqa: B017
        t.count()
