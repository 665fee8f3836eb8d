"""Estimation of transforms: moments, shift search, phase correlation, affine Gauss-Newton, local block matching."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelbrick.functions.kernels import given, grid, sample, unpacked
from voxelbrick.operators import bricks, intensity, metrics, resample
from voxelbrick.operators.bricks import AXES, Triple, side_of
from voxelbrick.sources.scratch import stored


def moments(voxels: DataFrame, group: list[str]) -> DataFrame:
    """mass, centroid and covariance of intensity: one aggregate of ten sums."""
    v = F.col("v").cast("double")
    names = [("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"), ("y", "x")]
    sums = voxels.groupBy(*group).agg(F.sum(v).alias("mass"), *[F.sum(v * F.col(a)).alias(f"s{a}") for a in "zyx"], *[F.sum(v * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in names])
    out = sums.select("*", *[(F.col(f"s{a}") / F.col("mass")).alias(f"c{a}") for a in "zyx"])
    return out.select(*group, "mass", "cz", "cy", "cx", *[(F.col(f"s{a}{b}") / F.col("mass") - F.col(f"c{a}") * F.col(f"c{b}")).alias(f"cov_{a}{b}") for a, b in names])


def brick_moments(bricks: DataFrame) -> DataFrame:
    """moments of bricks by volume_id and channel, and n, their voxels: eleven sums leave each brick."""
    names = ["n", "mass", "sz", "sy", "sx", "szz", "syy", "sxx", "szy", "szx", "syx"]

    def part(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                v = unpacked(r).ravel().astype(float)
                z, y, x = grid((r.z0, r.y0, r.x0), (r.nz, r.ny, r.nx))
                rows.append((r.volume_id, r.channel, float(len(v)), v.sum(), v @ z, v @ y, v @ x, v @ (z * z), v @ (y * y), v @ (x * x), v @ (z * y), v @ (z * x), v @ (y * x)))
            yield pd.DataFrame(rows, columns=["volume_id", "channel", *names])

    sums = bricks.mapInPandas(part, "volume_id string, channel int, " + ", ".join(f"{c} double" for c in names)).groupBy("volume_id", "channel").agg(*[F.sum(c).alias(c) for c in names])
    mean = lambda c: F.try_divide(F.col(c), F.col("mass"))
    return sums.select("volume_id", "channel", "n", "mass", *[mean(f"s{a}").alias(f"c{a}") for a in AXES], *[(mean(f"s{p}") - mean(f"s{p[0]}") * mean(f"s{p[1]}")).alias(f"cov_{p}") for p in ("zz", "yy", "xx", "zy", "zx", "yx")])


def init_translation(fixed: DataFrame, moving: DataFrame) -> DataFrame:
    """(tz, ty, tx): from the fixed centroid to the moving one."""
    f, m = moments(fixed, []), moments(moving, [])
    return f.select(*[F.col(f"c{a}").alias(f"f{a}") for a in "zyx"]).crossJoin(m.select(*[F.col(f"c{a}").alias(f"m{a}") for a in "zyx"])).select(*[(F.col(f"m{a}") - F.col(f"f{a}")).alias(f"t{a}") for a in "zyx"])


_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")
_SCORES = "volume_id string, channel int, tile_index int, dz int, dy int, dx int, " + ", ".join(f"{c} double" for c in _SUMS)


def centres(fixed: DataFrame, moving: DataFrame) -> DataFrame:
    """volume_id, channel, fc, mc: the mean of either side's voxels."""

    def part(batches):
        for b in batches:
            yield pd.DataFrame([(r.volume_id, r.channel, float(r.nz * r.ny * r.nx), unpacked(r).sum(dtype=float)) for r in b.itertuples()], columns=["volume_id", "channel", "n", "s"])

    mean = lambda v, name: v.mapInPandas(part, "volume_id string, channel int, n double, s double").groupBy("volume_id", "channel").agg((F.sum("s") / F.sum("n")).alias(name))
    return mean(fixed, "fc").join(mean(moving, "mc"), ["volume_id", "channel"])


def _shifted(fixed: DataFrame, moving: DataFrame, shape: Triple, brick: Triple, radius: int, tiles: DataFrame | None, start: DataFrame | None, extra: DataFrame, ready, score, schema: str) -> DataFrame:
    """score(overlap of fixed, overlap of moving) -> columns, for each whole shift within radius of start, and each block of bricks, or with
    tiles each brick and tile of it (else tile 0).

    A block of fixed's bricks meets the moving box around it once; all shifts are scored in its task, on what ready(row, fixed, moving) makes
    of both boxes before. extra: columns by volume_id and channel. Voxels that fixed lacks or its mask leaves out, and moving ones that
    aren't finite, don't count."""
    wanted = fixed.join(F.broadcast(extra), ["volume_id", "channel"])  # a row for each pair, so that no pixel is shuffled for it
    if start is None:
        wanted = wanted.withColumns({f"s{a}": F.lit(0) for a in AXES})
        ahead = resample.with_transforms(moving, resample.IDENTITY, (0, 0, 0), None)
    else:
        wanted = wanted.join(F.broadcast(start.select("volume_id", "channel", *[F.col(f"s{a}").cast("int").alias(f"s{a}") for a in AXES])), ["volume_id", "channel"])
        ahead = resample.with_transforms(moving, resample.IDENTITY, (0, 0, 0), translations(start.withColumnsRenamed({f"s{a}": f"d{a}" for a in AXES})))
    if tiles is None:
        wanted = wanted.withColumn("tiles", F.lit(None).cast("array<int>"))
    else:
        by = intensity.tiles_by_brick(tiles, brick)
        wanted = wanted.join(by, [c for c in by.columns if c != "tiles"])
    names = [c.split()[0] for c in schema.split(", ")]
    steps, tiled = range(-radius, radius + 1), tiles is not None

    def kernel(want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        r = next(want.itertuples())  # what is the pair's own
        at, end = resample.block_box(want)
        s, n = np.array([r.sz, r.sy, r.sx]), np.array(shape)
        low, high = resample.clamped_box(at, end, np.eye(3), s.astype(float), float(radius), shape)
        f, there, boxes = np.zeros(end - at), np.zeros(end - at, bool), [] if tiled else [(0, at, end)]
        for b in want.itertuples():
            p = np.array([b.z0, b.y0, b.x0])
            q = p + (b.nz, b.ny, b.nx)
            here = tuple(slice(u, v) for u, v in zip(p - at, q - at, strict=True))
            f[here], there[here] = unpacked(b), given(b)
            if tiled:
                boxes += [(t["tile_index"], *(edge([t[f"{a}{e}"] for a in AXES], x) for e, edge, x in ((0, np.maximum, p), (1, np.minimum, q)))) for t in b.tiles]
        m = resample.assembled(have, low, high)
        finite = np.isfinite(m)
        some = not (there.all() and finite.all())
        f, m = ready(r, f, np.where(finite, m, 0.0) if some else m)
        places, scores = [], []
        for tile, p, q in boxes:
            for d in itertools.product(steps, steps, steps):
                d = s + d
                i, j = np.maximum(p, -d), np.minimum(q, n - d)
                if (i < j).all():
                    of_f, of_m = (tuple(slice(u, v) for u, v in zip(i + e, j + e, strict=True)) for e in (-at, d - low))
                    a, b = f[of_f].ravel(), m[of_m].ravel()
                    if some:
                        keep = there[of_f].ravel() & finite[of_m].ravel()
                        a, b = a[keep], b[keep]
                    if len(a):
                        scores.append(score(a, b))
                        places.append((tile, *map(int, d)))
        if not scores:
            return pd.DataFrame(columns=names)
        many = [len(x[0]) for x in scores]
        columns = [*np.repeat(np.array(places), many, axis=0).T, *(np.concatenate(c) for c in zip(*scores, strict=True))]
        return pd.DataFrame({"volume_id": r.volume_id, "channel": r.channel, **dict(zip(names[2:], columns, strict=True))})

    return resample.gathered_blocks(wanted, resample.sent(ahead, shape, shape, side_of(brick), float(radius)), kernel, brick, schema)


def shift_scores(fixed: DataFrame, moving: DataFrame, shape: Triple, brick: Triple, radius: int, tiles: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """volume_id, channel, tile_index, dz, dy, dx, n, ncc: Pearson correlation of fixed(i) with moving(i + d) over the voxels
    that are inside both volumes, for each whole shift within radius of start on each axis; by tile, or over all (tile_index 0).

    fixed, moving: bricks of one shape, paired by volume_id and channel. start: volume_id, channel, sz, sy, sx, whole numbers; nothing is
    resampled for it. Sums are about each side's mean, so bright volumes of little contrast lose no digits."""

    def ready(r, f, m):
        return f - r.fc, m - r.mc

    def score(a, b):
        return [[float(x)] for x in (len(a), a.sum(), b.sum(), a @ a, b @ b, a @ b)]

    names = [c.split()[0] for c in _SCORES.split(", ")]
    sums = _shifted(fixed, moving, shape, brick, radius, tiles, start, centres(fixed, moving), ready, score, _SCORES).groupBy(*names[:6]).agg(*[F.sum(c).alias(c) for c in _SUMS])
    spread = lambda s: F.greatest(F.col(f"s{s}{s}") - F.col(f"s{s}") * F.col(f"s{s}") / F.col("n"), F.lit(0.0))
    den = F.sqrt(spread("a") * spread("b"))
    ncc = F.when(den < 1e-12, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / den)))
    return sums.select(*names[:6], F.col("n").cast("long").alias("n"), ncc.alias("ncc"))


def shift_information(fixed: DataFrame, moving: DataFrame, shape: Triple, brick: Triple, radius: int, tiles: DataFrame | None = None, start: DataFrame | None = None, bins: int = 32) -> DataFrame:
    """shift_scores with nmi, normalised mutual information, in place of ncc: for volumes of different stains.

    Values are binned between each side's own least and greatest; the cells of a shift's joint histogram are counted brick by brick and
    merged with map-side combine, at most bins * bins rows a shift."""
    ends = lambda v, p: intensity.brick_ends(v, "minmax", ("volume_id", "channel")).toDF("volume_id", "channel", f"{p}_lo", f"{p}_hi")
    extra = stored(ends(fixed, "f").join(ends(moving.drop("mask"), "m"), ["volume_id", "channel"]), "ends")

    def ready(r, f, m):
        return metrics.bin_index(f, r.f_lo, r.f_hi, bins) * bins, metrics.bin_index(m, r.m_lo, r.m_hi, bins)

    def score(a, b):
        c = np.bincount(a + b, minlength=bins * bins)
        k = np.flatnonzero(c)
        return k // bins, k % bins, c[k]

    keys = ["volume_id", "channel", "tile_index", "dz", "dy", "dx"]
    schema = "volume_id string, channel int, tile_index int, dz int, dy int, dx int, i int, j int, c long"
    cells = _shifted(fixed, moving, shape, brick, radius, tiles, start, extra, ready, score, schema).groupBy(*keys, "i", "j").agg(F.sum("c").alias("c"))
    cells = stored(cells, "cells")
    return metrics.nmi(cells, tuple(keys)).join(cells.groupBy(*keys).agg(F.sum("c").alias("n")), keys).select(*keys, "n", "nmi")


def _best(scores: DataFrame, by: list[str], digits: int, score: str = "ncc") -> DataFrame:
    """The greatest score (rounded, so that ties are ties), then the least length, then z, y, x; still: the score of no shift."""
    s = scores.withColumn(score, F.round(score, digits))
    length = F.col("dz") * F.col("dz") + F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    best = s.groupBy(*by).agg(F.min(F.struct((-F.col(score)).alias("k"), length.alias("l"), "dz", "dy", "dx", "n")).alias("b"), F.max(F.when(length == 0, F.col(score))).alias("still"))
    return best.select(*by, "b.dz", "b.dy", "b.dx", "b.n", (-F.col("b.k")).alias(score), "still")


METRICS = {"ncc": shift_scores, "nmi": shift_information}


def search_shift(fixed: DataFrame, moving: DataFrame, shape: Triple, brick: Triple, radius: int, digits: int = 9, metric: str = "ncc", start: DataFrame | None = None) -> DataFrame:
    """volume_id, channel, dz, dy, dx, n and the metric: the best whole shift of each pair of volumes within radius of start. metric: ncc or nmi."""
    return _best(METRICS[metric](fixed, moving, shape, brick, radius, start=start), ["volume_id", "channel"], digits, metric).drop("still")


def translations(shifts: DataFrame, scale: int = 1) -> DataFrame:
    """(volume_id, channel, m, t) of whole shifts, times scale: the transforms that bring the moving volume back."""
    m = F.array(*[F.lit(float(x)) for x in resample.IDENTITY])
    return shifts.select("volume_id", "channel", m.alias("m"), F.array(*[(F.col(f"d{a}") * scale).cast("double") for a in AXES]).alias("t"))


def phase_shift(fixed: DataFrame, moving: DataFrame, shape: Triple, tile: Triple, limit: Triple) -> DataFrame:
    """volume_id, channel, dz, dy, dx, peak: whole shifts within limit by phase correlation (Kuglin and Hines 1975).

    The volumes are cut to tiles; a task correlates one tile of either, and the tiles' scores of each shift are summed, so
    that neither a volume nor its shifts meet in one task. The limit is less than half a tile."""
    cut = lambda v: resample.sent(resample.with_transforms(v, resample.IDENTITY, (0, 0, 0), None), shape, shape, tile)
    reach = [min(m, max((min(t, n) - 1) // 2, 0)) for m, t, n in zip(limit, tile, shape, strict=True)]

    def kernel(key, f: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        low = np.array(key[2:]) * tile
        high = np.minimum(low + tile, shape)
        a, b = resample.assembled(f, low, high), resample.assembled(m, low, high)
        p, q = np.fft.rfftn(a - a.mean()), np.fft.rfftn(b - b.mean())
        cross = np.conj(p) * q
        score = np.fft.irfftn(cross / np.maximum(np.abs(cross), 1e-12), a.shape) * a.size
        rows = [(*key[:2], *d, float(score[d])) for d in itertools.product(*[range(-min(r, (n - 1) // 2), min(r, (n - 1) // 2) + 1) for r, n in zip(reach, a.shape, strict=True)])]
        return pd.DataFrame(rows, columns=["volume_id", "channel", "dz", "dy", "dx", "score"])

    f, m = cut(fixed), cut(moving)
    each = f.groupBy(*resample.ON).cogroup(m.toDF(*m.columns).groupBy(*resample.ON)).applyInPandas(kernel, "volume_id string, channel int, dz int, dy int, dx int, score double")
    summed = each.groupBy("volume_id", "channel", "dz", "dy", "dx").agg(F.sum("score").alias("score"))
    voxels = float(np.prod(shape))
    return summed.groupBy("volume_id", "channel").agg(F.max(F.struct("score", "dz", "dy", "dx")).alias("b")).select("volume_id", "channel", "b.dz", "b.dy", "b.dx", (F.col("b.score") / voxels).alias("peak"))


def _offset_scores(a: np.ndarray, b: np.ndarray, steps: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How well a(i) agrees with b(i + u) for u in steps on each axis, by the phases of their cross spectrum; b's window is moved by d."""
    window = lambda by: np.einsum("i,j,k->ijk", *[np.sin(np.pi * np.clip((np.arange(k) + 0.5 - e) / k, 0, 1)) ** 2 for k, e in zip(a.shape, by, strict=True)])
    x, y = (np.fft.fftn((v - v.mean()) * window(e)) for v, e in ((a, np.zeros(3)), (b, d)))
    cross = np.conj(x) * y
    cross = cross / (np.abs(cross) + 0.003 * np.abs(cross).max() + 1e-300)  # phases, but for those of noise
    for k in a.shape:  # one axis after the other; each product puts its offsets last
        turn = np.exp(2j * np.pi * np.fft.fftfreq(k)[:, None] * steps[None, :])
        turn[np.abs(np.fft.fftfreq(k)) >= 0.5] = 0
        cross = np.tensordot(cross, turn, axes=(0, 0))
    return cross.real


def _peak(s: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The offset of the greatest score, between steps by a parabola on each axis."""
    at = np.unravel_index(s.argmax(), s.shape)
    out = []
    for axis, i in enumerate(at):
        line = s[tuple(slice(None) if k == axis else at[k] for k in range(3))]
        bend = line[i - 1] - 2 * line[i] + line[i + 1] if 0 < i < len(steps) - 1 else 0.0
        out.append(steps[i] + ((line[i - 1] - line[i + 1]) / (2 * bend) * (steps[1] - steps[0]) if bend < 0 else 0.0))
    return np.array(out)


def subvoxel(fixed: DataFrame, moving: DataFrame, shape: Triple, tile: Triple, shifts: DataFrame, fine: int = 20) -> DataFrame:
    """volume_id, channel, dz, dy, dx (double): whole shifts (volume_id, channel, dz, dy, dx) refined to parts of a voxel.

    Tiles, grown by a quarter on each side so that they overlap, and moving where its shift puts it, are windowed by cosines; the phases of
    their cross spectrum are transformed back by matrix products at offsets of 1 / fine within half a voxel (Guizar-Sicairos et al.
    2008), and the tiles' scores of each offset are summed: (fine + 1) ** 3 numbers leave a tile. A parabola through the peak decides."""
    steps = np.arange(fine + 1) / fine - 0.5
    pad = np.array([max(1, t // 4) for t in tile])
    reach, n = float(pad.max()), np.array(shape)
    start = stored(shifts.select("volume_id", "channel", *[F.col(f"d{a}").cast("int").alias(f"d{a}") for a in AXES]), "shifts")
    by = translations(start)
    f = resample.sent(resample.with_transforms(fixed.join(start.select("volume_id", "channel"), ["volume_id", "channel"]), resample.IDENTITY, (0, 0, 0), None), shape, shape, tile, reach)
    m = resample.sent(resample.with_transforms(moving, resample.IDENTITY, (0, 0, 0), by), shape, shape, tile, reach)
    known = {(r.volume_id, r.channel): np.array([r.dz, r.dy, r.dx]) for r in start.collect()}  # a row for each pair

    def kernel(key, have_f: pd.DataFrame, have_m: pd.DataFrame) -> pd.DataFrame:
        s = known[(key[0], int(key[1]))]
        low = np.array(key[2:]) * tile
        p, q = np.maximum(low - pad, np.maximum(0, -s)), np.minimum(np.minimum(low + tile, n) + pad, n - np.maximum(s, 0))
        if not len(have_f) or not len(have_m) or (q - p < 2).any():
            return pd.DataFrame({"volume_id": [], "channel": [], "i": [], "score": []})
        a, b = resample.assembled(have_f, p, q), resample.assembled(have_m, p + s, q + s)
        d = np.zeros(3)
        for _ in range(4):  # the window follows the content, else it draws the peak to 0
            score = _offset_scores(a, b, steps, d)
            d = _peak(score, steps)
        return pd.DataFrame({"volume_id": key[0], "channel": int(key[1]), "i": np.arange(score.size, dtype=np.int32), "score": score.ravel()})

    each = f.groupBy(*resample.ON).cogroup(m.toDF(*m.columns).groupBy(*resample.ON)).applyInPandas(kernel, "volume_id string, channel int, i int, score double")
    summed = stored(each.groupBy("volume_id", "channel", "i").agg(F.sum("score").alias("score")), "offsets")

    def peak(key, rows: pd.DataFrame) -> pd.DataFrame:
        """(fine + 1) ** 3 rows a pair."""
        s = np.zeros((fine + 1) ** 3)
        s[rows["i"]] = rows["score"]
        out = _peak(s.reshape((fine + 1,) * 3), steps)
        return pd.DataFrame([(key[0], int(key[1]), *(known[(key[0], int(key[1]))] + out).astype(float))], columns=["volume_id", "channel", "dz", "dy", "dx"])

    return summed.groupBy("volume_id", "channel").applyInPandas(peak, "volume_id string, channel int, dz double, dy double, dx double")


def estimate_affine(fixed: DataFrame, moving: DataFrame, shape: Triple, moving_shape: Triple, brick: Triple, levels: tuple = (2, 1), rounds: int = 20, start=None) -> tuple[np.ndarray, np.ndarray]:
    """(m, t) on indices for one volume and channel each (equal volume_id and channel): register.staged, coarse to fine, on proxies of every levels[i]-th voxel."""
    from voxelbrick.operators import register

    key = fixed.select("volume_id", "channel").first()
    m, t = start or (np.eye(3), np.zeros(3))
    for k, s in enumerate(levels):
        f, g = (v if s == 1 else stored(bricks.stride(v, (s,) * 3, n, brick), "proxy") for v, n in ((fixed, shape), (moving, moving_shape)))
        found = register.staged(f, g, register.smaller(shape, (s,) * 3), register.smaller(moving_shape, (s,) * 3), brick, {tuple(key): (m, np.asarray(t) / s)}, register.STAGES if k == 0 else register.STAGES[-1:], rounds)
        m, t = found[tuple(key)]
        t = t * s
    return m, t


def refine_tiles(tiles: DataFrame, fixed: DataFrame, moving: DataFrame, shape: Triple, brick: Triple, radius: int, least_fraction: float | None = 0.01, metric: str = "ncc") -> DataFrame:
    """A displacement for each tile by block matching: volume_id, tile_index, dz, dy, dx, skipped, reason.

    tiles: volume_id, channel, tile_index, box, foreground_fraction (from tile_foreground), and usable if it was tested. fixed, moving: bricks
    after the global map. Background tiles (below least_fraction; None: none are), unusable ones and tiles whose match is no better than no
    shift keep 0, with the reason."""
    by = ["volume_id", "channel", "tile_index"]
    usable = F.col("usable") if "usable" in tiles.columns else F.lit(True)
    dark = F.lit(False) if least_fraction is None else F.col("foreground_fraction") < least_fraction
    best = _best(METRICS[metric](fixed, moving, shape, brick, radius, tiles.where(usable & ~dark)), by, 9, metric)
    out = tiles.join(best, by, "left")
    reason = F.when(dark, "background").when(~usable, "unusable").when(F.col(metric).isNull(), "no voxels").when(F.col(metric) <= F.coalesce("still", F.lit(-2.0)), "no gain")
    out = out.withColumn("reason", reason).withColumn("skipped", F.col("reason").isNotNull())
    return out.select("volume_id", "tile_index", *[F.when(F.col("skipped"), 0).otherwise(F.col(f"d{a}")).cast("int").alias(f"d{a}") for a in AXES], "skipped", "reason")
