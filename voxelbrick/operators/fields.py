"""Displacement fields: smoothing with a halo, dense refinement by demons (Thirion 1998), and coarse fields at full resolution.

A field is a table of bricks whose data hold three float32 numbers a voxel (all dz, then all dy, then all dx): a fixed voxel
i meets moving (or globally moved) index i + d(i). It may be stored on a proxy; warp_coarse brings it to full resolution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelbrick.functions.kernels import grid, sample, samples
from voxelbrick.operators import resample
from voxelbrick.operators.bricks import _COLUMNS, AXES, Triple, _cut, _row, frame, side_of
from voxelbrick.operators.resample import IDENTITY, ON, PIECES, assembled, block_box, clamped_box, gathered, gathered_blocks, output_grid, sent, with_transforms
from voxelbrick.schema import BRICKS
from voxelbrick.sources.scratch import dropped, stored


def _stack(r) -> np.ndarray:
    return np.frombuffer(r.data, r.dtype).reshape(-1, r.nz, r.ny, r.nx)


def _brick(r, start, a: np.ndarray) -> tuple:
    """A row of BRICKS with all numbers of a voxel (a: numbers, z, y, x)."""
    return (r[0], int(r[1]), *map(int, r[2:5]), *map(int, start), *a.shape[1:], str(a.dtype), np.ascontiguousarray(a).tobytes())


def _bricks(key, at: np.ndarray, a: np.ndarray, brick: Triple, have: pd.DataFrame, reach: int) -> pd.DataFrame:
    """The bricks of a block that starts at `at` (a: numbers, z, y, x) that have pieces no farther than reach."""
    first = have[["s_z0", "s_y0", "s_x0"]].to_numpy()
    end = first + have[["s_nz", "s_ny", "s_nx"]].to_numpy()
    rows = []
    for k, low, part in _cut(key[0], key[1], at, a[0], brick):
        if ((first < np.array(low) + part.shape + reach) & (end > np.array(low) - reach)).all(axis=1).any():
            part = a[(slice(None), *[slice(p - o, p - o + w) for p, o, w in zip(low, at, part.shape, strict=True)])]
            rows.append(_brick((key[0], key[1], *k), low, part))
    return pd.DataFrame(rows, columns=_COLUMNS)


def stacked(parts: list[DataFrame]) -> DataFrame:
    """One field out of three tables of bricks (dz, dy, dx) with equal keys: a row a brick, all of its numbers together."""
    out, more = parts[0], range(1, len(parts))
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.select(*ON, F.col("data").alias(f"d{i}")), ON)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.volume_id, r.channel, r.bz, r.by, r.bx, r.z0, r.y0, r.x0, r.nz, r.ny, r.nx, "float32", b"".join(np.frombuffer(x, r.dtype).astype(np.float32).tobytes() for x in (r.data, *[getattr(r, f"d{i}") for i in more]))) for r in b.itertuples()]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return out.mapInPandas(join, BRICKS)


def blurred(a: np.ndarray, sigma: float, radius: int, axis: int) -> np.ndarray:
    """A Gaussian along one axis, edges repeated."""
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    wide = np.pad(a, [(radius, radius) if i == axis else (0, 0) for i in range(a.ndim)], mode="edge")
    n = a.shape[axis]
    return sum(k * np.take(wide, np.arange(i, i + n), axis=axis) for i, k in enumerate(w))


def _halo(sigma: float) -> int:
    return max(1, int(np.ceil(3 * sigma)))


def smoothed(have: pd.DataFrame, at, end, sigma: float, shape: Triple) -> np.ndarray:
    """The box at..end (numbers, z, y, x; float32) after a separable Gaussian, out of pieces that cover it and its halo."""
    radius = _halo(sigma)
    low, high = clamped_box(at, end, np.eye(3), np.zeros(3), float(radius), shape)
    r0 = have.iloc[0]
    a = assembled(have, low, high, len(r0["s_data"]) // (np.dtype(r0["s_dtype"]).itemsize * int(r0["s_nz"]) * int(r0["s_ny"]) * int(r0["s_nx"])))
    for axis in range(3):
        a = blurred(a, sigma, radius, axis + 1)
    return a[(slice(None), *[slice(p - q, e - q) for p, e, q in zip(at, end, low, strict=True)])].astype(np.float32)


def smooth(bricks: DataFrame, sigma: float, shape: Triple, brick: Triple) -> DataFrame:
    """bricks (any numbers a voxel) after a separable Gaussian; the volume's edge is repeated. Each block of bricks gets its own box and a halo of 3 sigma."""
    radius, side = _halo(sigma), side_of(brick)

    def kernel(key, have: pd.DataFrame) -> pd.DataFrame:
        at = np.array(key[2:]) * side
        a = smoothed(have, at, np.minimum(at + side, shape), sigma, shape)
        return _bricks(key, at, a, brick, have, radius)

    pieces = sent(with_transforms(bricks, IDENTITY, (0, 0, 0), None), shape, shape, side, float(radius))
    return pieces.groupBy(*ON).applyInPandas(kernel, BRICKS)


def sloped(fixed: DataFrame, shape: Triple, brick: Triple) -> DataFrame:
    """Bricks of four numbers a voxel: the value and its central differences along z, y, x."""
    side = side_of(brick)

    def kernel(key, have: pd.DataFrame) -> pd.DataFrame:
        at = np.array(key[2:]) * side
        end = np.minimum(at + side, shape)
        low, high = clamped_box(at, end, np.eye(3), np.zeros(3), 1.0, shape)
        a = assembled(have, low, high)
        slope = [np.gradient(a, axis=i) if a.shape[i] > 1 else np.zeros_like(a) for i in range(3)]
        out = np.stack([a, *slope])[(slice(None), *[slice(p - q, e - q) for p, e, q in zip(at, end, low, strict=True)])]
        return _bricks(key, at, out.astype(np.float32), brick, have, 1)

    return sent(with_transforms(fixed, IDENTITY, (0, 0, 0), None), shape, shape, side, 1.0).groupBy(*ON).applyInPandas(kernel, BRICKS)


_MEASURES = ("n", "sa", "sb", "saa", "sbb", "sab")
_STATE = f"{BRICKS}, far double, " + ", ".join(f"{c} double" for c in _MEASURES)


def demons(fixed: DataFrame, moving: DataFrame, shape: Triple, brick: Triple, rounds: int = 30, sigma: float = 1.5, gain: float = 1e-4, patience: int = 3) -> DataFrame:
    """The field (stored; one row a brick, see above) that brings moving onto fixed; bricks of one shape, paired by volume_id and channel, all pairs at once.

    A round: each block of bricks smooths its part of the field by a Gaussian of sigma, for which blocks exchange halos, compares itself with
    moving under it, and adds the force (f - g) grad f / (|grad f|^2 + (f - g)^2): one shuffle. Voxels that are exactly 0 on either side (its outside) neither push nor count. It stops when no pair's NCC has risen by gain for
    `patience` rounds; each pair keeps its best field, or none (zeros) if nothing was better. Means are taken off; contrasts should agree."""
    ids = ["volume_id", "channel"]
    ready = stored(sloped(fixed, shape, brick).withColumnRenamed("data", "f_data").withColumnRenamed("dtype", "f_dtype"), "sloped")
    ends = moving.sparkSession.createDataFrame(_centres(fixed, moving).collect(), "volume_id string, channel int, fc double, mc double")  # a row for each pair
    names = [c.split()[0] for c in _STATE.split(", ")]

    def kernel(want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        at, end = block_box(want)
        each = list(want.itertuples())
        size = [(r.nz, r.ny, r.nx) for r in each]
        cut = np.cumsum([0, *map(np.prod, size)])
        f = np.concatenate([np.frombuffer(r.f_data, r.f_dtype).reshape(4, -1) for r in each], axis=1).astype(float)
        d, of_field = np.zeros((3, cut[-1])), have[have["field"]]
        if len(of_field):
            a = smoothed(of_field, at, end, sigma, shape)
            d = np.concatenate([a[(slice(None), *[slice(p - o, p - o + w) for p, o, w in zip((r.z0, r.y0, r.x0), at, n, strict=True)])].reshape(3, -1) for r, n in zip(each, size, strict=True)], axis=1).astype(float)
        low, high = clamped_box(at, end, np.eye(3), np.zeros(3), float(each[0].reach), shape)
        c = np.concatenate([grid((r.z0, r.y0, r.x0), n) for r, n in zip(each, size, strict=True)], axis=1) + d
        inside = np.all((c >= 0) & (c <= np.array(shape)[:, None] - 1), axis=0)
        src = assembled(have[~have["field"]], low, high)
        g, solid = samples([src, (src != 0).astype(float)], low, shape, np.clip(c, 0, np.array(shape)[:, None] - 1))
        inside &= (solid > 0.999) & (f[0] != 0)  # 0 is what lies outside
        a, b = f[0] - each[0].fc, g - each[0].mc
        diff = (a - b) * inside
        den = (f[1:] ** 2).sum(axis=0) + diff**2
        push = np.where(den > 1e-12, diff / np.maximum(den, 1e-12), 0) * f[1:]
        d = (d + push).astype(np.float32)
        rows = []
        for r, n, i, j in zip(each, size, cut, cut[1:], strict=False):
            u, w, own = a[i:j][inside[i:j]], b[i:j][inside[i:j]], d[:, i:j].reshape(3, *n)
            row = _brick((r.volume_id, r.channel, r.bz, r.by, r.bx), (r.z0, r.y0, r.x0), own)
            rows.append((*row, float(np.abs(own).max(initial=0)), float(len(u)), u.sum(), w.sum(), u @ u, w @ w, u @ w))
        return pd.DataFrame(rows, columns=names)

    side = side_of(brick)
    still = lambda v: with_transforms(v, IDENTITY, (0, 0, 0), None)
    ready_ = ready.join(F.broadcast(ends), ids)  # ends: a row for each pair
    states, scores, since = [None], [], {}
    while len(scores) <= rounds:
        before = states[-1]
        far = 0.0 if before is None else before.agg(F.max("far")).first()[0] or 0.0
        pieces = sent(still(moving), shape, shape, side, far).withColumn("field", F.lit(False))
        if before is not None:  # the field's own pieces have the halo of its smoothing
            pieces = pieces.unionByName(sent(still(before.select(*_COLUMNS)), shape, shape, side, float(_halo(sigma))).withColumn("field", F.lit(True)))
        wanted = ready_.withColumn("reach", F.lit(far))
        now = stored(gathered_blocks(wanted, pieces, kernel, brick, _STATE), "demons")
        score = {}
        for r in now.groupBy(*ids).agg(*[F.sum(c).alias(c) for c in _MEASURES]).collect():  # a row for each pair
            a, b = max(r.saa - r.sa**2 / max(r.n, 1), 0), max(r.sbb - r.sb**2 / max(r.n, 1), 0)
            score[(r.volume_id, r.channel)] = (r.sab - r.sa * r.sb / max(r.n, 1)) / np.sqrt(a * b) if a * b > 1e-24 else 0.0
        scores.append(score)
        states.append(now)
        best = {k: max(s.get(k, -2.0) for s in scores[:-1]) if len(scores) > 1 else -2.0 for k in score}
        for k, v in score.items():
            since[k] = 0 if v > best[k] + gain else since.get(k, 0) + 1
        # A table is read again only if it may be the best of some pair: the last `patience` rounds and the best ones.
        chosen = {k: max(range(len(scores)), key=lambda i, k=k: (round(scores[i].get(k, -2.0), 9), -i)) for k in score}
        for i, t in enumerate(states[:-1]):
            if t is not None and i not in chosen.values():
                dropped(t)
                states[i] = None
        if all(v >= patience for v in since.values()):
            break
    out = None
    zero = ready.select(*_COLUMNS[:-2], F.lit("float32").alias("dtype"), F.lit(None).cast("binary").alias("data"))
    for i in sorted(set(chosen.values())):
        pairs = [k for k, v in chosen.items() if v == i]
        here = F.concat_ws("/", "volume_id", F.col("channel").cast("string")).isin([f"{v}/{c}" for v, c in pairs])
        one = _zeros(zero.where(here)) if i == 0 else smooth(states[i].select(*_COLUMNS).where(here), sigma, shape, brick)
        out = one if out is None else out.unionByName(one)
    out = stored(out, "field")
    for t in (*states, ready):
        if t is not None:
            dropped(t)
    return out


def _centres(fixed: DataFrame, moving: DataFrame) -> DataFrame:
    """volume_id, channel, fc, mc: the means of voxels other than 0, what lies outside."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r.volume_id, r.channel, float(np.count_nonzero(_stack(r))), _stack(r).sum(dtype=float)) for r in b.itertuples()], columns=["volume_id", "channel", "n", "s"])

    mean = lambda v, name: v.mapInPandas(part, "volume_id string, channel int, n double, s double").groupBy("volume_id", "channel").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1.0))).alias(name))
    return mean(fixed, "fc").join(mean(moving, "mc"), ["volume_id", "channel"])


def _zeros(keys: DataFrame) -> DataFrame:
    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_brick((r.volume_id, r.channel, r.bz, r.by, r.bx), (r.z0, r.y0, r.x0), np.zeros((3, r.nz, r.ny, r.nx), np.float32)) for r in b.itertuples()], columns=_COLUMNS)

    return keys.mapInPandas(fill, BRICKS)


_ASKS = "volume_id string, bz int, by int, bx int, z0 int, y0 int, x0 int, z1 int, y1 int, x1 int, lz int, ly int, lx int, hz int, hy int, hx int, oz int, oy int, ox int, kz int, ky int, kx int, coarse binary, m array<double>, t array<double>"


def warp_coarse(moving: DataFrame, moving_shape: Triple, field: DataFrame, steps: Triple, shape: Triple, brick: Triple, transforms: DataFrame | None = None, dtype: str = "float64", moving_brick: Triple | None = None) -> DataFrame:
    """moving resampled at m (i + d(i)) + t for each voxel i of `shape`, where d comes from a field on proxies of `steps` voxels.

    field: one channel a volume_id, for all channels of moving, in proxy voxels; between its voxels (the middles of their blocks) it is
    linear, beyond the outermost ones constant. transforms (volume_id, m, t): identity by default.
    Each output brick first gets its part of the coarse field and works out which box of moving it needs: a bound of its own, so that
    a large displacement somewhere widens no other brick's box. These requests, small rows, go to the source bricks, and pixels
    are shuffled once."""
    s = np.asarray(steps, float)
    o = (s - 1) / 2
    small = tuple(-(-n // k) for n, k in zip(shape, steps, strict=True))
    source = moving_brick or brick
    down = np.diag(1 / s)
    one = field.withColumn("channel", F.lit(0))
    pieces = sent(with_transforms(one, down.ravel(), -o / s, None), small, shape, brick, 0.0)
    if transforms is not None:
        resample.checked(transforms)
    ids = field.select("volume_id").distinct().withColumn("channel", F.lit(0))
    wanted = with_transforms(output_grid(ids, shape, brick), IDENTITY, (0, 0, 0), transforms.select("volume_id", "m", "t") if transforms is not None else None)
    names = [c.split()[0] for c in _ASKS.split(", ")]

    def displaced(coarse: np.ndarray, low, at, size) -> np.ndarray:
        """d at the voxels of a box, in full-resolution voxels (3, n), from the box of the coarse field that starts at low."""
        c = (grid(at, size) - o[:, None]) / s[:, None]
        c = np.clip(c, 0, np.array(small)[:, None] - 1)
        return np.stack([sample(x, low, small, c) * k for x, k in zip(coarse, s, strict=True)])

    def ask(r, have: pd.DataFrame) -> pd.DataFrame:
        at, end = np.array([r.z0, r.y0, r.x0]), np.array([r.z1, r.y1, r.x1])
        low, high = clamped_box(at, end, down, -o / s, 0.0, small)
        coarse = assembled(have, low, high, 3)
        m, t = np.array(r.m).reshape(3, 3), np.array(r.t)
        c = m @ (grid(at, end - at) + displaced(coarse, low, at, end - at)) + t[:, None]
        n = np.array(moving_shape)
        p, q = np.clip(np.floor(c.min(axis=1)).astype(int), 0, n - 1), np.clip(np.floor(c.max(axis=1)).astype(int) + 1, 0, n - 1) + 1
        return pd.DataFrame([(r.volume_id, r.bz, r.by, r.bx, *at, *end, *p, *q, *low, *(high - low), coarse.astype(np.float32).tobytes(), list(r.m), list(r.t))], columns=names)

    asks = stored(gathered(wanted, pieces, ask, brick, _ASKS), "asks")
    out = asks.select("volume_id", *[F.col(c) for c in ("bz", "by", "bx", "lz", "ly", "lx", "hz", "hy", "hx")])
    for a, k in zip(AXES, source, strict=True):
        out = out.withColumn(f"s{a}", F.explode(F.sequence(F.floor(F.col(f"l{a}") / k).cast("int"), F.floor((F.col(f"h{a}") - 1) / k).cast("int"))))
    box = F.struct(*[F.col(c) for c in ("bz", "by", "bx", "lz", "ly", "lx", "hz", "hy", "hx")])
    out = stored(out.groupBy("volume_id", "sz", "sy", "sx").agg(F.collect_list(box).alias("boxes")), "requests")
    met = moving.select(*_COLUMNS).join(out.withColumnsRenamed({"sz": "bz", "sy": "by", "sx": "bx"}), ["volume_id", "bz", "by", "bx"])
    piece = [c.split()[0] for c in PIECES.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                a, at, rows = _stack(r)[0], np.array([r.z0, r.y0, r.x0]), []
                for x in r.boxes:
                    p, q = np.maximum([x["lz"], x["ly"], x["lx"]], at), np.minimum([x["hz"], x["hy"], x["hx"]], at + a.shape)
                    if (p < q).all():
                        part = a[tuple(slice(i, j) for i, j in zip(p - at, q - at, strict=True))]
                        rows.append((r.volume_id, r.channel, x["bz"], x["by"], x["bx"], *map(int, p), *part.shape, r.dtype, part.tobytes()))
                yield pd.DataFrame(rows, columns=piece)

    channels = moving.select("volume_id", "channel").distinct()

    def kernel(r, have: pd.DataFrame) -> pd.DataFrame:
        at, end = np.array([r.z0, r.y0, r.x0]), np.array([r.z1, r.y1, r.x1])
        coarse = np.frombuffer(r.coarse, np.float32).reshape(3, r.kz, r.ky, r.kx).astype(float)
        m, t = np.array(r.m).reshape(3, 3), np.array(r.t)
        c = m @ (grid(at, end - at) + displaced(coarse, (r.oz, r.oy, r.ox), at, end - at)) + t[:, None]
        low = (r.lz, r.ly, r.lx)
        v = sample(assembled(have, low, (r.hz, r.hy, r.hx)), low, moving_shape, c)
        return frame([_row(r.volume_id, r.channel, (r.bz, r.by, r.bx), at, v.reshape(end - at).astype(dtype))])

    return gathered(asks.join(F.broadcast(channels), "volume_id"), met.mapInPandas(cut, PIECES), kernel, brick)  # channels: a few rows
