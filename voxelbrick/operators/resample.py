"""Resampling by one gather: each source brick sends every output brick the part of it that this one's mapped box touches.

A transform maps fixed indices to moving indices: moving = m . fixed + t (m row-major, z, y, x). Which output bricks a
source brick serves is closed-form arithmetic on its box, so nothing is joined to find out: the pixels are shuffled once,
in their own dtype, each brick with the halo that interpolation needs. No long form is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelbrick.functions.kernels import box_weights, grid, sample, sample_box
from voxelbrick.operators.bricks import AXES, BLOCK, GROUP, Triple, _row, block_of, by_block, frame  # noqa: F401
from voxelbrick.operators.tiling import bricks_of
from voxelbrick.schema import BRICKS

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def index_affine(m_xyz, t_xyz, fixed: dict, moving: dict) -> tuple[tuple, tuple]:
    """(m, t) on z, y, x indices of a map of physical x, y, z points; fixed and moving: spacing, origin, direction (row-major)."""

    def to_point(g: dict) -> tuple[np.ndarray, np.ndarray]:
        d = np.array(g.get("direction", IDENTITY)).reshape(3, 3) * np.array(g["spacing"])[None, :]
        return d, np.array(g.get("origin", (0, 0, 0)), float)

    f, fo = to_point(fixed)
    g, go = to_point(moving)
    a, b = np.array(m_xyz, float).reshape(3, 3), np.array(t_xyz, float)
    inv = np.linalg.inv(g)
    m, t = inv @ a @ f, inv @ (a @ fo + b - go)
    return tuple(m[::-1, ::-1].ravel()), tuple(t[::-1])


def output_grid(ids: DataFrame, shape: Triple, brick: Triple) -> DataFrame:
    """A row for each brick of the output of each (volume_id, channel): bz, by, bx and its half-open box."""
    out = ids.select("volume_id", "channel").distinct()
    for a, n, s in zip(AXES, shape, brick, strict=True):
        out = out.withColumn(f"b{a}", F.explode(F.sequence(F.lit(0), F.lit(-(-n // s) - 1))))
        out = out.withColumn(f"{a}0", F.col(f"b{a}") * s).withColumn(f"{a}1", F.least(F.col(f"{a}0") + s, F.lit(n)))
    return out


def mapped_box(low, high, m: np.ndarray, t: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The half-open box, unclamped, of source voxels that linear interpolation needs for output voxels of the box low..high.

    An affine image of a box is bounded axis by axis by the sums of the lesser and of the greater products. reach: a bound
    on what is added to an output index, along each axis, before it is mapped."""
    p, q = m * (np.asarray(low, float) - reach), m * (np.asarray(high, float) - 1 + reach)
    return np.floor(t + np.minimum(p, q).sum(axis=1) - 1e-9).astype(int), np.floor(t + np.maximum(p, q).sum(axis=1) + 1e-9).astype(int) + 2


def _clamped(low: np.ndarray, high: np.ndarray, shape) -> tuple[np.ndarray, np.ndarray]:
    """The box inside the volume; a box beside it becomes the voxels at the edge."""
    n = np.asarray(shape)
    return np.clip(low, 0, n - 1), np.clip(high - 1, 0, n - 1) + 1


def clamped_box(low, high, m: np.ndarray, t: np.ndarray, reach: float, shape) -> tuple[np.ndarray, np.ndarray]:
    """What sent() gives an output box: its mapped box inside the source volume."""
    return _clamped(*mapped_box(low, high, m, t, reach), shape)


PIECES = "volume_id string, channel int, bz int, by int, bx int, s_z0 int, s_y0 int, s_x0 int, s_nz int, s_ny int, s_nx int, s_dtype string, s_data binary"


def checked(transforms: DataFrame) -> DataFrame:
    """transforms, or an error naming one that can't be inverted: found out here, not in a task."""
    e = lambda i, j: F.get("m", F.lit(3 * i + j))
    det = sum((e(0, i) * (e(1, (i + 1) % 3) * e(2, (i + 2) % 3) - e(1, (i + 2) % 3) * e(2, (i + 1) % 3)) for i in range(3)), F.lit(0.0))
    bad = transforms.where(F.coalesce(F.isnan(det) | (F.abs(det) < 1e-12) | (F.size("m") != 9) | (F.size("t") != 3), F.lit(True))).take(1)
    if bad:
        raise ValueError(f"a transform that can't be inverted: {bad[0].asDict()}")
    return transforms


def with_transforms(df: DataFrame, m, t, transforms: DataFrame | None) -> DataFrame:
    """df with m array<double> and t array<double>: its own of (volume_id[, channel]) in transforms, else the given one."""
    same = df.withColumns({"m": F.array(*[F.lit(float(x)) for x in m]), "t": F.array(*[F.lit(float(x)) for x in t])})
    if transforms is None:
        return same
    on = [c for c in ("volume_id", "channel") if c in transforms.columns]
    return df.join(F.broadcast(transforms.select(*on, "m", "t")), on)  # a row for each volume and channel, so that no pixel is shuffled for it


def sent(moving: DataFrame, moving_shape: Triple, shape: Triple, brick: Triple, reach: float = 0.0) -> DataFrame:
    """moving (bricks with m, t; any grid) cut to pieces for the output bricks that ask for them, keyed by these.

    Bricks may hold several numbers a voxel, all of one after all of the other (a field's three): they travel as one piece.
    The output voxels that a source brick can serve lie in the box of its corners, one voxel farther out for the clamped
    edge, mapped backwards; each output brick in it gets the part inside its own mapped box."""
    many = [-(-n // s) for n, s in zip(shape, brick, strict=True)]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                m, t = np.array(r.m, float).reshape(3, 3), np.array(r.t, float)
                a = np.frombuffer(r.data, r.dtype).reshape(-1, r.nz, r.ny, r.nx)
                start = np.array([r.z0, r.y0, r.x0])
                end = start + np.array(a.shape[1:])
                back = np.linalg.inv(m)
                p, q = back * (start - 1 - t), back * (end - t)
                first = np.floor((np.minimum(p, q).sum(axis=1) - reach - 1) / brick).astype(int)
                last = np.floor((np.maximum(p, q).sum(axis=1) + reach + 1) / brick).astype(int)
                first, last = np.maximum(first, 0), np.minimum(last, np.array(many) - 1)
                for k in np.ndindex(*np.maximum(last - first + 1, 0)):
                    k = first + k
                    low = k * brick
                    low, high = clamped_box(low, np.minimum(low + brick, shape), m, t, reach, moving_shape)
                    low, high = np.maximum(low, start), np.minimum(high, end)
                    if (low < high).all():
                        part = a[(slice(None), *[slice(i, j) for i, j in zip(low - start, high - start, strict=True)])]
                        out.append((r.volume_id, r.channel, *map(int, k), *map(int, low), *part.shape[1:], r.dtype, part.tobytes()))
                    if len(out) >= 64:
                        yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
                        out = []
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return moving.select("volume_id", "channel", "z0", "y0", "x0", "nz", "ny", "nx", "dtype", "data", "m", "t").mapInPandas(cut, PIECES)


def assembled(pieces: pd.DataFrame, low, high, numbers: int | None = None) -> np.ndarray:
    """The box low..high out of pieces; what none of them has is 0. numbers: those of a voxel, then the first axis of the result."""
    out = np.zeros([numbers or 1, *[q - p for p, q in zip(low, high, strict=True)]])
    for r in pieces.itertuples():
        a = np.frombuffer(r.s_data, r.s_dtype).reshape(-1, r.s_nz, r.s_ny, r.s_nx)
        o = (r.s_z0, r.s_y0, r.s_x0)
        p = [max(i, j) for i, j in zip(o, low, strict=True)]
        q = [min(i + n, j) for i, n, j in zip(o, a.shape[1:], high, strict=True)]
        if all(i < j for i, j in zip(p, q, strict=True)):
            out[(slice(None), *[slice(i - k, j - k) for i, j, k in zip(p, q, low, strict=True)])] = a[(slice(None), *[slice(i - k, j - k) for i, j, k in zip(p, q, o, strict=True)])]
    return out if numbers else out[0]


ON = ["volume_id", "channel", "bz", "by", "bx"]


def gathered(wanted: DataFrame, pieces: DataFrame, kernel, brick: Triple, schema: str = BRICKS, total: tuple | None = None) -> DataFrame:
    """kernel(row of wanted, pieces) -> DataFrame for each output brick in wanted, pieces or not; a brick beside wanted isn't made.

    A call costs milliseconds whatever its size, so that neighbouring small bricks, a block of them, come in one; each still gets its own
    row and pieces. total: columns of the kernel that are summed over a block, to one row; the others are the volume's own."""
    names = [c.split()[0] for c in schema.split(", ")]
    place = ["bz", "by", "bx"]
    block = by_block(brick)

    def run(key, want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        of, none = dict(list(have.groupby(place, sort=False))), have.iloc[:0]
        out = [x for x in (kernel(r, of.get((r.bz, r.by, r.bx), none)) for r in want.itertuples()) if len(x)]
        if not out:
            return pd.DataFrame(columns=names)
        if total:
            sums = dict(zip(total, sum(x[list(total)].to_numpy(float).sum(axis=0) for x in out), strict=True))
            return pd.DataFrame([{c: sums[c] if c in sums else out[0][c].iloc[0] for c in names}])
        return pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]

    return wanted.withColumns(block).groupBy(*GROUP).cogroup(pieces.toDF(*pieces.columns).withColumns(block).groupBy(*GROUP)).applyInPandas(run, schema)


def gathered_blocks(wanted: DataFrame, pieces: DataFrame, kernel, brick: Triple, schema: str) -> DataFrame:
    """kernel(rows of wanted, pieces) -> DataFrame for each block with bricks in wanted. pieces: those that sent() makes for blocks, of
    side_of(brick), so that neighbouring small bricks share one box and its halo."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        return kernel(want, have) if len(want) else pd.DataFrame(columns=names)

    return wanted.withColumns(by_block(brick)).groupBy(*GROUP).cogroup(pieces.toDF(*pieces.columns).groupBy(*ON)).applyInPandas(run, schema)


def block_box(want: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The half-open box of rows of bricks, of one block."""
    start = want[["z0", "y0", "x0"]].to_numpy()
    return start.min(axis=0), (start + want[["nz", "ny", "nx"]].to_numpy()).max(axis=0)


def downsample_linear(moving: DataFrame, shape: Triple, brick: Triple, factor: float) -> DataFrame:
    """Every volume at factor times its spacing, on round(n / factor) voxels an axis from the same origin; as it is for factors up to 1."""
    if factor <= 1:
        return moving
    return warp(moving, shape, tuple(max(1, round(n / factor)) for n in shape), brick, tuple(factor * x for x in IDENTITY))


def _extent(boxes: DataFrame) -> Triple:
    """The size of a grid of boxes: one small aggregate."""
    r = boxes.agg(*[F.max(f"{a}1").alias(a) for a in AXES]).first()
    return (r.z or 0, r.y or 0, r.x or 0)


def _place(r) -> tuple[np.ndarray, np.ndarray]:
    start = np.array([r.z0, r.y0, r.x0])
    return start, np.array([r.z1, r.y1, r.x1]) - start


def warp(moving: DataFrame, moving_shape: Triple, shape: Triple, brick: Triple, m=IDENTITY, t=(0.0, 0.0, 0.0), mode: str = "linear", dtype: str = "float64", transforms: DataFrame | None = None) -> DataFrame:
    """Every (volume_id, channel) of moving resampled onto a grid of `shape`; outside the moving volume 0. mode: linear or nearest.

    transforms (volume_id[, channel], m, t): each volume by its own; one without a row isn't made, one that is singular is an error."""
    if transforms is not None:
        checked(transforms)
    elif abs(np.linalg.det(np.array(m, float).reshape(3, 3))) < 1e-12:
        raise ValueError(f"a transform that can't be inverted: {m}")
    wanted = with_transforms(output_grid(moving, shape, brick), m, t, transforms)
    pieces = sent(with_transforms(moving, m, t, transforms), moving_shape, shape, brick)

    def kernel(r, have: pd.DataFrame) -> pd.DataFrame:
        start, size = _place(r)
        mat, off = np.array(r.m).reshape(3, 3), np.array(r.t)
        low, high = clamped_box(start, start + size, mat, off, 0.0, moving_shape)
        v = sample_box(assembled(have, low, high), low, moving_shape, mat, off, start, size, mode)
        return frame([_row(r.volume_id, r.channel, (r.bz, r.by, r.bx), start, v.reshape(size).astype(dtype))])

    return gathered(wanted, pieces, kernel, brick)


def warp_field(moving: DataFrame, moving_shape: Triple, field: DataFrame, brick: Triple, reach: float, dtype: str = "float64") -> DataFrame:
    """Resampling by a displacement for each voxel: moving index = fixed index + d.

    field: bricks of the output grid with channels 0, 1, 2 for dz, dy, dx; its volume_id is that of moving. reach: a
    bound on |d| along each axis, so that a brick asks for its own box grown by it."""
    part = lambda c: field.where(F.col("channel") == c).select("volume_id", "bz", "by", "bx", *([F.col(k) for k in ("z0", "y0", "x0", "nz", "ny", "nx")] if c == 0 else []), F.col("data").alias(f"d{c}"), F.col("dtype").alias(f"t{c}"))
    on = ["volume_id", "bz", "by", "bx"]
    wanted = part(0).join(part(1), on).join(part(2), on).withColumns({f"{a}1": F.col(f"{a}0") + F.col(f"n{a}") for a in AXES}).drop("nz", "ny", "nx")
    wanted = wanted.join(moving.select("volume_id", "channel").distinct(), "volume_id")
    pieces = sent(with_transforms(moving, IDENTITY, (0, 0, 0), None), moving_shape, _extent(wanted), brick, reach)

    def kernel(r, have: pd.DataFrame) -> pd.DataFrame:
        start, size = _place(r)
        d = np.stack([np.frombuffer(getattr(r, f"d{c}"), getattr(r, f"t{c}")).astype(float) for c in range(3)])
        if np.abs(d).max(initial=0) > reach:
            raise ValueError("a displacement is beyond reach")
        low, high = clamped_box(start, start + size, np.eye(3), np.zeros(3), reach, moving_shape)
        v = sample(assembled(have, low, high), low, moving_shape, grid(start, size) + d)
        return frame([_row(r.volume_id, r.channel, (r.bz, r.by, r.bx), start, v.reshape(size).astype(dtype))])

    return gathered(wanted, pieces, kernel, brick)


def tiled_apply(moving: DataFrame, moving_shape: Triple, tiles: DataFrame, shape: Triple, brick: Triple, overlap: Triple, m=IDENTITY, t=(0.0, 0.0, 0.0), mode: str = "two_pass", eps: float | None = 1e-6, dtype: str = "float64", transforms: DataFrame | None = None, reach: float | None = None) -> DataFrame:
    """Global affine, then each tile's own displacement, blended by raised-cosine weights, in one gather.

    tiles: [volume_id,] tile_index, box, dz, dy, dx (added to the fixed index before the global map). Each output brick takes, for
    each tile that meets it, its part of the tile times the tile's weights, and divides by the weights' sum (at least eps;
    None: the plain sum). two_pass: as resampling twice, the tile is first made by the global map inside its own box and
    then moved, 0 coming in from outside; composed: one interpolation. Voxels of no tile are 0. reach: a bound on the
    displacements; by default the greatest of them, one small aggregate.

    Tiles (a small table) meet output bricks on the bricks that they cover; a brick asks once for all its tiles, and the blend
    needs no further shuffle."""
    if reach is None:
        reach = float(tiles.agg(F.max(F.greatest(*[F.abs(F.col(f"d{a}").cast("double")) for a in AXES]))).first()[0] or 0.0)
    ids = [c for c in ("volume_id",) if c in tiles.columns]
    cols = ["tile_index", *[f"{a}{e}" for a in AXES for e in (0, 1)], *[f"d{a}" for a in AXES]]
    boxes = tiles.select(*ids, "tile_index", *[F.col(f"{a}{e}").cast("int").alias(f"{a}{e}") for a in AXES for e in (0, 1)], *[F.col(f"d{a}").cast("double").alias(f"d{a}") for a in AXES])
    per = bricks_of(boxes, brick).groupBy(*ids, "bz", "by", "bx").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("tiles"))
    wanted = with_transforms(output_grid(moving, shape, brick), m, t, transforms).join(per, [*ids, "bz", "by", "bx"], "left")
    # In two passes the first one's box may go a voxel beyond the displacement.
    pieces = sent(with_transforms(moving, m, t, transforms), moving_shape, shape, brick, reach + 1)

    def kernel(r, have: pd.DataFrame) -> pd.DataFrame:
        start, size = _place(r)
        mat, off = np.array(r.m).reshape(3, 3), np.array(r.t)
        low, high = clamped_box(start, start + size, mat, off, reach + 1, moving_shape)
        src = assembled(have, low, high)
        total, weight = np.zeros(size), np.zeros(size)
        for tile in r.tiles if r.tiles is not None else []:
            tile0, tile1 = (np.array([tile[f"{a}{e}"] for a in AXES]) for e in (0, 1))
            p, q = np.maximum(start, tile0), np.minimum(start + size, tile1)
            d = np.array([tile[f"d{a}"] for a in AXES])
            if mode == "composed":
                v = sample_box(src, low, moving_shape, mat, mat @ d + off, p, q - p)
            else:
                b0 = np.clip(np.floor(p + d).astype(int), tile0, tile1 - 1)
                b1 = np.clip(np.floor(q - 1 + d).astype(int) + 2, b0 + 1, tile1)
                first = sample_box(src, low, moving_shape, mat, off, b0, b1 - b0)
                v = sample_box(first, b0 - tile0, tile1 - tile0, np.eye(3), d - tile0, p, q - p)
            w = box_weights(tile1 - tile0, overlap)[tuple(slice(i, j) for i, j in zip(p - tile0, q - tile0, strict=True))]
            at = tuple(slice(i, j) for i, j in zip(p - start, q - start, strict=True))
            total[at] += v * w
            weight[at] += w
        out = np.where(weight > 0, total / (np.maximum(weight, eps) if eps is not None else np.where(weight > 0, weight, 1)), 0)
        return frame([_row(r.volume_id, r.channel, (r.bz, r.by, r.bx), start, out.astype(dtype))])

    return gathered(wanted, pieces, kernel, brick)
