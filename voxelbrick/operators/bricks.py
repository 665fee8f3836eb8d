"""Volumes as bricks: conversion, crop, stride, conform, transpose.

Bricks have a fixed side per axis and are keyed (volume_id, channel, bz, by, bx); border bricks are smaller. Work on a
brick stays in its task; to_bricks shuffles voxels, once, by blocks of neighbouring bricks.

A missing voxel is 0. A table that must tell it from one that was given as 0 has a column mask (to_bricks with given): statistics,
similarity and the long form then leave it out; what is resampled, padded or pooled has a number for each voxel, and no mask.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelbrick.functions.kernels import given as given_
from voxelbrick.functions.kernels import masked, packed, unpacked
from voxelbrick.schema import BRICKS, KEY, MASK, VOXELS

AXES = ("z", "y", "x")
Triple = tuple[int, int, int]


def shape_of(voxels: DataFrame) -> Triple:
    """(nz, ny, nx) from the largest indices: one small aggregate."""
    r = voxels.agg(*[(F.max(a) + 1).cast("int").alias(a) for a in AXES]).first()
    return (r.z or 0, r.y or 0, r.x or 0)


def _row(volume, channel, b, start, a: np.ndarray) -> tuple:
    return (volume, int(channel), *map(int, b), *map(int, start), *a.shape, *packed(a))


_COLUMNS = [c.split()[0] for c in BRICKS.split(", ")]


def frame(rows: list[tuple], mask: bool = False) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*_COLUMNS, "mask"] if mask else _COLUMNS)


#: Bytes of pixels after which a frame of new bricks leaves its task, about.
FRAME = 1 << 23


def frames(rows: Iterable[tuple], mask: bool = False) -> Iterator[pd.DataFrame]:
    """Rows of new bricks, frame by frame: a batch may be of many more bytes than what it was made of."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[len(_COLUMNS) - 1])
        if size >= FRAME:
            yield frame(out, mask)
            out, size = [], 0
    yield frame(out, mask)


#: Bricks that a reader of Parquet decodes at once: for these few, scans of long tables take hardly longer.
ROWS = 32

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_DECODED = "spark.sql.parquet.columnarReaderBatchSize"


def _bytes(text: str) -> int:
    """The bytes of a setting such as 64MB, 8m or 1048576."""
    m = re.fullmatch(r"([0-9]+)([kmgt]?)i?b?", text.strip().lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else 0


def bounded(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to FRAME bytes. A batch of many small bricks, its copy in pandas and those of the next steps of a task
    are all held at once, by each core, and would grow with the table up to Spark's default of 64 MB each.

    Also lowers the rows that Parquet's reader decodes at once to ROWS: each core holds their pixels unpacked, and Spark's default of 4096
    bricks may be gigabytes, however small their file is."""
    had = _bytes(spark.conf.get(_BATCH))
    if not 0 < had <= FRAME:
        spark.conf.set(_BATCH, str(FRAME))
    if int(spark.conf.get(_DECODED)) > ROWS:
        spark.conf.set(_DECODED, str(ROWS))


def has_mask(bricks: DataFrame) -> bool:
    return "mask" in bricks.columns


def columns(bricks: DataFrame) -> list[str]:
    """The columns of bricks as such, with the mask if there is one."""
    return [*_COLUMNS, "mask"] if has_mask(bricks) else _COLUMNS


def _kind(mask: bool) -> str:
    return f"{BRICKS}, {MASK}" if mask else BRICKS


#: Voxels of the small bricks that one call takes together.
BLOCK = 1 << 16


def block_of(brick: Triple, shape: Triple | None = None) -> Triple:
    """How many bricks on each axis make a block of at most BLOCK voxels; large bricks are blocks of their own. shape: no block grows on an
    axis that it covers, where it would only hold what is outside the volume."""
    side, many = list(brick), [1, 1, 1]
    while 2 * np.prod(side) <= BLOCK:
        short = [i for i in range(3) if shape is None or side[i] < shape[i]]
        if not short:
            break
        i = min(short, key=side.__getitem__)
        side[i], many[i] = 2 * side[i], 2 * many[i]
    return tuple(many)


def side_of(brick: Triple, shape: Triple | None = None) -> Triple:
    """The voxels of a block on each axis."""
    return tuple(s * n for s, n in zip(brick, block_of(brick, shape), strict=True))


def by_block(brick: Triple) -> dict:
    """gz, gy, gx: the place of a brick's block, as columns."""
    return {f"g{a}": F.floor(F.col(f"b{a}") / n).cast("int") for a, n in zip(AXES, block_of(brick), strict=True)}


#: What a block's bricks are grouped by.
GROUP = ["volume_id", "channel", "gz", "gy", "gx"]


def to_bricks(voxels: DataFrame, shape: Triple, brick: Triple = (16, 16, 32), dtype: str = "float64", given: bool = False) -> DataFrame:
    """voxels (volume_id, channel, z, y, x, v) to bricks; voxels outside shape are dropped, missing ones are 0. given: with a mask of the others.

    A call costs milliseconds whatever its size, so that the voxels of a block of small bricks come in one."""
    bounded(voxels.sparkSession)
    v = voxels.select(F.col("volume_id").cast("string").alias("volume_id"), F.col("channel").cast("int").alias("channel"), *[F.col(a).cast("int").alias(a) for a in AXES], F.col("v").cast("double").alias("v"))
    side = side_of(brick, shape)
    for a, n, s in zip(AXES, shape, side, strict=True):
        v = v.where(F.col(a).between(0, n - 1)).withColumn(f"g{a}", F.floor(F.col(a) / s).cast("int"))

    def fill(key, rows: pd.DataFrame) -> pd.DataFrame:
        start = np.array([k * s for k, s in zip(key[2:], side, strict=True)])
        out = np.zeros([min(s, n - o) for s, n, o in zip(side, shape, start, strict=True)], dtype)
        there = np.zeros(out.shape, bool)
        at = tuple(rows[a].to_numpy() - o for a, o in zip(AXES, start, strict=True))
        out[at] = rows["v"].to_numpy()
        there[at] = True
        pairs = zip(_cut(key[0], key[1], start, out, brick), _cut(key[0], key[1], start, there, brick), strict=True)
        new = [(_row(key[0], key[1], k, low, part), has) for (k, low, part), (_, _, has) in pairs if has.any()]
        return frame([(*row, masked(has)) if given else row for row, has in new], given)

    return v.groupBy("volume_id", "channel", *[f"g{a}" for a in AXES]).applyInPandas(fill, _kind(given))


def to_voxels(bricks: DataFrame, zeros: bool = True) -> DataFrame:
    """The long form of bricks, of the voxels that were given where there is a mask. zeros: keep voxels that are 0."""
    mask = has_mask(bricks)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                a = unpacked(r)
                z, y, x = np.indices(a.shape)
                out = pd.DataFrame({"volume_id": r.volume_id, "channel": r.channel, "z": z.ravel() + r.z0, "y": y.ravel() + r.y0, "x": x.ravel() + r.x0, "v": a.ravel().astype(np.float64)})
                out = out[given_(r).ravel()] if mask and r.mask is not None else out
                yield out if zeros else out[out["v"] != 0]

    return bricks.mapInPandas(spread, VOXELS)


def _mapped(bricks: DataFrame, fn) -> DataFrame:
    """fn(row, array) gives rows of new bricks for one brick; it moves voxels only, and a mask as it does them."""
    mask = has_mask(bricks)

    def rows(r):
        if not mask:
            yield from fn(r, unpacked(r))
        elif r.mask is None:
            yield from ((*x, None) for x in fn(r, unpacked(r)))
        else:
            yield from ((*x, y[-1]) for x, y in zip(fn(r, unpacked(r)), fn(r, given_(r)), strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from frames((x for r in b.itertuples() for x in rows(r)), mask)

    return bricks.mapInPandas(run, _kind(mask))


def _cut(volume, channel, start: np.ndarray, a: np.ndarray, brick: Triple):
    """Pieces of an array that starts at `start` on the grid of bricks."""
    ranges = [range(int(o) // s, (int(o) + n - 1) // s + 1) if n else range(0) for o, n, s in zip(start, a.shape, brick, strict=True)]
    for b in np.ndindex(*[len(r) for r in ranges]):
        k = [r[i] for r, i in zip(ranges, b, strict=True)]
        low = [max(i * s, int(o)) for i, s, o in zip(k, brick, start, strict=True)]
        high = [min((i + 1) * s, int(o) + n) for i, s, o, n in zip(k, brick, start, a.shape, strict=True)]
        yield k, low, a[tuple(slice(p - int(o), q - int(o)) for p, q, o in zip(low, high, start, strict=True))]


def regrid(pieces: DataFrame, shape: Triple, brick: Triple) -> DataFrame:
    """Pieces (bricks keyed right, but covering parts of them) merged to whole bricks of the grid."""
    mask = has_mask(pieces)

    def merged(key, rows: pd.DataFrame) -> tuple:
        start = [k * s for k, s in zip(key, brick, strict=True)]
        out = np.zeros([min(s, n - a) for s, n, a in zip(brick, shape, start, strict=True)], rows["dtype"].iloc[0])
        there = np.zeros(out.shape, bool)
        for r in rows.itertuples():
            a = unpacked(r)
            at = tuple(slice(p - o, p - o + n) for p, o, n in zip((r.z0, r.y0, r.x0), start, a.shape, strict=True))
            out[at] = a
            if mask:
                there[at] = given_(r)
        row = _row(rows["volume_id"].iloc[0], rows["channel"].iloc[0], key, start, out)
        return (*row, masked(there)) if mask else row

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        return frame([merged(k, some) for k, some in rows.groupby(["bz", "by", "bx"], sort=False)], mask)

    return pieces.withColumns(by_block(brick)).groupBy(*GROUP).applyInPandas(merge, _kind(mask))


def on_voxels_of(bricks: DataFrame, like: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """bricks on exactly the voxels that like has by its mask, on the same grid: 0 where bricks have none.

    ids (volume_id, channel, a few rows): the same voxels for each of them, in place of like's own. Of like only keys and masks are read."""
    want = like.select(*KEY, *[c for c in _COLUMNS if c[1:] == "0" or c[0] == "n"], "mask")
    if ids is not None:
        want = want.drop("volume_id", "channel").crossJoin(F.broadcast(ids.select("volume_id", "channel").distinct()))
    have = bricks.select(*KEY, *[F.col(c).alias(f"s_{c}") for c in ("nz", "ny", "nx", "dtype", "data")])

    def one(r) -> tuple:
        out = np.zeros((r.nz, r.ny, r.nx), r.s_dtype or np.float64)
        if r.s_data is not None:
            a = np.frombuffer(r.s_data, r.s_dtype).reshape(int(r.s_nz), int(r.s_ny), int(r.s_nx))
            part = a[tuple(slice(0, n) for n in out.shape)]
            out[tuple(slice(0, n) for n in part.shape)] = part
        return (*_row(r.volume_id, r.channel, (r.bz, r.by, r.bx), (r.z0, r.y0, r.x0), out), r.mask)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from frames(map(one, b.itertuples()), True)

    return want.join(have, KEY, "left").mapInPandas(fit, _kind(True))


def crop(bricks: DataFrame, low: Triple, high: Triple, brick: Triple) -> DataFrame:
    """The half-open box low..high, indices counted from its corner. Bricks outside it are pruned before any is decoded."""
    for a, p, q in zip(AXES, low, high, strict=True):
        bricks = bricks.where((F.col(f"{a}0") < q) & (F.col(f"{a}0") + F.col(f"n{a}") > p))

    def cut(r, a):
        start = np.array([r.z0, r.y0, r.x0])
        p = np.maximum(start, low)
        part = a[tuple(slice(i - o, min(o + n, q) - o) for i, o, n, q in zip(p, start, a.shape, high, strict=True))]
        for k, at, piece in _cut(r.volume_id, r.channel, p - np.array(low), part, brick):
            yield _row(r.volume_id, r.channel, k, at, piece)

    return regrid(_mapped(bricks, cut), tuple(q - p for p, q in zip(low, high, strict=True)), brick)


def stride(bricks: DataFrame, steps: Triple, shape: Triple, brick: Triple) -> DataFrame:
    """Every steps-th voxel of each axis from index 0; sizes become ceil(n / step). Each brick starts at its own phase."""

    def pick(r, a):
        start = np.array([r.z0, r.y0, r.x0])
        phase = (-start) % np.array(steps)
        part = a[tuple(slice(p, None, s) for p, s in zip(phase, steps, strict=True))]
        for k, at, piece in _cut(r.volume_id, r.channel, (start + phase) // np.array(steps), part, brick):
            yield _row(r.volume_id, r.channel, k, at, piece)

    return regrid(_mapped(bricks, pick), tuple(-(-n // s) for n, s in zip(shape, steps, strict=True)), brick)


def pooled(bricks: DataFrame, steps: list[Triple], shape: Triple, brick: Triple) -> DataFrame:
    """Means of blocks of steps[level] voxels, float32, for each level in one scan: bricks with a column level; sizes are ceil(n / step).

    Each brick gives its share of each block's mean, so what is shuffled is 1 / (step ** 3) of the volume. Voxel i of a level is the
    middle of voxels i * step to (i + 1) * step - 1."""
    sizes = [tuple(-(-n // s) for n, s in zip(shape, by, strict=True)) for by in steps]

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                start = (r.z0, r.y0, r.x0)
                rows = []
                for level, by in enumerate(steps):
                    part, first = unpacked(r).astype(np.float64), []
                    for axis, (s, o, n) in enumerate(zip(by, start, shape, strict=True)):
                        k0, k1 = o // s, (o + part.shape[axis] - 1) // s
                        cuts = np.maximum(np.arange(k0, k1 + 1) * s - o, 0)
                        full = np.minimum(np.arange(k0 + 1, k1 + 2) * s, n) - np.arange(k0, k1 + 1) * s
                        part = np.add.reduceat(part, cuts, axis=axis) / full.reshape([-1 if i == axis else 1 for i in range(3)])
                        first.append(k0)
                    rows += [(level, *_row(r.volume_id, r.channel, k, at, piece)) for k, at, piece in _cut(r.volume_id, r.channel, np.array(first), part, brick)]
                yield pd.DataFrame(rows, columns=["level", *_COLUMNS])

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        start = [k * s for k, s in zip(key[3:], brick, strict=True)]
        out = np.zeros([min(s, n - a) for s, n, a in zip(brick, sizes[key[0]], start, strict=True)])
        for r in rows.itertuples():
            a = unpacked(r)
            out[tuple(slice(p - o, p - o + n) for p, o, n in zip((r.z0, r.y0, r.x0), start, a.shape, strict=True))] += a
        return pd.DataFrame([(int(key[0]), *_row(key[1], key[2], key[3:], start, out.astype(np.float32)))], columns=["level", *_COLUMNS])

    kind = f"level int, {BRICKS}"
    return bricks.select(*_COLUMNS).mapInPandas(shares, kind).groupBy("level", *KEY).applyInPandas(merge, kind)


def conform(bricks: DataFrame, ids: DataFrame, shape: Triple, brick: Triple, pad: float = 0.0, dtype: str = "float64") -> DataFrame:
    """Each (volume_id, channel) of ids padded or cropped at the high ends to shape; every brick of the target is there. Voxels that a mask leaves out are pad, too."""
    many = [-(-n // s) for n, s in zip(shape, brick, strict=True)]
    want = ids.select("volume_id", "channel").distinct()
    for a, n in zip(AXES, many, strict=True):
        want = want.withColumn(f"b{a}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    mask = has_mask(bricks)
    have = bricks.select(*KEY, *[F.col(c).alias(f"s_{c}") for c in ("nz", "ny", "nx", "dtype", "data", *(["mask"] if mask else []))])

    def one(r) -> tuple:
        k = (r.bz, r.by, r.bx)
        start = [i * s for i, s in zip(k, brick, strict=True)]
        size = [min(s, n - o) for s, n, o in zip(brick, shape, start, strict=True)]
        out = np.full(size, pad, dtype)
        if r.s_data is not None:
            a = np.frombuffer(r.s_data, r.s_dtype).reshape(int(r.s_nz), int(r.s_ny), int(r.s_nx))
            if mask and r.s_mask is not None:
                a = np.where(np.frombuffer(r.s_mask, bool).reshape(a.shape), a, pad)
            part = a[tuple(slice(0, n) for n in size)]
            out[tuple(slice(0, n) for n in part.shape)] = part
        return _row(r.volume_id, r.channel, k, start, out)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from frames(map(one, b.itertuples()))

    return want.join(have, KEY, "left").mapInPandas(fit, BRICKS)


def to_zyx(bricks: DataFrame, axis_order: str = "xyz") -> DataFrame:
    """Bricks of an xyz volume with their axes turned to zyx; zyx ones as they are."""
    if axis_order == "zyx":
        return bricks

    def turn(r, a):
        yield _row(r.volume_id, r.channel, (r.bx, r.by, r.bz), (r.x0, r.y0, r.z0), a.transpose(2, 1, 0))

    return _mapped(bricks, turn)


def write_bricks(bricks: DataFrame, path: str) -> None:
    """Parquet by volume and channel: readers of one channel prune the rest."""
    bricks.write.mode("overwrite").partitionBy("volume_id", "channel").parquet(path)


def read_bricks(spark, path: str) -> DataFrame:
    bounded(spark)
    return spark.read.schema(BRICKS).parquet(path)
