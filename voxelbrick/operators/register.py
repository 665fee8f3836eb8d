"""Transforms of many pairs of volumes at once, from proxies: a shift search, then stages of ever more free parameters.

Full-resolution voxels are read once, to make the proxies (means of blocks, all levels in one scan). A round of a stage is
one job for all pairs: each brick of a fixed proxy meets the moving box that its pair's transform maps it to and sums its part of
a 14 by 14 system (9 numbers of a linear map, 3 of a shift, contrast and brightness); the driver gets one row a pair, solves for the
parameters that the stage leaves free, and damps the step (Levenberg and Marquardt) until the squared differences fall.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelbrick.functions.kernels import grid, samples, unpacked
from voxelbrick.operators import bricks as B
from voxelbrick.operators import estimate, manifest, resample
from voxelbrick.operators.bricks import AXES, Triple
from voxelbrick.sources.scratch import stored

STAGES = ("translation", "rigid", "similarity", "affine")
#: What a transform's type runs, in order; "shift" is the search alone, in whole voxels of the proxy.
KINDS = {"shift": (), **{s: STAGES[: i + 1] for i, s in enumerate(STAGES)}}
_FREE = 14
#: In voxels of the proxy: a last stage ends when a step moves nothing farther.
SETTLED = 0.01
_UPPER = np.triu_indices(_FREE)
_SUMS = [*[f"h{i}" for i in range(len(_UPPER[0]))], *[f"b{i}" for i in range(_FREE)], "cost", "n"]


def smaller(shape: Triple, steps: Triple) -> Triple:
    return tuple(-(-n // s) for n, s in zip(shape, steps, strict=True))


def to_level(m, t, steps) -> tuple[np.ndarray, np.ndarray]:
    """A transform of full-resolution indices as one of the indices of pooled proxies, whose voxel i is the middle of its block."""
    s = np.asarray(steps, float)
    o = (s - 1) / 2
    m, t = np.asarray(m, float).reshape(3, 3), np.asarray(t, float)
    return m * s[None, :] / s[:, None], (m @ o + t - o) / s


def from_level(m, t, steps) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of to_level."""
    s = np.asarray(steps, float)
    o = (s - 1) / 2
    m, t = np.asarray(m, float).reshape(3, 3), np.asarray(t, float)
    m = m * s[:, None] / s[None, :]
    return m, t * s + o - m @ o


def exponential(g: np.ndarray) -> np.ndarray:
    """The matrix exponential, by its series after halving."""
    n = max(0, int(np.ceil(np.log2(max(np.abs(g).sum(), 1e-30)))) + 4)
    out, term = np.eye(len(g)), np.eye(len(g))
    for k in range(1, 16):
        term = term @ g / 2**n / k
        out = out + term
    for _ in range(n):
        out = out @ out
    return out


def directions(stage: str, spacing: Triple = (1, 1, 1)) -> np.ndarray:
    """(14, k): what a stage may change, as directions in the 14 numbers. Rotations turn physical points; spacing is z, y, x."""
    cols = [np.eye(_FREE)[:, i] for i in range(9, _FREE)]
    if stage == "affine":
        cols += [np.eye(_FREE)[:, i] for i in range(9)]
    if stage in ("rigid", "similarity"):
        s = np.asarray(spacing, float)
        for a, b in ((1, 2), (0, 2), (0, 1)):
            w = np.zeros((3, 3))
            w[a, b], w[b, a] = s[b] / s[a], -s[a] / s[b]
            cols.append(np.concatenate([w.ravel(), np.zeros(5)]))
    if stage == "similarity":
        cols.append(np.concatenate([np.eye(3).ravel(), np.zeros(5)]))
    return np.stack(cols, axis=1)


@dataclass
class Fit:
    """The state of one pair: the best transform so far with its system, and the one on trial."""

    m: np.ndarray
    t: np.ndarray
    gain: float = 1.0
    bias: float = 0.0
    stage: int = 0
    damping: float = 1e-3
    trial: tuple = ()
    best: tuple = ()
    rounds: int = 0
    moved: float = np.inf
    done: bool = field(default=False)

    def seen(self, h: np.ndarray, b: np.ndarray, cost: float, n: float, stages: tuple, centre: np.ndarray, radius: float, spacing: Triple, least: float, most: int) -> None:
        """Takes the sums of the transform on trial, keeps or drops it, and sets the next trial. least: voxels below which an overlap doesn't count."""
        self.rounds += 1
        mean = cost / n if n > least else np.inf
        # No voxel has moved by more than this: the stage is over.
        settled = self.moved < (SETTLED if self.stage == len(stages) - 1 else 5 * SETTLED)
        if not self.best or mean < self.best[0]:
            self.m, self.t, self.gain, self.bias = self.trial
            self.best = (mean, h, b)
            self.damping = max(self.damping / 10, 1e-9)
        else:
            self.damping *= 10
        if not np.isfinite(self.best[0]):
            self.done = True
            return
        if settled or self.damping > 1e3 or self.rounds >= most:
            self.stage, self.damping, self.rounds = self.stage + 1, 1e-3, 0
            if self.stage >= len(stages):
                self.done = True
                return
        d = directions(stages[self.stage], spacing)
        h, b = d.T @ self.best[1] @ d, d.T @ self.best[2]
        scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
        h = h / scale[:, None] / scale[None, :] + self.damping * np.eye(len(h))
        step = d @ (np.linalg.lstsq(h, b / scale, rcond=1e-12)[0] / scale)
        g = step[:9].reshape(3, 3) / radius
        self.moved = float(np.abs(g).sum(axis=1).max() * radius + np.abs(step[9:12]).max())
        e = np.eye(3) + g if stages[self.stage] == "affine" else exponential(g)
        if abs(np.linalg.det(e)) < 0.1:  # no step turns a volume inside out
            e = np.eye(3)
        self.trial = (e @ self.m, e @ (self.t - centre) + centre + step[9:12], self.gain + step[12], self.bias + step[13])


def staged(fixed: DataFrame, moving: DataFrame, shape: Triple, moving_shape: Triple, brick: Triple, start: dict, stages: tuple = STAGES, rounds: int = 20, spacing: Triple = (1, 1, 1)) -> dict:
    """{(volume_id, channel): (m, t)} of the pairs in start, the same with which to begin. fixed, moving: stored bricks, paired by volume_id and channel.

    A pair whose volumes share fewer than a tenth of the fixed voxels under its start stays at it."""
    centre, radius = (np.array(moving_shape) - 1) / 2, max(max(moving_shape) / 2, 1.0)
    fits = {k: Fit(np.asarray(m, float).reshape(3, 3), np.asarray(t, float)) for k, (m, t) in start.items()}
    for f in fits.values():
        f.trial = (f.m, f.t, f.gain, f.bias)
    spark, least = fixed.sparkSession, 0.1 * float(np.prod(shape))
    # Values are taken about their means, so that contrast and brightness don't look alike.
    means = {(r.volume_id, r.channel): (r.fc, r.mc) for r in estimate.centres(fixed, moving).collect()}  # a row for each pair
    fits = {k: f for k, f in fits.items() if k in means}
    n = tuple(int(x) for x in moving_shape)

    def kernel(want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        r = next(want.itertuples())  # what is the pair's own
        mat, off = np.array(r.m).reshape(3, 3), np.array(r.t)
        low, high = resample.clamped_box(*resample.block_box(want), mat, off, 2.0, n)
        src = resample.assembled(have, low, high)
        at = np.concatenate([grid((b.z0, b.y0, b.x0), (b.nz, b.ny, b.nx)) for b in want.itertuples()], axis=1)
        f = np.concatenate([unpacked(b).ravel().astype(float) for b in want.itertuples()])
        c = mat @ at + off[:, None]
        ok = np.all((c >= 0) & (c <= np.array(n)[:, None] - 1), axis=0)
        c = c[:, ok]
        slope = [np.gradient(src, axis=a) if src.shape[a] > 1 else np.zeros_like(src) for a in range(3)]
        v, *e = samples([src, *slope], low, n, c)
        v, e = v - r.mc, r.gain * np.stack(e)
        d = f[ok] - r.fc - r.gain * v - r.bias
        y = (c - centre[:, None]) / radius
        j = np.concatenate([(e[:, None, :] * y[None, :, :]).reshape(9, -1), e, v[None], np.ones((1, len(v)))])
        return pd.DataFrame([(r.volume_id, r.channel, *(j @ j.T)[_UPPER], *(j @ d), d @ d, float(len(d)))], columns=["volume_id", "channel", *_SUMS])

    schema = "volume_id string, channel int, " + ", ".join(f"{c} double" for c in _SUMS)
    while open_ := {k: f for k, f in fits.items() if not f.done and stages}:
        rows = [(*k, f.trial[0].ravel().tolist(), f.trial[1].tolist(), float(f.trial[2]), float(f.trial[3]), *map(float, means[k])) for k, f in open_.items()]
        trial = spark.createDataFrame(rows, "volume_id string, channel int, m array<double>, t array<double>, gain double, bias double, fc double, mc double")
        pieces = resample.sent(resample.with_transforms(moving, resample.IDENTITY, (0, 0, 0), trial), moving_shape, shape, B.side_of(brick), 2.0)
        got = resample.gathered_blocks(fixed.join(F.broadcast(trial), ["volume_id", "channel"]), pieces, kernel, brick, schema)
        got = got.groupBy("volume_id", "channel").agg(*[F.sum(c).alias(c) for c in _SUMS]).collect()  # a row for each pair
        sums = {(r.volume_id, r.channel): np.array([r[c] for c in _SUMS]) for r in got}
        for k, f in open_.items():
            s = sums.get(k)
            if s is None:
                f.done = True
                continue
            h = np.zeros((_FREE, _FREE))
            h[_UPPER] = s[: len(_UPPER[0])]
            f.seen(h + np.triu(h, 1).T, s[len(_UPPER[0]) : -2], s[-2], s[-1], stages, centre, radius, spacing, least, rounds)
    return {k: (np.asarray(m, float).reshape(3, 3), np.asarray(t, float)) for k, (m, t) in start.items()} | {k: (f.m, f.t) for k, f in fits.items()}


TRANSFORMS = "volume_id string, channel int, m array<double>, t array<double>, type string, downsample string"


def pending(pairs: DataFrame, kind: str, steps: Triple, saved: DataFrame | None, force: bool) -> tuple[DataFrame, DataFrame | None]:
    """(pairs left to estimate, saved rows to reuse): rows of saved with the same type and downsample cover theirs, unless force."""
    by = "x".join(map(str, steps))
    named = pairs.select("volume_id", "channel", F.concat_ws("/", "volume_id", F.col("channel").cast("string")).alias("pair_id"), F.lit(kind).alias("type"), F.lit(by).alias("downsample"))
    if saved is None:
        return named.select("volume_id", "channel"), None
    had = saved.withColumn("pair_id", F.concat_ws("/", "volume_id", F.col("channel").cast("string")))
    left = manifest.pending_work(named, had, force).select("volume_id", "channel")
    kept = manifest.reusable_work(had, named).select(*[c.split()[0] for c in TRANSFORMS.split(", ")])
    return left, kept.where("false") if force else kept


def register(
    fixed: DataFrame, moving: DataFrame, shape: Triple, brick: Triple, kind: str = "affine", steps: Triple = (16, 16, 16), levels: tuple = (2, 1), radius: int = 3, metric: str = "ncc",
    spacing: Triple = (1, 1, 1), shared: bool = False, saved: DataFrame | None = None, force: bool = False,
) -> DataFrame:
    """volume_id, channel, m, t, type, downsample, stored: the transform of each volume of moving, on full-resolution indices.

    fixed, moving: bricks of one shape, paired by volume_id and channel; shared: fixed is one volume and channel, for all. kind: a key of
    KINDS. A search of whole shifts (by metric, within radius of what the moments suggest) on the coarsest proxy, then kind's stages on
    proxies of every levels[i] * steps voxels, coarse to fine. saved: rows of earlier runs; those of the same type and downsample are kept
    and their pairs not estimated again, unless force. Only pixels of the pairs that are left are read."""
    ids, kept = pending(moving.select("volume_id", "channel").distinct(), kind, steps, saved, force)
    ids = stored(ids, "pending")
    todo = ids.collect()  # a row for each pair
    spark = moving.sparkSession
    if not todo:
        return stored(kept, "transforms") if kept is not None else spark.createDataFrame([], TRANSFORMS)
    by = [tuple(int(s) * k for s in steps) for k in (levels if KINDS[kind] else (1,))]
    some = moving.join(F.broadcast(ids), ["volume_id", "channel"])  # a row for each pair
    proxies = []
    for side, one in (("fixed", fixed if shared else fixed.join(F.broadcast(ids), ["volume_id", "channel"])), ("moving", some)):
        if by == [(1, 1, 1)]:
            levels_ = [one]
        else:
            all_ = stored(B.pooled(one, by, shape, brick), f"{side}-proxies")
            levels_ = [all_.where(F.col("level") == i).drop("level") for i in range(len(by))]
        if side == "fixed" and shared:
            levels_ = [v.drop("volume_id", "channel").crossJoin(F.broadcast(ids)).select(*B.columns(v)) for v in levels_]  # proxies only
        proxies.append(levels_)
    small = smaller(shape, by[0])
    found = find_translation(proxies[0][0], proxies[1][0], small, brick, radius, metric)
    rows = {(r.volume_id, r.channel): from_level(np.eye(3), (r.dz, r.dy, r.dx), by[0]) for r in found.collect()}
    for k, step in enumerate(by if KINDS[kind] else ()):
        size = smaller(shape, step)
        # Stages with fewer parameters only matter on the coarsest level.
        stages = KINDS[kind] if k == 0 else KINDS[kind][-1:]
        at = {p: to_level(m, t, step) for p, (m, t) in rows.items()}
        rows = {p: from_level(m, t, step) for p, (m, t) in staged(proxies[0][k], proxies[1][k], size, size, brick, at, stages, spacing=spacing).items()}
    out = spark.createDataFrame([(*p, m.ravel().tolist(), t.tolist(), kind, "x".join(map(str, steps))) for p, (m, t) in rows.items()], TRANSFORMS)
    return stored(out if kept is None else out.unionByName(kept), "transforms")


def find_translation(fixed: DataFrame, moving: DataFrame, shape: Triple, brick: Triple, radius: int, metric: str = "ncc") -> DataFrame:
    """volume_id, channel, dz, dy, dx, n and the metric, stored: moments give a start in whole voxels, a search within radius around it decides. Nothing is resampled."""
    on = ["volume_id", "channel"]
    f, m = (estimate.brick_moments(v) for v in (fixed, moving))
    start = f.select(*on, *[F.col(f"c{a}").alias(f"f{a}") for a in AXES]).join(m.select(*on, *[F.col(f"c{a}").alias(f"m{a}") for a in AXES]), on)
    start = stored(start.select(*on, *[F.coalesce(F.rint(F.col(f"m{a}") - F.col(f"f{a}")), F.lit(0.0)).cast("int").alias(f"s{a}") for a in AXES]), "start")
    return stored(estimate.search_shift(fixed, moving, shape, brick, radius, metric=metric, start=start), "translation")
