"""Intensity conversion, statistics and foreground: by bricks (a row never is a voxel) and, for small tables, on the long form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelbrick.functions.kernels import given, unpacked
from voxelbrick.operators import ranks
from voxelbrick.operators.bricks import _kind, _row, columns, frames, has_mask
from voxelbrick.operators.tiling import bricks_of

Triple = tuple[int, int, int]


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def percentiles(df: DataFrame, at: list[float], group: list[str], value: str = "v", approximate: bool = False) -> DataFrame:
    """group and q (array): linear between ranks, of finite values. approximate: bounded memory, for values without a small domain."""
    v = F.when(finite(F.col(value)), F.col(value))
    q = F.percentile_approx(v, at, 10_000) if approximate else F.percentile(v, F.array(*[F.lit(p) for p in at]))
    return df.groupBy(*group).agg(q.alias("q"))


def to_uint16(df: DataFrame, mode: str = "clip", group: list[str] | None = None) -> DataFrame:
    """df with v as 0..65535, half to even. clip: as it is; minmax, robust (0.1 and 99.9 percentiles): rescaled within the
    group (a volume, or a chunk of one). Not finite: 0. A group without range: 0."""
    v = F.when(finite(F.col("v").cast("double")), F.col("v").cast("double"))
    if mode == "clip":
        return df.withColumn("v", F.coalesce(F.when(v.isNotNull(), F.rint(F.greatest(F.lit(0.0), F.least(F.lit(65535.0), v)))), F.lit(0.0)).cast("int"))
    group = group or ["volume_id", "channel"]
    if mode == "minmax":
        ends = df.groupBy(*group).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    elif mode == "robust":
        ends = percentiles(df, [0.001, 0.999], group).select(*group, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    else:
        raise ValueError(f"unknown mode {mode}")
    part = (v - F.col("lo")) / (F.col("hi") - F.col("lo"))
    scaled = F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)) * 65535)
    return df.join(ends, group).withColumn("v", F.coalesce(F.when(v.isNotNull() & (F.col("hi") > F.col("lo")), scaled), F.lit(0.0)).cast("int")).drop("lo", "hi")


def robust_uint8(df: DataFrame, group: list[str]) -> DataFrame:
    """df with u8: 0.5 and 99.5 percentiles of the group to 0..255, cut down to whole numbers; their range if equal; 0 without range."""
    v = F.col("v").cast("double")
    ends = df.groupBy(*group).agg(F.percentile(F.when(finite(v), v), F.array(F.lit(0.005), F.lit(0.995))).alias("q"), F.min(F.when(finite(v), v)).alias("mn"), F.max(F.when(finite(v), v)).alias("mx"))
    flat = F.col("q")[1] <= F.col("q")[0]
    ends = ends.select(*group, F.when(flat, F.col("mn")).otherwise(F.col("q")[0]).alias("lo"), F.when(flat, F.col("mx")).otherwise(F.col("q")[1]).alias("hi"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return df.join(ends, group).withColumn("u8", F.coalesce(F.when(finite(v) & (F.col("hi") > F.col("lo")), F.floor(part * 255)), F.lit(0)).cast("int")).drop("lo", "hi")


def array_stats(df: DataFrame, group: list[str]) -> DataFrame:
    """n, finite_count, nonzero (of all, so NaN counts), p0 p1 p50 p99 p999 p100 of finite values, all_zero."""
    v = F.col("v").cast("double")
    ok = F.when(finite(v), v)
    ps = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p999": 0.999, "p100": 1.0}
    out = df.groupBy(*group).agg(F.count("*").alias("n"), F.count(ok).alias("finite_count"), F.count_if((v != 0) | F.isnan(v)).alias("nonzero"), F.percentile(ok, F.array(*[F.lit(p) for p in ps.values()])).alias("q"))
    return out.select(*group, "n", "finite_count", "nonzero", *[F.col("q")[i].alias(k) for i, k in enumerate(ps)], (F.col("nonzero") == 0).alias("all_zero"))


def downsample_stride(df: DataFrame, steps: Triple) -> DataFrame:
    """Every steps-th voxel of each axis, indices divided."""
    for a, s in zip("zyx", steps, strict=True):
        df = df.where(F.pmod(F.col(a), F.lit(s)) == 0).withColumn(a, F.floor(F.col(a) / s).cast("int"))
    return df


def background_threshold(df: DataFrame, fraction: float = 0.02, steps: Triple = (16, 16, 16), group: list[str] | None = None) -> DataFrame:
    """min + fraction * (max - min) of the finite voxels of a strided proxy."""
    v = F.col("v").cast("double")
    ok = F.when(finite(v), v)
    agg = downsample_stride(df, steps).groupBy(*(group or []))
    return agg.agg((F.min(ok) + fraction * (F.max(ok) - F.min(ok))).alias("threshold"))


def brick_sums(bricks: DataFrame, group: tuple) -> DataFrame:
    """group, n, finite_count, nonzero (of all, so NaN counts), lo, hi (of finite values, null if none) of the voxels given: a row leaves each brick."""
    kinds = {f.name: f.dataType.simpleString() for f in bricks.schema}
    names = ["n", "finite_count", "nonzero", "lo", "hi"]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                a = unpacked(r)[given(r)]
                ok = a[np.isfinite(a)]
                rows.append((*[getattr(r, g) for g in group], a.size, ok.size, int((a != 0).sum()), float(ok.min()) if ok.size else None, float(ok.max()) if ok.size else None))
            yield pd.DataFrame(rows, columns=[*group, *names])

    schema = ", ".join(f"{g} {kinds[g]}" for g in group) + ", n long, finite_count long, nonzero long, lo double, hi double"
    each = bricks.mapInPandas(part, schema)
    clean = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    return each.groupBy(*group).agg(*[F.sum(c).alias(c) for c in names[:3]], F.min(clean("lo")).alias("lo"), F.max(clean("hi")).alias("hi"))


def brick_ends(bricks: DataFrame, mode: str, group: tuple) -> DataFrame:
    """group, lo, hi of finite values: least and greatest (minmax), or the 0.1 and 99.9 percentiles (robust; exact, see ranks)."""
    if mode == "minmax":
        return brick_sums(bricks, group).where("finite_count > 0").select(*group, "lo", "hi")
    return ranks.percentiles(bricks, [0.001, 0.999], group).select(*group, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def uint16_bricks(bricks: DataFrame, mode: str = "clip", group: tuple = ("volume_id", "channel")) -> DataFrame:
    """to_uint16 for bricks, which become uint16 in their own tasks. group: key columns of bricks, bz among them for chunks of planes."""
    if mode not in ("clip", "minmax", "robust"):
        raise ValueError(f"unknown mode {mode}")
    known = bricks.withColumns({"lo": F.lit(0.0), "hi": F.lit(65535.0)}) if mode == "clip" else bricks.join(brick_ends(bricks, mode, group), list(group), "left")
    known, mask = known.select(*columns(bricks), "lo", "hi"), has_mask(bricks)

    def one(r) -> tuple:
        v = unpacked(r).astype(float)
        ok = np.isfinite(v)
        if mode != "clip":
            flat = not r.hi > r.lo
            v = np.zeros_like(v) if flat else np.clip((np.where(ok, v, r.lo) - r.lo) / (r.hi - r.lo), 0, 1) * 65535
        out = np.rint(np.clip(np.where(ok, v, 0), 0, 65535)).astype(np.uint16)
        row = _row(r.volume_id, r.channel, (r.bz, r.by, r.bx), (r.z0, r.y0, r.x0), out)
        return (*row, r.mask) if mask else row

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from frames(map(one, b.itertuples()), mask)

    return known.mapInPandas(convert, _kind(mask))


def brick_array_stats(bricks: DataFrame, group: tuple = ("volume_id", "channel")) -> DataFrame:
    """array_stats of the voxels in bricks, whose percentiles are exact for any dtype (see ranks)."""
    ps = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p999": 0.999, "p100": 1.0}
    q = ranks.percentiles(bricks, list(ps.values()), group).drop("n")
    out = brick_sums(bricks, group).join(q, list(group), "left")
    return out.select(*group, "n", "finite_count", "nonzero", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(ps)], (F.col("nonzero") == 0).alias("all_zero"))


def tiles_by_brick(tiles: DataFrame, brick: Triple) -> DataFrame:
    """[volume_id, channel,] bz, by, bx, tiles: the list of (tile_index, box) that meet a brick."""
    ids = [c for c in ("volume_id", "channel") if c in tiles.columns]
    cols = ["tile_index", *[f"{a}{e}" for a in "zyx" for e in (0, 1)]]
    return bricks_of(tiles.select(*ids, *cols), brick).groupBy(*ids, "bz", "by", "bx").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("tiles"))


TILE_STATS = "volume_id string, channel int, tile_index int, seen long, above long, finite long, nonzero long, mn double, mx double"


def with_threshold(df: DataFrame, threshold: float | DataFrame) -> DataFrame:
    """df with the column threshold: one for all, or that of its (volume_id, channel)."""
    if isinstance(threshold, DataFrame):
        return df.join(threshold.select("volume_id", "channel", "threshold"), ["volume_id", "channel"], "left")
    return df.withColumn("threshold", F.lit(float(threshold)))


def tile_stats(tiles: DataFrame, bricks: DataFrame, brick: Triple, threshold: float | DataFrame = 0.0, stride: int = 1) -> DataFrame:
    """For each tile and (volume_id, channel): seen and above (over the threshold) at a stride from the tile's corner; finite, nonzero, mn and mx of all its voxels.

    Each brick sends counts of its part of the tiles that it meets; no pixel is shuffled where the tiles are few enough to be broadcast."""
    ids = [c for c in ("volume_id", "channel") if c in tiles.columns]
    met = with_threshold(bricks.join(tiles_by_brick(tiles, brick), [*ids, "bz", "by", "bx"]), threshold)
    names = [c.split()[0] for c in TILE_STATS.split(", ")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                a = unpacked(r).astype(float)
                start = np.array([r.z0, r.y0, r.x0])
                for t in r.tiles:
                    low, high = (np.array([t[f"{x}{e}"] for x in "zyx"]) for e in (0, 1))
                    p, q = np.maximum(low, start), np.minimum(high, start + a.shape)
                    if not (p < q).all():
                        continue
                    part = a[tuple(slice(i, j) for i, j in zip(p - start, q - start, strict=True))]
                    seen = part[tuple(slice(int(i), None, stride) for i in (low - p) % stride)]
                    good = part[np.isfinite(part)]
                    rows.append((r.volume_id, r.channel, t["tile_index"], seen.size, int((seen > r.threshold).sum()), good.size, int((good != 0).sum()), good.min(initial=np.inf), good.max(initial=-np.inf)))
            yield pd.DataFrame(rows, columns=names)

    each = met.mapInPandas(count, TILE_STATS)
    return each.groupBy("volume_id", "channel", "tile_index").agg(*[F.sum(c).alias(c) for c in names[3:7]], F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def _of_tiles(tiles: DataFrame, bricks: DataFrame, stats: DataFrame) -> DataFrame:
    """Each tile for each volume, with its statistics; tiles of no brick have none."""
    ids = [c for c in ("volume_id", "channel") if c in tiles.columns]
    volumes = bricks.select("volume_id", "channel").distinct()
    every = tiles.join(volumes, ids) if ids else tiles.crossJoin(F.broadcast(volumes))  # a row for each volume and channel, no pixels
    return every.join(stats, ["volume_id", "channel", "tile_index"], "left")


def tile_foreground(tiles: DataFrame, bricks: DataFrame, brick: Triple, threshold: float | DataFrame, stride: int, least: float = 0.01) -> DataFrame:
    """threshold: one number, or (volume_id, channel, threshold). tiles for each (volume_id, channel) with foreground_fraction, the share above the threshold of voxels at a stride from
    the tile's own corner (absent ones count as 0), and output_skipped where it is below least."""
    many = F.lit(1).cast("long")
    for a in "zyx":
        many = many * F.ceil((F.col(f"{a}1") - F.col(f"{a}0")) / stride)
    out = _of_tiles(tiles, bricks, tile_stats(tiles, bricks, brick, threshold, stride).select("volume_id", "channel", "tile_index", "seen", "above"))
    out = with_threshold(out, threshold)
    zeros = F.when(F.col("threshold") < 0, many - F.coalesce("seen", F.lit(0))).otherwise(0)
    out = out.withColumn("foreground_fraction", (F.coalesce("above", F.lit(0)) + zeros) / many)
    return out.withColumn("output_skipped", F.col("foreground_fraction") < least).drop("above", "seen", "threshold")


def tile_usable(tiles: DataFrame, bricks: DataFrame, brick: Triple) -> DataFrame:
    """tiles for each (volume_id, channel) with nonzero, and usable: enough voxels that aren't 0 (at least 100 and 1e-5 of the tile) and some range."""
    n = F.lit(1).cast("long")
    for a in "zyx":
        n = n * (F.col(f"{a}1") - F.col(f"{a}0"))
    stats = tile_stats(tiles, bricks, brick).select("volume_id", "channel", "tile_index", "seen", "nonzero", "mn", "mx")
    out = _of_tiles(tiles, bricks, stats).withColumn("n", n).withColumn("nonzero", F.coalesce("nonzero", F.lit(0)))
    full = F.col("seen") == F.col("n")  # absent voxels are 0
    mn, mx = F.when(full, F.col("mn")).otherwise(F.least("mn", F.lit(0.0))), F.when(full, F.col("mx")).otherwise(F.greatest("mx", F.lit(0.0)))
    usable = (F.col("nonzero") >= F.greatest(F.lit(100), F.floor(F.col("n") * 1e-5))) & F.coalesce(mx > mn, F.lit(False))
    return out.withColumn("usable", usable).drop("mn", "mx", "seen", "n")
