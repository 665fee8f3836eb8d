"""Overlapping tiles of volumes: starts, grids, schedules, maps, weights, and joins of tiles with bricks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
Triple = tuple[int, int, int]


def axis_starts(length: Column, tile: Column, overlap: Column) -> Column:
    """Starts of tiles along an axis: 0 if the tile covers it; else steps of tile - overlap, and the last that fits."""
    step, last = tile - overlap, length - tile
    steps = F.when(step > 0, step).otherwise(F.raise_error(F.lit("a tile has to be longer than its overlap")).cast("int"))
    return F.when(tile >= length, F.array(F.lit(0))).otherwise(F.array_union(F.sequence(F.lit(0), last, steps), F.array(last))).cast("array<int>")


def make_tiles(volumes: DataFrame, tile: Triple, overlap: Triple, ids: list[str], first: int | None = None) -> DataFrame:
    """Tiles of each volume (ids, nz, ny, nx; one row each): ids, tile_index from 1 in z, y, x order, and its half-open box. first: keep so many.

    A tile's number follows from its places on the axes, so that nothing is sorted; volumes are spread before they become tiles."""
    out = volumes.select(*ids, "nz", "ny", "nx").repartition(*ids)
    index = F.lit(0)
    for a, t, o in zip(AXES, tile, overlap, strict=True):
        n = F.col(f"n{a}")
        out = out.withColumn("_starts", axis_starts(n, F.least(F.lit(t), n), F.least(F.lit(o), F.greatest(n - 1, F.lit(0)))))
        out = out.withColumn(f"_many_{a}", F.size("_starts")).select("*", F.posexplode("_starts").alias(f"_place_{a}", f"{a}0")).drop("_starts")
        out = out.withColumn(f"{a}1", F.least(F.col(f"{a}0") + t, n))
        index = index * F.col(f"_many_{a}") + F.col(f"_place_{a}")
    out = out.withColumn("tile_index", (index + 1).cast("int"))
    if first:
        out = out.where(F.col("tile_index") <= first)
    return out.select(*ids, "tile_index", "z0", "z1", "y0", "y1", "x0", "x1")


def _auto_axis(length: Column, count: Column, fraction: float | None, pixels: int) -> tuple[Column, Column]:
    if fraction is not None:
        tile = F.ceil(length / (count - (count - 1) * fraction)).cast("int")
        over = F.rint(tile * fraction).cast("int")
    else:
        tile = F.ceil((length + (count - 1) * pixels) / count).cast("int")
        over = F.lit(pixels)
    over = F.greatest(F.lit(0), F.least(over, tile - 1))
    one = count <= 1
    return F.when(one, length).otherwise(F.least(tile, length)).cast("int"), F.when(one, 0).otherwise(over).cast("int")


def auto_schedule(volumes: DataFrame, tiles: int, fraction: float | None = 0.25, pixels: int = 0) -> DataFrame:
    """volumes (nz, ny, nx) with rows, cols, tile_z/y/x, over_z/y/x: the factor pair of `tiles` with rows up to its root
    whose aspect is nearest the image's (logarithms; ties: fewer rows); the depth is whole."""
    n = F.lit(tiles)
    rows = F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(n)).cast("int")), lambda r: n % r == 0)
    score = lambda r: F.struct(F.abs(F.log((n / r) / r / (F.col("nx") / F.greatest(F.col("ny"), F.lit(1))))).alias("score"), r.alias("rows"))
    out = volumes.withColumn("rows", F.array_min(F.transform(rows, score))["rows"]).withColumn("cols", (n / F.col("rows")).cast("int"))
    ty, oy = _auto_axis(F.col("ny"), F.col("rows"), fraction, pixels)
    tx, ox = _auto_axis(F.col("nx"), F.col("cols"), fraction, pixels)
    return out.withColumns({"tile_z": F.col("nz"), "tile_y": ty, "tile_x": tx, "over_z": F.lit(0), "over_y": oy, "over_x": ox})


def tile_map(tiles: DataFrame, ids: list[str]) -> DataFrame:
    """Segments of each axis: ids, axis, start, stop, and where the next one begins (band: the pixels shared with it)."""
    parts = None
    for a in AXES:
        one = tiles.select(*ids, F.lit(a).alias("axis"), F.col(f"{a}0").alias("start"), F.col(f"{a}1").alias("stop")).distinct()
        parts = one if parts is None else parts.unionByName(one)
    after = F.lead("start").over(Window.partitionBy(*ids, "axis").orderBy("start"))
    return parts.withColumn("next_start", after).withColumn("band", F.when(F.col("next_start").isNotNull(), F.greatest(F.col("stop") - F.col("next_start"), F.lit(0))))


def ramp_weight(at: Column, length: Column, overlap: Column, low: float = 1e-4) -> Column:
    """The raised-cosine weight at a position of an axis; low is the floor where there is a ramp."""
    edge = F.least(overlap, F.floor(length / 2))
    near = F.least(at, length - 1 - at)
    wave = 0.5 * (1 - F.cos(F.pi() * near / edge))
    return F.when(edge <= 0, 1.0).when(near < edge, F.greatest(wave, F.lit(low))).otherwise(1.0)


def blend_gib(volumes: DataFrame, limit: float) -> DataFrame:
    """Two float32 buffers of each volume in GiB, and whether they are within the limit."""
    gib = F.col("nz").cast("long") * F.col("ny") * F.col("nx") * 8 / float(1 << 30)
    return volumes.withColumn("blend_gib", gib).withColumn("fits", F.col("blend_gib") <= limit)


def bricks_of(boxes: DataFrame, brick: Triple, prefix: str = "") -> DataFrame:
    """A row for each brick (prefix + bz, by, bx) that a half-open box meets: the equi-join key of a box and bricks."""
    for a, s in zip(AXES, brick, strict=True):
        low, high = F.floor(F.col(f"{a}0") / s).cast("int"), F.floor((F.col(f"{a}1") - 1) / s).cast("int")
        boxes = boxes.where(F.col(f"{a}1") > F.col(f"{a}0")).withColumn(f"{prefix}b{a}", F.explode(F.sequence(low, high)))
    return boxes


def padded(tiles: DataFrame, volumes: DataFrame, ids: list[str], margin_xy: int, margin_z: int) -> DataFrame:
    """Tiles grown by margins, clipped at the volume's border: rz0 .. rx1 are what to read."""
    out = tiles.join(volumes.select(*ids, "nz", "ny", "nx"), ids)
    for a in AXES:
        m = margin_z if a == "z" else margin_xy
        out = out.withColumn(f"r{a}0", F.greatest(F.lit(0), F.col(f"{a}0") - m)).withColumn(f"r{a}1", F.least(F.col(f"n{a}"), F.col(f"{a}1") + m))
    return out.drop("nz", "ny", "nx")
