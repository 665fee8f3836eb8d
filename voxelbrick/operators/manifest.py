"""Channel numbering, regions, manifests, resumption and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the long name of a transform type that has a short one.
ALIAS = {"QuickSyN": "antsRegistrationSyNQuick[s]"}


def pack_channels(df: DataFrame, ids: list[str], offset: str, prefix: str = "out") -> DataFrame:
    """Distinct channels of each group numbered from its offset, in order, with the file name."""
    d = df.select(*ids, "channel", offset).distinct()
    out = d.withColumn("out_channel", (F.row_number().over(Window.partitionBy(*ids).orderBy("channel")) - 1 + F.col(offset)).cast("int"))
    return out.withColumn("name", F.format_string(f"{prefix}_C%03d", "out_channel")).drop(offset)


def cycle_offsets(df: DataFrame, ids: list[str], order: str, n: str = "n") -> DataFrame:
    """The channels of the cycles before."""
    w = Window.partitionBy(*ids).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("int"))


def eta(df: DataFrame, ids: list[str], order: str, seconds: str) -> DataFrame:
    """elapsed, done, total, and the seconds left at the mean rate so far."""
    w = Window.partitionBy(*ids).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("elapsed", F.sum(seconds).over(w)).withColumn("done", F.count("*").over(w)).withColumn("total", F.count("*").over(Window.partitionBy(*ids)))
    return out.withColumn("eta", F.col("elapsed") / F.col("done") * (F.col("total") - F.col("done")))


def timing_rollup(df: DataFrame) -> DataFrame:
    """Seconds by channel and stage, by channel and in all; share of all."""
    r = df.rollup("channel", "stage").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("steps"), F.grouping_id().alias("depth"))
    whole = r.where("depth = 3").select(F.col("seconds").alias("all"))
    return r.crossJoin(F.broadcast(whole)).withColumn("share", F.col("seconds") / F.col("all")).drop("all")


def roi_bbox(points: DataFrame, depth: int, zrange: DataFrame | None = None) -> DataFrame:
    """points (roi_id, px, py) to boxes floor(min), ceil(max), whole depth; empty boxes are marked."""
    out = points.groupBy("roi_id").agg(F.floor(F.min("px")).alias("x0"), F.ceil(F.max("px")).alias("x1"), F.floor(F.min("py")).alias("y0"), F.ceil(F.max("py")).alias("y1"))
    return out.withColumns({"z0": F.lit(0), "z1": F.lit(depth)}).withColumn("empty", (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")))


def roi_union(points: DataFrame, default: tuple[int, int] | None = None) -> DataFrame:
    """points (roi_id, px, py, slice one-based, 0 or null: none): the union box; z from the slices, else the default."""
    z = F.when(F.col("slice") > 0, F.col("slice") - 1)
    out = points.groupBy("roi_id").agg(F.floor(F.min("px")).alias("x0"), F.ceil(F.max("px")).alias("x1"), F.floor(F.min("py")).alias("y0"), F.ceil(F.max("py")).alias("y1"), F.min(z).alias("z0"), (F.max(z) + 1).alias("z1"))
    if default:
        out = out.withColumns({"z0": F.coalesce("z0", F.lit(default[0])), "z1": F.coalesce("z1", F.lit(default[1]))})
    return out


def check_bounds(boxes: DataFrame, nz: int, ny: int, nx: int) -> DataFrame:
    """boxes with out_of_bounds, empty_box, starts_at_zero."""
    out = F.lit(False)
    for a, n in (("z", nz), ("y", ny), ("x", nx)):
        out = out | (F.col(f"{a}0") < 0) | (F.col(f"{a}1") > n)
    empty = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")) | (F.col("z1") <= F.col("z0"))
    return boxes.withColumns({"out_of_bounds": out, "empty_box": empty, "starts_at_zero": (F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("z0") == 0)})


def pending_work(requested: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Requested rows (pair_id, type, downsample) that no finished one covers; a type's short name is its long one."""
    named = lambda d: d.withColumn("type", F.when(F.col("type") == "QuickSyN", ALIAS["QuickSyN"]).otherwise(F.col("type")))
    r = named(requested)
    return r if force else r.join(named(done).select("pair_id", "type", "downsample").distinct(), ["pair_id", "type", "downsample"], "left_anti")


def reusable_work(requested: DataFrame, done: DataFrame) -> DataFrame:
    named = lambda d: d.withColumn("type", F.when(F.col("type") == "QuickSyN", ALIAS["QuickSyN"]).otherwise(F.col("type")))
    return named(requested).join(named(done).select("pair_id", "type", "downsample").distinct(), ["pair_id", "type", "downsample"], "left_semi")


def tiles_with_transforms(tiles: DataFrame, saved: DataFrame) -> DataFrame:
    """Tiles to apply: those with output skipped are left out, those without refinement get no displacement; lacking says that no row was saved."""
    on = [*[c for c in ("volume_id",) if c in tiles.columns and c in saved.columns], "tile_index"]
    s = saved.select(*on, F.coalesce("skipped", F.lit(False)).alias("skipped"), F.coalesce("output_skipped", F.lit(False)).alias("output_skipped"), "dz", "dy", "dx", F.lit(True).alias("_there"))
    j = tiles.join(s, on, "left").where(~F.coalesce("output_skipped", F.lit(False)))
    return j.select(*tiles.columns, *[F.when(F.col("skipped"), 0).otherwise(F.col(c)).alias(c) for c in ("dz", "dy", "dx")], F.col("_there").isNull().alias("lacking"))


def missing_channels(requested: DataFrame, outputs: DataFrame, ids: list[str]) -> DataFrame:
    return requested.join(outputs.select(*ids, "channel").distinct(), [*ids, "channel"], "left_anti")


def write_manifest(rows: DataFrame, key: str) -> DataFrame:
    """One JSON text for each key: its output rows in a list."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*rest))).alias("outputs"))).alias("manifest"))


def read_manifest(manifests: DataFrame, key: str) -> DataFrame:
    """key, channel, path (registered_tif, else registered), elapsed_seconds of each output that is a volume file."""
    kind = "outputs array<struct<channel:int,registered:string,registered_tif:string,elapsed_seconds:double>>"
    o = manifests.select(key, F.explode(F.from_json("manifest", kind)["outputs"]).alias("o"))
    path = F.coalesce("o.registered_tif", "o.registered")
    return o.select(key, F.col("o.channel").alias("channel"), path.alias("path"), F.col("o.elapsed_seconds").alias("elapsed_seconds")).where(F.lower("path").rlike(r"\.(tif|tiff|nrrd)$"))


def metrics_summary(metrics: DataFrame, ids: list[str]) -> DataFrame:
    """metrics (ids, phase, ncc, nmi, nrmse) to a row with before_ and after_ columns."""
    names = ("ncc", "nmi", "nrmse")
    p = metrics.groupBy(*ids).pivot("phase", ["before", "after"]).agg(*[F.first(n).alias(n) for n in names])
    return p


def cycle_manifest(paths: DataFrame, ids: list[str]) -> DataFrame:
    """Ordered channel paths of all cycles (ids, cycle, channel, path), one flat list and their numbers."""
    g = paths.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("cycle", "channel", "path"))).alias("all"))
    return g.select(*ids, F.posexplode("all").alias("position", "one")).select(*ids, "position", "one.cycle", "one.channel", "one.path")
