"""Catalogs of volumes, pyramid levels, slice folders, sources and picks: small or medium tables, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelbrick.functions import parse
from voxelbrick.sources.scratch import stored


def build_catalog(datasets: DataFrame, axis_order: str = "auto") -> DataFrame:
    """datasets (path, dataset_key, shape array, spacing array, override array) to catalog rows; rows that aren't 3D are dropped (see not_3d).

    auto means zyx; an xyz shape is turned. A spacing override wins."""
    if axis_order not in ("auto", "zyx", "xyz"):
        raise ValueError(f"unknown axis order {axis_order}")
    i = (2, 1, 0) if axis_order == "xyz" else (0, 1, 2)
    sp = F.coalesce("override", "spacing")
    k = parse.parse_dataset_key(F.col("dataset_key"))
    d = datasets.where(F.size("shape") == 3)
    return d.select("path", "dataset_key", k["level"].alias("level"), k["timepoint"].alias("timepoint"), k["channel"].alias("channel"), F.lit("xyz" if axis_order == "xyz" else "zyx").alias("axis_order"), *[F.col("shape")[j].alias(c) for j, c in zip(i, ("nz", "ny", "nx"), strict=True)], *[sp[j].alias(c) for j, c in enumerate(("sx", "sy", "sz"))])


def not_3d(datasets: DataFrame) -> DataFrame:
    return datasets.where(F.size("shape") != 3)


def levels(catalog: DataFrame, ids: list[str]) -> DataFrame:
    return catalog.select(*ids, "level").distinct()


def first_by(df: DataFrame, ids: list[str], order: list) -> DataFrame:
    """One row of each group of ids, the first by order. Ranked with a window, whose partial limit runs before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*ids).orderBy(*order))).where("_n = 1").drop("_n")


def discover_dataset(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, owner, level, timepoint, channel), catalog (owner, dataset_key, size): the exact key if it is there,
    else by: no 'Data' in the name, another level, time point or channel, then size, then name."""
    c = catalog.select("owner", "dataset_key", F.col("size").alias("size"))
    r = requests.select("request_id", "owner", F.col("level").alias("rl"), F.col("timepoint").alias("rt"), F.col("channel").alias("rc"))
    has = lambda word, n: F.col("dataset_key").contains(F.concat(F.lit(word + " "), F.col(n).cast("string")))
    exact = F.col("dataset_key") == F.format_string("DataSet/ResolutionLevel %d/TimePoint %d/Channel %d/Data", "rl", "rt", "rc")
    order = [~exact, ~F.col("dataset_key").contains("Data"), ~has("ResolutionLevel", "rl"), ~has("TimePoint", "rt"), ~has("Channel", "rc"), F.col("size"), F.col("dataset_key")]
    return first_by(r.join(c, "owner"), ["request_id"], order).select("request_id", "dataset_key", exact.alias("exact"))


def match_pyramid(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """requests (request_id, path, level, timepoint, channel, nz, ny, nx, s_z, s_y, s_x) with match: the other level of the same
    data whose shape is within 1 of ceil(n / stride); least (sum of differences, sum of scale errors, level). No stride: null."""
    c = catalog.select("path", "timepoint", "channel", F.col("level").alias("match"), *[F.col(f"n{a}").alias(f"m{a}") for a in "zyx"])
    j = requests.join(c, ["path", "timepoint", "channel"]).where(F.col("match") != F.col("level"))
    delta, error = F.lit(0), F.lit(0.0)
    for a in "zyx":
        d = F.abs(F.col(f"m{a}") - F.ceil(F.col(f"n{a}") / F.col(f"s_{a}")))
        j = j.where(d <= 1)
        delta, error = delta + d, error + F.abs(F.col(f"n{a}") / F.greatest(F.col(f"m{a}"), F.lit(1)) - F.col(f"s_{a}"))
    j = j.where(F.greatest("s_z", "s_y", "s_x") > 1)
    best = first_by(j, ["request_id"], [delta, error, F.col("match")]).select("request_id", "match")
    return requests.join(best, "request_id", "left")


def coarsest_level(catalog: DataFrame, ids: list[str], base: int = 0) -> DataFrame:
    """The other level with the least voxels (ties: the highest), its scale against the base level."""
    b = catalog.where(F.col("level") == base).select(*ids, *[F.col(f"n{a}").alias(f"b{a}") for a in "zyx"])
    o = catalog.where(F.col("level") != base)
    voxels = F.col("nz").cast("long") * F.col("ny") * F.col("nx")
    top = first_by(o, ids, [voxels, F.desc("level")]).select(*ids, "level", "nz", "ny", "nx")
    return top.join(b, ids).select(*ids, "level", *[(F.col(f"b{a}") / F.greatest(F.col(f"n{a}"), F.lit(1))).alias(f"scale_{a}") for a in "zyx"])


#: Files that one task of discover_slices sorts, about.
RANGE = 1 << 17


def discover_slices(files: DataFrame) -> DataFrame:
    """files (dir, file) with dir_index and z: natural order of folders and of files in them. Folders are few.

    Files are sorted in ranges, as many as they need, so that no folder is sorted in one task; a file's z is its place in its range, after
    the sizes of the folder's earlier ranges. The ranges are stored: others would be drawn if they were made again."""
    key = parse.natural_key
    files = stored(files.withColumn("_key", key(F.col("file"))), "slices")  # the key is costly, and ranges are drawn from it before they are made
    dirs = files.select("dir").distinct().withColumn("dir_index", (F.row_number().over(Window.orderBy(key(F.col("dir")), "dir")) - 1).cast("int"))
    order = ["dir", "_key", "file"]
    cut = files.repartitionByRange(files.count() // RANGE + 1, *order).sortWithinPartitions(*order)
    cut = stored(cut.withColumn("_id", F.monotonically_increasing_id()).drop("_key"), "ranges")  # the range's number, and 33 bits of the place in it
    cut = cut.withColumn("_range", F.shiftright("_id", 33))
    earlier = Window.partitionBy("dir").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("dir", "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    sizes = sizes.select("dir", "_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = cut.join(F.broadcast(sizes), ["dir", "_range"])  # a row for each folder and range
    return out.withColumn("z", (F.col("_id") - F.col("_first") + F.col("_before")).cast("int")).drop("_range", "_id", "_first", "_before").join(F.broadcast(dirs), "dir")


def validate_slices(files: DataFrame, shape: str = "shape", dtype: str = "dtype") -> DataFrame:
    """dir, n_slices, off_shape, off_dtype, bad: against the whole set's first slice (first file of the first folder, natural
    order): how many of the folder's slices have another shape or dtype, and whether it differs in that or in its number of slices.

    A null shape or dtype differs from any other."""
    first_dir = files.select("dir").distinct().agg(F.min(F.struct(parse.natural_key(F.col("dir")).alias("k"), "dir")).alias("d")).select("d.dir")
    inside = files.join(F.broadcast(first_dir), "dir")
    first = inside.agg(F.min(F.struct(parse.natural_key(F.col("file")).alias("k"), "file", F.col(shape).alias("shape"), F.col(dtype).alias("dtype"))).alias("f"), F.count("*").alias("want")).select(F.col("f.shape").alias("_shape"), F.col("f.dtype").alias("_dtype"), "want")
    known = files.crossJoin(F.broadcast(first))  # one row
    off = lambda a, b: F.count_if(~F.col(a).eqNullSafe(F.col(b)))
    per = known.groupBy("dir").agg(F.count("*").alias("n_slices"), F.first("want").alias("want"), off(shape, "_shape").alias("off_shape"), off(dtype, "_dtype").alias("off_dtype"))
    return per.withColumn("bad", (F.col("n_slices") != F.col("want")) | (F.col("off_shape") > 0) | (F.col("off_dtype") > 0)).drop("want")


def resolve_sources(channels: DataFrame, overrides: DataFrame, default: Column) -> DataFrame:
    """channels (ids, channel) with source: the override's path ('{channel}' filled in), else the default; known says its kind is read."""
    o = overrides.select(*[c for c in overrides.columns if c != "path"], F.col("path").alias("_path"))
    on = [c for c in overrides.columns if c != "path"]
    src = F.coalesce(F.replace(F.col("_path"), F.lit("{channel}"), F.col("channel").cast("string")), default)
    out = channels.join(o, on, "left").withColumn("source", src).drop("_path")
    return out.withColumn("known", parse.file_suffix(F.col("source")).isin(".ims", ".tif", ".tiff"))


def infer_channel_files(files: DataFrame, channels: DataFrame, ids: list[str]) -> DataFrame:
    """ids, channel, path, how: the one file whose name has the channel; several: ambiguous (path null); none: the channel's
    place among the siblings in sort-key order, if there are enough; else missing."""
    hits = channels.join(files, ids).where(parse.matches_channel(F.col("path"), F.col("channel")))
    named = hits.groupBy(*ids, "channel").agg(F.count("*").alias("hits"), F.min("path").alias("named"))
    order = Window.partitionBy(*ids).orderBy(parse.channel_order(F.col("path")), F.lower("path"))
    place = files.withColumn("channel", (F.row_number().over(order) - 1).cast("int")).withColumnRenamed("path", "placed")
    out = channels.join(named, [*ids, "channel"], "left").join(place.select(*ids, "channel", "placed"), [*ids, "channel"], "left")
    how = F.when(F.col("hits") == 1, "name").when(F.col("hits") > 1, "ambiguous").when(F.col("placed").isNotNull(), "order").otherwise("missing")
    return out.select(*ids, "channel", F.when(F.col("hits") == 1, F.col("named")).when(F.col("hits").isNull(), F.col("placed")).alias("path"), how.alias("how"))


def pick_one(files: DataFrame, ids: list[str]) -> DataFrame:
    """The only file of each group that isn't a result of an earlier run (by its name, not its folder), paths compared without case; n says how many there were."""
    keep = files.where(~F.lower(parse.file_name(F.col("path"))).rlike("registered|_roi_|_roi\\.nrrd$"))
    one = keep.groupBy(*ids, F.lower("path").alias("low")).agg(F.min("path").alias("path"))
    n = one.groupBy(*ids).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return n.withColumn("path", F.when(F.col("n") == 1, F.col("path")))
