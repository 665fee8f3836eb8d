"""The given tables as volumes, regions, slices and logs, in Spark; the same in DuckDB's SQL, for the tests' answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vox_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense volume of 64 columns and 25 rows a plane."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return e.select(F.lit("emb").alias("volume_id"), F.lit(0).alias("channel"), F.floor(F.col("vec_id") / 25).cast("int").alias("z"), (F.col("vec_id") % 25).cast("int").alias("y"), "x", F.floor((F.col("e").cast("double") + 1) * 20000).cast("bigint").alias("v"))


def shifted(voxels: DataFrame, by: tuple[int, int, int], shape: tuple[int, int, int], name: str = "mov") -> DataFrame:
    """voxels moved by whole indices, kept inside the shape."""
    out = voxels.withColumn("volume_id", F.lit(name))
    for a, d, n in zip("zyx", by, shape, strict=True):
        out = out.withColumn(a, (F.col(a) + d).cast("int")).where(F.col(a).between(0, n - 1))
    return out


PLANTED = (1, 2, 3)
CHANNEL_SHIFTS = {1: (1, 0, 0), 2: (0, 2, -1), 3: (-1, 1, 2)}
CYCLE_SHIFTS = ((0, 0, 0), (1, -1, 2), (2, -2, 4))
FAR_COLUMN = 40


def locally_moved(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """voxels moved by PLANTED, those from FAR_COLUMN on by one row more."""
    out = voxels.withColumn("y", (F.col("y") + (F.col("x") >= FAR_COLUMN).cast("int")).cast("int")).where(F.col("y") < shape[1])
    return shifted(out, PLANTED, shape)


#: Planted maps by name: degrees about x, shear of y by x, scale, and a shift.
PLANTED_MAPS = {"turned": (6.0, 0.0, 1.0, (0.3, -0.4, 0.6)), "scaled": (0.0, 0.0, 1.03, (-0.5, 0.2, 0.4)), "sheared": (2.0, 0.02, 0.98, (0.0, 0.5, -0.7))}


def planted_map(name: str, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(m, t) on z, y, x indices, about the middle of a volume of `shape`."""
    degrees, shear, scale, shift = PLANTED_MAPS[name]
    c, a = (np.array(shape) - 1) / 2, np.radians(degrees)
    m = scale * np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), shear], [0, 0, 1]])
    return m, c - m @ c + np.array(shift)


def cycles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """Three cycles (volume_id): channel 0 is the same structure in each, channel 1 is another of its own; a cycle lies by its own shift."""
    v = vox_emb(spark, sf_dir)
    r = v.agg(*[(F.max(a) + 1).alias(a) for a in "zyx"]).first()
    shape = (r.z, r.y, r.x)
    out = None
    for i, by in enumerate(CYCLE_SHIFTS):
        two = v.unionByName(v.withColumn("channel", F.lit(1)).withColumn("v", F.col("v") * (i + 1) % 30011))
        one = shifted(two, by, shape, str(i))
        out = one if out is None else out.unionByName(one)
    return out, shape


def vox_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse volume for each cycle (day div 10) and channel (kind of event)."""
    kinds = F.expr("case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end")
    g = table(spark, sf_dir, "events").select(F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("d"), F.col("user_id").cast("int").alias("y"), F.hour("ts").alias("x"), kinds.alias("channel"), F.round(F.col("value") * 100).cast("bigint").alias("c"))
    return g.groupBy(F.floor(F.col("d") / 10).cast("int").alias("cycle"), "channel", (F.col("d") % 10).cast("int").alias("z"), "y", "x").agg(F.sum("c").alias("v"))


def roi_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region for each order: points (px, py) and a one-based slice."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("roi_id"), (F.col("l_partkey").cast("double") + F.col("l_discount").cast("double")).alias("px"), (F.col("l_suppkey").cast("double") + F.col("l_tax").cast("double")).alias("py"), F.col("l_linenumber").cast("int").alias("slice"))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("Ex_"), (405 + 50 * F.col("l_linenumber")).cast("string"), F.lit("_deskewed_stitched")).alias("dir"), F.concat(F.lit("img_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit(".tif")).alias("file")).distinct()


LEVELS = (("a.ims", 0, 0, 0, 1568, 2304, 12800), ("a.ims", 1, 0, 0, 784, 1152, 6400), ("a.ims", 2, 0, 0, 392, 576, 3200), ("a.ims", 3, 0, 0, 392, 288, 1600), ("b.ims", 0, 0, 1, 99, 101, 103), ("b.ims", 1, 0, 1, 50, 51, 52), ("b.ims", 2, 0, 1, 25, 25, 26))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pyramid catalog for each supplier: the example levels under its own paths."""
    small = spark.createDataFrame(LEVELS, "file string, level int, timepoint int, channel int, nz int, ny int, nx int")
    key = F.format_string("DataSet/ResolutionLevel %d/TimePoint %d/Channel %d/Data", "level", "timepoint", "channel")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("owner"))
    return s.crossJoin(F.broadcast(small)).withColumn("path", F.concat(F.col("owner").cast("string"), F.lit("/"), "file")).withColumn("dataset_key", key).drop("file")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("long").alias("step"), F.col("event_type").alias("channel"), F.when(F.col("event_id") % 3 == 0, "estimate").when(F.col("event_id") % 3 == 1, "apply").otherwise("write").alias("stage"), F.col("value").cast("double").alias("seconds"))


SQL = {
    "emb": "emb as (select cast(vec_id//25 as int) z, cast(vec_id%25 as int) y, cast(i-1 as int) x, cast(floor((cast(embedding[i] as double)+1)*20000) as bigint) v from embeddings, range(1,65) r(i))",
    "shape": "shape as (select max(z)+1 nz, max(y)+1 ny, max(x)+1 nx from emb)",
    "mov": "mov as (select z+1 z, y+2 y, x+3 x, v from emb, shape where z+1<nz and y+2<ny and x+3<nx)",
    "evt": "evt as (select cast(d//10 as int) cycle, cast(ch as int) channel, cast(d%10 as int) z, y, cast(x as int) x, cast(sum(c) as bigint) v from (select cast(ts as date) - date '2024-01-01' d, cast(user_id as int) y, hour(ts) x, case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end ch, cast(round(value*100) as bigint) c from events) group by all)",
    "roi_pts": "roi_pts as (select l_orderkey roi_id, cast(l_partkey as double)+cast(l_discount as double) px, cast(l_suppkey as double)+cast(l_tax as double) py, cast(l_linenumber as int) slice from lineitem)",
    "slices": "slices as (select distinct 'Ex_'||(405+50*l_linenumber)||'_deskewed_stitched' dir, 'img_'||l_orderkey||'_'||l_partkey||'.tif' file from lineitem)",
    "catalog": "catalog as (select cast(s_suppkey as int) owner, s_suppkey||'/'||file path, level, timepoint, channel, nz, ny, nx, 'DataSet/ResolutionLevel '||level||'/TimePoint '||timepoint||'/Channel '||channel||'/Data' dataset_key from supplier, (values " + ", ".join(map(str, LEVELS)) + ") t(file, level, timepoint, channel, nz, ny, nx))",
    "run_log": "run_log as (select cast(event_id as bigint) step, event_type channel, case event_id%3 when 0 then 'estimate' when 1 then 'apply' else 'write' end stage, cast(value as double) as seconds from events)",
}


def sql(*names: str) -> str:
    """A WITH clause of the named fixtures, in order."""
    return "with " + ", ".join(SQL[n] for n in names) + " "
