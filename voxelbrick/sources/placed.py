"""Bricks as tables bucketed by their place, so that volumes meet without a shuffle and a box opens a share of the files.

A brick's place is one number: its channel, then its Morton key (the bits of bz, by and bx taken in turn). A cell is a cube of
2 ** grain bricks a side. A table is partitioned by volume, channel and cell, and bucketed and sorted by place: equal buckets of
two volumes hold the same places, and a box lies in few cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelbrick.operators.bricks import AXES, Triple, columns, crop

#: Bits of an index along an axis; the channel has what is left of 63.
BITS = 17


def morton(z: int, y: int, x: int) -> int:
    """One number of three: bit k of x, y and z becomes bit 3k, 3k + 1 and 3k + 2. Each is below 2 ** BITS."""
    return sum(((n >> k) & 1) << (3 * k + i) for k in range(BITS) for i, n in enumerate((x, y, z)))


def _spread(c: Column) -> Column:
    """The bits of c, two zeros between each two: the upper half of each run of bits moves up, run by run."""
    c = c.cast("long")
    for run in (16, 8, 4, 2, 1):
        mask = sum(((1 << run) - 1) << (3 * run * j) for j in range(64 // (3 * run) + 1)) & (2**63 - 1)
        c = c.bitwiseOR(F.shiftleft(c, 2 * run)).bitwiseAND(F.lit(mask))
    return c


def cell_of(grain: int) -> Column:
    """The Morton key of a brick's cell; of the brick itself at grain 0."""
    z, y, x = (_spread(F.shiftright(F.col(f"b{a}"), grain)) for a in AXES)
    return F.shiftleft(z, 2).bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(x)


def place_of() -> Column:
    return F.shiftleft(F.col("channel").cast("long"), 3 * BITS).bitwiseOR(cell_of(0))


def place_bricks(bricks: DataFrame, table: str, path: str, buckets: int, grain: int = 3) -> None:
    """Writes bricks to a table of the session's catalog, its files under path. Tables that shall meet need as many buckets as each other.

    One shuffle by place, with as many partitions as buckets, so that a task writes its own bucket's files: one for each volume, channel and
    cell. A join has a task a bucket, and a channel cells times buckets files: 256 buckets and cells of 10 GB give files of 40 MB."""
    placed = bricks.select(*columns(bricks)).withColumns({"cell": cell_of(grain), "place": place_of()}).repartition(buckets, "place")
    placed.write.mode("overwrite").option("path", path).partitionBy("volume_id", "channel", "cell").bucketBy(buckets, "place").sortBy("place").saveAsTable(table)


def read_placed(spark: SparkSession, table: str) -> DataFrame:
    """Bricks with their place, which metrics.pair_bricks uses where both sides have it."""
    df = spark.table(table)
    return df.select(*columns(df), "place")


def box_cells(low: Triple, high: Triple, brick: Triple, grain: int) -> list[int]:
    """The cells that meet the box low..high."""
    ranges = [range(p // (s << grain), max(q - 1, p) // (s << grain) + 1) for p, q, s in zip(low, high, brick, strict=True)]
    return sorted(morton(z, y, x) for z in ranges[0] for y in ranges[1] for x in ranges[2])


def read_box(spark: SparkSession, table: str, low: Triple, high: Triple, brick: Triple, grain: int = 3) -> DataFrame:
    """The bricks that meet the box low..high: only files of its cells are opened, and in them only row groups that may hold its bricks."""
    df = spark.table(table).where(F.col("cell").isin(box_cells(low, high, brick, grain)))
    for a, p, q, s in zip(AXES, low, high, brick, strict=True):
        df = df.where(F.col(f"b{a}").between(p // s, max(q - 1, p) // s))
    return df.select(*columns(df))


def crop_placed(spark: SparkSession, table: str, low: Triple, high: Triple, brick: Triple, grain: int = 3) -> DataFrame:
    """crop of a placed table."""
    return crop(read_box(spark, table, low, high, brick, grain), low, high, brick)
