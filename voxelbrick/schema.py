"""Schemas of the tables that the jobs exchange. A voxel that has no row, or lies in no brick, is 0."""

from pyspark.sql import types as T

CATALOG = "path string, kind string, cycle int, channel int, level int, timepoint int, dataset_key string, axis_order string, nz int, ny int, nx int, sx double, sy double, sz double, dtype string"
VOXELS = "volume_id string, channel int, z int, y int, x int, v double"
BRICKS = "volume_id string, channel int, bz int, by int, bx int, z0 int, y0 int, x0 int, nz int, ny int, nx int, dtype string, data binary"
TILES = "tile_index int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int"
#: Of a table with this column too: a byte a voxel, 1 where there was a row; null where there was one for each.
MASK = "mask binary"
KEY = ["volume_id", "channel", "bz", "by", "bx"]


def fields(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
