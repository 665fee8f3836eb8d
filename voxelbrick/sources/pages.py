"""Large multi-page TIFF files as a Spark data source: its partitions are ranges of pages, its rows bricks.

The driver follows a file's chain of page directories (two short reads a page); a task reads only the strips of its own pages,
one band of bricks at a time. Files are opened by pyarrow.fs, so a path is a mounted one, or a URI of a store that Arrow opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from voxelbrick.operators.bricks import Triple, _cut, _row
from voxelbrick.schema import BRICKS
from voxelbrick.sources.tiff import Ranged, sample, size_of

ARROW = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in BRICKS.split(", "))])
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class PageRange(InputPartition):
    """Pages first.. of a file, by the places of their directories."""

    path: str
    first: int
    directories: tuple[int, ...]


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.brick = tuple(int(n) for n in options.get("brick", "64,64,64").split(","))
        self.bytes = int(options.get("partitionbytes", 128 << 20))
        self.low, self.high = int(options.get("low", 0)), int(options.get("high", 2**31 - 1))

    def _files(self) -> tuple[fs.FileSystem, list[str]]:
        store, path = fs.FileSystem.from_uri(self.uri)
        if store.get_file_info(path).type == fs.FileType.File:
            return store, [path]
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        return store, sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".tif", ".tiff")))

    def partitions(self) -> list[PageRange]:
        """Ranges of whole bricks in z, of about `bytes` each; those outside low..high are left out."""
        store, paths = self._files()

        def ranges(path: str) -> list[PageRange]:
            with store.open_input_file(path) as f:
                file = Ranged(lambda at, n: f.read_at(n, at))
                places = list(file.chain())
                if not places:
                    return []
                (height, width), kind = size_of(tags := file.tags(places[0])), sample(tags)
            deep = self.brick[0]
            step = deep * max(1, self.bytes // (deep * height * width * np.dtype(kind).itemsize))
            start = max(self.low, 0) // deep * deep
            return [PageRange(path, z, tuple(places[z : min(z + step, -(-self.high // deep) * deep)])) for z in range(start, min(len(places), self.high), step)]

        with ThreadPoolExecutor(16) as pool:
            return [r for one in pool.map(ranges, paths) for r in one]

    def read(self, part: PageRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no pages at all
            return
        store, _ = fs.FileSystem.from_uri(self.uri)
        deep, tall, _ = self.brick
        with store.open_input_file(part.path) as f:
            file = Ranged(lambda at, n: f.read_at(n, at))
            for z in range(0, len(part.directories), deep):
                pages = [file.tags(at) for at in part.directories[z : z + deep]]
                if len({(size_of(t), sample(t)) for t in pages}) > 1:
                    raise ValueError("pages differ in shape or sample type")
                height, _ = size_of(pages[0])
                for y in range(0, height, tall):
                    band = np.stack([file.rows(t, y, min(y + tall, height)) for t in pages])
                    rows = [_row(part.path, 0, k, at, piece) for k, at, piece in _cut(part.path, 0, np.array([part.first + z, y, 0]), band, self.brick)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class PushingReader(PageReader):
    """Takes comparisons of bz and z0 with numbers; Spark still checks them on the bricks."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("bz",), ("z0",)):
                # What a brick's place must be: at least `least`, less than `most`; as planes, of which a brick has several.
                scale = self.brick[0] if f.attribute == ("bz",) else 1
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, (f.value + isinstance(f, GreaterThan)) * scale)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, (f.value + (not isinstance(f, LessThan))) * scale)
            yield f


class TiffPages(DataSource):
    """Options: path (a file or a folder of .tif and .tiff), brick "z,y,x", low and high (planes, half-open), partitionbytes, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pages"

    def schema(self) -> str:
        return BRICKS

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else PageReader)(dict(self.options))


def read_tiff_pages(spark: SparkSession, path: str, brick: Triple, planes: tuple[int, int] | None = None, partition_bytes: int = 128 << 20) -> DataFrame:
    """Bricks of each TIFF file under path, volume_id its path, channel 0; no shuffle, since ranges of pages are whole bricks deep.

    planes: only the bricks that hold planes low..high, and only their pages are read. Where the session has
    spark.sql.python.filterPushdown.enabled, filters on bz and z0 prune pages too."""
    spark.dataSource.register(TiffPages)
    low, high = planes or (0, 2**31 - 1)
    options = {"brick": ",".join(map(str, brick)), "low": low, "high": high, "partitionbytes": partition_bytes, "pushdown": spark.conf.get(PUSHDOWN, "false")}
    return spark.read.format("tiff_pages").options(**options).load(path)
