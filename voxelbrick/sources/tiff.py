"""Uncompressed grayscale TIFF and BigTIFF: decoding to bricks, planes from bricks, stacks of slices.

Files are rows (path, content), the columns of Spark's binaryFile source, so reading works on any store Spark reads;
write_tiff_planes gives such rows, and save_files puts them in a folder that the executors mount.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelbrick.functions.kernels import unpacked
from voxelbrick.operators.bricks import AXES, Triple, _cut, _mapped, _row, frame, regrid
from voxelbrick.schema import BRICKS

# Fixed values of the format: tags, field sizes, sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
_FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 16: "Q"}
_DTYPES = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}


class Ranged:
    """A TIFF file by ranges: read(offset, n) gives the n bytes at offset, fewer where the file ends."""

    def __init__(self, read: Callable[[int, int], bytes]):
        head = read(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or len(head) < 16 or (version := struct.unpack_from(order + "H", head, 2)[0]) not in (42, 43):
            raise ValueError("not a TIFF file")
        self._read, self.order, self.big = read, order, version == 43
        self.first = struct.unpack_from(order + ("Q" if self.big else "I"), head, 8 if self.big else 4)[0]

    def _bytes(self, at: int, n: int) -> bytes:
        got = self._read(at, n)
        if len(got) < n:
            raise ValueError("the chain of pages turns back or leaves the file")
        return got

    def _number(self, code: str, at: int) -> int:
        return struct.unpack(self.order + code, self._bytes(at, struct.calcsize("<" + code)))[0]

    def chain(self) -> Iterator[int]:
        """Where each page's directory is: two short reads a page, no pixels."""
        at, seen = self.first, set()
        head, size, entry = ("Q", 8, 20) if self.big else ("H", 2, 12)
        while at:
            if at in seen:
                raise ValueError("the chain of pages turns back or leaves the file")
            seen.add(at)
            yield at
            at = self._number("Q" if self.big else "I", at + size + self._number(head, at) * entry)

    def tags(self, at: int) -> dict:
        """The fields of the directory at `at`."""
        head, size, entry, word = ("Q", 8, 20, "Q") if self.big else ("H", 2, 12, "I")
        table, out = self._bytes(at + size, self._number(head, at) * entry), {}
        for o in range(0, len(table), entry):
            tag, kind = struct.unpack_from(self.order + "HH", table, o)
            count = struct.unpack_from(self.order + word, table, o + 4)[0]
            code = _FIELD.get(kind)
            if code is None:
                continue
            form = f"{self.order}{count}{code}" if code != "II" else f"{self.order}{2 * count}I"
            inline, n = o + entry - struct.calcsize("<" + word), struct.calcsize(form)
            short = n <= struct.calcsize("<" + word)
            out[tag] = struct.unpack_from(form, table, inline) if short else struct.unpack(form, self._bytes(struct.unpack_from(self.order + word, table, inline)[0], n))
        return out

    def rows(self, tags: dict, low: int, high: int) -> np.ndarray:
        """Rows low..high of a page; only their bytes are read, strips that follow one another at once."""
        kind, (height, width) = sample(tags), size_of(tags)
        each = min(tags.get(ROWS, (height,))[0], height)
        if len(tags[OFFSETS]) != -(-height // each):
            raise ValueError("only uncompressed grayscale strips are read")
        line, ranges = width * np.dtype(kind).itemsize, []
        for i in range(low // each, -(-high // each)):
            p, q = max(low, i * each), min(high, (i + 1) * each, height)
            at, n = tags[OFFSETS][i] + (p - i * each) * line, (q - p) * line
            if ranges and sum(ranges[-1]) == at:
                ranges[-1] = (ranges[-1][0], ranges[-1][1] + n)
            else:
                ranges.append((at, n))
        return np.frombuffer(b"".join(self._bytes(*r) for r in ranges), self.order + kind).reshape(high - low, width).astype(kind)


def size_of(tags: dict) -> tuple[int, int]:
    """(height, width) of a page."""
    return tags[HEIGHT][0], tags[WIDTH][0]


def sample(tags: dict) -> str:
    """The dtype of a page's samples; compressed, tiled or many-sample pages raise ValueError."""
    if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1 or OFFSETS not in tags:
        raise ValueError("only uncompressed grayscale strips are read")
    kind = _DTYPES.get((tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]))
    if kind is None:
        raise ValueError("only uint8, uint16 and float32 samples are read")
    return kind


def decode(data: bytes) -> np.ndarray:
    """(z, y, x); one page is z = 1. Compressed, tiled or many-sample files raise ValueError."""
    file = Ranged(lambda at, n: data[at : at + n])
    pages = [file.tags(at) for at in file.chain()]
    if len({(size_of(t), sample(t)) for t in pages}) > 1:
        raise ValueError("pages differ in shape or sample type")
    return np.stack([file.rows(t, 0, size_of(t)[0]) for t in pages])


def encode(volume: np.ndarray, big: bool = True) -> bytes:
    """A file of one page for each plane of (z, y, x), little-endian, one strip a page."""
    kind = {"uint8": (8, 1), "uint16": (16, 1), "float32": (32, 3)}[str(volume.dtype)]
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    out, at = [head], len(head)
    word, count, pad = ("Q", "Q", 8) if big else ("I", "I", 4)
    for i, plane in enumerate(volume):
        tags = [(WIDTH, 4, plane.shape[1]), (HEIGHT, 4, plane.shape[0]), (BITS, 3, kind[0]), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (OFFSETS, 16 if big else 4, 0), (SAMPLES, 3, 1), (ROWS, 4, plane.shape[0]), (COUNTS, 16 if big else 4, plane.nbytes), (FORMAT, 3, kind[1])]
        size = struct.calcsize("<" + ("Q" if big else "H")) + len(tags) * (20 if big else 12) + struct.calcsize("<" + word)
        body = struct.pack("<" + ("Q" if big else "H"), len(tags))
        for tag, k, v in tags:
            v = at + size if tag == OFFSETS else v
            body += struct.pack(f"<HH{count}", tag, k, 1) + struct.pack("<" + {3: "H", 4: "I", 16: "Q"}[k], v).ljust(pad, b"\0")
        end = at + size + plane.nbytes
        body += struct.pack("<" + word, end if i < len(volume) - 1 else 0)
        out += [body, np.ascontiguousarray(plane).tobytes()]
        at = end
    return b"".join(out)


def read_tiff(files: DataFrame, brick: Triple) -> DataFrame:
    """files (path, content[, volume_id, channel]) to bricks; volume_id is the path and channel 0 if they aren't given.

    A file is decoded in one task: it is one row already."""
    if "volume_id" not in files.columns:
        files = files.withColumns({"volume_id": F.col("path"), "channel": F.lit(0)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                a = decode(bytes(r.content))
                yield frame([_row(r.volume_id, r.channel, k, at, piece) for k, at, piece in _cut(r.volume_id, r.channel, np.zeros(3, int), a, brick)])

    return files.select("volume_id", "channel", "content").mapInPandas(run, BRICKS)


def assemble_stack(slices: DataFrame, shape: Triple, brick: Triple) -> DataFrame:
    """slices (volume_id, channel, z, content: a TIFF of one plane) to bricks: planes are cut where they are, pieces of a brick meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                a = decode(bytes(r.content))
                if a.shape[1:] != tuple(shape[1:]):
                    raise ValueError(f"slice {r.z} is {a.shape[1:]}, not {tuple(shape[1:])}")
                yield frame([_row(r.volume_id, r.channel, k, at, piece) for k, at, piece in _cut(r.volume_id, r.channel, np.array([r.z, 0, 0]), a, brick)])

    return regrid(slices.select("volume_id", "channel", "z", "content").mapInPandas(run, BRICKS), shape, brick)


def write_tiff_planes(bricks: DataFrame, shape: Triple, prefix: str = "out") -> DataFrame:
    """volume_id, channel, z, path (<prefix>_C###/z#####.tif), content: one uint16 BigTIFF for each plane, one task a plane."""
    _, ny, nx = shape

    def planes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                a = unpacked(r)
                yield pd.DataFrame([(r.volume_id, r.channel, r.z0 + i, r.y0, r.x0, r.ny, r.nx, np.rint(np.clip(p, 0, 65535)).astype("u2").tobytes()) for i, p in enumerate(a)], columns=["volume_id", "channel", "z", "y0", "x0", "ny", "nx", "data"])

    parts = bricks.mapInPandas(planes, "volume_id string, channel int, z int, y0 int, x0 int, ny int, nx int, data binary")

    def join(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((1, ny, nx), "u2")
        for r in rows.itertuples():
            out[0, r.y0 : r.y0 + r.ny, r.x0 : r.x0 + r.nx] = np.frombuffer(r.data, "u2").reshape(r.ny, r.nx)
        return pd.DataFrame([(*key, f"{prefix}_C{key[1]:03d}/z{key[2]:05d}.tif", encode(out))], columns=["volume_id", "channel", "z", "path", "content"])

    return parts.groupBy("volume_id", "channel", "z").applyInPandas(join, "volume_id string, channel int, z int, path string, content binary")


def write_tiff_slabs(bricks: DataFrame, shape: Triple, deep: int, prefix: str = "out") -> DataFrame:
    """volume_id, channel, z0, path (<prefix>_C###/z#####.tif), content: a BigTIFF for each `deep` planes, one task a file, which it must hold in memory."""
    slab = (deep, *shape[1:])
    pieces = _mapped(bricks, lambda r, a: [_row(r.volume_id, r.channel, k, at, piece) for k, at, piece in _cut(r.volume_id, r.channel, np.array([r.z0, r.y0, r.x0]), a, slab)])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                yield pd.DataFrame([(r.volume_id, r.channel, r.z0, f"{prefix}_C{r.channel:03d}/z{r.z0:05d}.tif", encode(unpacked(r)))], columns=["volume_id", "channel", "z0", "path", "content"])

    return regrid(pieces, shape, slab).mapInPandas(write, "volume_id string, channel int, z0 int, path string, content binary")


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """files (path, content) put under a folder, a mounted one or a URI of a store that pyarrow.fs opens; (path, bytes). A file is renamed when whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.itertuples():
                full = f"{base}/{r.path}"
                store.create_dir(os.path.dirname(full), recursive=True)
                with store.open_output_stream(part := f"{full}.{os.getpid()}.part") as f:
                    f.write(bytes(r.content))
                store.move(part, full)
            yield pd.DataFrame({"path": b["path"], "bytes": [len(x) for x in b["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, bytes long")


__all__ = ["AXES", "assemble_stack", "decode", "encode", "read_tiff", "save_files", "write_tiff_planes", "write_tiff_slabs"]
