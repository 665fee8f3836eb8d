"""Exact percentiles of voxels in bounded memory, by radix selection on order-preserving integer keys.

Each pass counts the next DIGIT bits of the keys, for values whose higher bits are those of a wanted rank: a brick sends at most
2**DIGIT counts for each wanted prefix of its group, Spark merges them, and a running sum finds the digit in which each rank
lies. uint8 and uint16 volumes take one pass, float32 two, others four. No row stands for a voxel, and no task or group holds
more counts than a pass's bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelbrick.functions.kernels import given, unpacked
from voxelbrick.sources.scratch import stored

DIGIT = 16


def keys_of(v: np.ndarray, bits: int) -> np.ndarray:
    """uint64 keys of finite values, ordered as the values: whole numbers below 2**16, or the bits of a float of 32 or 64 bits with the sign turned."""
    if bits == 16:
        return v.astype(np.uint64)
    kind, top = (np.uint32, np.uint32(1 << 31)) if bits == 32 else (np.uint64, np.uint64(1 << 63))
    b = (v + 0.0).astype(np.float32 if bits == 32 else np.float64).view(kind)  # + 0.0: one zero
    return np.where(b & top, ~b, b | top).astype(np.uint64)


def value_of(key: int, bits: int) -> float:
    """The inverse of keys_of."""
    if bits == 16:
        return float(key)
    kind, top = (np.uint32, 1 << 31) if bits == 32 else (np.uint64, 1 << 63)
    raw = key & ~top if key & top else ~key & (2 * top - 1)
    return float(np.array([raw], kind).view(np.float32 if bits == 32 else np.float64)[0])


def _bits(types: set[str]) -> int:
    if types <= {"uint8", "uint16", "bool"}:
        return 16
    return 32 if types <= {"uint8", "uint16", "bool", "float32", "int16", "int8", "float16"} else 64


def percentiles(bricks: DataFrame, at: list[float], group: tuple = ("volume_id", "channel")) -> DataFrame:
    """(group, n, q): n finite voxels and the percentiles (0 to 1) of their values, linear between ranks as numpy's, in the order of at.

    group: key columns of bricks. Groups without a finite voxel have no row. Exact for values that a float64 holds."""
    bits = _bits({r.dtype for r in bricks.select("dtype").distinct().collect()})  # a row for each type
    kinds = {f.name: f.dataType.simpleString() for f in bricks.schema}
    by = ", ".join(f"{g} {kinds[g]}" for g in group)

    def counted(some: DataFrame, shift: int) -> DataFrame:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    v = unpacked(r)[given(r)]
                    v = v[np.isfinite(v)] if v.dtype.kind == "f" else v
                    k = keys_of(v, bits)
                    for p in [0] if r.prefixes is None else r.prefixes:
                        here = k if r.prefixes is None else k[(k >> np.uint64(shift + DIGIT)) == np.uint64(p)]
                        c = np.bincount(((here >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64), minlength=1)
                        d = np.flatnonzero(c)
                        if len(d):
                            yield pd.DataFrame({**{g: getattr(r, g) for g in group}, "prefix": np.int64(p), "digit": d.astype(np.int32), "c": c[d]})

        return some.mapInPandas(part, f"{by}, prefix long, digit int, c long").groupBy(*group, "prefix", "digit").agg(F.sum("c").alias("c"))

    pixels = bricks.select(*{*group}, "nz", "ny", "nx", "dtype", "data", *(["mask"] if "mask" in bricks.columns else []))
    # First pass: counts of the highest digit give n, and with it the ranks.
    shift = bits - DIGIT
    counts = stored(counted(pixels.withColumn("prefixes", F.lit(None).cast("array<bigint>")), shift), "digits")
    total = counts.groupBy(*group).agg(F.sum("c").alias("n"))
    rank = lambda p, f: f(F.lit(float(p)) * (F.col("n") - 1)).cast("long")
    asked = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(rank(p, F.floor), rank(p, F.ceil)) for p in at]))))
    wanted = stored(total.select(*group, "n", asked.alias("rank")).withColumns({"prefix": F.lit(0).cast("long"), "left": F.col("rank")}), "wanted")  # a few rows a group
    while True:
        own = Window.partitionBy(*group, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**DIGIT rows
        steps = counts.withColumn("before", F.coalesce(F.sum("c").over(own), F.lit(0)))
        met = wanted.join(steps, [*group, "prefix"]).where((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("c")))
        key = (F.shiftleft("prefix", DIGIT) + F.col("digit")).cast("long")
        wanted = stored(met.select(*group, "n", "rank", key.alias("prefix"), (F.col("left") - F.col("before")).alias("left")), "wanted")
        if shift == 0:
            break
        shift -= DIGIT
        some = wanted.groupBy(*group).agg(F.array_distinct(F.collect_list("prefix")).alias("prefixes"))
        counts = stored(counted(pixels.join(F.broadcast(some), list(group)), shift), "digits")  # a row a group, two prefixes a percentile

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["v"] = [value_of(int(k) & (1 << bits) - 1, bits) for k in b["prefix"]]
            yield b[[*group, "n", "rank", "v"]]

    known = wanted.mapInPandas(decode, f"{by}, n long, rank long, v double").groupBy(*group, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))

    def linear(p: float):
        h = F.lit(float(p)) * (F.col("n") - 1)
        low, high = (F.try_element_at("of", rank(p, f)) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)  # as Spark's percentile rounds

    return known.select(*group, "n", F.array(*[linear(p) for p in at]).alias("q"))
