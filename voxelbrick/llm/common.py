"""Shared pieces of the text operators: scratch tables, word hashing, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is named, in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="spark-voxelbrick-")
            sc.setCheckpointDir(named)
    return named


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: it cuts lineage, and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/voxelbrick-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored() table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "voxelbrick-" in path.getName():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MOST_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Rows of long text reach Python in batches of few rows from here on: the session's setting is lowered, never raised."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= MOST_ROWS:
        spark.conf.set(key, str(MOST_ROWS))


def map_texts(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow where fn takes and gives a RecordBatch, in batches of at most MOST_ROWS rows."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, MOST_ROWS):
                yield fn(b.slice(i, MOST_ROWS))

    return df.mapInArrow(run, schema)


def hashed_sample(df: DataFrame, key: str, most: int, rows: int) -> DataFrame:
    """At most `most` of df's rows (about `rows` in number): those with the smallest hash of key.

    Rows far above the expected cut are filtered first, so that what tasks send for the choice doesn't grow with their number."""
    if rows > 2 * most:
        df = df.where(F.pmod(F.xxhash64(F.lit(1), key), F.lit(1 << 40)) < int((1 << 40) * 1.5 * most / rows))
        return df.orderBy(F.pmod(F.xxhash64(F.lit(1), key), F.lit(1 << 40)), key).limit(most)
    return df.orderBy(F.xxhash64(key), key).limit(most)


# ---------------------------------------------------------------- words

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash's multiplier and of its inverse, modulo 2**64."""
    global _powers, _inverse
    if len(_powers) <= n:
        m = 1 << int(n).bit_length()
        inv = np.uint64(pow(int(_MULT), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, _MULT)]), dtype=np.uint64)
            _inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, inv)]), dtype=np.uint64)
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word (a run of bytes other than space and 9 to 13), A-Z in lower case."""
    b = _LOWER[np.frombuffer(text, np.uint8)]
    if not len(b):
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle, no word none."""
    w = word_hashes(text)
    if not len(w):
        return w
    m = min(k, len(w))
    h = np.zeros(len(w) - m + 1, np.uint64)
    for i in range(m):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - m + 1 + i])
    return np.unique(h)


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------- components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a long, b long); component is the smallest node reachable.

    Alternating large-star and small-star (Kiveris et al. 2014): each round is two aggregations with map-side
    combine, stored, and two equi-joins with them, so a hot centre is split like any skewed join key; no group is collected.
    Rounds end when no edge changes. Self-loops, nulls and repeated edges are ignored."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = stored(small, "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for t in (now, least, large, low):
            dropped(t)
        now = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())


def forest(links: np.ndarray, size: int) -> np.ndarray:
    """The smallest index linked with each of `size` indices, by label propagation over the pairs links (n, 2)."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[links[:, 0]], root[links[:, 1]])
        new = root.copy()
        np.minimum.at(new, links[:, 0], low)
        np.minimum.at(new, links[:, 1], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def env_path(name: str) -> str:
    """A public tokenizer's vocabulary file, by the installed package that holds it."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
