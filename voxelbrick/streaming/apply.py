"""Cycles that arrive one after another: saved transforms applied to new brick files by a stream."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxelbrick.operators import jobs, resample
from voxelbrick.operators.bricks import Triple
from voxelbrick.schema import BRICKS, KEY, fields

STATE = "done boolean, twice boolean, files array<string>, channels array<int>, holders array<binary>"
FOUND = "volume_id string, channel int, bz int, by int, bx int, file string, twice boolean"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path; empty where there is none yet."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def whole_volumes(keys: DataFrame, shape: Triple, brick: Triple, force: bool = False) -> DataFrame:
    """Where the bricks of volumes that have become whole are (FOUND), of a stream of keys (KEY, file, modified, bricks: how many make it whole).

    A volume's state is the number of the file that holds it, for each brick of the grid: four bytes a brick, no pixels. A brick that
    comes again counts once and the last one is used, by time and name of its file (of two in one file, either). Of a whole volume only that it is done stays in
    the state; its later bricks are passed over. force: its state stays, and each later brick gives it out again. A volume whose bricks is null waits."""
    many = tuple(-(-n // s) for n, s in zip(shape, brick, strict=True))

    def place(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, twice, files, channels, kept = state.get if state.exists else (False, False, [], [], [])
        new = pd.concat(batches).sort_values(["modified", "file"])
        if done and not force:
            return
        files, holders = list(files), {c: np.frombuffer(h, np.int32).copy() for c, h in zip(channels, kept, strict=True)}
        at = new[["bz", "by", "bx"]].to_numpy()
        if (at < 0).any() or (at >= many).any():
            raise ValueError(f"a brick of {key[0]} lies outside the grid of {many} bricks")
        number = {f: i for i, f in enumerate(files)}
        for (file, channel), rows in new.groupby(["file", "channel"], sort=False):
            if file not in number:
                number[file] = len(files)
                files.append(file)
            holder = holders.setdefault(int(channel), np.full(int(np.prod(many)), -1, np.int32))
            holder[np.ravel_multi_index(rows[["bz", "by", "bx"]].to_numpy().T, many)] = number[file]
        twice = bool(twice or new.duplicated(["channel", "bz", "by", "bx", "file"]).any())
        need, have = new["bricks"].dropna(), sum(int((h >= 0).sum()) for h in holders.values())
        ready = len(need) > 0 and have >= need.iloc[0]
        if ready and not force:
            state.update((True, False, [], [], []))
        else:
            state.update((ready, twice, files, list(holders), [h.tobytes() for h in holders.values()]))
        if ready:
            for channel, holder in holders.items():
                there = np.flatnonzero(holder >= 0)
                bz, by, bx = np.unravel_index(there, many)
                yield pd.DataFrame({"volume_id": key[0], "channel": channel, "bz": bz, "by": by, "bx": bx, "file": [files[i] for i in holder[there]], "twice": twice})

    return keys.groupBy("volume_id").applyInPandasWithState(place, FOUND, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_apply(
    spark: SparkSession, source: str, target: str, checkpoint: str, shape: Triple, brick: Triple, transforms: DataFrame, complete: DataFrame,
    tiles: DataFrame | None = None, saved: DataFrame | None = None, overlap: Triple = (0, 0, 0), force: bool = False, files_a_batch: int | None = None,
) -> DataFrame:
    """Reads new brick files under source, applies saved transforms (volume_id, m, t) to whole volumes and writes these to target.

    complete (volume_id, bricks): how many bricks a volume has in all its channels. The stream itself reads keys only, and its state says
    when a volume is whole (whole_volumes), however many batches that takes; then the files that hold it, and no others, are read
    where they are, so they must stay until then. A batch costs its new keys and the volumes that it completes, whatever came before.
    A batch that runs again after a failure writes the same partitions anew. With tiles (volume_id, tile_index, box) and saved tile
    transforms the volumes are tiled and blended. A volume without a transform is an error. No event time, so no watermark; it stops
    when everything there now is done. <target>-found keeps, by batch, which files made which volume."""

    def batch(found: DataFrame, number: int) -> None:
        found.write.mode("overwrite").parquet(log := f"{target}-found/batch={number}")  # the state's work is done once
        found = spark.read.schema(FOUND).parquet(log)
        files = [r.file for r in found.select("file").distinct().collect()]  # names of files, of the volumes that one batch completes
        if not files:
            return
        ready = found.select("volume_id").distinct()
        lost = ready.join(transforms, "volume_id", "left_anti").take(1)
        if lost:
            raise ValueError(f"no transform is saved for {lost[0].volume_id}")
        rows = spark.read.schema(BRICKS).option("basePath", source).parquet(*map(unquote, files)).withColumn("file", F.col("_metadata.file_path"))
        bricks = rows.join(found, [*KEY, "file"], "left_semi").select(*fields(BRICKS).names)
        if found.where("twice").take(1):
            bricks = bricks.dropDuplicates(KEY)
        if tiles is None:
            out = resample.warp(bricks, shape, shape, brick, transforms=transforms)
        else:
            out = jobs.apply_tiles(bricks, shape, brick, tiles.join(ready, "volume_id", "left_semi"), overlap, transforms, saved)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("volume_id").parquet(target)

    new = spark.readStream.schema(BRICKS)
    new = (new.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else new).parquet(source)
    keys = new.select(*KEY, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).join(complete.select("volume_id", "bricks"), "volume_id", "left")
    q = whole_volumes(keys, shape, brick, force).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return _table(spark, target, BRICKS)
