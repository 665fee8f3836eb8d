"""Regions from CSV files: columns X and Y, header in any case and with spaces or a byte order mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_roi_csv(spark: SparkSession, path: str) -> DataFrame:
    """(roi_id, px, py) of the vertices in CSV files; roi_id is that column if there is one, else the file's name. Without X or Y it is a ValueError; coordinates that are no numbers are null."""
    df = spark.read.option("header", True).csv(path)
    names = {c.replace("﻿", "").strip().lower(): c for c in df.columns}
    if not {"x", "y"} <= names.keys():
        raise ValueError("the CSV needs columns X and Y")
    num = lambda c: F.trim(F.col(f"`{names[c]}`")).try_cast("double")
    name = F.trim(F.col(f"`{names['roi_id']}`")) if "roi_id" in names else F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)
    return df.select(name.alias("roi_id"), num("x").alias("px"), num("y").alias("py"))
