"""Bytes of whole files through Hadoop's file systems, for the driver.

Only results of bounded size are written this way: workbooks, shapefiles,
parameter files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

EXCEL_ROWS = 1_048_576


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_json(spark: SparkSession, path: str, value) -> None:
    write_bytes(spark, path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode())


def bounded_rows(df: DataFrame, limit: int = EXCEL_ROWS) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for one file")
    return rows
