"""Writing results: keyed tables, appended logs and size-aware batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corvina.operators.tables import upsert
from corvina.session import written

MOST_POINTS, MOST_BYTES, ENVELOPE = 500, 16 * 1024 * 1024, 128


def point_bytes(payload: Column, dense: Column, sparse_terms: Column) -> Column:
    """About how large a vector point is as JSON: payload, 14 bytes a float, 22 a sparse entry."""
    return F.octet_length(payload) + F.coalesce(dense, F.lit(0)) * 14 + F.coalesce(sparse_terms, F.lit(0)) * 22 + F.lit(ENVELOPE)


def batched(points: DataFrame, order: Sequence[str], size: str = "bytes", most: int = MOST_POINTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds shard and batch: rows gathered in order until the next would exceed either limit.

    Batches are formed within each shard (a partition of the ordered rows), as any parallel
    writer does. A single point above the byte limit is a batch of its own.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema) + ", shard int, batch int"
    ordered = points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, n, total = 0, 0, 0
        for f in frames:
            ids = []
            for b in f[size]:
                if n and (n >= most or total + b > most_bytes):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + b
                ids.append(batch)
            yield f.assign(batch=ids)

    return ordered.mapInPandas(run, schema)


def append(df: DataFrame, path: str) -> None:
    """Append rows to a log table."""
    df.write.mode("append").parquet(path)


def merge_into(new: DataFrame, path: str, keys: Sequence[str], keep_first: Sequence[str] = ()) -> None:
    """MERGE rows into the table at ``path``; the old version is read whole before it is replaced."""
    spark = new.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    out = upsert(spark.read.parquet(path), new, keys, keep_first) if there else new
    written(out).write.mode("overwrite").parquet(path)


def truncate(spark_df: DataFrame, path: str) -> None:
    """Leave an empty table with the schema of ``spark_df``."""
    spark_df.limit(0).write.mode("overwrite").parquet(path)
