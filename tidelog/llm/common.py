"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointing(spark: SparkSession) -> SparkSession:
    """Makes sure that checkpoint() has a folder: the session's ``spark.checkpoint.dir``, or one of our own where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where none is set, one of this machine, if all tasks run here too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="tidelog-")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the column's values take about ``limit`` bytes in each; a longer value comes alone."""
    for batch in batches:
        size = batch.column(column).cast(pa.large_string())
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(size), 0)).to_pylist()
        start = base = 0
        for k, end in enumerate(ends):
            if k > start and end - base > limit:
                yield batch.slice(start, k - start)
                start, base = k, ends[k - 1]
        if start < len(ends):
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Null texts count as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
