"""Readers for the input tables (plain Parquet scans: pushdown and pruning by Catalyst)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, factor: int = 4) -> DataFrame:
    """Spread rows over the cluster before heavy per-row work (tokenising,
    chunking, embedding, parsing).

    A scan yields one task per file split; an input of few large splits (one
    row group per file, say) would leave most cores idle while a handful of
    tasks chew through every document. When the input is smaller than
    ``factor × defaultParallelism`` splits (by the optimizer's size estimate -
    nothing is executed to decide) the rows are redistributed round-robin: one
    cheap shuffle of the raw rows before the expensive work. Large inputs - the
    normal case on a cluster - and inputs already redistributed are left alone.
    """
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism * factor
    logical = df._jdf.queryExecution().optimizedPlan()
    if "Repartition" in logical.toString():
        return df
    size = int(str(logical.stats().sizeInBytes()))
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB"))
    if size >= target * split:
        return df
    return df.repartition(target)


def _hadoop(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that the library wrote."""
    fs, jpath = _hadoop(spark, path)
    fs.delete(jpath, True)


def file_listing(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files: differs once the table does."""
    fs, jpath = _hadoop(spark, path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(jpath)))


def _bytes(v: str) -> int:
    v = v.strip().lower()
    for suffix, mult in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("tb", 1 << 40),
                         ("k", 1 << 10), ("m", 1 << 20), ("g", 1 << 30), ("t", 1 << 40), ("b", 1)):
        if v.endswith(suffix):
            return int(float(v[: -len(suffix)]) * mult)
    return int(v)
