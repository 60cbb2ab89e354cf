"""Helpers shared by the training-data operators: Arrow maps, written tables, bounded label samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import unique_subdir

#: Bytes that separate words; everything else is part of a word.
WORD_SEPARATORS = " \t\n\v\f\r"


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``fn`` over the Arrow batches of ``df`` (bounded by Spark's batch limits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)

    return df.mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared work folder and read back: cuts the
    lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = unique_subdir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(base: str, columns: list[str]) -> str:
    """``base``, with as many underscores as make it differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether ``crc32(id as text) mod modulus`` is ``remainder`` (null id: false)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def label_sample(labels: DataFrame, label: str, modulus: int, remainder: int, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled training ids (doc_id, y), the first by a hash of
    the id: a deterministic sample, so small that it may be broadcast. Rows with a
    null id or label do not count; an id labelled both ways is left out."""
    one = (labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
           .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
           .where(~held_out(F.col("doc_id"), modulus, remainder))
           .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_hi"))
           .where(F.col("y") == F.col("_hi")))
    return one.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(text, y) of the sampled ids; the sample's size is bounded by its parameter."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, intercept: bool = True, rounds: int = 50,
                 weights: np.ndarray | None = None) -> np.ndarray:
    """Newton iterations of L2-regularised logistic regression; the last
    coefficient is the intercept when there is one (not regularised)."""
    x = np.asarray(x, dtype=np.float64)
    if intercept:
        x = np.hstack([x, np.ones((len(x), 1))])
    reg = np.full(x.shape[1], l2)
    if intercept:
        reg[-1] = 1e-9
    w = np.zeros(x.shape[1])
    sw = np.ones(len(x)) if weights is None else weights
    scale = sw.sum()

    def loss(v):
        z = x @ v
        return float((sw * (np.logaddexp(0.0, z) - y * z)).sum() / scale + 0.5 * (reg * v * v).sum())

    best = loss(w)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (sw * (p - y)) / scale + reg * w
        h = (x * (sw * p * (1 - p))[:, None]).T @ x / scale + np.diag(reg + 1e-9)
        step = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-6 and loss(w - t * step) > best + 1e-15:
            t *= 0.5
        new = loss(w - t * step)
        if not best - new > 1e-12:
            break
        w, best = w - t * step, new
    return w


class RunHash:
    """64-bit hashes of byte ranges of an array, all at once.

    A range's hash is the sum modulo 2^64 of a random value per byte times a random
    factor per place in the range, mixed with its length, so no rule between places
    (as powers of one base have) makes different ranges equal. Ranges longer than
    ``LONG`` are hashed one by one. Ranges must ascend and not overlap."""

    LONG = 1 << 16

    def __init__(self, seed: int):
        self.seed = seed
        self.table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.factor = np.zeros(0, np.uint64)

    def __call__(self, a: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        length = stop - start
        most = min(int(length.max()), self.LONG) + 1
        if len(self.factor) < most:
            places = np.arange(1 << (most - 1).bit_length(), dtype=np.uint64)
            with np.errstate(over="ignore"):
                self.factor = mixed((places + np.uint64(self.seed)) * np.uint64(0x9E3779B97F4A7C15))
        lead = int(start[0])
        place = np.arange(lead, len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
        np.minimum(place, len(self.factor) - 1, out=place)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.table[a[lead:]] * self.factor[place])))
        with np.errstate(over="ignore"):
            h = mixed((sums[stop - lead] - sums[start - lead]) ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        for i in np.flatnonzero(length > self.LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(a[start[i]:stop[i]].tobytes(), self.seed)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
