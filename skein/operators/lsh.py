"""Approximate recall with random-hyperplane LSH.

Every vector gets one ``bits``-bit sign code per table (native dot products
with fixed hyperplanes). A query's candidates are the memory rows sharing its
code, or one that differs in a bit, in any table. Each bucket is scored by the exact
top-n kernel of ``recall`` inside cogroup tasks, so a bucket never emits all its pairs;
where either side of a bucket is larger than ``block_rows`` it is split, so a hot bucket
is spread over a grid of tasks. Candidates are then merged exactly per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .recall import DEFAULT_BLOCK_ROWS, _top_n, usable

#: Buckets whose sizes are sent to every executor, so that the vectors are shuffled once.
BROADCAST_BUCKETS = 1 << 18


def hyperplanes(dims: int, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dims))


def lsh_codes(vec: str, planes: np.ndarray) -> F.Column:
    """``array<int>`` of one code per table."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    codes = []
    for t in range(planes.shape[0]):
        code = F.lit(0)
        for b in range(planes.shape[1]):
            h = F.array(*[F.lit(float(x)) for x in planes[t, b]])
            d = F.aggregate(F.zip_with(v, h, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
            code = code + F.when(d >= 0, F.lit(1 << b)).otherwise(F.lit(0))
        codes.append(code)
    return F.array(*codes)


def lsh_knn(queries: DataFrame, memory: DataFrame, n: int, *, query_key: str, memory_key: str,
            dims: int, bits: int | None = None, tables: int = 8, vec: str = "embedding",
            block_rows: int = DEFAULT_BLOCK_ROWS, bucket_rows: int = 256, seed: int = 7) -> DataFrame:
    """``query_key, rank, memory_key, distance, found``: the best ``n`` among the
    candidates of each query, and how many candidates were found (at most ``n``). A
    query without any has one row, with a null rank and ``found`` 0.

    ``bits`` (default: from the number of memory rows, so that a bucket holds about
    ``bucket_rows``) is a code's length. A query looks at its own bucket and at those
    that differ in one bit, in every table.
    """
    if bits is None:
        bits = max(0, math.ceil(math.log2(max(1, memory.count() / bucket_rows))))
    planes = hyperplanes(dims, bits, tables, seed)
    # codes always have one entry per table; *_outer avoids an inferred
    # "size(codes) > 0" filter that would compute the codes twice
    q = queries.filter(usable(vec, dims)).select(F.col(query_key).alias("__qid"), F.col(vec).alias("__qvec"),
                       F.posexplode_outer(lsh_codes(vec, planes)).alias("__t", "__own"))
    probes = F.array(F.col("__own"), *[F.col("__own").bitwiseXOR(F.lit(1 << b)) for b in range(bits)])
    q = q.withColumn("__code", F.explode(probes)).drop("__own")
    m = memory.filter(usable(vec, dims)).select(F.col(memory_key).alias("__mid"), F.col(vec).alias("__vec"),
                      F.posexplode_outer(lsh_codes(vec, planes)).alias("__t", "__code"))

    def subs(side: DataFrame, out: str) -> DataFrame:
        return side.groupBy("__t", "__code").agg(
            F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias(out))

    # blocks per bucket and side (tables x 2^bits rows): a hot bucket becomes a grid of tasks
    sizes = subs(m, "__ms").join(subs(q, "__qs"), ["__t", "__code"])
    sizes = F.broadcast(sizes) if tables << bits <= BROADCAST_BUCKETS else sizes
    m = (m.join(sizes, ["__t", "__code"]).withColumn("__sub", F.pmod(F.xxhash64("__mid"), F.col("__ms")).cast("int"))
         .withColumn("__qsub", F.explode(F.sequence(F.lit(0), F.col("__qs") - 1))).drop("__ms", "__qs"))
    q = (q.join(sizes, ["__t", "__code"]).withColumn("__qsub", F.pmod(F.xxhash64("__qid"), F.col("__qs")).cast("int"))
         .withColumn("__sub", F.explode(F.sequence(F.lit(0), F.col("__ms") - 1))).drop("__ms", "__qs"))
    qtype = queries.schema[query_key].dataType
    mtype = memory.schema[memory_key].dataType
    schema = T.StructType([T.StructField("qid", qtype), T.StructField("mid", mtype),
                           T.StructField("distance", T.DoubleType())])

    def cokernel(qpdf: pd.DataFrame, mpdf: pd.DataFrame) -> pd.DataFrame:
        if not len(qpdf) or not len(mpdf):
            return pd.DataFrame({"qid": [], "mid": [], "distance": []})
        mpdf = mpdf.sort_values("__mid", kind="stable")
        Q = np.stack(qpdf["__qvec"].to_numpy()).astype(np.float64)
        M = np.stack(mpdf["__vec"].to_numpy()).astype(np.float64)
        idx, val = _top_n(Q, M, n, "l2")
        k = idx.shape[1]
        return pd.DataFrame({"qid": np.repeat(qpdf["__qid"].to_numpy(), k), "mid": mpdf["__mid"].to_numpy()[idx.ravel()],
                             "distance": val.ravel()})

    keys = ["__t", "__code", "__sub", "__qsub"]
    cand = q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInPandas(cokernel, schema)
    best = cand.groupBy("qid", "mid").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("qid").orderBy(F.col("distance").asc(), F.col("mid").asc())
    best = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    best = best.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("qid")))
    asked = queries.select(F.col(query_key).alias("__asked")).distinct()
    return (asked.join(best, F.col("__asked") == F.col("qid"), "left")
            .select(F.col("__asked").alias(query_key), "rank", F.col("mid").alias(memory_key), "distance",
                    F.coalesce("found", F.lit(0)).alias("found")))
