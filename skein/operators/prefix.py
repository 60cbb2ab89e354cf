"""Running sums inside groups that may be huge (one session or stream holding
a large share of all rows).

A plain ``sum() over (partition by g order by o)`` sorts a whole group in one
task. Here the order column is cut into blocks of ``block`` consecutive
values: block totals come from an aggregate, the running total *before* each
block from a window over the small table of block totals, and the running sum
inside a block from a window over ``(group, block)``, which holds at most
``block`` rows when order values are distinct. The two are joined on ``(group,
block)``, a key that spreads a hot group over many tasks; totals and rows come
from one shuffle of the input on that key. Null groups and null order values
are kept, as a group and a block of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys)`` in which null keys are equal; keys come from the left."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def running_sum(df: DataFrame, groups: Sequence[str], order: str, value: Column | str, out: str,
                block: int = DEFAULT_BLOCK) -> DataFrame:
    """Adds ``out`` = sum of ``value`` over rows of the same group with
    ``order`` ≤ this row's (inclusive running sum; ties of ``order`` are summed
    together, as a RANGE frame would; null order values come first)."""
    v = F.col(value) if isinstance(value, str) else value
    b = df.withColumn("__v", v).withColumn("__blk", F.floor(F.col(order) / F.lit(block)).cast("long"))
    b = b.repartition(*groups, "__blk")
    totals = b.groupBy(*groups, "__blk").agg(F.sum("__v").alias("__bt"))
    before = totals.select(
        *groups, "__blk",
        F.coalesce(F.sum("__bt").over(Window.partitionBy(*groups).orderBy(F.col("__blk").asc_nulls_first())
                                      .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    w = Window.partitionBy(*groups, "__blk").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    inner = b.withColumn("__in", F.sum("__v").over(w))
    return (join_null_safe(inner, before, [*groups, "__blk"])
            .withColumn(out, F.col("__before") + F.col("__in"))
            .drop("__v", "__blk", "__in", "__before"))
