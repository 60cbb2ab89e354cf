"""The sampler chain as operators on a scored-candidates table
``(group_id, candidate, score)``: flat bias → repetition penalty → top-k →
top-p → temperature → random draw.

Groups are one generation step each, so a group holds at most one row per
vocabulary entry: windows over ``group_id`` sort bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SAMPLER_REPEAT_LAST_N, SAMPLER_REPEAT_PENALTY, SAMPLER_TEMPERATURE

G, C, S = "group_id", "candidate", "score"


def flat_bias(cands: DataFrame, bias: DataFrame) -> DataFrame:
    """``score + bias`` for candidates listed in ``bias([group_id,] candidate, bias)``:
    one list for all groups, or one per group (request and step). The join strategy
    is left to adaptive execution, which sees the list's size."""
    return (cands.join(bias, [G, C] if G in bias.columns else [C], "left")
            .withColumn(S, F.col(S) + F.coalesce(F.col("bias"), F.lit(0.0)))
            .drop("bias"))


def last_n_history(history: DataFrame, n: int = SAMPLER_REPEAT_LAST_N, order_col: str = "step") -> DataFrame:
    """Distinct candidates among the last ``n`` history rows of each group
    (``history(group_id, candidate, step)``)."""
    w = Window.partitionBy(G).orderBy(F.col(order_col).desc(), F.col(C).desc())
    return (history.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
            .select(G, C).distinct())


def repetition_penalty(cands: DataFrame, recent: DataFrame, penalty: float = SAMPLER_REPEAT_PENALTY) -> DataFrame:
    """Candidates seen recently: ``score / p`` if positive else ``score * p``."""
    seen = recent.select(G, C).withColumn("__seen", F.lit(True))
    s = F.col(S)
    return (cands.join(seen, [G, C], "left")
            .withColumn(S, F.when(F.col("__seen").isNull(), s)
                        .when(s > 0, s / penalty).otherwise(s * penalty))
            .drop("__seen"))


def top_k(cands: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per group (ties by candidate ascending)."""
    w = Window.partitionBy(G).orderBy(F.col(S).desc(), F.col(C).asc())
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def softmax(cands: DataFrame, temperature: float = 1.0, out: str = "prob") -> DataFrame:
    """Max-subtracted softmax of ``score / temperature`` within each group."""
    w = Window.partitionBy(G)
    z = F.col(S) / F.lit(temperature)
    e = F.exp(z - F.max(z).over(w))
    return cands.withColumn("__e", e).withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def top_p(cands: DataFrame, p: float) -> DataFrame:
    """Nucleus: in descending score order keep rows while the probability mass
    *before* the row is below ``p`` (so at least one row survives)."""
    sm = softmax(cands)
    w = Window.partitionBy(G).orderBy(F.col(S).desc(), F.col(C).asc())
    before = F.coalesce(F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return sm.withColumn("mass_before", before).filter(F.col("mass_before") < p)


def temperature(cands: DataFrame, t: float = SAMPLER_TEMPERATURE) -> DataFrame:
    return softmax(cands.withColumn(S, F.col(S) / F.lit(t)))


def uniform_hash(seed: int, *cols: str):
    """Deterministic uniform in (0, 1) from md5 of ``seed|col|col...``."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16 ** 13))


def weighted_draw(cands: DataFrame, seed: int = 0) -> DataFrame:
    """One candidate per group drawn with probability ``prob`` (Gumbel-max with a
    hash-derived uniform, so reruns agree). A single hash aggregate."""
    key = F.log(F.col("prob")) - F.log(-F.log(uniform_hash(seed, G, C)))
    return (cands.withColumn("__key", key).groupBy(G)
            .agg(F.max_by(C, "__key").alias(C)))


def single_candidate(cands: DataFrame, bias: DataFrame, private: Sequence[int] = ()) -> DataFrame:
    """A group whose bias list has exactly one entry, a positive one, takes that
    candidate without scoring (``forced``); other groups go through the chain. Private
    candidates leave the list first. ``bias([group_id,] candidate, bias)``: one list
    for all groups or one per group; a listed candidate need not be scored."""
    listed = bias.filter(~F.col(C).isin(list(private))) if private else bias
    groups = cands.select(G).distinct()
    if G in bias.columns:
        only = F.when((F.count(F.lit(1)) == 1) & (F.min("bias") > 0), F.min(C))
        joined = groups.join(listed.groupBy(G).agg(only.alias("forced")), G, "left")
    else:
        two = listed.select(C, "bias").limit(2).collect()  # is there exactly one?
        forced = two[0][C] if len(two) == 1 and (two[0]["bias"] or 0) > 0 else None
        joined = groups.withColumn("forced", F.lit(forced).cast(cands.schema[C].dataType))
    return joined.select(G, "forced", F.col("forced").isNotNull().alias("shortcut"))
