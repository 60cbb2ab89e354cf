"""Vocabulary masks and enum remainders for schema-constrained output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters a free string token may not contain.
STRING_FORBIDDEN = ('"', "\n", "\t", "\r")


def enum_remainders(states: DataFrame, values: DataFrame, max_length: int | None = None,
                    state_col: str = "state", value_col: str = "value") -> DataFrame:
    """For each typed prefix (state) the rest of every enum value it can still
    become (``remainder``; ``""`` means the value may end here). Values longer
    than ``max_length`` bytes are impossible. ``values`` is the enum (a schema's
    literal list)."""
    vals = values.select(F.col(value_col).alias("__v")).distinct()
    if max_length is not None:
        vals = vals.filter(F.octet_length("__v") <= max_length)
    # "value starts with state" as an equi-join: every value is expanded into
    # all of its prefixes (as many as its length) and joined on equality
    pref = vals.select("__v", F.explode(F.transform(F.sequence(F.lit(0), F.length("__v")),
                                                    lambda i: F.substring("__v", 1, i))).alias("__p"))
    j = states.join(pref, F.col(state_col) == F.col("__p"))
    return j.select(state_col, F.expr(f"substring(__v, length({state_col}) + 1)").alias("remainder"),
                    (F.length("__v") == F.length(state_col)).alias("may_end"))


def vocab_mask(remainders: DataFrame, vocab: DataFrame, state_col: str = "state",
               token_col: str = "token") -> DataFrame:
    """Allowed next tokens per state: non-empty tokens that are a prefix of some
    remainder, excluding tokens with a quote, newline, tab or carriage return.

    The prefix test is turned into an equi-join: every remainder is expanded
    into its non-empty prefixes (as many as its length) and joined on equality
    with the vocabulary - a hash join instead of states × vocabulary."""
    pref = remainders.filter(F.length("remainder") > 0).select(
        state_col, F.explode(F.transform(F.sequence(F.lit(1), F.length("remainder")),
                                         lambda i: F.substring("remainder", 1, i))).alias("__p")).distinct()
    v = (vocab.select(F.col(token_col).alias("__p"))
         .filter((F.length("__p") > 0) & ~F.col("__p").rlike('["\\n\\t\\r]')).distinct())
    return pref.join(v, "__p").select(state_col, F.col("__p").alias(token_col))


def any_string_mask(vocab: DataFrame, remaining: int | None = None, token_col: str = "token") -> DataFrame:
    """Tokens allowed inside a free string with ``remaining`` bytes left (None: no
    maximum), and the closing quote, which always is."""
    fits = F.lit(True) if remaining is None else F.octet_length(token_col) <= remaining
    inside = (F.length(token_col) > 0) & fits & ~F.col(token_col).rlike('["\\n\\t\\r]')
    return vocab.filter(inside | (F.col(token_col) == '"'))


def prefixes(values: DataFrame, value_col: str = "value", out_col: str = "state") -> DataFrame:
    """All prefixes (including empty and whole) of every value."""
    return values.select(F.explode(F.transform(F.sequence(F.lit(0), F.length(value_col)),
                                               lambda i: F.substring(value_col, 1, i))).alias(out_col)).distinct()


__all__: Sequence[str] = ["enum_remainders", "vocab_mask", "any_string_mask", "prefixes"]
