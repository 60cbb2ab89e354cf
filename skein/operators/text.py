"""Text operators over document tables: clean, tokenise, vocabulary, chunk.

All per-document work is expressed as native column expressions on the row
itself (no shuffle); only the vocabulary needs a shuffle (``distinct``) and a
distributed dense rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig, TOKEN_PATTERN
from ..functions import text as T
from ..session import unique_subdir
from ..sources.tables import spread
from .segment import not_single, segment


class InvalidChunkSeparator(ValueError):
    """A separator or post-filter string that is not exactly one token."""


_TOKEN_RE = regex.compile(TOKEN_PATTERN)


def check_single_tokens(strings: Sequence[str]) -> None:
    """Driver-side config check: each string must tokenise to exactly one token."""
    for s in strings:
        if len(_TOKEN_RE.findall(s)) != 1:
            raise InvalidChunkSeparator(s)


def clean(df: DataFrame, text_col: str = "text", patterns: Sequence[str] | None = None,
          out_col: str = "clean") -> DataFrame:
    pats = ChunkConfig().pre_filters if patterns is None else tuple(patterns)
    return df.withColumn(out_col, T.prefilter(F.col(text_col), pats))


def token_rows(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """One row per token: ``keys..., pos (0-based), token``."""
    # *_outer generators: Catalyst infers no "size(...) > 0" filter from them,
    # so the generator input is not evaluated a second time below the shuffle
    return (spread(df.select(*keys, text_col))
            .select(*keys, F.posexplode_outer(T.tokenize(F.col(text_col))).alias("pos", "token"))
            .filter(F.col("token").isNotNull()))


def vocabulary(tokens: DataFrame, token_col: str = "token", partitions: int | None = None, counts: bool = False) -> DataFrame:
    """Distinct tokens with dense ids ``1..V`` in binary string order, with ``counts`` also
    their number of occurrences ``n``.

    A global ``dense_rank`` would put the whole vocabulary in one task. Instead
    the distinct tokens are range-partitioned and sorted; each partition numbers
    its rows locally (``monotonically_increasing_id`` minus the partition base)
    and adds the count of all earlier partitions. The numbered rows are written
    once, so that counts and rows are of the same ranges; only one row per
    partition reaches the small offsets table.
    """
    distinct = tokens.select(F.col(token_col).alias("token"))
    distinct = distinct.groupBy("token").agg(F.count(F.lit(1)).alias("n")) if counts else distinct.distinct()
    n = partitions or int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        distinct.repartitionByRange(n, "token").sortWithinPartitions("token")
        .withColumn("pid", F.spark_partition_id())
        .withColumn("local", F.monotonically_increasing_id() - F.shiftleft(F.col("pid").cast("long"), 33))
    )
    spark = tokens.sparkSession
    path = unique_subdir(spark, "vocabulary")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    per_range = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("cnt"))
    offsets = per_range.select(
        "pid",
        (F.sum("cnt").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))).alias("base"),
    ).fillna(0, ["base"])
    return ranged.join(F.broadcast(offsets), "pid").select(
        "token", (F.col("base") + F.col("local") + 1).alias("token_id"), *(["n"] if counts else []))


#: Bytes of the tokens that are sent to every executor, each with what its entry needs besides.
BROADCAST_BYTES, ENTRY_BYTES = 16 << 20, 64


def _common(vocab: DataFrame) -> tuple[int | None, bool]:
    """The least power of two such that the tokens that occur at least so often fit
    ``BROADCAST_BYTES`` (none: no such number), and whether these are all tokens."""
    sizes = vocab.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.sum(F.octet_length("token") + ENTRY_BYTES).alias("size")).collect()
    least, total = None, 0
    for bits, size in sorted(sizes, reverse=True):
        total += size
        if total > BROADCAST_BYTES:
            return least, False
        least = 1 << (bits - 1)
    return least, True


def token_ids(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token rows with the ``token_id`` of a vocabulary (null: not in it).

    With the tokens' numbers of occurrences (``vocabulary(counts=True)``) the most common
    tokens, as many as fit a broadcast, meet the rows in place; only the rows of rarer tokens
    are shuffled, and no token has many of those."""
    def joined(part: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return part.join(ids.select("token", "token_id"), "token", how).select(*rows.columns, "token_id")

    least, whole = _common(vocab) if "n" in vocab.columns else (None, False)
    if least is None:
        return joined(rows, vocab, "left")
    common = F.broadcast(vocab.where(F.col("n") >= least))
    if whole:
        return joined(rows, common, "left")
    rare = rows.join(common.select("token"), "token", "left_anti").select(*rows.columns)
    return joined(rows, common, "inner").unionByName(joined(rare, vocab.where(F.col("n") < least), "left"))


def chunk(df: DataFrame, keys: Sequence[str], config: ChunkConfig = ChunkConfig(),
          text_col: str = "text", clean_text: bool = True, vocab: DataFrame | None = None) -> DataFrame:
    """Ingest chunking: pre-filter → tokenise → hierarchical chunks →
    post-filter → drop empty → detokenise.

    Tokens are those of the default pattern, or with ``vocab`` (token, token_id) the longest
    tokens of that vocabulary (see :mod:`.segment`).
    Output ``keys..., chunk_no (0-based, after dropping empties), text, n_tokens``.
    """
    src = T.prefilter(F.col(text_col), config.pre_filters) if clean_text else F.col(text_col)
    if vocab is None:
        check_single_tokens(config.separators)
        check_single_tokens(config.post_filter)
        # tokens are materialised once per row: the chunk expression reads them many times
        toks = spread(df.select(*keys, F.col(text_col))).select(*keys, T.tokenize(src).alias("__tk"))
    else:
        bad = not_single([*config.separators, *config.post_filter], vocab)
        if bad:
            raise InvalidChunkSeparator(bad[0])
        toks = segment(df.select(*keys, src.alias("__text")), vocab, "__text", "__seg").select(
            *keys, F.col("__seg.token").alias("__tk"))
    chunks = T.chunk_tokens(F.col("__tk"), config.separators, config.max_tokens, config.post_filter)
    return (
        toks.select(*keys, F.posexplode_outer(chunks).alias("chunk_no", "tk"))
        .filter(F.col("tk").isNotNull())
        .select(*keys, F.col("chunk_no").cast("long"), T.detokenize("tk").alias("text"),
                F.size("tk").cast("long").alias("n_tokens"))
    )


SETTINGS = ("separators", "max_tokens", "pre_filters", "post_filter")


def settings_table(spark: SparkSession, configs: Mapping[str, ChunkConfig]) -> DataFrame:
    """Chunk settings by memory as a table: ``memory`` and the fields of the configuration."""
    rows = [(name, *(list(v) if isinstance(v, tuple) else v for v in (getattr(c, f) for f in SETTINGS))) for name, c in configs.items()]
    return spark.createDataFrame(rows, "memory string, separators array<string>, max_tokens int, "
                                       "pre_filters array<string>, post_filter array<string>")


def invalid_settings(settings: DataFrame) -> DataFrame:
    """``memory, reason`` of settings that chunking refuses: a separator or post-filter string
    that is not exactly one token, a maximum under 1, a null field or member, a repeated name."""
    def several(field: str) -> Column:
        return F.exists(field, lambda s: F.coalesce(F.size(T.tokenize(s)) != 1, F.lit(True)))

    null = F.lit(False)
    for f in SETTINGS:
        null = null | F.col(f).isNull()
    reason = (F.when(null | F.exists("pre_filters", lambda p: p.isNull()), "null")
              .when(several("separators"), "separator").when(several("post_filter"), "post-filter")
              .when(F.col("max_tokens") < 1, "maximum"))
    twice = settings.groupBy("memory").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("memory", F.lit("repeated").alias("reason"))
    return settings.select("memory", reason.alias("reason")).where("reason IS NOT NULL").unionByName(twice)


def chunk_by_memory(df: DataFrame, settings: DataFrame, keys: Sequence[str], memory: str = "memory",
                    text_col: str = "text") -> DataFrame:
    """:func:`chunk` with the settings of each row's memory, from a table (see
    :func:`settings_table`): ``keys..., memory, chunk_no, text, n_tokens``.

    Rows of a null memory or of one without settings give no chunks (``unknown_names``
    lists them); a null text gives none. Settings that :func:`invalid_settings` lists raise
    :class:`InvalidChunkSeparator` before any text is read. The settings, a row a memory, are
    joined to the documents; documents are not moved where Spark finds them small enough.
    """
    bad = invalid_settings(settings).first()
    if bad is not None:
        raise InvalidChunkSeparator(f"{bad.memory}: {bad.reason}")
    named = settings.select(F.col("memory").alias("__memory"), *(F.col(f).alias(f"__{f}") for f in SETTINGS))
    rows = spread(df.select(*keys, F.col(memory).alias("__name"), F.col(text_col).alias("__text")))
    rows = rows.join(named, F.col("__name") == F.col("__memory")).withColumn(
        "__tk", T.tokenize(T.prefilter_by("__text", "__pre_filters")))
    tk = F.col("__tk")
    bounds = rows.withColumn("__bounds", T.chunk_bounds_by(tk, "__separators", "__max_tokens"))
    chunks = F.transform("__bounds", lambda b: F.filter(
        F.slice(tk, b["s"], b["e"] - b["s"] + 1), lambda t: ~F.array_contains("__post_filter", t)))
    return (bounds.select(*keys, F.col("__name").alias("memory"),
                          F.posexplode_outer(F.filter(chunks, lambda c: F.size(c) > 0)).alias("chunk_no", "tk"))
            .filter(F.col("tk").isNotNull())
            .select(*keys, "memory", F.col("chunk_no").cast("long"), T.detokenize("tk").alias("text"),
                    F.size("tk").cast("long").alias("n_tokens")))


def chunk_fixed(df: DataFrame, keys: Sequence[str], max_tokens: int, text_col: str = "text") -> DataFrame:
    toks = spread(df.select(*keys, text_col)).select(*keys, T.tokenize(F.col(text_col)).alias("__tk"))
    chunks = T.fixed_chunk_tokens(F.col("__tk"), max_tokens)
    return (
        toks.select(*keys, F.posexplode_outer(chunks).alias("chunk_no", "tk"))
        .filter(F.col("tk").isNotNull())
        .select(*keys, F.col("chunk_no").cast("long"), T.detokenize("tk").alias("text"),
                F.size("tk").cast("long").alias("n_tokens"))
    )


def chunk_size_report(df: DataFrame, config: ChunkConfig = ChunkConfig(), text_col: str = "text") -> DataFrame:
    """Chunk-size invariant: chunks (before post-filter) larger than the maximum.
    One row: number of chunks, number over the maximum (must be 0), largest."""
    toks = spread(df.select(text_col)).select(
        T.tokenize(T.prefilter(F.col(text_col), config.pre_filters)).alias("__tk"))
    tk = F.col("__tk")
    sizes = toks.select(F.explode_outer(F.transform(T.chunk_bounds(tk, config.separators, config.max_tokens),
                                            lambda b: b["e"] - b["s"] + 1)).alias("n"))
    sizes = sizes.filter(F.col("n") > 0)
    return sizes.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count(F.when(F.col("n") > config.max_tokens, 1)).alias("n_oversize"),
        F.max("n").cast("long").alias("max_tokens"),
    )


def token_stats(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """Token count, word count (split on runs of spaces) and tokens per word."""
    n = F.size(T.tokenize(F.col(text_col)))
    w = T.word_count(F.col(text_col))
    return spread(df.select(*keys, text_col)).select(
        *keys,
        n.cast("long").alias("n_tokens"),
        w.cast("long").alias("n_words"),
        F.round(F.try_divide(n.cast("double"), w.cast("double")), 1).alias("tokens_per_word"),
    )
