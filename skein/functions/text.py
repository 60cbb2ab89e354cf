"""Column expressions for cleaning, tokenising and chunking text.

Everything here is a native Spark expression (regex functions and
higher-order array functions), so it runs inside the scan stage with no
shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_PRE_FILTERS, TOKEN_PATTERN, WORD_PATTERN

BOUNDS_TYPE = "array<struct<s:int,e:int>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefilter(text: Column | str, patterns: Sequence[str] = DEFAULT_PRE_FILTERS) -> Column:
    """Replace every match of each pattern (in order) by one space, then make
    one non-iterated pass turning two spaces into one (only if any pattern)."""
    out = _col(text)
    for p in patterns:
        out = F.regexp_replace(out, F.lit(p), F.lit(" "))
    if patterns:
        out = F.replace(out, F.lit("  "), F.lit(" "))
    return out


def tokenize(text: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """Lossless tokenisation: ``array_join(tokenize(t), '') == t``."""
    return F.regexp_extract_all(_col(text), F.lit(pattern), 0)


def words(text: Column | str) -> Column:
    """Lower-cased word tokens (used by the hash embedder)."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_PATTERN), 0)


def detokenize(tokens: Column | str) -> Column:
    return F.array_join(_col(tokens), "")


def _window_bounds(lo: Column, hi: Column, mx: int) -> Column:
    """Fixed windows of ``mx`` tokens over positions lo+1..hi (short tail kept)."""
    return F.transform(
        F.sequence(lo + 1, hi, F.lit(mx)),
        lambda w: F.struct(w.alias("s"), F.least(w + (mx - 1), hi).alias("e")),
    )


def _level_bounds(tk: Column, lo: Column, hi: Column, seps: Sequence[str], mx: int) -> Column:
    """Chunk bounds for tokens lo+1..hi (1-based, inclusive), which are known to
    be more than ``mx`` tokens long.

    Pieces end at each occurrence of the first separator (inclusive) and at
    ``hi``. A fold packs pieces into chunks while ``len < mx`` (strict); an
    oversize piece flushes the current chunk and is split by the remaining
    separators on its own. Empty flushes are skipped.
    """
    if not seps:
        return _window_bounds(lo, hi, mx)
    sep, rest = seps[0], tuple(seps[1:])
    ends = F.filter(F.sequence(lo + 1, hi), lambda i: (F.element_at(tk, i) == F.lit(sep)) | (i == hi))
    init = F.struct(
        (lo + 1).alias("st"),
        lo.alias("en"),
        F.array().cast(BOUNDS_TYPE).alias("out"),
    )

    def flushed(acc: Column) -> Column:
        return F.when(
            acc["en"] >= acc["st"],
            F.concat(acc["out"], F.array(F.struct(acc["st"].alias("s"), acc["en"].alias("e")))),
        ).otherwise(acc["out"])

    def merge(acc: Column, x: Column) -> Column:
        big = (x - acc["en"]) > mx
        fits = (x - acc["st"] + 1) < mx
        out = (
            F.when(big, F.concat(flushed(acc), _level_bounds(tk, acc["en"], x, rest, mx)))
            .when(fits, acc["out"])
            .otherwise(flushed(acc))
        )
        st = F.when(big, x + 1).when(fits, acc["st"]).otherwise(acc["en"] + 1)
        return F.struct(st.alias("st"), x.alias("en"), out.alias("out"))

    return F.aggregate(ends, init, merge, flushed)


def chunk_bounds(tokens: Column | str, separators: Sequence[str], max_tokens: int) -> Column:
    """``array<struct<s,e>>`` of 1-based inclusive token bounds of each chunk.

    Hierarchical rules: a text of at most ``max_tokens`` is one chunk; otherwise
    split by the first separator, pack, and recurse into oversize pieces with the
    remaining separators; with none left cut fixed windows. The recursion is
    unrolled here, at plan-build time, because the separator list is known.
    """
    if max_tokens < 1:
        raise ValueError("max_tokens must be positive")
    tk = _col(tokens)
    n = F.size(tk)
    return F.when(
        n <= max_tokens, F.array(F.struct(F.lit(1).alias("s"), n.alias("e")))
    ).otherwise(_level_bounds(tk, F.lit(0), n, tuple(separators), max_tokens))


SEGMENTS_TYPE = "array<struct<s:int,e:int,open:boolean>>"


def _split_segment(tk: Column, seg: Column, sep: Column, mx: Column) -> Column:
    """One level of :func:`_level_bounds` with the separator and maximum as columns:
    the chunks of an open segment in order, its oversize pieces open for the next level."""
    lo, hi = seg["s"] - 1, seg["e"]
    ends = F.filter(F.sequence(lo + 1, hi), lambda i: (F.element_at(tk, i) == sep) | (i == hi))
    init = F.struct((lo + 1).alias("st"), lo.alias("en"), F.array().cast(SEGMENTS_TYPE).alias("out"))

    def one(s: Column, e: Column, is_open: bool) -> Column:
        return F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(is_open).alias("open")))

    def flushed(acc: Column) -> Column:
        return F.when(acc["en"] >= acc["st"], F.concat(acc["out"], one(acc["st"], acc["en"], False))).otherwise(acc["out"])

    def merge(acc: Column, x: Column) -> Column:
        big = (x - acc["en"]) > mx
        fits = (x - acc["st"] + 1) < mx
        out = F.when(big, F.concat(flushed(acc), one(acc["en"] + 1, x, True))).when(fits, acc["out"]).otherwise(flushed(acc))
        st = F.when(big, x + 1).when(fits, acc["st"]).otherwise(acc["en"] + 1)
        return F.struct(st.alias("st"), x.alias("en"), out.alias("out"))

    return F.aggregate(ends, init, merge, flushed)


def chunk_bounds_by(tokens: Column | str, separators: Column | str, max_tokens: Column | str) -> Column:
    """:func:`chunk_bounds` with the separators (an array) and the maximum of each row as
    columns: a fold over the separators splits the segments that are still oversize, level
    by level, so the expression does not grow with the number of separators."""
    tk, mx = _col(tokens), _col(max_tokens)
    n = F.size(tk)
    whole = F.array(F.struct(F.lit(1).alias("s"), n.alias("e"), (n > mx).alias("open")))
    segments = F.aggregate(
        _col(separators), whole.cast(SEGMENTS_TYPE),
        lambda segs, sep: F.flatten(F.transform(
            segs, lambda g: F.when(g["open"], _split_segment(tk, g, sep, mx)).otherwise(F.array(g)))))

    def windows(g: Column) -> Column:
        cut = F.transform(F.sequence(g["s"], g["e"], mx), lambda w: F.struct(w.alias("s"), F.least(w + mx - 1, g["e"]).alias("e")))
        return F.when(g["open"], cut).otherwise(F.array(F.struct(g["s"].alias("s"), g["e"].alias("e"))))

    return F.flatten(F.transform(segments, windows))


def prefilter_by(text: Column | str, patterns: Column | str) -> Column:
    """:func:`prefilter` with the patterns of each row as a column (an array)."""
    pats = _col(patterns)
    out = F.aggregate(pats, _col(text), lambda t, p: F.regexp_replace(t, p, F.lit(" ")))
    return F.when(F.size(pats) > 0, F.replace(out, F.lit("  "), F.lit(" "))).otherwise(out)


def chunk_tokens(tokens: Column | str, separators: Sequence[str], max_tokens: int,
                 post_filter: Sequence[str] = ()) -> Column:
    """``array<array<string>>``: the token lists of the chunks, post-filtered,
    with empty chunks dropped (so positions number the kept chunks)."""
    tk = _col(tokens)
    chunks = F.transform(chunk_bounds(tk, separators, max_tokens),
                         lambda b: F.slice(tk, b["s"], b["e"] - b["s"] + 1))
    if post_filter:
        drop = F.array(*[F.lit(t) for t in post_filter])
        chunks = F.transform(chunks, lambda c: F.filter(c, lambda t: ~F.array_contains(drop, t)))
    return F.filter(chunks, lambda c: F.size(c) > 0)


def fixed_chunk_tokens(tokens: Column | str, max_tokens: int) -> Column:
    """Fixed windows of ``max_tokens`` (the no-separator case on its own)."""
    tk = _col(tokens)
    bounds = F.when(F.size(tk) == 0, F.array().cast(BOUNDS_TYPE)).otherwise(
        _window_bounds(F.lit(0), F.size(tk), max_tokens))
    return F.transform(bounds, lambda b: F.slice(tk, b["s"], b["e"] - b["s"] + 1))


def word_count(text: Column | str) -> Column:
    """Pieces of a split on runs of spaces; leading/trailing empties count."""
    return F.size(F.split(_col(text), "[ ]+", -1))
