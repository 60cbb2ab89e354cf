"""Vector and id expressions (native Spark)."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONTENT_ID_NAMESPACE, HASH_DIMS
from .text import words


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_id(text: Column | str, namespace: str = CONTENT_ID_NAMESPACE) -> Column:
    """UUID version 5 of the UTF-8 text under ``namespace``, as a native
    expression: sha1(namespace bytes || text bytes), version nibble 5,
    RFC 4122 variant bits, 8-4-4-4-12 lower-case hex."""
    ns_hex = uuid.UUID(namespace).hex
    h = F.sha1(F.concat(F.unhex(F.lit(ns_hex)), F.encode(_col(text), "UTF-8")))
    variant = F.lower(F.conv(
        (F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)).cast("string"), 10, 16))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


#: Words that the embedder holds as numbers at a time.
WORDS_AT_ONCE = 1 << 20


def _codes(word: bytes, dims: int) -> tuple[int, float]:
    """Dimension and sign of a word: first 4 hex digits of md5 mod dims, sign from hex
    digit 5 (< 8: +1)."""
    h = hashlib.md5(word, usedforsecurity=False).digest()
    return int.from_bytes(h[:2], "big") % dims, 1.0 if h[2] < 128 else -1.0


def _make_bincount(dims: int):
    @F.arrow_udf("array<float>")
    def bincount(words: pa.Array) -> pa.Array:
        # Arrow in, Arrow out: a Python object for each distinct word of a piece only, and
        # one signed bincount per piece, slot = row * dims + dimension.
        n, flat = len(words), words.flatten()
        ends = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        values = np.zeros((n, dims), np.float32)
        for s in range(0, len(flat), WORDS_AT_ONCE):
            piece = flat.slice(s, WORDS_AT_ONCE).dictionary_encode()
            code = np.array([_codes(w, dims) for w in piece.dictionary.cast(pa.binary()).to_pylist()])[piece.indices.to_numpy()]
            row = np.searchsorted(ends, np.arange(s, s + len(piece)), "right")
            first, last = row[0], row[-1] + 1
            slot = (row - first) * dims + code[:, 0].astype(np.int64)
            values[first:last] += np.bincount(slot, code[:, 1], (last - first) * dims).reshape(-1, dims)
        offsets = pa.array(np.arange(0, (n + 1) * dims, dims, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), type=pa.float32()))

    # Marked nondeterministic only so that Catalyst never copies the UDF into a
    # pushed-down filter (e.g. a dimension check), which would run it twice.
    return bincount.asNondeterministic()


_BINCOUNT: dict[int, object] = {}


def hash_embedding(text: Column | str, dims: int = HASH_DIMS) -> Column:
    """Deterministic integer-valued embedding ``array<float>`` of ``dims``: the sum over the
    lower-cased words of their signs on their dimensions.

    Words are found natively; distinct words are hashed and all counted per Arrow batch."""
    if dims not in _BINCOUNT:
        _BINCOUNT[dims] = _make_bincount(dims)
    return _BINCOUNT[dims](words(_col(text)))


def as_double(v: Column | str) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def display_normalise(v: Column | str) -> Column:
    """Clip to [-1, 1], then ``(x/2 + 0.5)^2 * 255`` per component."""
    return F.transform(as_double(v), lambda x: F.pow(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) / 2 + 0.5, 2) * 255)


def round_half_up(x: Column, places: int) -> Column:
    """Rounding with halves toward +infinity (``floor(x*10^p + 0.5) / 10^p``)."""
    scale = float(10 ** places)
    return F.floor(x * scale + 0.5) / scale
