"""Compact columns for rows that stand for a block of documents: packed integers and words."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

SEPARATOR = b"\xff"


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def pack_ints(a: np.ndarray) -> bytes:
    """Non-negative integers, byte plane by byte plane (high bytes repeat), compressed."""
    w = 1 if not len(a) or a.max() < 1 << 8 else 2 if a.max() < 1 << 16 else 4
    planes = a.astype(f"<u{w}").view(np.uint8).reshape(-1, w).T.tobytes()
    return struct.pack("<BQ", w, len(a)) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack_ints(raw: bytes) -> np.ndarray:
    w, n = struct.unpack_from("<BQ", raw)
    if not n:
        return np.zeros(0, np.int64)
    planes = pa.decompress(raw[9:], decompressed_size=n * w, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(w, n).T.copy().view(f"<u{w}").ravel()


def pack_words(words: list[bytes]) -> bytes:
    """Words end to end; no byte of UTF-8 equals the separator."""
    raw = b"".join(w + SEPARATOR for w in words)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_words(raw: bytes) -> list[bytes]:
    n, = struct.unpack_from("<Q", raw)
    return pa.decompress(raw[8:], decompressed_size=n, codec="zstd", asbytes=True).split(SEPARATOR)[:-1] if n else []


def gather(flat: np.ndarray, first: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[first : first + length]`` numbered by ``which``, end to end, and their lengths."""
    n = length[which]
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    return n, flat[np.repeat(first[which] - (end - n), n) + np.arange(total)]
