"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A sequence costs a linear term per token and a quadratic term per piece (attention
within a document). Pieces go, largest cost first, to the sequence with the least
cost so far that still has room (found exactly); only a piece that no sequence has room for
is cut, over the least-cost ones. Packing runs in bounded groups of documents chosen by a hash
of the id, with as many sequences as the group's tokens need, so at most one
sequence per group is padded.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunHash

CAPACITY = 2048
END = 1
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
#: Documents per packing group, on average.
GROUP_DOCS = 3000
#: Splitting pattern of the byte-level vocabulary (a fixed value of that tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteTokenizer:
    """Token ids of a byte-level BPE vocabulary file (read by ``tokenizers``).

    White space joins a word's tokens only as one leading space, so the ids of a run
    " word" do not depend on its neighbours. A chunk of texts is cut into such runs with
    array operations; each run is looked up by a 64-bit hash, and only runs not met
    before are tokenised (by ``tiktoken``, which merges the same ranks faster). Texts
    with rare white space, on which pattern dialects differ, are tokenised whole, and
    texts with names of the file's added tokens between those.
    """

    BOUNDARY = 0xFF  # no byte of UTF-8
    CHUNK = 1 << 20

    def __init__(self, path: str, max_runs: int = 1_500_000):
        import tiktoken
        from tokenizers import Tokenizer

        back = _byte_characters()
        ranks = {}
        file = Tokenizer.from_file(path)
        for token, i in file.get_vocab(with_added_tokens=False).items():
            if all(c in back for c in token):  # others are added tokens
                ranks[bytes(back[c] for c in token)] = i
        ranks = {k: v for k, v in ranks.items() if k != b"<|endoftext|>"}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        added = {t.content: i for i, t in file.get_added_tokens_decoder().items()}
        names = sorted(added, key=len, reverse=True)
        self.added = {n: added[n] for n in names}
        self.names = [n.encode() for n in names]
        self.parts = re.compile("(" + "|".join(map(re.escape, names)) + ")")
        self.newline = self.encoding.encode_ordinary("\n")[0]
        self.max_runs = max_runs
        self.kind = np.zeros(256, np.uint8)
        self.kind[[9, 10, 11, 12, 13, 32]] = 1
        self.kind[self.BOUNDARY] = 2
        self.odd = np.zeros(256, bool)
        self.odd[[0x1C, 0x1D, 0x1E, 0x1F, 0xE1, 0xE2, 0xE3, 0xEF]] = True
        self.hash = RunHash(20)
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.off = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        out: list[np.ndarray] = []
        chunk: list[bytes] = []
        size = 0
        for t in texts:
            raw = t.encode("utf-8", "replace")
            chunk.append(raw)
            size += len(raw)
            if size > self.CHUNK:
                out += self._chunk(chunk)
                chunk, size = [], 0
        return out + (self._chunk(chunk) if chunk else [])

    def _whole(self, raw: bytes) -> np.ndarray:
        if not any(n in raw for n in self.names):
            return np.array([*self.encoding.encode_ordinary(raw.decode()), END], dtype=np.uint32)
        ids: list[int] = []
        for k, part in enumerate(self.parts.split(raw.decode())):
            ids += [self.added[part]] if k % 2 else self.encoding.encode_ordinary(part)
        return np.array([*ids, END], dtype=np.uint32)

    def _chunk(self, raws: list[bytes]) -> list[np.ndarray]:
        end = bytes([self.BOUNDARY])
        joined = end.join(raws) + end
        a = np.frombuffer(joined, np.uint8)
        odd = self.odd[a]
        odd[:-1] |= (a[:-1] == 0xC2) & ((a[1:] == 0x85) | (a[1:] == 0xA0))
        own = {i for i, r in enumerate(raws) if any(n in r for n in self.names)}
        if odd.any() or own:
            ends = np.flatnonzero(a == self.BOUNDARY)
            own |= set(np.searchsorted(ends, np.flatnonzero(odd)).tolist())
            rest = iter(self._chunk([r for i, r in enumerate(raws) if i not in own]) if len(own) < len(raws) else ())
            return [self._whole(r) if i in own else next(rest) for i, r in enumerate(raws)]
        start, stop = self._runs(a)
        h = self.hash(a, start, stop)
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        new = np.ones(len(uniq), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != uniq[inside]
        if new.any():
            if len(self.keys) + int(new.sum()) > self.max_runs:
                self.reset()
                new[:] = True
            self._learn(joined, a, uniq[new], start[first[new]], stop[first[new]])
            at = np.searchsorted(self.keys, uniq)
        at = at[inv]
        n, off = self.len[at], self.off[at]
        total = np.cumsum(n)
        flat = self.pool[np.repeat(off - (total - n), n) + np.arange(int(total[-1]))]
        return np.split(flat, total[a[start] == self.BOUNDARY][:-1])

    def _runs(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs that tile the bytes: a word with one leading space, white space by the
        pattern's rule (all but the last character before a word; all at a text's end),
        and each boundary."""
        kind = self.kind[a]
        cut = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
        rs = np.concatenate(([0], cut))
        re = np.concatenate((cut, [len(a)]))
        rk = kind[rs]
        blank = rk == 1
        before_word = blank & (np.append(rk[1:], 2) == 0)
        space = a[re - 1] == 32
        word = rk == 0
        spaced = word & np.concatenate(([False], (blank & space)[:-1]))
        first = np.zeros(len(a), bool)
        first[rs[rk == 2]] = True
        first[rs[word & ~spaced]] = True
        first[rs[spaced] - 1] = True
        first[rs[blank & ~before_word]] = True
        first[rs[before_word & (re - rs > 1)]] = True
        first[re[before_word & ~space] - 1] = True
        start = np.flatnonzero(first)
        return start, np.append(start[1:], len(a))

    def _learn(self, joined: bytes, a: np.ndarray, keys: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        is_word = self.kind[a[stop - 1]] == 0
        runs = [joined[s:e] for s, e in zip(start[is_word].tolist(), stop[is_word].tolist())]
        # a line feed between two runs is a token of its own
        got = np.array(self.encoding.encode_ordinary(b"\n".join(runs).decode()), dtype=np.uint32)
        breaks = got == self.newline
        if int(breaks.sum()) != max(0, len(runs) - 1):
            raise ValueError("the vocabulary has a token that joins lines")
        n_words = np.diff(np.concatenate(([-1], np.flatnonzero(breaks), [len(got)]))) - 1 if runs else np.zeros(0, np.int64)
        blanks = [joined[s:e] for s, e in zip(start[~is_word].tolist(), stop[~is_word].tolist())]
        rest = [[END] if r[0] == self.BOUNDARY else self.encoding.encode_ordinary(r.decode()) for r in blanks]
        keys = np.concatenate((keys[is_word], keys[~is_word]))
        n = np.concatenate((n_words, np.array([len(x) for x in rest], np.int64))).astype(np.int64)
        ids = [got[~breaks], np.array([i for x in rest for i in x], np.uint32)]
        all_keys = np.concatenate((self.keys, keys))
        order = np.argsort(all_keys, kind="stable")
        self.keys = all_keys[order]
        self.off = np.concatenate((self.off, len(self.pool) + np.cumsum(n) - n))[order]
        self.len = np.concatenate((self.len, n))[order]
        self.pool = np.concatenate((self.pool, *ids))


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer per Python worker: its runs serve all tasks of that worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


def _byte_characters() -> dict[str, int]:
    """Byte of each character in which byte-level vocabularies write it: printable
    Latin-1 characters stand for themselves, the others for 256 onwards in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def cost(tokens: int) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int, int]]]:
    """For each length, its pieces (start, length, sequence, offset).

    There are ceil(total / capacity) sequences. Whole multiples of the capacity fill
    sequences of their own; the remainders follow by descending cost.
    """
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    n_seq = -(-sum(lengths) // capacity)
    seq = 0
    rest = []
    for i, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            out[i].append((k * capacity, capacity, seq, 0))
            seq += 1
        if n % capacity:
            rest.append((i, full * capacity, n % capacity))
    rest.sort(key=lambda x: (-cost(x[2]), x[0]))
    used = dict.fromkeys(range(seq, n_seq), 0)
    open_ = _ByRoom(capacity)
    for s in used:
        open_.put(capacity, 0.0, s)
    for i, start, n in rest:
        while n:
            # the least-cost sequence with room for all that is left, else the least-cost one
            room, c, s = open_.take(n) or open_.take(1)
            m = min(n, room)
            out[i].append((start, m, s, used[s]))
            used[s] += m
            start, n = start + m, n - m
            if room > m:
                open_.put(room - m, c + cost(m), s)
    return out


class _ByRoom:
    """Sequences by remaining room: a heap by cost for each room, and a tree over the
    rooms that holds the least cost of each part, so that the least-cost sequence with at
    least some room is found exactly."""

    NONE = (math.inf, -1)

    def __init__(self, capacity: int):
        self.half = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.half)]
        self.tree = [self.NONE] * (2 * self.half)

    def _refresh(self, room: int) -> None:
        at = room + self.half
        self.tree[at] = self.heaps[room][0] if self.heaps[room] else self.NONE
        while at > 1:
            at >>= 1
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def put(self, room: int, c: float, s: int) -> None:
        heapq.heappush(self.heaps[room], (c, s))
        if self.heaps[room][0] == (c, s):
            self._refresh(room)

    def take(self, least: int) -> tuple[int, float, int] | None:
        """(room, cost, sequence) of the least cost with ``least`` room, taken out."""
        best, where, lo, hi = self.NONE, 0, least + self.half, 2 * self.half
        while lo < hi:
            if lo & 1:
                if self.tree[lo] < best:
                    best, where = self.tree[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if self.tree[hi] < best:
                    best, where = self.tree[hi], hi
            lo, hi = lo >> 1, hi >> 1
        if best == self.NONE:
            return None
        while where < self.half:
            where = 2 * where + (self.tree[2 * where] != best)
        room = where - self.half
        c, s = heapq.heappop(self.heaps[room])
        self._refresh(room)
        return room, c, s


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, with_ids: bool) -> DataFrame:
    """(doc, row, total, start, n, ids, crc) per whole multiple of the capacity and per remainder.
    Only remainders need their ids later, unless ``with_ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        step = 4 * capacity
        for b in batches:
            doc, row, texts = (b.column(i).to_pylist() for i in range(3))
            rows: list[tuple] = []
            size = 0
            for d, r, ids in zip(doc, row, tok.encode([t or "" for t in texts])):
                raw = ids.astype("<u4").tobytes()
                total = len(ids)
                for at in range(0, len(raw), step):
                    piece = raw[at:at + step]
                    keep = with_ids or len(piece) < step
                    rows.append((d, r, total, at // 4, len(piece) // 4, piece if keep else None, zlib.crc32(piece)))
                    size += len(piece) if keep else 0
                if size > 8 << 20:
                    yield _batch(rows, b.schema.field(0).type)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, b.schema.field(0).type)

    kind = docs.schema[id_col].dataType.simpleString()
    # rows of one id are told apart by their text's hash: equal rows get equal pieces
    src = docs.select(F.col(id_col).alias("doc"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc {kind}, row bigint, total bigint, start bigint, n int, ids binary, crc bigint")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
    names = ["doc", "row", "total", "start", "n", "ids", "crc"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, with_ids: bool = True, n_docs: int | None = None) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset) and, with ``with_ids``, ``ids`` (little-endian unsigned 32-bit).

    A document's ids are those of its text (null: empty) and one end id. Sequences
    hold at most ``capacity`` ids, without gaps. Rows that repeat an id are packed
    each; an empty table gives no rows; rows with a null id are packed too.
    """
    n = docs.count() if n_docs is None else n_docs
    groups = max(1, math.ceil(n / GROUP_DOCS))
    pieces = tokenised(docs, tokenizer_path, id_col, text_col, capacity, with_ids)
    # equal rows (same id and text) share a hash, so a counter is not needed: the group is
    # drawn from the row hash and, for many equal rows, from the partition they stand in
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("row", F.spark_partition_id()), F.lit(groups)).cast("int"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              f"sequence_id bigint, offset bigint" + (", ids binary" if with_ids else ""))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "start", "crc"], kind="stable").reset_index(drop=True)
        base = int(pdf["grp"].iloc[0]) << 32
        n, start, ids, crc = pdf["n"].tolist(), pdf["start"].tolist(), pdf["ids"].tolist(), pdf["crc"].tolist()
        doc, total = pdf["doc"].tolist(), pdf["total"].tolist()
        rows = []
        for i, cuts in enumerate(pack(n, capacity)):
            for at, m, s, off in cuts:
                part = None if ids[i] is None else ids[i][4 * at:4 * (at + m)]
                c = crc[i] if m == n[i] else zlib.crc32(part)
                rows.append((doc[i], start[i] + at, m, c, total[i], base + s, off, part))
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        return out if with_ids else out.drop(columns="ids")

    return pieces.groupBy("grp").applyInPandas(place, schema)
