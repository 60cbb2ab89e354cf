"""BPE encoding and decoding of a corpus through a table of its distinct words.

A tokenizer's merges never cross a word, so a word's ids are the same wherever it
stands. Texts are split into words once; a block of documents keeps its list of distinct
words and, per document, the words' numbers in that list (the positions). The lists of
all blocks are dealt to groups by a hash of the word, so that a group sees every block's
entry of its words, encodes each distinct word once and sends the ids back to the
blocks, which replace numbers by ids.

A word has at most one entry per block, however often it is used, so a frequent word is
no hot key: it has as many entries as there are blocks, one word in tens of thousands of
a block's list. Groups hold ``GROUP_WORDS`` entries on average, whatever the input.

Decoding joins ids with the vocabulary's pieces. That side is bounded by the tokenizer
file (checked), so it is broadcast and taken from by position, batch by batch.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .packed import Numbers, gather, pack_ints, pack_words, unpack_ints, unpack_words
from .packing import _byte_characters

#: A block ends with the document that reaches one of these bounds.
BLOCK_CHARS = 20 << 20
BLOCK_DOCS = 16_384
#: Entries (block, word) of a group of words, on average.
GROUP_WORDS = 200_000
#: Most pieces of a vocabulary that decoding broadcasts.
MAX_PIECES = 2_000_000
#: First character of a listed word: of the text, or the name of an added token.
ORDINARY, ADDED = "=", "+"
#: The normaliser and the splitting rule that :class:`Words` knows how to do itself
#: (fixed values of that tokenizer); files with others are split by the library.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters that every version of Unicode normalises, lower-cases and classes alike:
#: Latin letters and signs up to U+017F, without the dotted capital I, and common dashes
#: and quotes. Texts that hold any other are split by the library.
PLAIN = [c for c in map(chr, [*range(0, 0x1C), *range(0x20, 0x130), *range(0x131, 0x180)])] + list("–—‘’“”…")


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == kind)


class Words:
    """Splits texts into words as a tokenizer file does, added tokens first."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        self.known = ((spec.get("normalizer") or {}).get("normalizers") == NORMALIZER and len(pre) == 2
                      and (pre[0].get("pattern"), pre[0].get("behavior"), pre[0].get("invert")) == ({"Regex": PATTERN}, "Removed", True)
                      and (pre[1].get("type"), pre[1].get("add_prefix_space"), pre[1].get("use_regex")) == ("ByteLevel", False, False))
        added = spec.get("added_tokens") or []
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that are stripped, whole words or normalised are not supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        letters, numbers = _class("L"), _class("N")
        space = "\t\n\v\f\r \x85\xa0"
        self.strange = re.compile(f"[^{''.join(map(re.escape, PLAIN))}]")
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+").findall
        self.bytes = _byte_characters()
        self.chars = {b: c for c, b in self.bytes.items()}

    def split(self, text: str) -> list[str | tuple[str]]:
        """The words of a text in order; an added token stands as a tuple of its name."""
        if self.added is None or not (parts := self.added.split(text))[1:]:
            return self._plain(text)
        return [w for i, p in enumerate(parts) for w in ([(p,)] if i % 2 else self._plain(p))]

    def _plain(self, text: str) -> list[str]:
        if self.known and not self.strange.search(text):
            return self.find(text.lower())
        if self.tok.normalizer is not None:
            text = self.tok.normalizer.normalize_str(text)
        words = [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)] if self.tok.pre_tokenizer else [text] * bool(text)
        return [bytes(map(self.bytes.__getitem__, w)).decode() for w in words] if self.known else words

    @staticmethod
    def listed(word: str | tuple[str]) -> str:
        return ORDINARY + word if isinstance(word, str) else ADDED + word[0]

    def ids(self, listed: str) -> list[int]:
        """The ids of a listed word."""
        word = listed[1:]
        if listed[0] == ADDED:
            return [self.tok.token_to_id(word)]
        if self.known:
            word = "".join(map(self.chars.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(word)]


_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One splitter per Python worker and file."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def split_blocks(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """One row per block: block, id (of its documents), counts (words per document),
    codes (the words' numbers), words (the block's distinct words, most frequent first,
    numbered from 0), n_words; codes and words are packed."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = words_of(path)
        block = TaskContext.get().partitionId() << 32
        numbers, codes, ids, size = Numbers(), [], [], 0

        def close() -> pa.RecordBatch:
            counts, c = [len(x) for x in codes], np.concatenate(codes)
            codes.clear()
            words = list(numbers)
            order = np.argsort(-np.bincount(c, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words))
            listed = pack_words([splitter.listed(words[i]).encode() for i in order.tolist()])
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([counts], pa.list_(pa.int32())),
                 pa.array([pack_ints(rank[c])], pa.binary()), pa.array([listed], pa.binary()), pa.array([len(words)], pa.int64())],
                ["block", "id", "counts", "codes", "words", "n_words"])

        for b in batches:
            id_type = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                codes.append(np.fromiter(map(numbers.__getitem__, splitter.split(text)), np.uint32))
                ids.append(i)
                size += len(text)
                if size >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield close()
                    block += 1
                    numbers, codes, ids, size = Numbers(), [], [], 0
        if ids:
            yield close()

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"block bigint, id array<{kind}>, counts array<int>, codes binary, words binary, n_words bigint")


def deal_words(blocks: DataFrame, groups: int) -> DataFrame:
    """(grp, block, k, words): each block's list, cut by a hash of the word; k: the steps
    between the words' numbers in the block, which ascend. Both are packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("words")):
                words = unpack_words(raw.as_py())
                if not words:
                    continue
                at = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % groups
                order = np.argsort(at, kind="stable")
                grp, first = np.unique(at[order], return_index=True)
                cut = [order[i:j] for i, j in zip(first.tolist(), [*first[1:].tolist(), len(order)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grp, pa.int64()), pa.array(np.full(len(grp), block), pa.int64()),
                     pa.array([pack_ints(np.diff(k, prepend=0)) for k in cut], pa.binary()),
                     pa.array([pack_words([words[i] for i in k.tolist()]) for k in cut], pa.binary())], ["grp", "block", "k", "words"])

    return blocks.select("block", "words").mapInArrow(run, "grp bigint, block bigint, k binary, words binary")


def encode_words(dealt: DataFrame, path: str) -> DataFrame:
    """(block, k, n, ids) of every row of :func:`deal_words`: n ids for each of its
    words, end to end, packed. A distinct word is encoded once, in its group."""

    def run(t: pa.Table) -> pa.Table:
        w = words_of(path)
        numbers = Numbers()
        rows = [np.fromiter(map(numbers.__getitem__, unpack_words(x.as_py())), np.int64) for x in t["words"]]
        coded = [w.ids(x.decode()) for x in numbers]
        length = np.array([len(x) for x in coded], np.int64)
        flat = np.array([i for x in coded for i in x], np.int64)
        got = [gather(flat, np.cumsum(length) - length, length, r) for r in rows]
        return pa.table({"block": t["block"], "k": t["k"], "n": pa.array([pack_ints(n) for n, _ in got], pa.binary()),
                         "ids": pa.array([pack_ints(i) for _, i in got], pa.binary())})

    return dealt.groupBy("grp").applyInArrow(run, "block bigint, k binary, n binary, ids binary")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every row: the ids that the tokenizer file at ``path``
    gives for the whole text without special tokens around it, as little-endian unsigned
    32-bit integers.

    A null text is empty: no ids. Names of added tokens in a text become those tokens.
    Rows with a null or repeated id are encoded each; an empty table gives no rows;
    other columns are ignored.
    """
    blocks = written(split_blocks(docs, path, id_col, text_col), "word-blocks")
    entries = blocks.agg(F.sum("n_words")).first()[0] or 0
    coded = encode_words(deal_words(blocks, entries // GROUP_WORDS + 1), path)
    rows = blocks.select(F.col("block").alias("of"), "id", "counts", "codes", "n_words")
    kind = docs.schema[id_col].dataType.simpleString()

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        n_words = left["n_words"][0].as_py()
        codes = unpack_ints(left["codes"][0].as_py())
        length, first, flat, at = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64), [], 0
        for k, n, ids in zip(*(right[c] for c in ("k", "n", "ids"))):
            k, n = np.cumsum(unpack_ints(k.as_py()).astype(np.int64)), unpack_ints(n.as_py()).astype(np.int64)
            length[k], first[k] = n, at + np.cumsum(n) - n
            flat.append(unpack_ints(ids.as_py()).astype("<u4"))
            at += len(flat[-1])
        table = np.concatenate(flat) if flat else np.zeros(0, "<u4")
        cuts = np.append(0, np.cumsum(left["counts"].combine_chunks().flatten().to_numpy()))
        ends = np.append(0, np.cumsum(length[codes]))[cuts]
        out, at = np.empty(int(ends[-1]), "<u4"), 0
        for a in range(0, len(codes), 1 << 16):
            ids = gather(table, first, length, codes[a:a + (1 << 16)])[1]
            out[at:at + len(ids)] = ids
            at += len(ids)
        packed = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(4 * ends), pa.py_buffer(out)])
        return pa.table({id_col: left["id"].combine_chunks().flatten(), "n_tokens": pa.array(np.diff(ends), pa.int64()),
                         "ids": packed.cast(pa.binary())})

    return (rows.groupBy("of").cogroup(coded.groupBy("block"))
            .applyInArrow(fill, f"`{id_col}` {kind}, n_tokens bigint, ids binary"))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``: the text of the ids, special tokens included.

    Ids are packed as :func:`encode` packs them; null ids give null, no ids the empty
    text, and ids that the vocabulary lacks are left out, as the library leaves them out.
    A column of ``encoded`` named like ``out_col`` is replaced.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    vocab = tok.get_vocab(with_added_tokens=True)
    if len(vocab) > MAX_PIECES:
        raise ValueError(f"the vocabulary has {len(vocab)} pieces, more than the {MAX_PIECES} that decoding broadcasts")
    names: list[str | None] = [None] * (max(vocab.values(), default=-1) + 2)
    for name, i in vocab.items():
        names[i] = name
    joined = tok.decoder is None  # else the library makes the text of the pieces
    pieces = encoded.sparkSession.sparkContext.broadcast(names)
    kept = [c for c in encoded.columns if c != out_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces.value, pa.large_string())
        space = pa.scalar(" ", pa.large_string())

        def text(raw: bytes | None) -> str | None:
            if raw is None:
                return None
            ids = np.frombuffer(raw, "<u4")
            if not joined:
                return words_of(path).tok.decode(ids.tolist(), skip_special_tokens=False)
            got = table.take(pa.array(np.minimum(ids, len(table) - 1))).drop_null()
            return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(got)], pa.int32()), got), space)[0].as_py()

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = pa.array([text(x.as_py()) for x in part.column(ids_col)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), out], [*kept, out_col])

    return encoded.mapInArrow(run, schema + f", `{out_col}` string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids through :func:`encode`, the
    text back from them through :func:`decode`."""
    return decode(encode(docs, path), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
