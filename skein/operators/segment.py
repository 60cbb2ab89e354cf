"""Tokenising by a vocabulary table: the longest token of the vocabulary, from left to right.

A text is read from its start; at every place the longest token of the vocabulary that
begins there is taken, and a character at which none begins is a token of its own
without id. So the tokens of a text always join to the text.

Two ways with equal results. A vocabulary of at most ``broadcast_bytes``, measured first,
is sent to the workers. A larger one stays a table, dealt out by how its tokens begin: by
as many characters, two at least, as leave few enough tokens that begin alike. A character
that no longer token has ends every match, so texts are cut there into runs, and each
distinct run is looked up once: every place of it goes, with the characters that a token may
have, to the tokens that begin like it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import unique_subdir
from ..sources.tables import spread

#: What a vocabulary entry costs a worker besides its bytes (string, number, slot).
ENTRY_BYTES = 160
TOKENS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("token_id", T.LongType())]))
_ARROW = pa.list_(pa.struct([("token", pa.string()), ("token_id", pa.int64())]))
#: Places in an Arrow batch on their way to the vocabulary, and places and vocabulary
#: (by :data:`ENTRY_BYTES`) that meet in one group.
PIECES = 20_000
GROUP_PLACES = 500_000
GROUP_BYTES = 4 << 20
#: Characters of text whose tokens a worker holds as Python objects.
TEXT_CHARS = 1 << 18


class VocabularyMatcher:
    """The longest vocabulary token at a place of a text; lengths are tried per first character."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids
        lengths: dict[str, set[int]] = {}
        for t in ids:
            lengths.setdefault(t[0], set()).add(len(t))
        self.lengths = {c: tuple(sorted(v, reverse=True)) for c, v in lengths.items()}

    def segment(self, text: str) -> list[dict]:
        out, at = [], 0
        while at < len(text):
            token, number = text[at], None
            for n in self.lengths.get(token, ()):
                number = self.ids.get(text[at:at + n])
                if number is not None:
                    token = text[at:at + n]
                    break
            out.append({"token": token, "token_id": number})
            at += len(token)
        return out


def vocabulary_table(vocab: DataFrame, token_col: str = "token", id_col: str = "token_id") -> DataFrame:
    """(token, token_id) of a vocabulary: empty and null tokens and null ids do not count,
    a token with several ids has the least."""
    return (vocab.select(F.col(token_col).alias("token"), F.col(id_col).cast("long").alias("token_id"))
            .where((F.length("token") > 0) & F.col("token_id").isNotNull())
            .groupBy("token").agg(F.min("token_id").alias("token_id")))


def segment(df: DataFrame, vocab: DataFrame, text_col: str = "text", out_col: str = "tokens",
            token_col: str = "token", id_col: str = "token_id", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with ``out_col``, an array of (token, token_id) of its texts, null for a null
    text, empty for an empty one. Repeated rows and other columns stay as they are; a column
    named ``out_col`` is replaced. An empty vocabulary gives single characters without ids.
    """
    df = df.drop(out_col)
    table = vocabulary_table(vocab, token_col, id_col)
    size = table.agg(F.coalesce(F.sum(F.octet_length("token") + F.lit(ENTRY_BYTES)), F.lit(0)).alias("n")).first().n
    if size <= broadcast_bytes:
        return _by_matcher(spread(df), table, text_col, out_col)
    return _by_join(df, table, text_col, out_col, 16 + size // GROUP_BYTES)


def _by_matcher(df: DataFrame, table: DataFrame, text_col: str, out_col: str) -> DataFrame:
    ids = {r.token: r.token_id for r in table.collect()}  # at most broadcast_bytes
    sent = df.sparkSession.sparkContext.broadcast(VocabularyMatcher(ids))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = sent.value
        for b in _few(batches, at):
            tokens = [None if t is None else match.segment(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, _ARROW)], [*b.schema.names, out_col])

    return df.mapInArrow(run, _schema(df, out_col))


def _few(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a piece have about ``TEXT_CHARS`` characters."""
    for b in batches:
        if not b.num_rows:
            yield b
            continue
        chars = np.cumsum(pc.fill_null(pc.utf8_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
        piece = chars // TEXT_CHARS
        ends = np.append(np.flatnonzero(np.diff(piece)) + 1, b.num_rows).tolist()
        for start, end in zip([0, *ends], ends):
            yield b.slice(start, end - start)


def _schema(df: DataFrame, out_col: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(out_col, TOKENS)])


def _free(base: str, taken: list[str]) -> str:
    while base.lower() in {c.lower() for c in taken}:
        base += "_"
    return base


def _by_join(df: DataFrame, table: DataFrame, text_col: str, out_col: str, buckets: int) -> DataFrame:
    """The rows are numbered and written once. Their distinct runs are cut and joined back.
    Tokens of one character need no exchange: there are no more of them than characters."""
    spark = df.sparkSession
    number, cuts = _free("__row", df.columns), _free("__cuts", df.columns)
    path = unique_subdir(spark, "segment")
    df.withColumn(number, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    path = unique_subdir(spark, "segment-vocabulary")  # read several times
    table.write.parquet(path)
    table = spark.read.schema(table.schema).parquet(path)
    singles = {r.token: r.token_id for r in table.where(F.length("token") == 1).collect()}
    inside = table.where(F.length("token") > 1).select(F.explode(F.split("token", "")).alias("c")).where("c <> ''").distinct().collect()
    run = re.compile("[" + "".join(re.escape(r.c) for r in inside) + "]{2,}" if inside else "(?!)")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, 1):
            found = [(row, m.start(), m.group()) for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                     for m in run.finditer(text)]
            for s in range(0, len(found), PIECES):
                row, at, text = zip(*found[s:s + PIECES])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row, pa.int64()), pa.array(at, pa.int32()), pa.array(text, pa.string())], ["row", "at", "run"])

    found = (spread(rows.select(number, text_col).where(F.length(text_col) > 1))
             .mapInArrow(runs, "row long, at int, run string"))
    known = _cut(found.select("run").distinct(), table, singles, buckets)
    found = found.join(known, "run").groupBy(F.col("row").alias(number)).agg(
        F.collect_list(F.struct("at", "tokens")).alias(cuts))
    joined = rows.join(found, number, "left").select(*df.columns, cuts)
    names = df.columns
    text_at = names.index(text_col)

    def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, text_at):
            found = b.column(len(names))
            ends = np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            places, cut = found.flatten().flatten()
            first = [0, *np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False)).tolist()]
            places, (strings, numbers) = places.to_pylist(), (c.to_pylist() for c in cut.flatten().flatten())
            tokens: list[str] = []
            ids: list[int | None] = []
            sizes, texts = [0], b.column(text_at)

            def between(rest: str) -> None:
                tokens.extend(rest)
                ids.extend(map(singles.get, rest))

            for text, start, end in zip(texts.to_pylist(), [0, *ends], ends):
                at = 0
                for k in sorted(range(start, end), key=places.__getitem__):
                    between(text[at:places[k]])
                    run = strings[first[k]:first[k + 1]]
                    tokens += run
                    ids += numbers[first[k]:first[k + 1]]
                    at = places[k] + sum(map(len, run))
                between((text or "")[at:])
                sizes.append(len(tokens))
            out = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(ids, pa.int64())], fields=list(_ARROW.value_type))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), out, type=_ARROW, mask=texts.is_null())], [*names, out_col])

    return joined.mapInArrow(run_rows, _schema(df, out_col))


def _split(tokens: DataFrame, most: int) -> set[str]:
    """The beginnings, of two characters and more, of more than ``most`` tokens each. Of one
    length there are at most the vocabulary's size / ``most``."""
    out: set[str] = set()
    level = {r.p for r in tokens.groupBy(F.substring("token", 1, 2).alias("p")).count().where(F.col("count") > most).collect()}
    spark, n = tokens.sparkSession, 2
    while level:
        out |= level
        longer = F.broadcast(spark.createDataFrame([(p,) for p in sorted(level)], "p string"))
        under = tokens.where(F.length("token") > n).join(longer, F.substring("token", 1, n) == F.col("p"), "left_semi")
        n += 1
        level = {r.p for r in under.groupBy(F.substring("token", 1, n).alias("p")).count().where(F.col("count") > most).collect()}
    return out


def _depth(text: str, split: set[str], at: int = 0) -> int:
    """How many characters of ``text[at:]`` say where it is looked up; 0 if it ends before."""
    n = 2
    while text[at:at + n] in split:
        n += 1
        if at + n > len(text):
            return 0
    return n


def _cut(runs: DataFrame, table: DataFrame, singles: dict[str, int], buckets: int) -> DataFrame:
    """(run, tokens) of distinct runs. Places and tokens meet in buckets of beginnings; where
    a bucket has many places, they are dealt out over several copies of its tokens. A token
    that is itself a beginning of too many is no longer than those few, and goes with the runs."""
    spark = runs.sparkSession
    path = unique_subdir(spark, "segment-runs")
    runs.withColumn("number", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    texts = rows.select("number", "run")
    long = table.where(F.length("token") > 1)
    split = _split(long, max(1, GROUP_BYTES // ENTRY_BYTES))
    begins = F.broadcast(spark.createDataFrame([(p,) for p in sorted(split)], "p string"))
    inner = {r.token: r.token_id for r in long.join(begins, F.col("token") == F.col("p"), "left_semi").collect()}
    inner_lengths = sorted({len(t) for t in inner}, reverse=True)
    # ints on both sides of the exchange
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("bucket")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begins = [(t[:n] if (n := _depth(t, split)) else None) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(begins, pa.string()), *b.columns], ["begin", "token", "token_id"])

    tokens = (long.select("token", "token_id").mapInArrow(begin, "begin string, token string, token_id long")
              .where("begin IS NOT NULL").select(bucket("begin"), "token", "token_id"))
    path = unique_subdir(spark, "segment-tokens")
    tokens.write.parquet(path)
    tokens = spark.read.schema(tokens.schema).parquet(path)
    longest = long.agg(F.max(F.length("token")).alias("n")).first().n or 0

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, 1):
            seen: Counter[str] = Counter()
            for text in b.column(1).to_pylist():
                for place in range(len(text) - 1):
                    n = _depth(text, split, place)
                    if n:
                        seen[text[place:place + n]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["begin", "n"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str, str]] = []

        def emit() -> pa.RecordBatch:
            row, place, begin, window = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array(begin, pa.string()),
                                               pa.array(window, pa.string())], ["row", "place", "begin", "window"])

        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for place in range(len(text) - 1):
                    n = _depth(text, split, place)
                    if n:
                        held.append((row, place, text[place:place + n], text[place:place + longest]))
                    if len(held) >= PIECES:
                        yield emit()
                        held = []
        if held:
            yield emit()

    # one row a bucket: the length of its longest token, and copies of its tokens
    asked = spread(texts).mapInArrow(beginnings, "begin string, n long").groupBy(bucket("begin")).agg(F.sum("n").alias("places"))
    sizes = F.broadcast(tokens.groupBy("bucket").agg(F.max(F.length("token")).alias("longest")).join(asked, "bucket").select(
        "bucket", "longest", F.ceil(F.col("places") / GROUP_PLACES).cast("int").alias("copies")))
    places = (spread(texts).mapInArrow(windows, "row long, place int, begin string, window string").withColumn("bucket", bucket("begin"))
              .join(sizes, "bucket").select(
                  "bucket", F.pmod(F.xxhash64("row", "place"), "copies").cast("int").alias("copy"),
                  "row", "place", F.expr("substring(window, 1, longest)").alias("window")))
    dealt = tokens.join(sizes, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "token", "token_id")

    def match(asked: pa.Table, known: pa.Table) -> pa.Table:
        ids = dict(zip(known.column("token").to_pylist(), known.column("token_id").to_pylist()))
        lengths: dict[str, set[int]] = {}
        for t in ids:
            lengths.setdefault(t[:2], set()).add(len(t))
        tried = {c: tuple(sorted(v, reverse=True)) for c, v in lengths.items()}
        at, size, found = [], [], []
        for i, window in enumerate(asked.column("window").to_pylist()):
            for n in tried.get(window[:2], ()):
                number = ids.get(window[:n]) if n <= len(window) else None
                if number is not None:
                    at.append(i)
                    size.append(n)
                    found.append(number)
                    break
        hits = asked.select(["row", "place"]).take(pa.array(at, pa.int64()))
        return pa.table([*hits.columns, pa.array(size, pa.int32()), pa.array(found, pa.int64())], names=["row", "place", "n", "token_id"])

    found = (places.groupBy("bucket", "copy").cogroup(dealt.groupBy("bucket", "copy"))
             .applyInArrow(match, "row long, place int, n int, token_id long")
             .groupBy(F.col("row").alias("number")).agg(F.collect_list(F.struct("place", "n", "token_id")).alias("matches")))
    joined = rows.join(found, "number", "left").select("run", "matches")

    def walk(text: str, matches: list[dict] | None) -> list[dict]:
        best = {m["place"]: m for m in matches or ()}
        out, at = [], 0
        while at < len(text):
            m = best.get(at)
            if m:
                n, number = m["n"], m["token_id"]
            else:
                n = next((n for n in inner_lengths if text[at:at + n] in inner and at + n <= len(text)), 1)
                number = inner[text[at:at + n]] if n > 1 else singles.get(text[at])
            out.append({"token": text[at:at + n], "token_id": number})
            at += n
        return out

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, 0):
            tokens = [walk(t, m) for t, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, _ARROW)], ["run", "tokens"])

    return joined.mapInArrow(walked, T.StructType([T.StructField("run", T.StringType()), T.StructField("tokens", TOKENS)]))


def not_single(strings: Sequence[str], vocab: DataFrame, token_col: str = "token") -> list[str]:
    """Those of ``strings`` that are not one token of the vocabulary: neither in it nor a
    single character. Only tokens equal to one of the strings reach the driver."""
    known = {r[0] for r in vocab.select(token_col).where(F.col(token_col).isin(list(strings))).distinct().collect()}
    return [s for s in strings if not s or (len(s) > 1 and s not in known)]
