"""Ranked lexical search by presence masks.

The documents are indexed once, in blocks: a block's terms with their document counts,
and per document its length, terms and frequencies. Queries then run over the blocks, no
document or posting leaves its task, and only the best documents of every task are ranked
at the end.

In a block, the presence bitmaps of a query's terms, laid side by side, give every
document its mask of matched terms. Documents are grouped by mask; a mask's maximum score
is the sum of its terms' largest contributions in the block. Masks are evaluated by
descending maximum, and the query is finished with the block when the next maximum is
below the lowest score kept so far (an equal one may still win by its id). The scores
kept by a task carry over from block to block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written
from .packed import Numbers, gather, pack_ints, pack_words, unpack_ints, unpack_words

#: A block ends with the document that reaches one of these bounds.
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 4096
#: Distinct terms of the queries of one pass over the index, on average.
TERMS_PER_PASS = 200_000
#: Masks are scored one by one or, where they hold few documents, so many documents together.
CHUNK = 64
#: Bytes of a term: digits, letters and everything beyond ASCII; A-Z are lower-cased.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Ranking:
    """top: documents per query; the score's fixed numbers: share of the length in m,
    factor of m, scale of a contribution and of a weight."""

    top: int = 10
    length_share: int = 75
    factor: int = 8
    unit: int = 1000


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TERM_BYTES).split() if text else []


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents: id (of its documents), n (terms per document),
    words and df (the block's terms and their document counts), and per document its
    ``held`` distinct terms' numbers (word) and frequencies (tf); all but id packed."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, n, held, word, tf, size = Numbers(), [], [], [], [], [], 0

        def close() -> pa.RecordBatch:
            every = np.concatenate(word)
            packed = [pack_ints(np.array(n)), pack_words(list(numbers)), pack_ints(np.bincount(every, minlength=len(numbers))),
                      pack_ints(np.array(held)), pack_ints(every), pack_ints(np.concatenate(tf))]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(id_type)), pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64()),
                 *(pa.array([x], pa.binary()) for x in packed)],
                ["id", "n_docs", "n_terms", "n", "words", "df", "held", "word", "tf"])

        for b in batches:
            id_type = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                all_terms = np.fromiter(map(numbers.__getitem__, terms(text)), np.int64)
                w, c = np.unique(all_terms, return_counts=True)
                ids.append(i)
                n.append(len(all_terms))
                held.append(len(w))
                word.append(w.astype(np.uint32))
                tf.append(c.astype(np.uint32))
                size += len(text or "")
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield close()
                    numbers, ids, n, held, word, tf, size = Numbers(), [], [], [], [], [], 0
        if ids:
            yield close()

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id array<{kind}>, n_docs bigint, n_terms bigint, n binary, words binary, df binary, "
                               "held binary, word binary, tf binary")


def document_counts(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df) of the terms of ``wanted`` over all blocks, which read only their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, df in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(unpack_words(words.as_py()), pa.binary()),
                                                  pa.array(unpack_ints(df.as_py()).astype(np.int64))], ["term", "df"])

    rows = index.select("words", "df").mapInArrow(run, "term binary, df bigint")
    return rows.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of the distinct terms of every row of (item, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words, times = np.unique(np.array(terms(text), object), return_counts=True)
            rows += [(item, w, int(c)) for w, c in zip(words.tolist(), times.tolist())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64()))],
                                          ["item", "term", "times"])

    return map_batches(items.select("item", "text"), run, "item bigint, term binary, times bigint")


class Block:
    """A block of the index, cut down to the terms of a set of queries."""

    def __init__(self, row: dict, numbers: dict[bytes, int], n_docs: int, n_terms: int, rank: Ranking):
        self.ids = row["id"]
        local = np.array([numbers.get(w, -1) for w in unpack_words(row["words"])], np.int64)
        word = local[unpack_ints(row["word"])]
        keep = word >= 0
        doc = np.repeat(np.arange(len(self.ids)), unpack_ints(row["held"]))[keep]
        tf = unpack_ints(row["tf"])[keep].astype(np.int64)
        n = unpack_ints(row["n"]).astype(np.int64)
        m = 100 - rank.length_share + (rank.length_share * n * n_docs) // max(1, n_terms)
        self.word = word[keep]
        self.gain = (rank.unit ** 3 * tf) // (rank.unit * tf + rank.factor * m[doc])
        self.held = np.bincount(doc, minlength=len(self.ids))
        self.first = np.cumsum(self.held) - self.held
        order = np.argsort(self.word, kind="stable")
        self.term, start, self.df = np.unique(self.word[order], return_index=True, return_counts=True)
        self.start = start
        self.by_term = doc[order]
        self.most = np.maximum.reduceat(self.gain[order], start) if len(start) else np.zeros(0, np.int64)

    def masks(self, at: np.ndarray) -> np.ndarray:
        """Per document the presence bits of the terms numbered ``at``, eight to a byte."""
        bits = np.zeros((-(-len(at) // 8), len(self.ids)), np.uint8)
        for j, t in enumerate(at.tolist()):
            bits[j >> 3, self.by_term[self.start[t]:self.start[t] + self.df[t]]] |= 1 << (j & 7)
        return np.ascontiguousarray(bits.T)

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of documents that hold a term; ``weight`` is by term number."""
        held, at = gather(np.arange(len(self.word)), self.first, self.held, docs)
        part = weight[self.word[at]] * self.gain[at]
        return np.add.reduceat(part, np.cumsum(held) - held)

    def search(self, query: tuple[np.ndarray, np.ndarray], weight: np.ndarray, kept: list[tuple], top: int) -> tuple[list[tuple], int]:
        """``kept`` (score, id) with this block's best, at most ``top``, and the number
        of documents scored. ``query``: numbers and weights of its terms."""
        at = np.searchsorted(self.term, query[0])
        here = np.flatnonzero(at < len(self.term))
        here = here[self.term[at[here]] == query[0][here]]
        if not len(here):
            return kept, 0
        at, w = at[here], query[1][here]
        masks = self.masks(at)
        docs = np.flatnonzero(masks.any(1))
        one = masks[docs].view(np.dtype((np.void, masks.shape[1]))).ravel()
        distinct, group = np.unique(one, return_inverse=True)
        bits = np.unpackbits(distinct.view(np.uint8).reshape(len(distinct), -1), axis=1, bitorder="little")[:, :len(at)]
        bound = bits @ (w * self.most[at])
        order = np.argsort(-bound, kind="stable")
        size = np.bincount(group)
        members = np.argsort(group, kind="stable")
        first = np.cumsum(size) - size
        weight[query[0]] = query[1]
        done, scored = 0, 0
        while done < len(order) and (len(kept) < top or bound[order[done]] >= kept[-1][0]):
            stop = done + max(1, int(np.searchsorted(np.cumsum(size[order[done:done + CHUNK]]), CHUNK, side="right")))
            _, chosen = gather(docs[members], first, size, order[done:stop])
            got = self.scores(chosen, weight)
            least = max(1, kept[-1][0] if len(kept) == top else 1)
            new = [(s, self.ids[d]) for s, d in zip(got.tolist(), chosen.tolist()) if s >= least]
            kept = sorted(kept + new, key=lambda x: (-x[0], x[1] is None, x[1]))[:top]
            scored += len(chosen)
            done = stop
        weight[query[0]] = 0
        return kept, scored


def search(index: DataFrame, items: DataFrame, id_type: str, item_col: str = "item_id", text_col: str = "text",
           doc_col: str = "doc_id", how: Ranking = Ranking()) -> DataFrame:
    """(item, rank, doc, score): per row of ``items`` the ``top`` documents of the index
    with the highest positive scores, equal scores by ascending id (null last).

    Items without terms and items that match nothing give no rows; rows that repeat an
    item are ranked each. Queries run in passes of about ``TERMS_PER_PASS`` terms, each
    pass broadcasting its own queries only.
    """
    spark = index.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    keyed = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("name"), F.col(text_col).alias("text")),
                    "search-items")
    wanted = written(query_terms(keyed), "search-terms")
    df = written(document_counts(index, wanted), "search-df")
    passes = wanted.count() // TERMS_PER_PASS + 1
    found = None
    for p in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).join(df, "term").orderBy("item", "term").toArrow()
        one = _pass(index, part, n_docs, n_terms, id_type, how)
        found = one if found is None else found.unionByName(one)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= how.top)
    return ranked.join(keyed.select("item", "name"), "item").select(
        F.col("name").cast(kind).alias(item_col), "rank", F.col("doc").alias(doc_col), "score")


def _pass(index: DataFrame, part: pa.Table, n_docs: int, n_terms: int, id_type: str, how: Ranking) -> DataFrame:
    """(item, doc, score): each task's best documents for the queries of ``part``."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(part["term"].to_pylist()))}
    item, number = part["item"].to_numpy(), np.array([numbers[w] for w in part["term"].to_pylist()], np.int64)
    weight = np.array([math.floor(how.unit * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in part["df"].to_pylist()], np.int64)
    weight = weight * part["times"].to_numpy()
    queries = []
    if len(item):
        cuts = np.append(np.flatnonzero(np.diff(item, prepend=item[0] - 1)), len(item))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            use = np.flatnonzero(weight[a:b] > 0) + a  # terms without weight add nothing
            queries.append((int(item[a]), number[use], weight[use]))
    shared = index.sparkSession.sparkContext.broadcast((numbers, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = shared.value
        lookup, kept = np.zeros(len(known), np.int64), [[] for _ in asked]
        for b in batches:
            for k in range(b.num_rows):
                block = Block(b.slice(k, 1).to_pylist()[0], known, n_docs, n_terms, how)
                for q, (_, at, w) in enumerate(asked):
                    kept[q], _ = block.search((at, w), lookup, kept[q], how.top)
        rows = [(asked[q][0], d, s) for q, best in enumerate(kept) for s, d in best]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "doc", "score"), r)) for r in rows], schema=schema)

    id_arrow = index.select(F.col("id").getItem(0).alias("doc")).limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("item", pa.int64()), ("doc", id_arrow), ("score", pa.int64())])
    return index.select("id", "n", "words", "held", "word", "tf").mapInArrow(run, f"item bigint, doc {id_type}, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text",
                   how: Ranking = Ranking()) -> DataFrame:
    """:func:`search` of every row of ``items`` over an index of all rows of ``docs``.

    Null texts and texts without terms match nothing and do not count as documents. Rows
    of ``docs`` that repeat an id are documents each. Empty tables give no rows; columns
    other than the ids and texts are ignored.
    """
    index = written(build_index(docs, id_col, text_col), "search-index")
    return search(index, items, docs.schema[id_col].dataType.simpleString(), item_col, text_col, id_col, how)


def oracle(how: Ranking = Ranking()) -> str:
    """DuckDB SQL for :func:`rank_documents` over the tables documents and benchmark."""
    def words(key: str, table: str) -> str:
        text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"SELECT {key}, unnest(regexp_extract_all({text}, '{TERM}')) AS term FROM (SELECT *, row_number() OVER () AS rid FROM {table})"
    u, s = how.unit, how.length_share
    return f"""
WITH dt AS ({words('rid, doc_id', 'documents')}),
tf AS (SELECT rid, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM dt GROUP BY rid, term),
ln AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
al AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM ln),
q AS (SELECT rid AS item, item_id, term, count(*) AS times FROM ({words('rid, item_id', 'benchmark')}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT item, item_id, term, times * CAST(floor({u} * ln((2 * n_docs + 2) / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
      FROM q JOIN df USING (term), al),
m AS (SELECT rid, {100 - s} + (({s} * n * n_docs) // n_terms) AS m FROM ln, al),
sc AS (SELECT item, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id,
              sum(w * (({u ** 3} * tf) // ({u} * tf + {how.factor} * m)))::BIGINT AS score
       FROM w JOIN tf USING (term) JOIN m USING (rid) GROUP BY item, rid),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
      FROM sc WHERE score > 0)
SELECT * FROM r WHERE rank <= {how.top}
"""
