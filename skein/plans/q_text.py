"""Queries of the text family (cleaning, tokenising, chunking)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions import text as T
from ..operators import segment as SEG
from ..operators import text as ops
from ..sources.tables import table
from . import sqlgen as S
from .catalog import query

# Chunking set-ups used by the queries.
ONE_LEVEL = ChunkConfig(separators=(".",), max_tokens=64, pre_filters=(), post_filter=())
TWO_LEVEL = ChunkConfig(separators=("\n", "."), max_tokens=64, pre_filters=(), post_filter=())
POST_FILTER = ChunkConfig(separators=("\n", "."), max_tokens=64, post_filter=("\n",))
INGEST = ChunkConfig(separators=("\n", ".", " "), max_tokens=255)
FIXED_MAX = 64


def _chunk_oracle(cfg: ChunkConfig) -> str:
    text = S.prefilter("text", cfg.pre_filters) if cfg.pre_filters else "text"
    ctes, name = S.chunk_ctes("documents", "doc_id", text, cfg.separators, cfg.max_tokens, cfg.post_filter)
    return f"WITH RECURSIVE {ctes}\nSELECT doc_id, chunk_no, text, n_tokens FROM {name}"


@query("prefilter", f"SELECT doc_id, {S.prefilter('text')} AS clean FROM documents")
def prefilter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.prefilter(F.col("text")).alias("clean"))


@query("tokenize",
       f"SELECT *, dense_rank() OVER (ORDER BY token)::BIGINT AS token_id FROM ("
       f"SELECT doc_id, (generate_subscripts(tk, 1) - 1)::BIGINT AS pos, unnest(tk) AS token "
       f"FROM (SELECT doc_id, {S.tokens('text')} AS tk FROM documents))")
def tokenize(spark, sf):
    """Tokens with their ids in the corpus vocabulary."""
    rows = ops.token_rows(table(spark, sf, "documents"), ["doc_id"])
    return ops.token_ids(rows, ops.vocabulary(rows, counts=True)).withColumn("pos", F.col("pos").cast("long"))


@query("token_counts",
       f"SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest({S.tokens('text')}) AS token FROM documents) "
       f"GROUP BY token")
def token_counts(spark, sf):
    rows = ops.token_rows(table(spark, sf, "documents"), [])
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("vocabulary",
       f"SELECT token, dense_rank() OVER (ORDER BY token)::BIGINT AS token_id FROM "
       f"(SELECT DISTINCT unnest({S.tokens('text')}) AS token FROM documents)")
def vocabulary(spark, sf):
    return ops.vocabulary(ops.token_rows(table(spark, sf, "documents"), []))


@query("chunk_one_level", _chunk_oracle(ONE_LEVEL))
def chunk_one_level(spark, sf):
    return ops.chunk(table(spark, sf, "documents"), ["doc_id"], ONE_LEVEL, clean_text=False)


@query("chunk_two_level", _chunk_oracle(TWO_LEVEL))
def chunk_two_level(spark, sf):
    return ops.chunk(table(spark, sf, "documents"), ["doc_id"], TWO_LEVEL, clean_text=False)


@query("chunk_fixed",
       f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY w) - 1)::BIGINT AS chunk_no, "
       f"array_to_string(tk[w:w + {FIXED_MAX - 1}], '') AS text, len(tk[w:w + {FIXED_MAX - 1}])::BIGINT AS n_tokens "
       f"FROM (SELECT doc_id, tk, unnest(range(1, len(tk) + 1, {FIXED_MAX})) AS w "
       f"FROM (SELECT doc_id, {S.tokens('text')} AS tk FROM documents))")
def chunk_fixed(spark, sf):
    return ops.chunk_fixed(table(spark, sf, "documents"), ["doc_id"], FIXED_MAX)


@query("post_filter", _chunk_oracle(POST_FILTER))
def post_filter(spark, sf):
    return ops.chunk(table(spark, sf, "documents"), ["doc_id"], POST_FILTER)


def _size_check_oracle(cfg: ChunkConfig) -> str:
    # sizes of all chunks before the post-filter (same CTEs without post-filter)
    raw = ChunkConfig(cfg.separators, cfg.max_tokens, cfg.pre_filters, ())
    text = S.prefilter("text", raw.pre_filters)
    ctes, _ = S.chunk_ctes("documents", "doc_id", text, raw.separators, raw.max_tokens, ())
    return (f"WITH RECURSIVE {ctes}\nSELECT count(*)::BIGINT AS n_chunks, "
            f"count(*) FILTER (WHERE e - s + 1 > {raw.max_tokens})::BIGINT AS n_oversize, "
            f"max(e - s + 1)::BIGINT AS max_tokens FROM c_bounds WHERE e >= s")


@query("chunk_size_check", _size_check_oracle(INGEST))
def chunk_size_check(spark, sf):
    return ops.chunk_size_report(table(spark, sf, "documents"), INGEST)


@query("ingest_chunks", _chunk_oracle(INGEST))
def ingest_chunks(spark, sf):
    return ops.chunk(table(spark, sf, "documents"), ["doc_id"], INGEST)


#: Three memories, each with its own chunk settings.
MEMORIES = {"memory0": INGEST, "memory1": ChunkConfig(separators=(".",), max_tokens=40, pre_filters=(r"[\r\t]",)),
            "memory2": ChunkConfig(separators=(), max_tokens=100, pre_filters=(), post_filter=(",", "."))}


def _by_memory_oracle() -> str:
    ctes, parts = [], []
    for n, (name, cfg) in enumerate(MEMORIES.items()):
        text = S.prefilter("text", cfg.pre_filters) if cfg.pre_filters else "text"
        cte, last = S.chunk_ctes(f"(SELECT * FROM documents WHERE doc_id % 3 = {n})", "doc_id", text, cfg.separators,
                                 cfg.max_tokens, cfg.post_filter, prefix=f"c{n}")
        ctes.append(cte)
        parts.append(f"SELECT doc_id, '{name}' AS memory, chunk_no, text, n_tokens FROM {last}")
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(parts)


@query("chunk_by_memory", _by_memory_oracle())
def chunk_by_memory(spark, sf):
    """Documents of three memories, chunked by the settings of their memory."""
    docs = table(spark, sf, "documents").withColumn("memory", F.concat(F.lit("memory"), F.col("doc_id") % 3))
    return ops.chunk_by_memory(docs, ops.settings_table(spark, MEMORIES), ["doc_id"])


# Pieces of a vocabulary besides whole tokens: their beginnings of these lengths.
PIECES = (1, 2, 4)
_VOCAB_SQL = (
    f"words AS (SELECT DISTINCT unnest({S.tokens('text')}) AS w FROM documents),\n"
    "vocab AS MATERIALIZED (SELECT token, dense_rank() OVER (ORDER BY token)::BIGINT AS token_id FROM ("
    "SELECT w AS token FROM words" + "".join(f" UNION SELECT w[1:{n}] FROM words" for n in PIECES) + "))"
)


def _subword_vocabulary(spark, sf):
    """The documents' tokens and their beginnings, with ids in binary order."""
    words = ops.token_rows(table(spark, sf, "documents"), []).select("token").distinct()
    parts = F.array(F.col("token"), *[F.substring("token", 1, n) for n in PIECES])
    return ops.vocabulary(words.select(F.explode(parts).alias("token")))


@query("vocab_segment",
       f"WITH RECURSIVE {_VOCAB_SQL},\n"
       "turns AS (SELECT conv_id, turn, text FROM conversations),\n"
       "places AS (SELECT conv_id, turn, text, unnest(range(1, len(text) + 1)) AS p FROM turns),\n"
       "sizes AS (SELECT DISTINCT len(token) AS n FROM vocab),\n"
       "best AS MATERIALIZED (SELECT conv_id, turn, p, max(n) AS n FROM places, sizes "
       "WHERE p + n - 1 <= len(text) AND text[p:p + n - 1] IN (SELECT token FROM vocab) GROUP BY ALL),\n"
       "path AS (SELECT conv_id, turn, text, 0 AS pos, 1 AS p FROM turns WHERE len(text) > 0 UNION ALL "
       "SELECT path.conv_id, path.turn, text, pos + 1, path.p + coalesce(best.n, 1) FROM path LEFT JOIN best "
       "ON best.conv_id = path.conv_id AND best.turn = path.turn AND best.p = path.p "
       "WHERE path.p + coalesce(best.n, 1) <= len(text)),\n"
       "cut AS (SELECT path.conv_id, path.turn, pos::BIGINT AS pos, text[path.p:path.p + coalesce(n, 1) - 1] AS token FROM path "
       "LEFT JOIN best ON best.conv_id = path.conv_id AND best.turn = path.turn AND best.p = path.p)\n"
       "SELECT conv_id, turn, pos, cut.token, token_id FROM cut LEFT JOIN vocab ON vocab.token = cut.token")
def vocab_segment(spark, sf):
    """Chat turns cut into the longest pieces of a vocabulary of subwords."""
    cut = SEG.segment(table(spark, sf, "conversations").select("conv_id", "turn", "text"), _subword_vocabulary(spark, sf))
    return cut.select("conv_id", "turn", F.posexplode("tokens").alias("pos", "t")).select(
        "conv_id", "turn", F.col("pos").cast("long").alias("pos"), "t.token", "t.token_id")


@query("token_stats",
       f"SELECT doc_id, len({S.tokens('text')})::BIGINT AS n_tokens, "
       f"len(string_split_regex(text, '[ ]+'))::BIGINT AS n_words, "
       f"round(len({S.tokens('text')}) / len(string_split_regex(text, '[ ]+')), 1) AS tokens_per_word "
       f"FROM documents")
def token_stats(spark, sf):
    return ops.token_stats(table(spark, sf, "documents"), ["doc_id"])
